"""Snapshots with a tree of digests, so that two of them are compared by reading only what differs.

Rows are dealt into leaves by a range or a hash of their key. The digest of a leaf is made of two independent sums of row hashes and a count, so it
doesn't depend on the order of rows, and the digest of a node is that of all rows below it. Comparing starts at the top and goes down
only where digests differ; a stored snapshot has a folder for each leaf, and only differing leaves are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators.joins import snapshot_diff

FANOUT = 16
LEAVES = FANOUT**3


def leaf_of(key: Column, leaves: int = LEAVES, width: int | None = None) -> Column:
    """The leaf of a key: of ``width`` consecutive whole numbers (any number of leaves), or one of ``leaves`` by its hash."""
    return F.floor(key / width).cast("long") if width else F.pmod(F.xxhash64(key), F.lit(leaves))


def digest_tree(df: DataFrame, facts: list[str], levels: int = 4) -> DataFrame:
    """(level, node, n, a, b) of the nodes over ``df``, which has ``leaf``: level 0 are the leaves, each level above has a FANOUT-th of them."""
    rows = df.select("leaf", F.xxhash64(F.lit(1), *facts).cast("decimal(20,0)").alias("a"), F.xxhash64(F.lit(2), *facts).cast("decimal(20,0)").alias("b"))
    leaves = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    each = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "*")
    node = F.floor(F.col("leaf") / F.pow(F.lit(FANOUT), "level")).cast("long")
    return each.groupBy("level", node.alias("node")).agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")))


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """leaf of each leaf that is not the same in both trees. Below a node that is the same, nothing is compared."""
    top = before.unionByName(after).agg(F.max("level")).first()[0]
    open_ = None
    for level in range(top or 0, -1, -1):
        a, b = (t.where(F.col("level") == level).drop("level") for t in (before, after))
        if open_ is not None:
            parent = F.floor(F.col("node") / FANOUT).cast("long")
            a, b = (t.join(open_.withColumnRenamed("node", "parent"), parent == F.col("parent"), "left_semi") for t in (a, b))
        open_ = a.unionByName(b).groupBy("node").agg(F.count("*").alias("k"), *(F.count_distinct(c).alias(c) for c in ("n", "a", "b"))).where("k < 2 OR n > 1 OR a > 1 OR b > 1").select("node")
    return open_.withColumnRenamed("node", "leaf")


def store(df: DataFrame, at: str, key: str, facts: list[str], leaves: int = LEAVES, width: int | None = None) -> None:
    """Write a snapshot: its rows by leaf, and its tree."""
    rows = df.withColumn("leaf", leaf_of(F.col(key), leaves, width))
    rows.repartition("leaf").write.partitionBy("leaf").parquet(f"{at}/rows")
    kept = df.sparkSession.read.schema(rows.schema).parquet(f"{at}/rows")
    digest_tree(kept, [key, *facts]).write.parquet(f"{at}/tree")


def stored_diff(spark: SparkSession, before: str, after: str, key: str, facts: list[str]) -> DataFrame:
    """key and status (added, removed, changed) of what differs between two stored snapshots that were dealt alike."""
    leaves = differing_leaves(*(spark.read.parquet(f"{at}/tree") for at in (before, after)))

    def differing(at: str) -> DataFrame:
        # A join on the folders' column: folders without a differing leaf are pruned while the query runs.
        return spark.read.parquet(f"{at}/rows").join(F.broadcast(leaves), "leaf", "left_semi").select(key, *facts)

    return snapshot_diff(differing(before), differing(after), key, facts).where("status <> 'same'")
