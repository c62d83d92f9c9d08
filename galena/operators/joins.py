"""Joins beyond the built-in ones. None uses an OR condition, which would become a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that are paired under one join key.
PAIR_BLOCK = 500
#: Rows of a key from which on it is joined apart, up to how many such keys are broadcast, and the parts of such a key otherwise.
HOT_ROWS, HOT_KEYS, SALTS = 1_000, 100_000, 32


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` to the one row that ``table`` has for a key; ``n`` (a column of it) tells how many of ``rows`` have the key.

    Rows of a hot key never meet in one task: hot keys are broadcast if there are at most HOT_KEYS (no more than rows /
    HOT_ROWS can be), else joined in SALTS parts. ``table`` is read twice.
    """
    hot, other = table.where(F.col(n) > HOT_ROWS), table.where(F.col(n) <= HOT_ROWS)
    n_hot = hot.count()
    if not n_hot:
        return rows.join(table, key)
    if n_hot > HOT_KEYS:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
        parts = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", salt).join(parts, [key, "__salt"]).drop("__salt")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(other, key).unionByName(rows.join(F.broadcast(hot), key))


def lateral_top1(left: DataFrame, right: DataFrame, on: str, order_by: list[Column]) -> DataFrame:
    """Each left row with the first right row of its key, or nulls."""
    rank = F.row_number().over(Window.partitionBy(on).orderBy(*order_by))
    return left.join(right.withColumn("__rank", rank).where("__rank = 1").drop("__rank"), on, "left")


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Rows that match on any of the pairs, once for each of ``keys``: a union of equi joins."""
    parts = [left.join(right, F.col(a) == F.col(b)) for a, b in pairs]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(keys)


def inherit_with_override(own: DataFrame, inherited: DataFrame, keys: list[str]) -> DataFrame:
    """Own rows, and inherited rows of the keys that have none."""
    return own.unionByName(inherited.join(own.select(*keys).distinct(), keys, "left_anti"))


def pairs_within_group(df: DataFrame, group: str, id: str, max_group: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (left < right) of ids in a group, and the groups that are too large to be paired.

    Every group is paired unless ``max_group`` is given. A group above ``PAIR_BLOCK`` rows is dealt into
    blocks by the hash of the id, and each pair of blocks is a join key of its own, so that no task holds
    a whole group. The broadcast table lists only such groups: at most rows / ``PAIR_BLOCK``.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    fits = F.lit(True) if max_group is None else F.col("__n") <= max_group
    kept = df if max_group is None else df.join(sizes.where(fits).select(group), group)
    split = sizes.where(fits & (F.col("__n") > PAIR_BLOCK)).select(group, F.ceil(F.col("__n") / PAIR_BLOCK).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = kept.join(F.broadcast(split), group, "left").withColumn("__parts", parts).withColumn("__own", F.pmod(F.xxhash64(id), F.col("__parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))

    def side(name: str, own: str, other: str) -> DataFrame:
        return dealt.select(*[F.col(c).alias(f"{name}_{c}" if c != group else c) for c in df.columns], F.col("__own").alias(own), each.alias(other))

    pairs = side("left", "__a", "__b").join(side("right", "__b", "__a"), [group, "__a", "__b"]).drop("__a", "__b")
    return pairs.where(F.col(f"left_{id}") < F.col(f"right_{id}")), sizes.where(~fits).withColumnRenamed("__n", "size")


def expand_quantity(df: DataFrame, quantity: str, first_only: list[str]) -> DataFrame:
    """A row for each unit; columns of ``first_only`` stay with the first one."""
    rows = df.withColumn("unit", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce(quantity, F.lit(1)), F.lit(1)))))
    return rows.withColumns({c: F.when(F.col("unit") == 1, F.col(c)) for c in first_only})


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key and status: added, removed, changed or same."""
    a, b = (df.select(F.col(key).alias(f"__{n}"), F.struct(*compare).alias(f"__v{n}")) for df, n in ((before, "a"), (after, "b")))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__va").eqNullSafe(F.col("__vb")), "changed").otherwise("same")
    return both.select(F.coalesce("__a", "__b").alias(key), status.alias("status"))


def unique_match_join(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Left rows joined where exactly one right row has the key; keys with several matches."""
    n = right.groupBy(on).agg(F.count("*").alias("__n"))
    one = right.join(n.where("__n = 1").select(on), on, "left_semi")
    return left.join(one, on), left.join(n.where("__n > 1"), on, "left_semi").select(on).distinct()


def preference_join(left: DataFrame, right: DataFrame, on: str, preferences: list[Column], ties: list[Column]) -> DataFrame:
    """Each left row with the right row that meets the earliest preference, then by ``ties``."""
    rank = reduce(lambda acc, p: acc.when(p[1], p[0]), list(enumerate(preferences))[1:], F.when(preferences[0], 0)).otherwise(len(preferences))
    joined = left.join(right, on, "left").withColumn("__preference", rank)
    w = Window.partitionBy(*left.columns).orderBy("__preference", *ties)
    return joined.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def validated_join(observed: DataFrame, local: DataFrame, id: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Observations whose value equals the local one of their id, and the rejected rest."""
    return observed.join(local, [id, value]), observed.join(local, [id, value], "left_anti")
