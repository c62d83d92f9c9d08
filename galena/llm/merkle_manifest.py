"""A Merkle manifest of a dataset, and proofs that a recursive query climbs from every leaf.

A row of the table is a leaf, the leaves of a source are a tree in the order of their ids, and the subroots
of the sources, by source, are the leaves of a tree above. A node is the digest of up to ``fanout``
consecutive ones. The levels are built one after the other and kept as one table of nodes: the digests of
a node's children, and a link to its parent.

Leaves climb by a recursive query over that table. The leaves below one node go together as a row of
slots, as all they meet above it is the same: each step joins the node that is next, puts what was folded
so far into its slot, digests anew, and appends the siblings to the path. A node far up is met by many
rows, so it is kept once for each ``SHARE`` leaves below it, and rows are dealt out over these copies.

Positions come from a range partitioning of narrow rows: each range is counted, and a row's position is
its number within the range and source plus the rows of the source in ranges before. No task holds a
source. Digests are held as 32 bytes and hashed as hex text.

Defined results: a null column is hashed as ``-`` and null is a source of its own; null ids come first;
rows with the same id follow each other by digest, repeated rows are leaves of their own; a row without an
id is never tampered with; a source of one leaf has that leaf as subroot, and a lone subroot is the root;
without siblings the proof is the digest of an empty text; an empty table gives an empty result; columns
other than those hashed are not read.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.common import cut

FANOUT = 16
#: Leaves below a node for which one copy of it is kept.
SHARE = 1 << 14
#: Rows whose id's crc32 this divides are tampered with.
TAMPERED = 5
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
WIDTH = 32
#: The tree of the subroots, beside the trees of the sources, which are numbered from 0.
TOP = -1


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """doc_id, source, leaf, and forged: the digest after tampering, null where there was none."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    before = F.concat(*(field(docs[c]) for c in COLUMNS[:-1]))
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % tampered == 0
    return docs.select("doc_id", "source", digest(F.concat(before, field(docs["text"]))).alias("leaf"), F.when(chosen, digest(F.concat(before, field(lower)))).alias("forged"))


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in ranges of (by, order), with range and row; and a row for each range and ``by``: n, and start, the rows of the same ``by`` in ranges before."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    in_order = [F.col(c).asc_nulls_first() for c in [*by, *order, "row"]]
    out = cut(numbered.repartitionByRange(*in_order).withColumn("range", F.spark_partition_id()))
    counts = out.groupBy("range", *by).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return out, cut(counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def placed(rows: DataFrame, starts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """place: position of a row among those of the same ``by``, from 0. Other columns of ``starts`` come along."""
    within = Window.partitionBy("range", *by).orderBy(*(F.col(c).asc_nulls_first() for c in order), "row")
    same = functools.reduce(operator.and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ["range", *by]])
    joined = rows.withColumn("at", F.row_number().over(within)).alias("r").join(starts.alias("s"), same)
    more = [f"s.{c}" for c in starts.columns if c not in ("range", "start", *by)]
    return joined.select(*(f"r.{c}" for c in rows.columns if c not in ("range", "row")), *more, (F.col("s.start") + F.col("r.at") - 1).alias("place"))


def levels(lowest: DataFrame, fanout: int) -> DataFrame:
    """The nodes above rows of tree, count (rows of the tree), place, digest, below (leaves under it).

    A node: tree, level (from 1), place, kids (digests of its children, one after the other), digest, below, last (whether it is the only one left).
    """
    built: list[DataFrame] = []
    while True:
        kid = F.struct("place", "digest", "below")
        groups = lowest.where("count > 1").groupBy("tree", F.expr(f"place div {fanout}").alias("place")).agg(F.array_sort(F.collect_list(kid)).alias("all"), F.first("count").alias("count"))
        nodes = groups.select(
            "tree",
            F.lit(len(built) + 1).alias("level"),
            "place",
            F.aggregate("all", F.lit(b""), lambda a, k: F.concat(a, k["digest"])).alias("kids"),
            F.aggregate("all", F.lit(0).cast("long"), lambda a, k: a + k["below"]).alias("below"),
            F.ceil(F.col("count") / fanout).alias("count"),
        )
        built.append(cut(nodes.withColumn("digest", digest(F.lower(F.hex("kids"))))))
        lowest = built[-1]
        if lowest.isEmpty():
            return functools.reduce(DataFrame.unionByName, built).withColumn("last", F.col("count") == 1).drop("count")


def above(tree: str | Column, level: str | Column, place: Column, alone: Column, n_sources: int, fanout: int) -> list[Column]:
    """Tree, level, place and slot of the node that takes up what is at ``place``; ``alone``: whether it is all that its tree has."""
    top = F.when((F.col("tree") != TOP) & (n_sources > 1), F.lit(TOP).cast("long"))
    position = F.when(alone, F.col("tree")).otherwise(place)
    up = F.when(alone, top).otherwise(F.col("tree"))
    there = [up, F.when(alone, F.lit(1)).otherwise(F.lit(level) + 1), F.floor(position / fanout), F.pmod(position, F.lit(fanout)).cast("int")]
    return [F.when(up.isNotNull(), c).alias(f"up_{name}") for name, c in zip(("tree", "level", "place", "slot"), there, strict=True)]


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: int = TAMPERED, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Units of leaves, and the nodes that they climb.

    A unit: up_tree, up_level, up_place (the node that its leaves are children of, null if there is none), up_shares, and slots: doc_id, slot,
    leaf, folded (what goes into the node above, at first the tampered digest or the leaf).
    A node: tree, level, place, share, kids, digest, and the same link to the node above, with up_slot.
    """
    rows, starts = dealt(cut(leaves(docs, tampered)), ["source"], ["doc_id", "leaf"])
    names, ranges = dealt(starts.groupBy("source").agg(F.sum("n").alias("count")), [], ["source"])
    sources = cut(placed(names, ranges.drop("n"), [], ["source"]).withColumnRenamed("place", "tree"))
    n_sources = sources.count()
    # A range has few sources and a source few ranges, so rows of a large source stay apart.
    starts = starts.drop("n").alias("s").join(sources.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source"))).select("s.*", "o.tree", "o.count")
    rows = cut(placed(rows, starts, ["source"], ["doc_id", "leaf"]).withColumn("below", F.lit(1).cast("long")))
    low = levels(rows.select("tree", "count", "place", F.col("leaf").alias("digest"), "below"), fanout)
    subroots = low.where("last").select("tree", "digest", "below").unionByName(rows.where("count = 1").select("tree", F.col("leaf").alias("digest"), "below"))
    high = levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_sources).alias("count"), F.col("tree").alias("place"), "digest", "below"), fanout)
    nodes = low.unionByName(high)
    sizes = nodes.select(*(F.col(c).alias(f"up_{c}") for c in ("tree", "level", "place")), F.ceil(F.col("below") / share).cast("int").alias("up_shares"))
    link = ["up_tree", "up_level", "up_place"]
    nodes = nodes.select("*", *above("tree", F.col("level"), F.col("place"), F.col("last"), n_sources, fanout)).join(sizes, link, "left")
    copies = F.explode(F.sequence(F.lit(0), F.ceil(F.col("below") / share).cast("int") - 1)).alias("share")
    nodes = cut(nodes.select("tree", "level", "place", copies, "kids", "digest", *link, "up_slot", "up_shares"))
    own = rows.select("*", *above("tree", F.lit(0), F.col("place"), F.col("count") == 1, n_sources, fanout))
    slots = own.groupBy(link).agg(F.collect_list(F.struct("doc_id", F.col("up_slot").alias("slot"), "leaf", F.coalesce("forged", "leaf").alias("folded"))).alias("slots"))
    return slots.join(sizes, link, "left"), nodes


#: Others than slot ``s`` of the digests in ``kids``.
OTHERS = f"concat(substring({{kids}}, 1, {{s}} * {WIDTH}), substring({{kids}}, ({{s}} + 1) * {WIDTH} + 1))"
CLIMB = f"""
    WITH RECURSIVE climb AS (
        SELECT monotonically_increasing_id() AS unit, slots, CAST(NULL AS BINARY) AS kids, X'' AS path, CAST(NULL AS BINARY) AS subroot, CAST(NULL AS BINARY) AS root,
               up_tree, up_level, up_place, CAST(NULL AS INT) AS slot, CAST(0 AS INT) AS share
        FROM {{units}}
        UNION ALL
        SELECT c.unit,
               transform(c.slots, m -> named_struct('doc_id', m.doc_id, 'slot', m.slot, 'leaf', m.leaf, 'folded', unhex(sha2(lower(hex(concat(
                   substring(n.kids, 1, coalesce(c.slot, m.slot) * {WIDTH}), m.folded, substring(n.kids, (coalesce(c.slot, m.slot) + 1) * {WIDTH} + 1)))), 256)))),
               coalesce(c.kids, n.kids), IF(c.kids IS NULL, c.path, concat(c.path, {OTHERS.format(kids="n.kids", s="c.slot")})), IF(n.tree = {TOP}, c.subroot, n.digest), n.digest,
               n.up_tree, n.up_level, n.up_place, n.up_slot, CAST(pmod(hash(c.unit), n.up_shares) AS INT)
        FROM climb c JOIN {{nodes}} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_place = n.place AND c.share = n.share
    )
    SELECT slots, kids, path, subroot, root FROM climb WHERE up_tree IS NULL"""


def climbed(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """The units after their climb: slots (folded to the root), kids of the first node, path, subroot, root."""
    spark = units.sparkSession
    # The default bound on rows is for queries that may not end; a climb ends with the levels.
    bound = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        return cut(spark.sql(CLIMB, units=units, nodes=nodes))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", bound)


def proofs(docs: DataFrame, fanout: int = FANOUT, tampered: int = TAMPERED, share: int = SHARE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, leaf, subroot, root, siblings (digests from the leaf's level to the root's, as hex), folded_root, verified."""
    units, nodes = manifest(docs, fanout, tampered, share)
    each = climbed(cut(units), nodes).select(F.explode("slots").alias("m"), "kids", "path", "subroot", "root")
    first = F.expr(OTHERS.format(kids="kids", s="m.slot"))
    root = F.coalesce("root", "m.leaf")
    return each.select(
        "m.doc_id",
        F.lower(F.hex("m.leaf")).alias("leaf"),
        F.lower(F.hex(F.coalesce("subroot", "m.leaf"))).alias("subroot"),
        F.lower(F.hex(root)).alias("root"),
        F.lower(F.hex(F.concat(F.coalesce(first, F.lit(b"")), "path"))).alias("siblings"),
        F.lower(F.hex("m.folded")).alias("folded_root"),
        (F.col("m.folded") == root).alias("verified"),
    )


def proof_digests(docs: DataFrame) -> DataFrame:
    return proofs(docs).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")
