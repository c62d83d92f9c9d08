"""Mixing sources to target weights by systematic sampling.

Targets: the sources, by code point with null last, take weights from a repeating list and share a
multiple of all sizes; a target stops at ``max_copies`` times its source's size and the excess goes to
the others by weight. That is a water level: target = min(cap, level * weight).

Sampling: every document of a source expects ``target / source size`` copies. The documents of a
source stand in an order, the expected copies are prefix-summed, one random offset is added, and a
document is emitted once for each integer that its step crosses. Ordered by size, neighbours are
alike, so the words taken stay close to the target.

The prefix sum needs no task that holds a source: sources are cut into buckets (by size, then by
hash, as many as ``bucket_rows`` asks for), buckets are counted and summed up, and positions within a
bucket are added to the bucket's start. Equal expectations make the prefix sum ``position * rate``,
which stays exact at any length. What is broadcast is a row for each (source, size) that is cut into
buckets, at most ``MAX_BROADCAST`` rows: buckets grow with the table beyond that.

Defined results: a null text has size 0 and may be taken any number of times up to the cap; a source
of size 0 has target 0; a null source is a source of its own; repeated rows are documents of their
own; an empty table gives an empty result; columns keep their names, and the number of a copy is called
``copy``, with underscores after it if the table has such a column. Reruns agree: offsets and order come
from hashes of the id, the source and the text, so rows with one id, or none, are spread too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.common import WORD_RE, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
OFFSET_BITS = 20
MAX_BROADCAST = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def with_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes``: __source, __key, source_size, one row for each source. Adds target.

    Sorted by the level at which a source reaches its cap, the level is found where the capped sources
    before it and the weights after it use up the total. One row for each source, so one task is enough.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    n = len(weights)
    ranked = sizes.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("__cap", F.col("source_size") * float(max_copies)).withColumn("__full_at", F.col("__cap") / F.col("__weight"))
    before = Window.orderBy("__full_at", "__key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumns({"__total": share * F.sum("source_size").over(everything), "__weights": F.sum("__weight").over(everything)})
    ranked = ranked.withColumns({"__used": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)), "__gone": F.coalesce(F.sum("__weight").over(before), F.lit(0.0))})
    level = (F.col("__total") - F.col("__used")) / (F.col("__weights") - F.col("__gone"))
    # The first source, in this order, that isn't full at the level sets it for itself and all after it.
    ranked = ranked.withColumn("__level", F.min(F.when(level < F.col("__full_at"), level)).over(everything))
    first_open = F.min(F.when(level < F.col("__full_at"), F.col("__full_at"))).over(everything)
    ranked = ranked.withColumn("__first_open", first_open)
    ranked = ranked.withColumn("__level", F.min(F.when(F.col("__full_at") == F.col("__first_open"), level)).over(everything))
    target = F.when(F.col("__level").isNull() | (F.col("__full_at") < F.col("__first_open")), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("__weight")))
    return ranked.withColumn("target", target).select("__key", "source_size", "target")


def mix_sources(docs: DataFrame, size: Column | None = None, order: Column | None = None, seed: int = 17, bucket_rows: int = 1_000, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, copies. One row for each document.

    Without ``size`` (and ``order``, a hash of the row), words are counted once into a narrow table that
    all the counting reads. Buckets have ``bucket_rows`` documents, or more where rows / ``max_broadcast`` is more: which of
    several documents of one size are taken depends on both.
    """
    names = docs.columns
    narrow = size is not None
    size = size if narrow else word_count(docs["text"])
    # A struct keeps the document's columns apart from the names used here.
    base = docs.select(
        F.struct(*names).alias("__doc"),
        docs["source"].alias("__source"),
        F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("n")).alias("__key"),
        size.alias("size"),
        (order if narrow else row_hash(docs, seed)).alias("__hash"),
        docs["doc_id"].alias("__id"),
    )
    sizes = base.select("__source", "__key", "size", "__hash")
    sizes = sizes if narrow else cut(sizes)
    per_source = sizes.groupBy("__source", "__key").agg(F.sum("size").alias("source_size"), F.count("*").alias("__docs"))
    targets = with_targets(per_source)
    # Buckets of about bucket_rows documents of one source, in the order of (size class, hash). Only
    # classes above that are cut, and there are at most documents / bucket_rows of them to broadcast.
    total = per_source.agg(F.sum("__docs")).first()[0] or 0
    bucket_rows = max(bucket_rows, total // max_broadcast)
    large = sizes.groupBy("__key", "size").agg(F.count("*").alias("__n")).where(F.col("__n") > bucket_rows)
    large = F.broadcast(large.select("__key", "size", F.ceil(F.col("__n") / bucket_rows).alias("__parts")))

    def in_buckets(rows: DataFrame) -> DataFrame:
        return rows.join(large, ["__key", "size"], "left").withColumn("__bucket", F.pmod(F.col("__hash"), F.coalesce("__parts", F.lit(1))))

    placed = in_buckets(base)
    counted = in_buckets(sizes).groupBy("__key", "size", "__bucket").agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy("__key").orderBy("size", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("__start", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).join(targets, "__key").drop("__rows")
    within = Window.partitionBy("__key", "size", "__bucket").orderBy("__hash", "__id")
    out = placed.withColumn("__at", F.row_number().over(within)).join(starts, ["__key", "size", "__bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64("__key", F.lit(seed + 1)), F.lit(1 << OFFSET_BITS)) / float(1 << OFFSET_BITS)
    position = F.col("__start") + F.col("__at")
    crossed = F.floor(position * rate + offset) - F.floor((position - 1) * rate + offset)
    return out.select(F.col("__doc"), "size", "source_size", "target", F.least(crossed, F.lit(MAX_COPIES)).cast("long").alias("copies"))


def row_hash(docs: DataFrame, seed: int = 17) -> Column:
    return F.xxhash64(docs["doc_id"], F.lit(seed), docs["source"], docs["text"])


def sampled(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document; texts are not shuffled."""
    narrow = cut(docs.select("doc_id", "source", word_count(docs["text"]).alias("__size"), row_hash(docs).alias("__order")))
    mixed = mix_sources(narrow, size=narrow["__size"], order=narrow["__order"])
    return mixed.select("__doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def emit(docs: DataFrame) -> DataFrame:
    """The mixed documents: a row for each copy, with the columns of ``docs`` and ``copy`` (from 1)."""
    name = "copy"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    mixed = mix_sources(docs).where("copies > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    return mixed.select("__doc", copy).select("__doc.*", F.col("__copy").alias(name))
