"""Latest rows, top rows of groups, paging, targeting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.sources.tables import materialize


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; give an order that leaves no ties. Ranks are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def top_n_of_latest_groups(df: DataFrame, group: str, k: int, order_by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each of the ``k`` largest groups; groups are few, so only their keys are ranked."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(F.desc(group)).limit(k)
    return latest_per_key(df.join(F.broadcast(groups), group, "left_semi"), [group], order_by, n)


def stratified_sample(df: DataFrame, strata: list[str], id: str, n: int) -> DataFrame:
    """``n`` rows of each stratum, in the order of the md5 of the id: the same rows on every run."""
    return latest_per_key(df, strata, [F.md5(F.col(id).cast("string")).asc(), F.col(id).asc()], n)


def price_drop(df: DataFrame, keys: list[str], order_by: list[Column], price: str) -> DataFrame:
    """Key, previous and last price where the last of two observations is lower than a positive previous one."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    last = df.withColumns({"__rank": F.row_number().over(w), "previous": F.lead(price).over(w)}).where("__rank = 1")
    return last.where((F.col("previous") > 0) & (F.col(price) < F.col("previous"))).select(*keys, F.col(price).alias("current"), "previous")


def in_given_order(given: DataFrame, facts: DataFrame, id: str, place: str) -> DataFrame:
    """Facts of the ids that are given, in the order of their places; an id that is given twice comes twice, one without facts not at all.

    The order is the column ``place``, which goes through the join, as rows of a cluster have no other.
    """
    return given.select(place, id).join(facts, id).orderBy(place)


def page_with_total(df: DataFrame, order_by: list[Column], page: int, size: int) -> DataFrame:
    """One page of rows with the total and the page count. The total is an aggregate, not a window over everything."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    rows = df.orderBy(*order_by).offset((page - 1) * size).limit(size)
    return rows.join(F.broadcast(total))


def refresh_schedule(now: int, scheduled: bool = True) -> dict[str, bool]:
    """Which reasons are due at a time (seconds since 1970): by the parity of its six-hour bucket."""
    bucket = now // 21600
    even, fourth = bucket % 2 == 0 or not scheduled, bucket % 4 == 0 or not scheduled
    return {"WISHLIST_PRIORITY": True, "WISHLIST_STANDARD": even, "RECENT_RELEASE": even, "COLLECTION_ROTATION": fourth}


def tiered_targets(tiers: list[DataFrame], id: str, position: str, limit: int) -> DataFrame:
    """Ids of tiers in order; the first tier that holds an id wins, and ``limit`` ids are taken in all."""
    rows = reduce(DataFrame.unionByName, [t.select(id, F.col(position).alias("position"), F.lit(i).alias("tier")) for i, t in enumerate(tiers)])
    first = rows.groupBy(id).agg(F.min(F.struct("tier", "position")).alias("first"))
    return first.select(id, "first.tier", "first.position").orderBy("tier", "position", id).limit(limit)


def global_rank(df: DataFrame, order_by: list[Column | str], part_rows: int = 1_000_000) -> DataFrame:
    """A dense position (from 1) in a total order, without putting all rows into one task.

    Rows are cut into ranges by all keys of the order, as many as ``part_rows`` asks for, and written with the
    number of their range; ranges are counted, and positions within a range are added to the range's start.
    """
    parts = max(1, -(-df.count() // part_rows), min(64, df.sparkSession.sparkContext.defaultParallelism))
    ranged = materialize(df.repartitionByRange(parts, *order_by).withColumn("__part", F.spark_partition_id()))
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = starts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order_by))
    return ranged.withColumn("__at", within).join(F.broadcast(starts), "__part").withColumn("position", F.col("__start") + F.col("__at")).drop("__part", "__start", "__at")


def rotation_window(ranked: DataFrame, position: str, size: int, day: int) -> DataFrame:
    """``size`` rows of a ranked pool that move on by ``size`` each day and wrap around."""
    n = ranked.agg(F.count("*").alias("__n"))
    shifted = F.pmod(F.col(position) - 1 - F.lit(day) * size, F.col("__n"))
    return ranked.join(F.broadcast(n)).where(shifted < size).drop("__n")


def even_sample(ranked: DataFrame, position: str, n: int, pinned: Column) -> DataFrame:
    """About ``n`` rows at even distances in a ranked table, and the pinned rows."""
    total = ranked.agg(F.count("*").alias("__n"))
    step = F.floor((F.col(position) - 1) * n / F.col("__n"))
    before = F.floor((F.col(position) - 2) * n / F.col("__n"))
    return ranked.join(F.broadcast(total)).where((F.col(position) == 1) | (step > before) | pinned).drop("__n")
