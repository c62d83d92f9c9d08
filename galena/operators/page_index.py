"""An index of positions, so that the ten-thousandth page costs what the first one does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.sources.tables import scratch

RANGE_ROWS = 100_000


@dataclass(frozen=True)
class PageIndex:
    """Rows of a table in ranges of an order, a folder for each, and how many rows each range has and begins after."""

    rows: DataFrame
    ranges: DataFrame
    order_by: tuple[Column, ...]

    def page(self, page: int, size: int) -> DataFrame:
        """The rows of a page (from 1) with position, total and pages. Only ranges that hold some of them are read; none beyond the end."""
        first = (page - 1) * size
        held = self.ranges.where((F.col("start") < first + size) & (F.col("start") + F.col("n") > first)).select("range").collect()  # size + 1 at most
        total = self.ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
        rows = self.rows.where(F.col("range").isin([r["range"] for r in held]))
        at = F.row_number().over(Window.partitionBy("range").orderBy(*self.order_by))
        placed = rows.withColumn("position", at).join(F.broadcast(self.ranges.select("range", "start")), "range").withColumn("position", F.col("start") + F.col("position"))
        return placed.where((F.col("position") > first) & (F.col("position") <= first + size)).drop("range", "start").join(F.broadcast(total))


def build(df: DataFrame, order_by: list[Column], range_rows: int = RANGE_ROWS, at: str | None = None) -> PageIndex:
    """Sort ``df`` once into ranges of about ``range_rows`` rows and count them. ``order_by`` has to leave no ties.

    The counts are a row for each range, which one task adds up. ``at`` is the folder to keep the index in.
    """
    spark = df.sparkSession
    at = at or scratch(spark)
    parts = max(1, -(-df.count() // range_rows))
    df.repartitionByRange(parts, *order_by).withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(at)
    rows = spark.read.parquet(at) if parts > 1 or df.head(1) else df.withColumn("range", F.lit(0))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return PageIndex(rows, counts.withColumn("start", before), tuple(order_by))
