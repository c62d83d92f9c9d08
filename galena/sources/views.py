"""Catalogue concepts as views of the driver's tables.

An offer is a (supplier, part) pair, a line item one observation of its price, a part a variant whose
product is the group of parts with one name, a nation a market and a region its parent, a customer a
collection, its line items copies and its open orders wishes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.sources.tables import load


class Tables:
    """``Tables(spark, folder).lineitem`` and so on; views are methods."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, table: str) -> DataFrame:
        return load(self.spark, self.folder, table)

    def dealt(self, table: str, key: str) -> DataFrame:
        """A table in as many parts as there are cores: a small file would be one task, however much is made of its rows."""
        return getattr(self, table).repartition(self.spark.sparkContext.defaultParallelism, key)

    def placed(self, table: str) -> DataFrame:
        """A table with ``place``: where a row stands in it, by the names of its files and then within its file."""
        rows = getattr(self, table).withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
        files = rows.select("__file").distinct().withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("long"))
        return rows.join(F.broadcast(files), "__file").withColumn("place", F.col("__number") * (1 << 40) + F.col("__row")).drop("__file", "__row", "__number")

    def observations(self, lines: DataFrame | None = None, *more: str) -> DataFrame:
        """``lines``: the line items, with columns ``more`` that go along."""
        rows = (self.lineitem if lines is None else lines).join(self.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("market_id")), "l_suppkey")
        return rows.select(
            (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("offer_id"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("obs_id"),
            F.col("l_partkey").alias("variant_id"),
            F.col("l_suppkey").alias("retailer_id"),
            "market_id",
            F.col("l_shipdate").alias("observed_at"),
            F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("item_cents"),
            F.when(F.col("l_tax") >= 0.04, F.floor(F.col("l_tax") * 10000).cast("long")).alias("shipping_cents"),
            F.when(F.col("l_returnflag") == "N", "NEW").when(F.col("l_returnflag") == "A", "USED").otherwise("UNKNOWN").alias("condition"),
            F.when(F.col("l_linestatus") == "O", "AVAILABLE").otherwise("UNAVAILABLE").alias("availability"),
            F.col("l_discount").alias("discount"),
            F.col("l_linenumber").alias("line"),
            *more,
        )

    def list_prices(self) -> DataFrame:
        seen = self.observations().where("discount >= 0.06")
        prices = self.part.select(F.col("p_partkey").alias("variant_id"), F.floor(F.col("p_retailprice") * 300).cast("long").alias("list_cents"))
        return seen.join(prices, "variant_id").select("variant_id", "market_id", "observed_at", "obs_id", (F.col("list_cents") + F.col("line")).alias("list_cents"), F.when(F.col("line") == 7, F.expr("observed_at + interval 30 days")).alias("valid_until"))

    def variants(self) -> DataFrame:
        p = self.part
        return p.select(F.col("p_partkey").alias("variant_id"), F.col("p_name").alias("product_id"), "p_brand", "p_type", "p_size", "p_retailprice")

    def copies(self) -> DataFrame:
        rows = self.lineitem.join(self.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
        return rows.select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("variant_id"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("copy_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("l_returnflag") == "N", "NEW").when(F.col("l_returnflag") == "A", "USED").otherwise("UNKNOWN").alias("condition"),
            F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus") == "O").alias("is_complete"),
            F.when(F.col("l_tax") >= 0.02, F.col("l_discount") > 0.05).alias("has_box"),
            F.when(F.col("l_discount") >= 0.03, F.floor(F.col("l_extendedprice") * 100).cast("long")).alias("price_cents"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )

    def wishes(self) -> DataFrame:
        rows = self.lineitem.join(self.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
        return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("variant_id"), F.col("o_orderpriority").substr(1, 1).cast("int").alias("priority")).distinct()

    def claims(self) -> DataFrame:
        """Price-class claims of suppliers on parts: the field is the discount in percent."""
        return self.lineitem.select(
            F.col("l_partkey").alias("entity"),
            F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("value"),
            (F.col("l_suppkey") % 5).cast("int").alias("priority"),
            F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("confidence"),
            F.col("l_shipdate").alias("retrieved_at"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
            F.col("l_suppkey").alias("source"),
        )


#: The same views for DuckDB.
SQL = {
    "obs": """obs AS (SELECT l_suppkey * 1000000 + l_partkey AS offer_id, l_orderkey * 100 + l_linenumber AS obs_id, l_partkey AS variant_id, l_suppkey AS retailer_id, s_nationkey AS market_id, l_shipdate AS observed_at,
        CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS item_cents, CASE WHEN l_tax >= 0.04 THEN CAST(floor(l_tax * 10000) AS BIGINT) END AS shipping_cents,
        CASE l_returnflag WHEN 'N' THEN 'NEW' WHEN 'A' THEN 'USED' ELSE 'UNKNOWN' END AS condition, CASE l_linestatus WHEN 'O' THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS availability, l_discount AS discount, l_linenumber AS line
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)""",
    "lp": """lp AS (SELECT variant_id, market_id, observed_at, obs_id, CAST(floor(p_retailprice * 300) AS BIGINT) + line AS list_cents, CASE WHEN line = 7 THEN observed_at + INTERVAL 30 DAY END AS valid_until FROM obs JOIN part ON p_partkey = variant_id WHERE discount >= 0.06)""",
    "variants": "variants AS (SELECT p_partkey AS variant_id, p_name AS product_id, p_brand, p_type, p_size, p_retailprice FROM part)",
    "copies": """copies AS (SELECT o_custkey AS user_id, l_partkey AS variant_id, l_orderkey * 100 + l_linenumber AS copy_id, o_orderdate AS created_at, CASE l_returnflag WHEN 'N' THEN 'NEW' WHEN 'A' THEN 'USED' ELSE 'UNKNOWN' END AS condition,
        CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus = 'O' END AS is_complete, CASE WHEN l_tax >= 0.02 THEN l_discount > 0.05 END AS has_box, CASE WHEN l_discount >= 0.03 THEN CAST(floor(l_extendedprice * 100) AS BIGINT) END AS price_cents, CAST(l_quantity AS INT) AS quantity
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P')""",
    "wishes": "wishes AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS variant_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')",
    "claims": "claims AS (SELECT l_partkey AS entity, CAST(floor(l_discount * 100 + 0.5) AS INT) AS value, CAST(l_suppkey % 5 AS INT) AS priority, CAST(floor(l_tax * 100 + 0.5) AS INT) AS confidence, l_shipdate AS retrieved_at, l_orderkey * 100 + l_linenumber AS id, l_suppkey AS source FROM lineitem)",
}


def with_views(names: str, body: str) -> str:
    """DuckDB SQL with the views it names: ``with_views("obs lp", "SELECT ..")``."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
