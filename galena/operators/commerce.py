"""Price observations, promotions, offers and refresh targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.operators.filters import fresh_within, url_allowlist
from galena.operators.windows import latest_per_key
from galena.sources.tables import append_new


def promotion(total: Column, listed: Column, same_market: Column, fresh: Column) -> Column:
    """Share below the list price in whole percent, at least 0; null without a comparable pair."""
    usable = same_market & fresh & (total > 0) & (listed > 0)
    return F.when(usable, F.greatest(F.lit(0), F.floor((listed - total) * 100 / listed)).cast("long"))


def delivered(df: DataFrame) -> DataFrame:
    """total_cents: item and shipping, null if shipping isn't known."""
    return df.withColumn("total_cents", F.col("item_cents") + F.col("shipping_cents"))


def price_highlights(latest: DataFrame, listed: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Best fresh available offer of each variant and condition by delivered total, with its promotion.

    ``latest``: the latest observation of each offer; ``listed``: the latest list price of each
    (variant_id, market_id), with valid_until.
    """
    usable = delivered(latest).where((F.col("availability") == "AVAILABLE") & F.col("condition").isin("NEW", "USED") & F.col("total_cents").isNotNull() & fresh_within("observed_at", as_of, hours))
    best = latest_per_key(usable, ["variant_id", "condition"], [F.asc("total_cents"), F.asc("offer_id")])
    current = listed.where(F.col("valid_until").isNull()).select("variant_id", "market_id", "list_cents")
    joined = best.join(current, ["variant_id", "market_id"], "left")
    share = F.when(F.col("condition") == "NEW", promotion(F.col("total_cents"), F.col("list_cents"), F.col("list_cents").isNotNull(), F.lit(True)))
    return joined.select("variant_id", "condition", "offer_id", "market_id", "total_cents", "list_cents", share.alias("promotion"))


def fresh_deals(highlights: DataFrame) -> DataFrame:
    """Variants with a positive promotion, cheapest first."""
    deals = highlights.where("promotion > 0")
    return deals.orderBy("total_cents", F.desc("promotion"), "variant_id")


def offer_refresh(previous: DataFrame, incoming: DataFrame, observed: DataFrame, scope: Column, hosts: list[str], min_confidence: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offers after a refresh of the scope, observations to append, and rejected incoming rows with the reason.

    Rows outside the scope, with an unsafe address, of low confidence or without a price are rejected one by one;
    an offer of the scope that wasn't seen ends. Columns: offer_id, retailer_id, price_cents, confidence, url,
    observed_at; ``observed``: offer_id, observed_at of the observations that are there; ``scope`` reads retailer_id.
    """
    safe = url_allowlist("url", hosts).isNotNull()
    reason = F.when(~F.coalesce(scope, F.lit(False)), "outside the scope").when(~safe, "unsafe address").when(~F.coalesce(F.col("confidence") >= min_confidence, F.lit(False)), "low confidence").when(~F.coalesce(F.col("price_cents") > 0, F.lit(False)), "no price")
    told = incoming.withColumn("reason", reason)
    good, rejected = told.where("reason is null").drop("reason"), told.where("reason is not null")
    a = previous.select(F.col("offer_id").alias("__a"), F.col("retailer_id").alias("__ra"), F.col("price_cents").alias("__pa"))
    b = good.select(F.col("offer_id").alias("__b"), F.col("retailer_id").alias("__rb"), F.col("price_cents").alias("__pb"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer").withColumn("retailer_id", F.coalesce("__rb", "__ra"))
    status = F.when(F.col("__a").isNull(), "created").when(F.col("__b").isNotNull(), F.when(F.col("__pa").eqNullSafe(F.col("__pb")), "unchanged").otherwise("updated")).when(scope, "ended").otherwise("kept")
    offers = both.select(F.coalesce("__b", "__a").alias("offer_id"), "retailer_id", F.coalesce("__pb", "__pa").alias("price_cents"), status.alias("status"))
    return offers, append_new(observed, good.select("offer_id", "observed_at", "price_cents"), ["offer_id", "observed_at"]), rejected


def price_history(df: DataFrame, keys: list[str], at: list[str], price: str) -> DataFrame:
    """Count, current, first, lowest and highest price in one aggregation."""
    order = F.struct(*at)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by(price, order).alias("current"), F.min_by(price, order).alias("first"), F.min(price).alias("lowest"), F.max(price).alias("highest"))


def latest_list_price(listed: DataFrame) -> DataFrame:
    return latest_per_key(listed, ["variant_id", "market_id"], [F.desc("observed_at"), F.desc("obs_id"), F.desc("list_cents")])
