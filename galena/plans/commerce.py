"""Price analytics, deals, offer refresh, targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators import commerce as ops
from galena.operators import joins, windows
from galena.operators.classification import with_zero_rows
from galena.operators.windows import latest_per_key
from galena.plans.base import AS_OF, query
from galena.plans.windows import LATEST_SQL, latest_first
from galena.sources.tables import materialize, report_long
from galena.sources.views import Tables, with_views

HOURS = 24 * 400


def latest(t: Tables) -> DataFrame:
    return latest_per_key(t.observations(), ["offer_id"], latest_first())


_LATEST = f", latest AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY {LATEST_SQL}) = 1)"
_LISTED = ", listed AS (SELECT * FROM lp QUALIFY row_number() OVER (PARTITION BY variant_id, market_id ORDER BY observed_at DESC, obs_id DESC, list_cents DESC) = 1)"
_HIGH = f"""{_LATEST}{_LISTED}, best AS (SELECT *, item_cents + shipping_cents AS total_cents FROM latest WHERE availability = 'AVAILABLE' AND condition IN ('NEW', 'USED') AND shipping_cents IS NOT NULL
        AND observed_at <= TIMESTAMP '{AS_OF}' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR QUALIFY row_number() OVER (PARTITION BY variant_id, condition ORDER BY item_cents + shipping_cents, offer_id) = 1),
    high AS (SELECT b.variant_id, b.condition, b.offer_id, b.market_id, b.total_cents, l.list_cents, CASE WHEN b.condition = 'NEW' AND b.total_cents > 0 AND l.list_cents > 0 THEN CAST(greatest(0, floor((l.list_cents - b.total_cents) * 100 / l.list_cents)) AS BIGINT) END AS promotion
        FROM best b LEFT JOIN (SELECT * FROM listed WHERE valid_until IS NULL) l ON l.variant_id = b.variant_id AND l.market_id = b.market_id)"""


@query("latest_observation", with_views("obs", _LATEST.strip() + " SELECT offer_id, obs_id, item_cents, shipping_cents, condition FROM latest"))
def latest_observation(t: Tables) -> DataFrame:
    return latest(t).select("offer_id", "obs_id", "item_cents", "shipping_cents", "condition")


@query("latest_list_price", with_views("obs lp", _LISTED.strip() + " SELECT variant_id, market_id, list_cents, obs_id FROM listed"))
def latest_list_price(t: Tables) -> DataFrame:
    return ops.latest_list_price(t.list_prices()).select("variant_id", "market_id", "list_cents", "obs_id")


@query("price_highlights", with_views("obs lp", _HIGH.strip() + " SELECT * FROM high"))
def price_highlights(t: Tables) -> DataFrame:
    return ops.price_highlights(latest(t), ops.latest_list_price(t.list_prices()), AS_OF, HOURS)


@query("fresh_deals", with_views("obs lp", _HIGH.strip() + " SELECT variant_id, offer_id, total_cents, list_cents, promotion FROM high WHERE promotion > 0"))
def fresh_deals(t: Tables) -> DataFrame:
    return ops.fresh_deals(price_highlights(t)).select("variant_id", "offer_id", "total_cents", "list_cents", "promotion")


@query("promotion", with_views("obs lp", f"""{_LATEST.strip()}{_LISTED}
    SELECT offer_id, CASE WHEN condition = 'NEW' AND item_cents > 0 AND list_cents > 0 AND observed_at <= TIMESTAMP '{AS_OF}' THEN CAST(greatest(0, floor((list_cents - item_cents) * 100 / list_cents)) AS BIGINT) END AS promotion FROM latest JOIN listed USING (variant_id, market_id)""".replace("observed_at <=", "latest.observed_at <=")))
def promotion(t: Tables) -> DataFrame:
    listed = ops.latest_list_price(t.list_prices()).select("variant_id", "market_id", "list_cents")
    rows = latest(t).join(listed, ["variant_id", "market_id"])
    fresh = F.col("observed_at") <= F.lit(AS_OF).cast("timestamp_ntz")
    return rows.select("offer_id", ops.promotion(F.col("item_cents"), F.col("list_cents"), F.col("condition") == "NEW", fresh).alias("promotion"))


@query("price_observation", with_views("obs", "SELECT obs_id, offer_id, item_cents, item_cents + shipping_cents AS total_cents, item_cents >= 0 AND length(condition) >= 3 AS valid FROM obs"))
def price_observation(t: Tables) -> DataFrame:
    valid = (F.col("item_cents") >= 0) & (F.length("condition") >= 3)
    return ops.delivered(t.observations()).select("obs_id", "offer_id", "item_cents", "total_cents", valid.alias("valid"))


@query("official_price_status", with_views("obs lp", f"{_LISTED.strip()} SELECT variant_id, market_id, list_cents, CASE WHEN valid_until IS NULL OR valid_until >= TIMESTAMP '{AS_OF}' THEN 'CURRENT' ELSE 'LAST_KNOWN' END AS status FROM listed"))
def official_price_status(t: Tables) -> DataFrame:
    current = F.col("valid_until").isNull() | (F.col("valid_until") >= F.lit(AS_OF).cast("timestamp_ntz"))
    return ops.latest_list_price(t.list_prices()).select("variant_id", "market_id", "list_cents", F.when(current, "CURRENT").otherwise("LAST_KNOWN").alias("status"))


@query("price_history_stats", with_views("obs", """
    SELECT offer_id, count(*) AS n, max_by(p, k) AS current, min_by(p, k) AS first, min(p) AS lowest, max(p) AS highest
    FROM (SELECT offer_id, coalesce(item_cents + shipping_cents, item_cents) AS p, (observed_at, obs_id, item_cents, line) AS k FROM obs) GROUP BY offer_id"""))
def price_history_stats(t: Tables) -> DataFrame:
    rows = ops.delivered(t.observations()).withColumn("price", F.coalesce("total_cents", "item_cents"))
    return ops.price_history(rows, ["offer_id"], ["observed_at", "obs_id", "item_cents", "line"], "price")


_PREV = "prev AS (SELECT offer_id, any_value(retailer_id) AS retailer_id, min(item_cents) AS price_cents FROM obs WHERE observed_at < TIMESTAMP '2000-06-01' GROUP BY offer_id)"
_INC = "inc AS (SELECT offer_id, any_value(retailer_id) AS retailer_id, min(item_cents) AS price_cents, CAST(max(1 - discount) AS DOUBLE) AS confidence, max(observed_at) AS observed_at FROM obs WHERE observed_at >= TIMESTAMP '2000-06-01' GROUP BY offer_id)"


@query("offer_refresh", with_views("obs", f""", {_PREV}, {_INC}, good AS (SELECT * FROM inc WHERE retailer_id % 3 = 0 AND confidence >= 0.95 AND price_cents > 0 AND offer_id % 5 > 1)
    SELECT 'offer' AS kind, coalesce(g.offer_id, p.offer_id) AS offer_id, coalesce(g.price_cents, p.price_cents) AS price_cents,
    CASE WHEN p.offer_id IS NULL THEN 'created' WHEN g.offer_id IS NOT NULL THEN CASE WHEN g.price_cents = p.price_cents THEN 'unchanged' ELSE 'updated' END WHEN p.retailer_id % 3 = 0 THEN 'ended' ELSE 'kept' END AS status
    FROM prev p FULL JOIN good g ON g.offer_id = p.offer_id UNION ALL SELECT 'observation', offer_id, price_cents, 'appended' FROM good WHERE (offer_id, observed_at) NOT IN (SELECT offer_id, observed_at FROM obs WHERE observed_at < TIMESTAMP '2000-09-01')
    UNION ALL SELECT 'reject', offer_id, price_cents, CASE WHEN retailer_id % 3 > 0 THEN 'outside the scope' WHEN offer_id % 5 < 2 THEN 'unsafe address' WHEN confidence < 0.95 THEN 'low confidence' ELSE 'no price' END FROM inc WHERE offer_id NOT IN (SELECT offer_id FROM good)"""))
def offer_refresh(t: Tables) -> DataFrame:
    """Offers, appended observations and rejects of one refresh, as rows of one table.

    From a million parts on, offers of two retailers may have one number: the retailer is that of the first row, as the table has them.
    """
    obs, cut = t.observations(t.placed("lineitem"), "place"), F.lit("2000-06-01").cast("timestamp_ntz")
    retailer = F.min_by("retailer_id", "place").alias("retailer_id")
    previous = obs.where(F.col("observed_at") < cut).groupBy("offer_id").agg(retailer, F.min("item_cents").alias("price_cents"))
    incoming = obs.where(F.col("observed_at") >= cut).groupBy("offer_id").agg(retailer, F.min("item_cents").alias("price_cents"), F.max(1 - F.col("discount")).alias("confidence"), F.max("observed_at").alias("observed_at"))
    k = F.col("offer_id") % 5
    url = F.concat(F.when(k == 0, "http://shop.example.org/").when(k == 1, "https://evil.example.net/").otherwise("https://shop.example.org/"), F.col("offer_id").cast("string"))
    there = obs.where(F.col("observed_at") < F.lit("2000-09-01").cast("timestamp_ntz")).select("offer_id", "observed_at")
    offers, added, rejected = ops.offer_refresh(previous, incoming.withColumn("url", url), there, F.col("retailer_id") % 3 == 0, ["shop.example.org"])
    parts = (offers.withColumn("kind", F.lit("offer")), added.withColumns({"kind": F.lit("observation"), "status": F.lit("appended")}), rejected.withColumn("kind", F.lit("reject")).withColumnRenamed("reason", "status"))
    return reduce(DataFrame.union, [p.select("kind", "offer_id", "price_cents", "status") for p in parts])


@query("offer_coverage", with_views("obs", f"""{_LATEST.strip()} SELECT retailer_id, count(*) AS offers, count(DISTINCT variant_id) FILTER (WHERE condition = 'NEW' AND availability = 'AVAILABLE') AS active_new, count(DISTINCT variant_id) FILTER (WHERE condition = 'USED' AND availability = 'AVAILABLE') AS active_used FROM latest GROUP BY retailer_id"""))
def offer_coverage(t: Tables) -> DataFrame:
    def active(kind: str):
        return F.count_distinct(F.when((F.col("condition") == kind) & (F.col("availability") == "AVAILABLE"), F.col("variant_id")))

    return latest(t).groupBy("retailer_id").agg(F.count("*").alias("offers"), active("NEW").alias("active_new"), active("USED").alias("active_used"))


@query("identifier_coverage", """
    WITH i AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN lpad(CAST(p_partkey % 1500 AS VARCHAR), 8, '0') END AS code FROM part)
    SELECT count(*) AS variants, count(code) AS with_code, count(DISTINCT code) AS codes, (SELECT count(*) FROM (SELECT code FROM i WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1)) AS duplicated FROM i""")
def identifier_coverage(t: Tables) -> DataFrame:
    codes = t.part.select(F.when(F.col("p_size") % 4 > 0, F.lpad((F.col("p_partkey") % 1500).cast("string"), 8, "0")).alias("code"))
    per = codes.groupBy("code").agg(F.count("*").alias("n"))
    named = F.col("code").isNotNull()
    return per.agg(F.sum("n").alias("variants"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("with_code"), F.count("code").alias("codes"), F.count_if(named & (F.col("n") > 1)).alias("duplicated"))


REASONS = ["WISHLIST", "ACTIVE_OFFER", "RECENT_RELEASE", "RELEASE_YEAR", "RECENT_COLLECTION"]


@query("price_targets", with_views("obs copies wishes", f"""{_LATEST.strip()}, q AS (SELECT 0 AS tier, variant_id FROM wishes WHERE priority = 1 GROUP BY 2 HAVING count(*) > 4 UNION ALL SELECT DISTINCT 1, variant_id FROM latest WHERE availability = 'AVAILABLE' AND condition = 'NEW' AND retailer_id % 10 = 0
        UNION ALL (SELECT 2, p_partkey FROM part WHERE p_size >= 40 ORDER BY p_size DESC, p_partkey DESC LIMIT 50) UNION ALL SELECT 3, p_partkey FROM part WHERE p_size = 50 UNION ALL (SELECT DISTINCT 4, variant_id FROM copies JOIN part ON p_partkey = variant_id WHERE p_size >= 30 ORDER BY variant_id DESC LIMIT 100)),
    f AS (SELECT variant_id, min(tier) AS tier FROM q GROUP BY 1), s AS (SELECT * FROM f QUALIFY row_number() OVER (ORDER BY tier, variant_id) <= 300), r AS (SELECT unnest(range(0, 5)) AS tier)
    SELECT 'candidates' AS section, ({REASONS})[r.tier + 1] AS key, CAST(count(q.variant_id) AS DOUBLE) AS value FROM r LEFT JOIN q ON q.tier = r.tier GROUP BY r.tier UNION ALL SELECT 'selected', ({REASONS})[r.tier + 1], CAST(count(s.variant_id) AS DOUBLE) FROM r LEFT JOIN s ON s.tier = r.tier GROUP BY r.tier
    UNION ALL SELECT 'overlap', ({REASONS})[a.tier + 1] || '&' || ({REASONS})[b.tier + 1], CAST(count(*) AS DOUBLE) FROM q a JOIN q b ON a.variant_id = b.variant_id AND a.tier < b.tier GROUP BY a.tier, b.tier"""))
def price_targets(t: Tables) -> DataFrame:
    """Candidates of five reasons, what is selected of each under a limit, and how the reasons overlap."""
    parts = t.part.select(F.col("p_partkey").alias("variant_id"), "p_size")
    active = latest(t).where("availability = 'AVAILABLE' and condition = 'NEW' and retailer_id % 10 = 0")
    owned = t.copies().select("variant_id").distinct().join(parts.where("p_size >= 30"), "variant_id")
    groups = [t.wishes().where("priority = 1").groupBy("variant_id").count().where("count > 4"), active, parts.where("p_size >= 40").orderBy(F.desc("p_size"), F.desc("variant_id")).limit(50), parts.where("p_size = 50"), owned.orderBy(F.desc("variant_id")).limit(100)]
    groups = [g.select("variant_id").distinct().withColumn("position", F.col("variant_id")) for g in groups]
    rows = materialize(reduce(DataFrame.union, [g.withColumn("tier", F.lit(i)) for i, g in enumerate(groups)]))
    taken = windows.tiered_targets([rows.where(F.col("tier") == i).drop("tier") for i in range(len(REASONS))], "variant_id", "position", 300)
    name = F.get(F.array(*map(F.lit, REASONS)), F.col("tier"))
    counted = {s: with_zero_rows(df.groupBy(name.alias("key")).agg(F.count("*").alias("n")), "key", REASONS).select("key", F.col("n").alias("value")) for s, df in (("candidates", rows), ("selected", taken))}
    named = rows.select("variant_id", "tier", name.alias("name"))
    pairs = named.alias("a").join(named.alias("b"), (F.col("a.variant_id") == F.col("b.variant_id")) & (F.col("a.tier") < F.col("b.tier")))
    overlap = pairs.groupBy(F.concat_ws("&", "a.name", "b.name").alias("key")).agg(F.count("*").alias("value"))
    return report_long(counted | {"overlap": overlap})


@query("price_apply", with_views("obs lp", """
    , seen AS (SELECT *, CAST(variant_id AS VARCHAR) || CASE WHEN obs_id % 5 = 0 THEN 'X' ELSE '' END AS observed, obs_id % 7 = 0 AS archived, obs_id % 2 = 0 AS there FROM lp), b AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS base FROM part WHERE p_size % 10 > 0),
    k AS (SELECT DISTINCT variant_id, market_id, observed_at FROM seen WHERE there), r AS (SELECT s.*, base IS NOT NULL AS ok, k.variant_id IS NULL AS fresh FROM seen s LEFT JOIN b ON p_partkey = s.variant_id AND base = observed LEFT JOIN k ON k.variant_id = s.variant_id AND k.market_id = s.market_id AND k.observed_at = s.observed_at)
    SELECT variant_id, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected, count(DISTINCT (market_id, observed_at)) FILTER (WHERE ok AND fresh) AS appended, count(DISTINCT (market_id, observed_at)) FILTER (WHERE ok AND fresh AND archived) AS closed FROM r GROUP BY variant_id"""))
def price_apply(t: Tables) -> DataFrame:
    """Observed list prices whose reference is that of their variant are appended once; archived ones are closed when seen."""
    seen = t.list_prices().select("*", F.concat(F.col("variant_id").cast("string"), F.when(F.col("obs_id") % 5 == 0, "X").otherwise("")).alias("base"))
    local = t.part.where("p_size % 10 > 0").select(F.col("p_partkey").alias("variant_id"), F.col("p_partkey").cast("string").alias("base"))
    accepted, rejected = joins.validated_join(seen, local, "variant_id", "base")
    keys = ["variant_id", "market_id", "observed_at"]
    there = seen.where("obs_id % 2 = 0").select(*keys).distinct()
    fresh = accepted.join(there, keys, "left_anti").groupBy(*keys).agg(F.bool_or(F.col("obs_id") % 7 == 0).alias("archived"))
    counts = [accepted.groupBy("variant_id").agg(F.count("*").alias("accepted")), rejected.groupBy("variant_id").agg(F.count("*").alias("rejected")), fresh.groupBy("variant_id").agg(F.count("*").alias("appended"), F.count_if("archived").alias("closed"))]
    return reduce(lambda a, b: a.join(b, "variant_id", "full_outer"), counts).fillna(0)
