"""Windows, sorts, paging, targeting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.operators import page_index
from galena.operators import windows as ops
from galena.plans.base import query
from galena.sources.views import Tables, with_views


def latest_first() -> list[Column]:
    """A total order of observations; a function, as columns need a session."""
    return [F.desc("observed_at"), F.desc("obs_id"), F.desc("item_cents"), F.desc("line")]


LATEST_SQL = "observed_at DESC, obs_id DESC, item_cents DESC, line DESC"


@query("latest_releases", """
    WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY y DESC LIMIT 2)
    SELECT year(o_orderdate) AS year, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) IN (SELECT y FROM y)
    QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) <= 12""")
def latest_releases(t: Tables) -> DataFrame:
    rows = t.orders.select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    return ops.top_n_of_latest_groups(rows, "year", 2, [F.desc("o_totalprice"), F.asc("o_orderkey")], 12)


@query("group_representative", """
    SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY
        CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 END, CASE WHEN p_size IS NULL THEN 1 ELSE 0 END, p_size DESC, p_retailprice, p_brand, p_partkey) = 1""")
def group_representative(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type") == "STANDARD", 0).when(F.col("p_type") == "PROMO", 1).otherwise(2)
    order = [kind.asc(), F.col("p_size").isNull().asc(), F.desc("p_size"), F.asc("p_retailprice"), F.asc("p_brand"), F.asc("p_partkey")]
    return ops.latest_per_key(t.part, ["p_name"], order).select("p_name", "p_partkey", "p_brand")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def distinct_on(t: Tables) -> DataFrame:
    """The first row of a key as an aggregate: one value for each key leaves each map task."""
    first = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("row"))
    return first.select("o_custkey", "row.*")


@query("given_order", """
    WITH g AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'), known AS (SELECT c_custkey AS id, c_name, c_nationkey FROM customer WHERE c_acctbal > 0)
    SELECT place, id, c_name, c_nationkey FROM g JOIN known USING (id)""")
def given_order(t: Tables) -> DataFrame:
    """Facts of customers in the order of a list of ids, which repeats some and has some that aren't known."""
    rank = ops.global_rank(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), "o_totalprice", "o_orderkey"), [F.desc("o_totalprice"), F.asc("o_orderkey")])
    known = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey")
    return ops.in_given_order(rank.select("id", F.col("position").alias("place")), known, "id", "place").select("place", "id", "c_name", "c_nationkey")


@query("snapshot_projection", """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind, CASE WHEN CAST(json_extract(props, '$.k') AS INT) BETWEEN 10 AND 90 THEN 1900 + CAST(json_extract(props, '$.k') AS INT) END AS year, CASE WHEN value >= 1 THEN CAST(floor(value * 100) AS BIGINT) END AS cents FROM events""")
def snapshot_projection(t: Tables) -> DataFrame:
    """What entries of a snapshot tell; a field that isn't told, or out of its range, stays null."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    told = {"kind": (F.col("event_type"), F.col("event_type").isin("view", "click")), "year": (1900 + k, k.between(10, 90)), "cents": (F.floor(F.col("value") * 100), F.col("value") >= 1)}
    return t.events.select("event_id", *[F.when(usable, value).alias(name) for name, (value, usable) in told.items()])


@query("deep_page", """
    SELECT l_orderkey, l_linenumber, l_extendedprice, position, total, greatest(1, (total + 35) // 36) AS pages FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS position, count(*) OVER () AS total FROM lineitem)
    WHERE position > 36 * 149 AND position <= 36 * 150""")
def deep_page(t: Tables) -> DataFrame:
    """Page 150 of all lines, through an index of positions."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return page_index.build(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], range_rows=20_000).page(150, 36)


@query("page_with_total", """
    SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part WHERE p_size >= 20) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM part WHERE p_size >= 20) / 36.0)) AS BIGINT) AS pages
    FROM part WHERE p_size >= 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 36 OFFSET 72""")
def page_with_total(t: Tables) -> DataFrame:
    rows = t.part.where("p_size >= 20").select("p_partkey", "p_name", "p_retailprice")
    return ops.page_with_total(rows, [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 36)


@query("stratified_sample", """
    SELECT p_type, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) <= 3""")
def stratified_sample(t: Tables) -> DataFrame:
    return ops.stratified_sample(t.part.select("p_type", "p_brand", "p_partkey"), ["p_type", "p_brand"], "p_partkey", 3)


@query("price_drop", with_views("obs", f"""
    SELECT offer_id, item_cents AS current, previous FROM (SELECT *, row_number() OVER w AS r, lead(item_cents) OVER w AS previous FROM obs WINDOW w AS (PARTITION BY offer_id ORDER BY {LATEST_SQL}))
    WHERE r = 1 AND previous > 0 AND item_cents < previous"""))
def price_drop(t: Tables) -> DataFrame:
    return ops.price_drop(t.observations(), ["offer_id"], latest_first(), "item_cents")


@query("ranked_per_theme", """
    SELECT n_regionkey, s_suppkey, place FROM (SELECT n_regionkey, s_suppkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END, s_acctbal DESC NULLS LAST, lower(s_name), s_suppkey) AS place
    FROM supplier JOIN nation ON n_nationkey = s_nationkey) WHERE place <= 10""")
def ranked_per_theme(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_regionkey").orderBy((F.col("s_acctbal") < 0).asc(), F.col("s_acctbal").desc_nulls_last(), F.lower("s_name"), "s_suppkey")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 10").select("n_regionkey", "s_suppkey", "place")


@query("copy_index", with_views("copies", """
    SELECT user_id, variant_id, copy_id, row_number() OVER (PARTITION BY user_id, variant_id ORDER BY created_at, copy_id, price_cents, quantity) AS copy_no, count(*) OVER (PARTITION BY user_id, variant_id) AS n_copies FROM copies"""))
def copy_index(t: Tables) -> DataFrame:
    item = Window.partitionBy("user_id", "variant_id")
    return t.copies().select("user_id", "variant_id", "copy_id", F.row_number().over(item.orderBy("created_at", "copy_id", "price_cents", "quantity")).alias("copy_no"), F.count("*").over(item).alias("n_copies"))


@query("recent_commercial", """
    SELECT p_name, p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 40 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 ORDER BY p_size DESC, p_name LIMIT 20""")
def recent_commercial(t: Tables) -> DataFrame:
    one = ops.latest_per_key(t.part.where("p_size between 10 and 40"), ["p_name"], [F.asc("p_partkey")])
    return one.orderBy(F.desc("p_size"), "p_name").limit(20).select("p_name", "p_partkey", "p_size")


@query("seen_bounds", with_views("obs", "SELECT offer_id, CAST(min(observed_at) AS DATE) AS first_seen, CAST(max(observed_at) AS DATE) AS last_seen, count(*) AS n FROM obs GROUP BY offer_id"))
def seen_bounds(t: Tables) -> DataFrame:
    return t.observations().groupBy("offer_id").agg(F.to_date(F.min("observed_at")).alias("first_seen"), F.to_date(F.max("observed_at")).alias("last_seen"), F.count("*").alias("n"))


@query("running_low", with_views("obs", """
    SELECT offer_id, obs_id, item_cents, min(item_cents) OVER (PARTITION BY offer_id ORDER BY observed_at, obs_id, item_cents, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM obs"""))
def running_low(t: Tables) -> DataFrame:
    w = Window.partitionBy("offer_id").orderBy("observed_at", "obs_id", "item_cents", "line").rowsBetween(Window.unboundedPreceding, 0)
    return t.observations().select("offer_id", "obs_id", "item_cents", F.min("item_cents").over(w).alias("low"))


@query("catalogue_sort", """
    SELECT p_partkey, row_number() OVER (ORDER BY CASE p_type WHEN 'PROMO' THEN 0 ELSE 1 END, p_size DESC, lower(p_brand), p_partkey) AS recommended, row_number() OVER (ORDER BY CASE WHEN p_size % 7 > 0 THEN p_size END DESC NULLS LAST, p_partkey) AS newest,
        row_number() OVER (ORDER BY CASE WHEN p_size % 7 > 0 THEN p_size END NULLS LAST, p_partkey) AS oldest FROM part""")
def catalogue_sort(t: Tables) -> DataFrame:
    """The place of every part in three orders of the catalogue; the fourth is ``reference_order``."""
    rows = t.part.withColumn("year", F.when(F.col("p_size") % 7 > 0, F.col("p_size")))
    orders = {"recommended": [(F.col("p_type") != "PROMO").asc(), F.desc("p_size"), F.lower("p_brand").asc(), F.asc("p_partkey")], "newest": [F.col("year").desc_nulls_last(), F.asc("p_partkey")], "oldest": [F.col("year").asc_nulls_last(), F.asc("p_partkey")]}
    ranked = [ops.global_rank(rows, order).select("p_partkey", F.col("position").alias(name)) for name, order in orders.items()]
    return reduce(lambda a, b: a.join(b, "p_partkey"), ranked)


@query("reference_order", """
    SELECT p_partkey, p_brand, row_number() OVER (ORDER BY CASE WHEN regexp_matches(p_brand, '^Brand#[1-9]$') THEN 0 WHEN regexp_matches(p_brand, '^Brand#1[0-9]$') THEN 1 ELSE 2 END,
        TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) NULLS LAST, lower(p_name), p_partkey) AS position FROM part""")
def reference_order(t: Tables) -> DataFrame:
    group = F.when(F.col("p_brand").rlike("^Brand#[1-9]$"), 0).when(F.col("p_brand").rlike("^Brand#1[0-9]$"), 1).otherwise(2)
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("bigint")
    return ops.global_rank(t.part, [group.asc(), number.asc_nulls_last(), F.lower("p_name").asc(), F.asc("p_partkey")]).select("p_partkey", "p_brand", "position")


@query("reference_anchor", """
    WITH a AS (SELECT min(p_size) AS low FROM part WHERE p_brand = 'Brand#17')
    SELECT p_partkey, p_size FROM part, a WHERE a.low IS NOT NULL AND p_size >= a.low AND p_size <= a.low + 2 ORDER BY p_size, p_partkey LIMIT 36""")
def reference_anchor(t: Tables) -> DataFrame:
    anchor = t.part.where("p_brand = 'Brand#17'").agg(F.min("p_size").alias("low"))
    near = t.part.join(F.broadcast(anchor), (F.col("p_size") >= F.col("low")) & (F.col("p_size") <= F.col("low") + 2))
    return near.orderBy("p_size", "p_partkey").limit(36).select("p_partkey", "p_size")


@query("sort_by_child_agg", with_views("copies", "SELECT variant_id, count(*) AS n, CAST(max(created_at) AS DATE) AS latest FROM copies GROUP BY variant_id").replace("AS latest FROM", "AS latest, row_number() OVER (ORDER BY count(*) DESC, CAST(max(created_at) AS DATE) DESC, variant_id) AS position FROM"))
def sort_by_child_agg(t: Tables) -> DataFrame:
    by = t.copies().groupBy("variant_id").agg(F.count("*").alias("n"), F.to_date(F.max("created_at")).alias("latest"))
    return ops.global_rank(by, [F.desc("n"), F.desc("latest"), F.asc("variant_id")])


@query("exact_or_fuzzy", """
    WITH e AS (SELECT * FROM part WHERE p_name = 'blue bolt'), f AS (SELECT * FROM part WHERE contains(lower(p_name), 'blue bolt') AND NOT EXISTS (SELECT 1 FROM e))
    SELECT p_partkey, p_name FROM (SELECT * FROM e UNION ALL SELECT * FROM f) ORDER BY p_name, p_partkey LIMIT 24""")
def exact_or_fuzzy(t: Tables) -> DataFrame:
    exact = t.part.where("p_name = 'blue bolt'")
    fuzzy = t.part.where(F.contains(F.lower("p_name"), F.lit("blue bolt")))
    found = F.broadcast(exact.limit(1).select(F.lit(1).alias("found")))
    return exact.union(fuzzy.join(found, F.lit(True), "left_anti")).orderBy("p_name", "p_partkey").limit(24).select("p_partkey", "p_name")


@query("wishlist_page", with_views("wishes", "SELECT user_id, variant_id, max(priority) AS priority FROM wishes GROUP BY ALL ORDER BY priority DESC, variant_id DESC NULLS LAST, user_id LIMIT 100"))
def wishlist_page(t: Tables) -> DataFrame:
    top = t.wishes().groupBy("user_id", "variant_id").agg(F.max("priority").alias("priority"))
    return top.orderBy(F.desc("priority"), F.col("variant_id").desc_nulls_last(), "user_id").limit(100)


_REASONS = ["WISHLIST_PRIORITY", "WISHLIST_STANDARD", "RECENT_RELEASE", "COLLECTION_ROTATION"]


@query("tiered_targets", with_views("wishes copies", f"""
    , hours AS (SELECT unnest([0, 6, 12]) AS hour), s AS (SELECT hour, (946684800 + hour * 3600) // 21600 % 2 = 0 AS even, (946684800 + hour * 3600) // 21600 % 4 = 0 AS fourth FROM hours),
    g AS (SELECT 0 AS tier, variant_id FROM wishes WHERE priority = 1 GROUP BY 2 HAVING count(*) >= 4 UNION ALL SELECT 1, variant_id FROM wishes WHERE priority = 2 GROUP BY 2 HAVING count(*) >= 4 UNION ALL SELECT 2, p_partkey FROM part WHERE p_size > 45 UNION ALL SELECT 3, variant_id FROM copies),
    f AS (SELECT hour, variant_id, min(tier) AS tier FROM g, s WHERE tier = 0 OR tier IN (1, 2) AND even OR tier = 3 AND fourth GROUP BY ALL)
    SELECT hour, variant_id, ({_REASONS})[tier + 1] AS reason FROM f QUALIFY row_number() OVER (PARTITION BY hour ORDER BY tier, variant_id) <= 1500"""))
def tiered_targets(t: Tables) -> DataFrame:
    """Targets of three refreshes, six hours apart: standard wishes and releases in every second, the collection in every fourth."""
    wishes, parts = t.wishes(), t.part.where("p_size > 45").select(F.col("p_partkey").alias("variant_id"))
    wanted = [wishes.where(F.col("priority") == p).groupBy("variant_id").count().where("count >= 4") for p in (1, 2)]
    groups = [*wanted, parts, t.copies()]
    groups = [x.select("variant_id").withColumn("position", F.col("variant_id")) for x in groups]
    runs = []
    for hour in (0, 6, 12):
        due = ops.refresh_schedule(946684800 + hour * 3600)
        chosen = [(g, r) for g, r in zip(groups, _REASONS, strict=True) if due[r]]
        taken = ops.tiered_targets([g for g, _ in chosen], "variant_id", "position", 1500)
        runs.append(taken.select(F.lit(hour).alias("hour"), "variant_id", F.get(F.array(*[F.lit(r) for _, r in chosen]), F.col("tier")).alias("reason")))
    return reduce(DataFrame.union, runs)


@query("rotation_window", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS position, count(*) OVER () AS n FROM part) SELECT p_partkey, position FROM r WHERE ((position - 1 - 7 * 300) % n + n) % n < 300")
def rotation_window(t: Tables) -> DataFrame:
    ranked = ops.global_rank(t.part.select("p_retailprice", "p_partkey"), ["p_retailprice", "p_partkey"])
    return ops.rotation_window(ranked, "position", 300, 7).select("p_partkey", "position")


@query("even_sample", """
    WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS p, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, p AS position FROM r WHERE p = 1 OR floor((p - 1) * 50.0 / n) > floor((p - 2) * 50.0 / n) OR c_custkey IN (3, 5)""")
def even_sample(t: Tables) -> DataFrame:
    ranked = ops.global_rank(t.customer.select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"])
    return ops.even_sample(ranked, "position", 50, F.col("c_custkey").isin(3, 5)).select("c_custkey", "position")


@query("union_distinct", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity < 3 UNION SELECT p_partkey FROM part WHERE p_size = 7")
def union_distinct(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity < 3").select(F.col("l_partkey").alias("id")).union(t.part.where("p_size = 7").select("p_partkey")).distinct()


@query("segment_overlap", """
    WITH s AS (SELECT p_partkey AS id, 'large' AS reason FROM part WHERE p_size >= 30 UNION ALL SELECT p_partkey, 'promo' FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey, 'cheap' FROM part WHERE p_retailprice < 1000)
    SELECT a.reason AS a, b.reason AS b, count(DISTINCT a.id) AS n FROM s a JOIN s b ON a.id = b.id AND a.reason < b.reason GROUP BY ALL""")
def segment_overlap(t: Tables) -> DataFrame:
    p = t.part
    segments = {"large": "p_size >= 30", "promo": "p_type = 'PROMO'", "cheap": "p_retailprice < 1000"}
    # One pass: the reasons of an id are an array, and pairs are made within it.
    reasons = p.select("p_partkey", F.array_sort(F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in segments.items()]), lambda x: x.isNotNull())).alias("r"))
    pairs = reasons.select("p_partkey", "r", F.posexplode("r").alias("i", "a")).select("p_partkey", "a", F.explode(F.slice("r", F.col("i") + 2, len(segments))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count_distinct("p_partkey").alias("n"))
