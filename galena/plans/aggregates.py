"""Aggregates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.operators import aggregates as ops
from galena.operators.windows import latest_per_key
from galena.plans.base import query
from galena.sources.views import Tables, with_views


@query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def group_count(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("filtered_agg", "SELECT l_returnflag, count(DISTINCT l_partkey) FILTER (WHERE l_discount > 0.05) AS discounted, count(DISTINCT l_suppkey) FILTER (WHERE l_tax = 0) AS untaxed FROM lineitem GROUP BY 1")
def filtered_agg(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("discounted"), F.count_distinct(F.when(F.col("l_tax") == 0, F.col("l_suppkey"))).alias("untaxed"))


@query("bool_or_flags", "SELECT l_partkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_quantity > 48) AS bulk, bool_or(l_discount = 0) AS full_price FROM lineitem GROUP BY 1")
def bool_or_flags(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_quantity") > 48).alias("bulk"), F.bool_or(F.col("l_discount") == 0).alias("full_price"))


@query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14")
def having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 14")


@query("share_of_total", "SELECT p_type, p_size, count(*) AS n, CAST(floor(count(*) * 10000 / sum(count(*)) OVER ()) AS BIGINT) AS share FROM part GROUP BY 1, 2")
def share_of_total(t: Tables) -> DataFrame:
    return ops.share_of_total(t.part, ["p_type", "p_size"])


@query("coverage_metrics", with_views("copies", """
    , c AS (SELECT count(*) AS total, count(is_complete) AS is_complete, count(has_box) AS has_box, count(price_cents) AS price_cents, count(*) FILTER (WHERE condition <> 'UNKNOWN') AS condition FROM copies)
    SELECT field, present, total, CAST(CASE WHEN total > 0 THEN floor(present * 10000 / total) ELSE 0 END AS BIGINT) AS percent FROM (UNPIVOT c ON is_complete, has_box, price_cents, condition INTO NAME field VALUE present)"""))
def coverage_metrics(t: Tables) -> DataFrame:
    return ops.coverage(t.copies(), {"is_complete": F.col("is_complete").isNotNull(), "has_box": F.col("has_box").isNotNull(), "price_cents": F.col("price_cents").isNotNull(), "condition": F.col("condition") != "UNKNOWN"})


@query("by_year_decade", "SELECT year(o_orderdate) AS year, CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS decade, count(*) AS n FROM orders GROUP BY 1, 2")
def by_year_decade(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    return t.orders.groupBy(year.alias("year"), (F.floor(year / 10) * 10).cast("long").alias("decade")).agg(F.count("*").alias("n"))


@query("group_stats", """
    SELECT count(*) FILTER (WHERE n > 1) AS several, count(*) FILTER (WHERE n > 1 AND has) AS several_with_class, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS superfluous FROM (SELECT p_name, count(DISTINCT p_partkey) AS n, bool_or(p_type = 'PROMO') AS has FROM part GROUP BY 1)""")
def group_stats(t: Tables) -> DataFrame:
    return ops.group_stats(t.part, "p_name", "p_partkey", "p_type", "PROMO")


@query("source_rollup", "SELECT l_suppkey, count(*) AS records, count(DISTINCT l_partkey) AS refs, CAST(max(l_shipdate) AS DATE) AS latest, max_by(l_orderkey, (l_shipdate, l_orderkey)) AS latest_run FROM lineitem GROUP BY 1")
def source_rollup(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("records"), F.count_distinct("l_partkey").alias("refs"), F.to_date(F.max("l_shipdate")).alias("latest"), F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("latest_run"))


@query("quality_summary", with_views("copies", """
    , q AS (SELECT count(*) FILTER (WHERE has_box) AS a, count(*) FILTER (WHERE NOT has_box) AS b, count(*) FILTER (WHERE has_box IS NULL) AS c, count(*) FILTER (WHERE is_complete) AS d, count(*) FILTER (WHERE NOT is_complete) AS e, count(*) FILTER (WHERE is_complete IS NULL) AS f, count(price_cents) AS g, count(*) - count(price_cents) AS h FROM copies)
    SELECT 'has_box' AS field, 'yes' AS state, a AS n FROM q UNION ALL SELECT 'has_box', 'no', b FROM q UNION ALL SELECT 'has_box', 'unknown', c FROM q UNION ALL SELECT 'is_complete', 'yes', d FROM q UNION ALL SELECT 'is_complete', 'no', e FROM q
    UNION ALL SELECT 'is_complete', 'unknown', f FROM q UNION ALL SELECT 'price_cents', 'known', g FROM q UNION ALL SELECT 'price_cents', 'unknown', h FROM q"""))
def quality_summary(t: Tables) -> DataFrame:
    return ops.quality_summary(t.copies(), ["has_box", "is_complete"], ["price_cents"])


@query("membership_totals", with_views("copies", """
    , m AS (SELECT p_partkey, n_nationkey AS theme FROM part JOIN nation ON n_nationkey = p_size % 25 UNION SELECT l_partkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT theme, count(*) AS total, count(*) FILTER (WHERE p_partkey NOT IN (SELECT variant_id FROM copies)) AS missing FROM m GROUP BY theme"""))
def membership_totals(t: Tables) -> DataFrame:
    """Themes of products and of variants as bits of each variant, against the variants that are owned."""
    inherited = t.part.select((F.col("p_size") % 25).cast("int").alias("theme"), "p_partkey").join(t.nation.select(F.col("n_nationkey").alias("theme")), "theme", "left_semi")
    place = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("theme"))
    own = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(place, "l_suppkey").select("theme", "p_partkey")
    held = t.copies().select(F.col("variant_id").alias("p_partkey"))
    return ops.membership_totals(inherited.unionByName(own), held, "theme", "p_partkey")


_STATES = "states AS (SELECT variant_id, bool_or(o) AS owned, bool_or(w) AS wanted FROM (SELECT variant_id, TRUE AS o, FALSE AS w FROM copies UNION ALL SELECT variant_id, FALSE, TRUE FROM wishes) GROUP BY 1)"


def states(t: Tables) -> DataFrame:
    own = t.copies().select("variant_id").distinct().select("variant_id", F.lit(True).alias("owned"), F.lit(False).alias("wanted"))
    return own.union(t.wishes().select("variant_id").distinct().select("variant_id", F.lit(False), F.lit(True)))


@query("progress", with_views("copies wishes", f""", {_STATES}
    SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE owned) AS owned, count(*) FILTER (WHERE NOT coalesce(owned, FALSE) AND wanted) AS wanted, count(*) FILTER (WHERE NOT coalesce(owned, FALSE) AND NOT coalesce(wanted, FALSE)) AS missing FROM part LEFT JOIN states ON variant_id = p_partkey GROUP BY p_brand"""))
def progress(t: Tables) -> DataFrame:
    return ops.progress(t.part.select("p_brand", F.col("p_partkey").alias("variant_id")), states(t), "p_brand", "variant_id")


@query("market_overview", """
    SELECT s_nationkey AS market, count(DISTINCT l_partkey) AS variants, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'N') AS normal, count(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def market_overview(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    # Distinct (market, variant) first, so only flags are aggregated after the shuffle.
    per = rows.groupBy("s_nationkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "N").alias("n"), F.bool_or(F.col("l_linestatus") == "O").alias("o"))
    return per.groupBy(F.col("s_nationkey").alias("market")).agg(F.count("*").alias("variants"), F.count_if("r").alias("returned"), F.count_if("n").alias("normal"), F.count_if("o").alias("open"))


@query("context_groups", "SELECT p_type, p_name, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY count(DISTINCT p_partkey) DESC, p_name) <= 20")
def context_groups(t: Tables) -> DataFrame:
    groups = t.part.groupBy("p_type", "p_name").agg(F.count_distinct("p_partkey").alias("n"))
    return latest_per_key(groups, ["p_type"], [F.desc("n"), F.asc("p_name")], 20)


@query("collection_insights", with_views("copies", """
    SELECT 'theme' AS section, p_type AS key, count(*) AS n FROM copies JOIN part ON p_partkey = variant_id GROUP BY 2 UNION ALL SELECT 'year', CAST(year(created_at) AS VARCHAR), count(*) FROM copies GROUP BY 2
    UNION ALL SELECT 'total', 'copies', count(*) FROM copies UNION ALL SELECT 'total', 'variants', count(DISTINCT variant_id) FROM copies"""))
def collection_insights(t: Tables) -> DataFrame:
    """All sections from one pass over (type, year, variant) counts."""
    c = t.copies().join(t.part.select(F.col("p_partkey").alias("variant_id"), "p_type"), "variant_id", "left")
    cube = c.groupingSets([[F.col("p_type")], [F.year("created_at")], []], F.col("p_type"), F.year("created_at")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"), F.count_distinct("variant_id").alias("v"))
    cube = cube.toDF("p_type", "year", "n", "g", "v")
    total = cube.where("g = 3").select(F.explode(F.array(F.struct(F.lit("total").alias("section"), F.lit("copies").alias("key"), F.col("n").alias("n")), F.struct(F.lit("total").alias("section"), F.lit("variants").alias("key"), F.col("v").alias("n")))).alias("r")).select("r.*")
    parts = cube.where("g < 3").select(F.when(F.col("g") == 1, "theme").otherwise("year").alias("section"), F.when(F.col("g") == 1, F.col("p_type")).otherwise(F.col("year").cast("string")).alias("key"), "n")
    return parts.union(total)


@query("agreement_or_null", "SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS l_linestatus FROM lineitem GROUP BY 1")
def agreement_or_null(t: Tables) -> DataFrame:
    return ops.agreement_or_null(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("contradictions", """
    WITH p AS (SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' THEN l_linestatus END) AS a1, max(CASE WHEN l_returnflag = 'N' THEN l_linestatus END) AS b1, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS a2, max(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS b2 FROM lineitem GROUP BY 1)
    SELECT l_partkey, 'l_linestatus' AS field, a1 AS "left", b1 AS "right" FROM p WHERE a1 <> b1 UNION ALL SELECT l_partkey, 'l_linenumber', CAST(a2 AS VARCHAR), CAST(b2 AS VARCHAR) FROM p WHERE a2 <> b2""")
def contradictions(t: Tables) -> DataFrame:
    return ops.contradictions(t.lineitem, "l_partkey", "l_returnflag", "R", "N", ["l_linestatus", "l_linenumber"])


@query("logical_duplicates", "SELECT l_orderkey, l_partkey, array_to_string(list_sort(list(l_linenumber)), ',') AS lines FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def logical_duplicates(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines")).where(F.size("lines") > 1)
    return groups.select("l_orderkey", "l_partkey", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("identifier_collisions", "SELECT p_brand, p_size, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS members FROM part WHERE p_type <> 'PROMO' GROUP BY 1, 2 HAVING count(DISTINCT p_name) > 1")
def identifier_collisions(t: Tables) -> DataFrame:
    return ops.collisions(t.part, ["p_brand", "p_size"], "p_name", F.col("p_type") == "PROMO").select("p_brand", "p_size", F.array_join("members", "|").alias("members"))


@query("coverage_by_year", """
    WITH f AS (SELECT l_partkey, bool_or(l_discount > 0.08) AS deal, bool_or(l_tax = 0) AS free FROM lineitem GROUP BY 1)
    SELECT year(l_shipdate) AS year, count(DISTINCT l_partkey) AS refs, count(DISTINCT l_partkey) FILTER (WHERE deal) AS deals, count(DISTINCT l_partkey) FILTER (WHERE free) AS frees FROM lineitem JOIN f USING (l_partkey) GROUP BY 1""")
def coverage_by_year(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy("l_partkey").agg(F.bool_or(F.col("l_discount") > 0.08).alias("deal"), F.bool_or(F.col("l_tax") == 0).alias("free"))
    years = t.lineitem.select("l_partkey", F.year("l_shipdate").alias("year")).distinct()
    return years.join(flags, "l_partkey").groupBy("year").agg(F.count("*").alias("refs"), F.count_if("deal").alias("deals"), F.count_if("free").alias("frees"))


@query("segment_coverage", with_views("copies wishes", """
    , s AS (SELECT p_partkey AS variant_id, 'large' AS segment FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, 'promo' FROM part WHERE p_type = 'PROMO' UNION ALL SELECT DISTINCT variant_id, 'wanted' FROM wishes WHERE priority = 1)
    SELECT segment, count(*) AS n, count(c.variant_id) AS owned, count(w.variant_id) AS wished FROM s LEFT JOIN (SELECT DISTINCT variant_id FROM copies) c USING (variant_id) LEFT JOIN (SELECT DISTINCT variant_id FROM wishes) w USING (variant_id) GROUP BY 1"""))
def segment_coverage(t: Tables) -> DataFrame:
    v = t.variants()
    return ops.segment_coverage({"large": v.where("p_size > 30"), "promo": v.where("p_type = 'PROMO'"), "wanted": t.wishes().where("priority = 1")}, {"owned": t.copies(), "wished": t.wishes()}, "variant_id")


@query("base_usage", "SELECT p_partkey // 10 AS base, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1")
def base_usage(t: Tables) -> DataFrame:
    return t.part.groupBy(F.floor(F.col("p_partkey") / 10).alias("base")).agg(F.count_distinct("p_partkey").alias("n"))


@query("transition_counts", """
    WITH k AS (SELECT event_id, user_id, event_type AS old, CASE WHEN event_type = 'signup' AND value > 50 THEN 'purchase' WHEN event_type = 'error' THEN 'view' ELSE event_type END AS new FROM events)
    SELECT old, new, count(*) AS n, count(*) FILTER (WHERE old <> new AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = k.user_id AND e.event_type = k.new)) AS collisions FROM k GROUP BY 1, 2""")
def transition_counts(t: Tables) -> DataFrame:
    new = F.when((F.col("event_type") == "signup") & (F.col("value") > 50), "purchase").when(F.col("event_type") == "error", "view").otherwise(F.col("event_type"))
    rows = t.events.select("user_id", F.col("event_type").alias("old"), new.alias("new"))
    held = t.events.select("user_id", F.col("event_type").alias("new")).distinct().withColumn("held", F.lit(True))
    return rows.join(held, ["user_id", "new"], "left").groupBy("old", "new").agg(F.count("*").alias("n"), F.count_if((F.col("old") != F.col("new")) & F.col("held").isNotNull()).alias("collisions"))


@query("collect_sorted_set", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers FROM lineitem GROUP BY 1")
def collect_sorted_set(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("suppliers"))


@query("evidence_matrix", """
    SELECT 'before' AS state, s_nationkey AS market, l_returnflag AS kind, count(*) AS evidence, count(DISTINCT l_partkey) AS variants, count(DISTINCT p_name) AS products FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 2, 3
    UNION ALL SELECT 'after', s_nationkey, CASE WHEN l_discount = 0 THEN 'X' ELSE l_returnflag END, count(*), count(DISTINCT l_partkey), count(DISTINCT p_name) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 2, 3""")
def evidence_matrix(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    after = F.when(F.col("l_discount") == 0, "X").otherwise(F.col("l_returnflag"))
    both = F.explode(F.array(F.struct(F.lit("before").alias("state"), F.col("l_returnflag").alias("kind")), F.struct(F.lit("after").alias("state"), after.alias("kind"))))
    told = rows.select(F.col("s_nationkey").alias("market"), "l_partkey", "p_name", both.alias("e")).select("market", "l_partkey", "p_name", "e.*")
    return told.groupBy("state", "market", "kind").agg(F.count("*").alias("evidence"), F.count_distinct("l_partkey").alias("variants"), F.count_distinct("p_name").alias("products"))


@query("reference_profile", "SELECT length(CAST(o_orderkey AS VARCHAR)) AS digits, o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1, 2")
def reference_profile(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.length(F.col("o_orderkey").cast("string")).alias("digits"), F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("n"))


@query("year_profile", """
    SELECT year(l_shipdate) AS year, count(DISTINCT p_name) AS products, count(DISTINCT l_partkey) AS variants, count(DISTINCT l_partkey) FILTER (WHERE p_type = 'STANDARD') AS standard, CAST(floor(count(*) * 10000 / (SELECT count(*) FROM lineitem)) AS BIGINT) AS share FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def year_profile(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    per = rows.groupBy(F.year("l_shipdate").alias("year")).agg(F.count_distinct("p_name").alias("products"), F.count_distinct("l_partkey").alias("variants"), F.count_distinct(F.when(F.col("p_type") == "STANDARD", F.col("l_partkey"))).alias("standard"), F.count("*").alias("n"))
    total = t.lineitem.agg(F.count("*").alias("total"))
    return per.join(F.broadcast(total)).select("year", "products", "variants", "standard", ops.percent(F.col("n"), F.col("total")).alias("share"))


@query("market_field_coverage", """
    WITH e AS (SELECT l_partkey, bool_or(l_discount > 0.05) AS any_deal, bool_or(l_discount > 0.05 AND s_nationkey = 3) AS deal_3, bool_or(l_discount > 0.05 AND s_nationkey = 7) AS deal_7 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1), c AS (SELECT count(*) FILTER (WHERE any_deal) AS any_deal, count(*) FILTER (WHERE deal_3) AS deal_3, count(*) FILTER (WHERE deal_7) AS deal_7 FROM e)
    SELECT field, n FROM (UNPIVOT c ON any_deal, deal_3, deal_7 INTO NAME field VALUE n)""")
def market_field_coverage(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    deal = F.col("l_discount") > 0.05
    per = rows.groupBy("l_partkey").agg(F.bool_or(deal).alias("any_deal"), F.bool_or(deal & (F.col("s_nationkey") == 3)).alias("deal_3"), F.bool_or(deal & (F.col("s_nationkey") == 7)).alias("deal_7"))
    names = ["any_deal", "deal_3", "deal_7"]
    return per.agg(*[F.count_if(n).alias(n) for n in names]).unpivot([], names, "field", "n")


@query("taxonomy_grouping_sets", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), (p_type, p_brand), ())")
def taxonomy_grouping_sets(t: Tables) -> DataFrame:
    a, b = F.col("p_type"), F.col("p_brand")
    return t.part.groupingSets([[a], [b], [a, b], []], a, b).agg(F.count("*").alias("n"))


@query("report_long", """
    SELECT 'status' AS section, o_orderstatus AS key, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2 UNION ALL SELECT 'type', p_type, CAST(count(*) AS DOUBLE) FROM part GROUP BY 2""")
def report_long(t: Tables) -> DataFrame:
    from galena.sources.tables import report_long as long

    def by(df: DataFrame, c: str) -> DataFrame:
        return df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("value"))

    return long({"status": by(t.orders, "o_orderstatus"), "type": by(t.part, "p_type")})


@query("unique_order_audit", "SELECT conv_id, count(*) AS turns, count(*) - count(DISTINCT turn) AS repeated, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM conversations GROUP BY 1")
def unique_order_audit(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.count("*") - F.count_distinct("turn")).alias("repeated"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))


@query("unique_match_count", "SELECT p_name, p_size, p_partkey, count(*) OVER (PARTITION BY p_name, p_size) AS n FROM part")
def unique_match_count(t: Tables) -> DataFrame:
    return t.part.select("p_name", "p_size", "p_partkey", F.count("*").over(Window.partitionBy("p_name", "p_size")).alias("n"))
