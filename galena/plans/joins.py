"""Filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators import digest_tree, filters, identity, joins, search_index
from galena.operators.windows import latest_per_key
from galena.plans.base import AS_OF, query
from galena.plans.windows import LATEST_SQL, latest_first
from galena.sources.tables import append_new, scratch
from galena.sources.tables import upsert_latest as upsert
from galena.sources.views import Tables, with_views


@query("scan_tables", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 30")
def scan_tables(t: Tables) -> DataFrame:
    return t.part.where("p_size > 30").select("p_partkey", "p_name", "p_size")


@query("effective_year", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_tax > 0.03 THEN year(l_shipdate) END, year(o_orderdate)) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def effective_year(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.when(F.col("l_tax") > 0.03, F.year("l_shipdate")), F.year("o_orderdate")).alias("year"))


@query("effective_date", """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderstatus = 'O' THEN make_date(year(o_orderdate), 1, 1) END) AS day FROM orders""")
def effective_date(t: Tables) -> DataFrame:
    year = F.when(F.col("o_orderstatus") == "O", F.year("o_orderdate"))
    day = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")), F.make_date(year, F.lit(1), F.lit(1)))
    return t.orders.select("o_orderkey", day.alias("day"))


@query("search_contains", """
    SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(s_name), '0007') OR contains(lower(n_name), 'nation_1')
        OR EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND contains(lower(p_name), 'blue bolt'))""")
def search_contains(t: Tables) -> DataFrame:
    rows = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))
    # Names are searched before the lines are read for them, through an index of their trigrams.
    index = search_index.trigrams(t.part, "p_partkey", "p_name")
    named = search_index.contains(index, t.part, "p_partkey", "p_name", "Blue Bolt").select(F.col("p_partkey").alias("l_partkey"))
    sold = t.lineitem.select("l_partkey", "l_suppkey").join(named, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("s_suppkey"))
    return filters.search(rows, "0007", ["s_name"]).unionByName(filters.search(rows, "nation_1", ["n_name"])).unionByName(rows.join(sold, "s_suppkey", "left_semi").select(*rows.columns)).select("s_suppkey", "s_name").distinct()


@query("search_children", """
    SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), 'r#00000001') OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND contains(lower(n_name), 'r#00000001'))
        OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND contains(lower(c_name), 'r#00000001'))""")
def search_children(t: Tables) -> DataFrame:
    return filters.search(t.supplier, "R#00000001", ["s_name"], [(t.nation, "n_nationkey", "s_nationkey", "n_name"), (t.customer, "c_nationkey", "s_nationkey", "c_name")]).select("s_suppkey")


_TREE_SQL = """tree AS (SELECT n_nationkey AS node, n_name AS name, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey),
    own AS (SELECT DISTINCT l_partkey AS key, s_nationkey AS node FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_type <> 'STANDARD'),
    inh AS (SELECT p_partkey AS key, CAST(p_size % 25 AS INT) AS node FROM part)"""


def _tree(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    tree = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    # Parts of the standard type have no nodes of their own: they take those of their product. Lines become pairs before any join.
    sold = t.lineitem.select(F.col("l_partkey").alias("key"), "l_suppkey").distinct().join(t.part.where("p_type <> 'STANDARD'").select(F.col("p_partkey").alias("key")), "key", "left_semi")
    own = sold.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("key", F.col("s_nationkey").alias("node")).distinct()
    return own, t.part.select(F.col("p_partkey").alias("key"), (F.col("p_size") % 25).cast("int").alias("node")), tree


@query("filter_hierarchy_override", f"""
    WITH {_TREE_SQL} SELECT DISTINCT key FROM (SELECT * FROM own UNION ALL SELECT * FROM inh WHERE key NOT IN (SELECT key FROM own)) JOIN tree USING (node) WHERE name = 'ASIA' OR parent = 'ASIA'""")
def filter_hierarchy_override(t: Tables) -> DataFrame:
    own, inherited, tree = _tree(t)
    return filters.filter_hierarchy(own, inherited, tree, "key", "node", "name", "parent", "ASIA")


@query("filter_membership_union", f"WITH {_TREE_SQL} SELECT DISTINCT key FROM (SELECT * FROM own UNION ALL SELECT * FROM inh) JOIN tree USING (node) WHERE name = 'NATION_3'")
def filter_membership_union(t: Tables) -> DataFrame:
    own, inherited, tree = _tree(t)
    return filters.filter_hierarchy(own, inherited, tree.withColumn("parent", F.lit(None).cast("string")), "key", "node", "name", "parent", "NATION_3", mode="union")


@query("filter_child_all", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40 AND l_discount < 0.02 AND l_returnflag = 'R')")
def filter_child_all(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return filters.filter_child_all(t.orders.select("o_orderkey"), lines, "o_orderkey", [F.col("l_quantity") > 40, F.col("l_discount") < 0.02, F.col("l_returnflag") == "R"])


@query("filter_tristate", with_views("copies", """
    SELECT 'yes' AS wanted, count(*) AS n FROM copies WHERE has_box IS TRUE UNION ALL SELECT 'no', count(*) FROM copies WHERE has_box IS FALSE UNION ALL SELECT 'unknown', count(*) FROM copies WHERE has_box IS NULL"""))
def filter_tristate(t: Tables) -> DataFrame:
    c = t.copies()
    n = c.agg(*[F.count_if(filters.tristate("has_box", w)).alias(w) for w in ("yes", "no", "unknown")])
    return n.unpivot([], ["yes", "no", "unknown"], "wanted", "n")


@query("needs_review", with_views("copies", "SELECT copy_id, variant_id, price_cents FROM copies WHERE condition = 'UNKNOWN' OR is_complete IS NULL OR has_box IS NULL OR price_cents IS NULL"))
def needs_review(t: Tables) -> DataFrame:
    unknown = (F.col("condition") == "UNKNOWN") | F.col("is_complete").isNull() | F.col("has_box").isNull() | F.col("price_cents").isNull()
    return t.copies().where(unknown).select("copy_id", "variant_id", "price_cents")


@query("inventory_scope", with_views("copies", "SELECT copy_id, variant_id FROM copies WHERE condition = 'USED' AND is_complete IS TRUE AND has_box IS NOT TRUE AND year(created_at) = 1998"))
def inventory_scope(t: Tables) -> DataFrame:
    c = t.copies().where("condition = 'USED'").where(filters.tristate("is_complete", "yes")).where(~filters.tristate("has_box", "yes"))
    return c.where(F.year("created_at") == 1998).select("copy_id", "variant_id")


@query("commercial_reference", """
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS reference FROM part WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '^([0-9]{3,4}|7[0-2][0-9]{3})$')
        AND NOT regexp_matches(CAST(p_partkey AS VARCHAR), '^0+$') AND p_type NOT IN ('PROMO', 'ECONOMY') AND coalesce(CASE WHEN p_size > 5 THEN p_brand END, '') <> 'Brand#9'""")
def commercial_reference(t: Tables) -> DataFrame:
    reference = F.col("p_partkey").cast("string")
    number = reference.rlike("^([0-9]{3,4}|7[0-2][0-9]{3})$") & ~reference.rlike("^0+$")
    brand = F.coalesce(F.when(F.col("p_size") > 5, F.col("p_brand")), F.lit(""))
    return t.part.where(number & ~F.col("p_type").isin("PROMO", "ECONOMY") & (brand != "Brand#9")).select("p_partkey", reference.alias("reference"))


@query("visible_media", "SELECT page_id FROM pages WHERE url <> 'https://example.com/placeholder.jpg' AND (CASE WHEN page_id % 3 > 0 THEN page_id % 3 = 1 END) IS DISTINCT FROM FALSE")
def visible_media(t: Tables) -> DataFrame:
    shown = F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 3 == 1)
    return t.pages.where((F.col("url") != "https://example.com/placeholder.jpg") & ~shown.eqNullSafe(F.lit(False))).select("page_id")


@query("url_allowlist", r"""
    SELECT page_id, CASE WHEN starts_with(url, 'https://') AND lower(regexp_extract(url, '^https?://([^/?#:@]+)(?:[/?#]|$)', 1)) IN (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:@]+)', 1)) FROM pages WHERE page_id < 40) THEN url END AS url FROM pages""")
def url_allowlist(t: Tables) -> DataFrame:
    """The allowed hosts are themselves a table here, so the list is a semi join."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:@]+)(?:[/?#]|$)", 1))
    hosts = t.pages.where("page_id < 40").select(F.lower(F.regexp_extract("url", "^https?://([^/?#:@]+)", 1)).alias("host")).distinct().withColumn("ok", F.lit(True))
    rows = t.pages.withColumn("host", host).join(hosts, "host", "left")
    return rows.select("page_id", F.when(F.col("ok") & F.col("url").startswith("https://"), F.col("url")).alias("url"))


@query("fresh_within", with_views("obs", f"SELECT offer_id, obs_id, item_cents FROM obs WHERE observed_at <= TIMESTAMP '{AS_OF}' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR"))
def fresh_within(t: Tables) -> DataFrame:
    return t.observations().where(filters.fresh_within("observed_at", AS_OF, 720)).select("offer_id", "obs_id", "item_cents")


@query("join_inner", "SELECT l_suppkey, n_name, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def join_inner(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    named = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey"))
    return per.join(named, F.col("s_suppkey") == F.col("l_suppkey")).select("l_suppkey", "n_name", "n", "quantity")


@query("join_left_facts", with_views("copies wishes", """
    SELECT p_partkey, coalesce(c.n, 0) AS copies, coalesce(w.n, 0) AS wishes, o.low FROM part
    LEFT JOIN (SELECT variant_id, count(*) AS n FROM copies GROUP BY 1) c ON c.variant_id = p_partkey LEFT JOIN (SELECT variant_id, count(*) AS n FROM wishes GROUP BY 1) w ON w.variant_id = p_partkey
    LEFT JOIN (SELECT l_partkey, min(l_quantity) AS low FROM lineitem GROUP BY 1) o ON o.l_partkey = p_partkey"""))
def join_left_facts(t: Tables) -> DataFrame:
    out = t.part.select("p_partkey")
    for name, df in (("copies", t.copies().groupBy("variant_id").agg(F.count("*").alias("copies"))), ("wishes", t.wishes().groupBy("variant_id").agg(F.count("*").alias("wishes"))), ("low", t.lineitem.groupBy(F.col("l_partkey").alias("variant_id")).agg(F.min("l_quantity").alias("low")))):
        out = out.join(df.withColumnRenamed("variant_id", f"__{name}"), F.col("p_partkey") == F.col(f"__{name}"), "left")
    return out.select("p_partkey", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("wishes", F.lit(0)).alias("wishes"), "low")


@query("lateral_top1", """
    SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey""")
def lateral_top1(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return joins.lateral_top1(t.customer.select("c_custkey"), orders, "c_custkey", [(F.col("o_orderstatus") != "F").asc(), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("or_join", "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey OR p_partkey = l_suppkey")
def or_join(t: Tables) -> DataFrame:
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_partkey"]
    return joins.or_join(left, t.part.select("p_partkey"), [("l_partkey", "p_partkey"), ("l_suppkey", "p_partkey")], keys).select(*keys)


@query("parent_self_join", """
    SELECT c.n_name AS child, p.n_name AS parent FROM nation c LEFT JOIN nation p ON p.n_nationkey = c.n_regionkey""")
def parent_self_join(t: Tables) -> DataFrame:
    child, parent = t.nation.alias("c"), t.nation.alias("p")
    return child.join(parent, F.col("p.n_nationkey") == F.col("c.n_regionkey"), "left").select(F.col("c.n_name").alias("child"), F.col("p.n_name").alias("parent"))


@query("json_unnest", """
    SELECT event_id, unnest(ARRAY[CAST(k AS VARCHAR), CAST(k % 7 AS VARCHAR)]) AS tag FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""")
def json_unnest(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    tags = t.events.select("event_id", F.to_json(F.array(k.cast("string"), (k % 7).cast("string"))).alias("tags"))
    return tags.select("event_id", F.explode(F.from_json("tags", "array<string>")).alias("tag"))


@query("expand_quantity", with_views("copies", """
    SELECT copy_id, variant_id, unit, CASE WHEN unit = 1 THEN price_cents END AS price_cents FROM (SELECT *, unnest(range(1, greatest(quantity, 1) + 1)) AS unit FROM copies)"""))
def expand_quantity(t: Tables) -> DataFrame:
    return joins.expand_quantity(t.copies(), "quantity", ["price_cents"]).select("copy_id", "variant_id", F.col("unit").cast("long").alias("unit"), "price_cents")


@query("join_value_list", "SELECT place, p_partkey, p_name FROM (VALUES (1, 17), (2, 4), (3, 99), (4, 100000000)) v(place, ref) JOIN part ON p_partkey = ref")
def join_value_list(t: Tables) -> DataFrame:
    listed = t.spark.createDataFrame([(1, 17), (2, 4), (3, 99), (4, 100000000)], "place int, ref long")
    return t.part.join(F.broadcast(listed), F.col("p_partkey") == F.col("ref")).select("place", "p_partkey", "p_name")


@query("promotion_join", with_views("obs lp", f"""
    , l AS (SELECT variant_id, market_id, list_cents FROM lp QUALIFY row_number() OVER (PARTITION BY variant_id, market_id ORDER BY observed_at DESC, obs_id DESC, list_cents DESC) = 1),
    o AS (SELECT variant_id, market_id, item_cents FROM obs QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY {LATEST_SQL}) = 1)
    SELECT count(*) AS comparable, count(*) FILTER (WHERE item_cents < list_cents) AS promotions FROM o JOIN l USING (variant_id, market_id)""").replace("\n\n    , l", ", l"))
def promotion_join(t: Tables) -> DataFrame:
    listed = latest_per_key(t.list_prices(), ["variant_id", "market_id"], [F.desc("observed_at"), F.desc("obs_id"), F.desc("list_cents")]).select("variant_id", "market_id", "list_cents")
    offers = latest_per_key(t.observations(), ["offer_id"], latest_first()).select("variant_id", "market_id", "item_cents")
    return offers.join(listed, ["variant_id", "market_id"]).agg(F.count("*").alias("comparable"), F.count_if(F.col("item_cents") < F.col("list_cents")).alias("promotions"))


@query("pairs_within_group", """
    SELECT a.c_nationkey, least(a.c_mktsegment, b.c_mktsegment) AS segment, greatest(a.c_mktsegment, b.c_mktsegment) AS other, count(*) AS pairs FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey GROUP BY ALL""")
def pairs_within_group(t: Tables) -> DataFrame:
    """Pairs of customers of a nation by their segments: classes of customers are paired, and tell how many pairs of customers they stand for."""
    classes, _ = identity.fold_classes(t.customer.select("c_nationkey", "c_custkey", "c_mktsegment"), "c_nationkey", "c_custkey")
    pairs = identity.class_pairs(classes, "c_nationkey", lambda p: p)
    ends = [f("left_c_mktsegment", "right_c_mktsegment").alias(c) for f, c in ((F.least, "segment"), (F.greatest, "other"))]
    return pairs.select("c_nationkey", *ends, F.col("pairs").cast("long").alias("pairs"))


_SNAP_SQL = "SELECT l_partkey AS ref, max({0}) AS v FROM lineitem WHERE year(l_shipdate) {1} GROUP BY 1"


@query("snapshot_diff", f"""
    WITH a AS ({_SNAP_SQL.format("l_quantity", "< 2000")}), b AS ({_SNAP_SQL.format("l_quantity", ">= 2000")})
    SELECT coalesce(a.ref, b.ref) AS ref, CASE WHEN a.ref IS NULL THEN 'added' WHEN b.ref IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.ref = b.ref""")
def snapshot_diff(t: Tables) -> DataFrame:
    def of(years: str) -> DataFrame:
        return t.lineitem.where(f"year(l_shipdate) {years}").groupBy(F.col("l_partkey").alias("ref")).agg(F.max("l_quantity").alias("v"))

    return joins.snapshot_diff(of("< 2000"), of(">= 2000"), "ref", ["v"])


@query("unique_match_join", """
    SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)""")
def unique_match_join(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    return joins.unique_match_join(t.orders.select("o_orderkey"), lines, "o_orderkey")[0]


@query("preference_lookup", """
    SELECT s_suppkey, l_orderkey, preference FROM (SELECT s_suppkey, l_orderkey, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS preference, l_shipdate, l_partkey, l_linenumber
        FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey)
    QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY preference, l_shipdate DESC NULLS LAST, l_orderkey, l_partkey, l_linenumber) = 1""")
def preference_lookup(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    both = F.coalesce((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.lit(False))
    out = joins.preference_join(t.supplier.select("s_suppkey"), lines, "s_suppkey", [both, F.coalesce(F.col("l_returnflag") == "R", F.lit(False))], [F.col("l_shipdate").desc_nulls_last(), "l_orderkey", "l_partkey", "l_linenumber"])
    return out.select("s_suppkey", "l_orderkey", F.col("__preference").alias("preference"))


@query("validated_join", "SELECT o_custkey AS id, count(*) FILTER (WHERE c_nationkey = o_orderkey % 25) AS accepted, count(*) FILTER (WHERE c_nationkey <> o_orderkey % 25) AS rejected FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def validated_join(t: Tables) -> DataFrame:
    observed = t.orders.select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 25).cast("int").alias("value"))
    good, bad = joins.validated_join(observed, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value")), "id", "value")
    rows = good.select("id", F.lit(1).alias("a"), F.lit(0).alias("r")).union(bad.select("id", F.lit(0), F.lit(1)))
    return rows.groupBy("id").agg(F.sum("a").alias("accepted"), F.sum("r").alias("rejected"))


@query("inherit_with_override", f"WITH {_TREE_SQL} SELECT key, node FROM own UNION ALL SELECT key, node FROM inh WHERE key NOT IN (SELECT key FROM own)")
def inherit_with_override(t: Tables) -> DataFrame:
    own, inherited, _ = _tree(t)
    return joins.inherit_with_override(own, inherited, ["key"])


_CHANGED = "p_size = 50 AND p_type = 'PROMO'"


@query("snapshot_diff_tree", f"""
    WITH a AS (SELECT p_partkey AS id, p_retailprice AS price, p_name AS name FROM part WHERE NOT (p_size = 49 AND p_type = 'PROMO')), b AS (SELECT p_partkey AS id, CASE WHEN {_CHANGED} THEN p_retailprice + 1 ELSE p_retailprice END AS price, p_name AS name FROM part WHERE NOT (p_size = 48 AND p_type = 'PROMO'))
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.id = b.id WHERE a.price IS DISTINCT FROM b.price OR a.name IS DISTINCT FROM b.name""")
def snapshot_diff_tree(t: Tables) -> DataFrame:
    """Two stored snapshots of parts of which few rows differ: only leaves whose digests differ are read."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), "p_size", "p_type")
    before = rows.where("NOT (p_size = 49 AND p_type = 'PROMO')")
    after = rows.where("NOT (p_size = 48 AND p_type = 'PROMO')").withColumn("price", F.when(F.expr(_CHANGED), F.col("price") + 1).otherwise(F.col("price")))
    at = scratch(t.spark)
    for name, snapshot in (("before", before), ("after", after)):
        digest_tree.store(snapshot.select("id", "price", "name"), f"{at}/{name}", "id", ["price", "name"], width=max(16, 1 + t.part.count() // 64))
    return digest_tree.stored_diff(t.spark, f"{at}/before", f"{at}/after", "id", ["price", "name"])


@query("upsert_latest", """
    WITH r AS (SELECT l_suppkey, l_partkey, l_quantity, l_shipdate, l_orderkey, l_linenumber, CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END AS fresh FROM lineitem)
    SELECT l_suppkey, l_partkey, l_quantity, l_orderkey FROM r QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC NULLS LAST, fresh DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1""")
def upsert_latest(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    merged = upsert(rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut), ["l_suppkey", "l_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber", "l_quantity"])
    return merged.select("l_suppkey", "l_partkey", "l_quantity", "l_orderkey")


@query("append_new_observations", """
    SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 25)""")
def append_new_observations(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return append_new(rows.where("l_quantity <= 25"), rows.where("l_quantity > 25"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")
