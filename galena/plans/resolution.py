"""Provenance and conflict resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.operators import resolution as ops
from galena.operators.windows import latest_per_key
from galena.plans.base import query
from galena.sources.views import Tables, with_views


@query("unpivot_facts", """
    SELECT p_partkey, field, value FROM (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS field, unnest([nullif(trim(p_name), ''), nullif(trim(p_brand), ''), nullif(trim(CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_type END), ''), CAST(p_size AS VARCHAR)]) AS value FROM part) WHERE value IS NOT NULL""")
def unpivot_facts(t: Tables) -> DataFrame:
    rows = t.part.withColumn("p_type", F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_type")))
    return ops.unpivot_facts(rows, ["p_partkey"], ["p_name", "p_brand", "p_type", "p_size"])


_RESOLVED = """
    , r AS (SELECT entity, value AS selected, id AS selected_id, row_number() OVER w AS rank, min(value) OVER (PARTITION BY entity) <> max(value) OVER (PARTITION BY entity) AS conflict, priority, confidence, lead(priority) OVER w AS p2, lead(confidence) OVER w AS c2
        FROM claims WINDOW w AS (PARTITION BY entity ORDER BY priority, confidence DESC, retrieved_at DESC, id, value)),
    resolved AS (SELECT entity, selected, selected_id, conflict, CASE WHEN p2 IS NULL THEN 'single-value' WHEN priority <> p2 THEN 'priority' WHEN confidence <> c2 THEN 'confidence' ELSE 'recency' END AS reason FROM r WHERE rank = 1)"""


def resolved(t: Tables) -> DataFrame:
    return ops.resolve_candidates(t.claims(), ["entity"], "value", "priority", "confidence", "retrieved_at", "id")


@query("resolve_candidates", with_views("claims", _RESOLVED.strip() + " SELECT * FROM resolved"))
def resolve_candidates(t: Tables) -> DataFrame:
    return resolved(t)


@query("sync_conflicts", with_views("claims", _RESOLVED.strip() + """
    , o AS (SELECT p_partkey AS entity FROM part WHERE p_size % 2 = 0 UNION SELECT p_partkey + 100000000 FROM part WHERE p_size = 3)
    SELECT coalesce(o.entity, c.entity) AS entity, CASE WHEN o.entity IS NULL THEN 'OPENED' WHEN c.entity IS NULL THEN 'AUTO_RESOLVED' ELSE 'OPEN' END AS status FROM o FULL JOIN (SELECT entity FROM resolved WHERE conflict) c ON c.entity = o.entity"""))
def sync_conflicts(t: Tables) -> DataFrame:
    p = t.part
    open_ = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("entity")).union(p.where("p_size = 3").select(F.col("p_partkey") + 100000000))
    return ops.sync_conflicts(open_, resolved(t), ["entity"])


@query("pivot_selected", """
    SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS one, max(CASE WHEN l_linenumber = 2 THEN TRY_CAST(q AS INT) END) AS two
    FROM (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem WHERE l_linenumber IN (1, 2) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1) GROUP BY 1""")
def pivot_selected(t: Tables) -> DataFrame:
    one = latest_per_key(t.lineitem.where("l_linenumber in (1, 2)"), ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")])
    facts = one.select("l_orderkey", F.when(F.col("l_linenumber") == 1, "one").otherwise("two").alias("field"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"))
    return ops.pivot_selected(facts, ["l_orderkey"], "field", "value", {"one": "string", "two": "int"})


@query("change_detect", """
    WITH p AS (SELECT page_id, page_id % 7 AS m, md5(html) AS d FROM pages WHERE page_id % 10 > 0), i AS (SELECT page_id, page_id % 5 AS m, CASE WHEN page_id % 3 = 0 THEN md5(html || 'x') ELSE md5(html) END AS d FROM pages)
    SELECT i.page_id, CASE WHEN p.page_id IS NULL THEN 'created' WHEN i.m <= p.m OR i.d = p.d THEN 'unchanged' ELSE 'updated' END AS status FROM i LEFT JOIN p USING (page_id)""")
def change_detect(t: Tables) -> DataFrame:
    pages = t.pages
    before = pages.where("page_id % 10 > 0").select("page_id", (F.col("page_id") % 7).alias("m"), F.md5("html").alias("d"))
    now = pages.select("page_id", (F.col("page_id") % 5).alias("m"), F.when(F.col("page_id") % 3 == 0, F.md5(F.concat("html", F.lit("x")))).otherwise(F.md5("html")).alias("d"))
    return ops.change_detect(before, now, "page_id", "m", "d")


_RUNS = """p AS (SELECT page_id, page_id % 7 AS m, md5(html) AS d FROM pages WHERE page_id % 10 > 0), i AS (SELECT page_id, url, page_id % 5 AS m, CASE WHEN page_id % 3 = 0 THEN md5(html || 'x') ELSE md5(html) END AS d, NOT regexp_matches(html, '(?i)<title') AS failed FROM pages),
    s AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS run, CASE WHEN failed THEN 'error' WHEN p.page_id IS NULL THEN 'created' WHEN i.m <= p.m OR i.d = p.d THEN 'unchanged' ELSE 'updated' END AS outcome FROM i LEFT JOIN p USING (page_id))"""


@query("run_summary", f"""WITH {_RUNS} SELECT run, count(*) AS seen, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'error') AS errors,
    CASE WHEN count(*) FILTER (WHERE outcome = 'error') > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM s GROUP BY 1""")
def run_summary(t: Tables) -> DataFrame:
    """An import run for each host: what became of its pages; a page without a title can't be read."""
    outcome = change_detect(t).withColumnRenamed("status", "outcome")
    pages = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("run"), (~F.col("html").rlike("(?i)<title")).alias("failed"))
    return ops.run_summary(pages.join(outcome, "page_id").withColumn("outcome", F.when(F.col("failed"), "error").otherwise(F.col("outcome"))), "run", "outcome")


@query("rebuild_bridges", """
    WITH w AS (SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_returnflag) = 1)
    SELECT l_partkey, array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') AS markets, count(DISTINCT l_returnflag) AS kinds FROM w JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def rebuild_bridges(t: Tables) -> DataFrame:
    latest = latest_per_key(t.lineitem, ["l_partkey", "l_suppkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.asc("l_returnflag")])
    rows = latest.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("s_nationkey")), lambda x: x.cast("string")), ",").alias("markets"), F.count_distinct("l_returnflag").alias("kinds"))


_PIECES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS HUGEINT)) AS VARCHAR)" for k in range(4))


@query("table_digest", f"""WITH r AS (SELECT sha256(CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS h FROM orders), s AS (SELECT count(*) AS rows, [{_PIECES}] AS p FROM r)
    SELECT sha256(CAST(rows AS VARCHAR) || '|' || array_to_string(p, '|')) AS digest, rows FROM s""")
def table_digest(t: Tables) -> DataFrame:
    return ops.table_digest(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("worst_class", "SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'N' WHEN 2 THEN 'A' ELSE 'R' END AS class FROM lineitem GROUP BY 1")
def worst_class(t: Tables) -> DataFrame:
    return ops.worst_class(t.lineitem, "l_orderkey", "l_returnflag", ["N", "A", "R"])


@query("backfill_link", "SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def backfill_link(t: Tables) -> DataFrame:
    return ops.backfill_link(t.lineitem, "l_orderkey", "l_suppkey")


@query("rekey_plan", """
    WITH k AS (SELECT p_partkey, p_brand AS old_key, CASE WHEN p_size > 25 THEN p_brand || ':' || p_name ELSE p_brand END AS new_key FROM part)
    SELECT p_partkey, old_key, new_key, count(*) OVER (PARTITION BY new_key) > 1 AS collision FROM k QUALIFY old_key IS DISTINCT FROM new_key""")
def rekey_plan(t: Tables) -> DataFrame:
    new = F.when(F.col("p_size") > 25, F.concat_ws(":", "p_brand", "p_name")).otherwise(F.col("p_brand"))
    return ops.rekey_plan(t.part, "p_partkey", "p_brand", new)


@query("consolidate_reviews", """
    SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) = 1 THEN 'ACTIVE' ELSE 'CLOSED' END AS state FROM orders WHERE o_orderstatus <> 'F'""")
def consolidate_reviews(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") != "P").asc(), "o_orderdate", "o_orderkey")
    return t.orders.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", F.when(F.row_number().over(w) == 1, "ACTIVE").otherwise("CLOSED").alias("state"))


@query("plan_drift", """
    WITH p AS (SELECT l_orderkey AS id, max(l_suppkey) AS place, max(l_quantity) AS h FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), c AS (SELECT l_orderkey AS id, max(l_suppkey) AS place, max(l_quantity) AS h FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1)
    SELECT coalesce(p.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'missing' WHEN p.id IS NULL THEN 'partial' WHEN p.place <> c.place THEN 'moved' WHEN p.h <> c.h THEN 'changed' END AS drift FROM p FULL JOIN c ON c.id = p.id WHERE c.id IS NULL OR p.id IS NULL OR p.place <> c.place OR p.h <> c.h""")
def plan_drift(t: Tables) -> DataFrame:
    def state(where: str, tag: str) -> DataFrame:
        return t.lineitem.where(where).groupBy(F.col("l_orderkey").alias(f"{tag}_id")).agg(F.max("l_suppkey").alias(f"{tag}_place"), F.max("l_quantity").alias(f"{tag}_hash"))

    both = state("l_linenumber <= 4", "p").join(state("l_linenumber >= 3", "c"), F.col("p_id") == F.col("c_id"), "full_outer")
    drift = F.when(F.col("c_id").isNull(), "missing").when(F.col("p_id").isNull(), "partial").when(F.col("p_place") != F.col("c_place"), "moved").when(F.col("p_hash") != F.col("c_hash"), "changed")
    return both.select(F.coalesce("p_id", "c_id").alias("id"), drift.alias("drift")).where("drift is not null")


@query("plan_violations", """
    WITH d AS (SELECT l_orderkey AS plan, count(*) AS n, count(DISTINCT l_linenumber) AS u, bool_or(l_returnflag = 'R' AND l_discount = 0) AS bad FROM lineitem GROUP BY 1)
    SELECT plan, 'duplicate record' AS violation FROM d WHERE u < n UNION ALL SELECT plan, 'ambiguous cluster' FROM d WHERE bad""")
def plan_violations(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("plan")).agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("u"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)).alias("bad"))
    found = F.filter(F.array(F.when(F.col("u") < F.col("n"), F.lit("duplicate record")), F.when(F.col("bad"), F.lit("ambiguous cluster"))), lambda x: x.isNotNull())
    return per.select("plan", F.explode(found).alias("violation"))


@query("product_plan", """
    WITH c AS (SELECT l_orderkey AS grp, l_partkey AS cluster, any_value(p_name) AS product, any_value(p_name || '/' || p_type || CASE WHEN p_size > 25 THEN '/' || p_brand ELSE '' END) AS key, count(*) FILTER (WHERE l_returnflag = 'R') AS shared FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), e AS (SELECT p_name || '/' || p_type AS key, min(p_brand) AS product FROM part WHERE p_size % 3 = 0 GROUP BY 1),
    a AS (SELECT c.*, e.product AS there, row_number() OVER (PARTITION BY c.product ORDER BY grp, cluster) = 1 AS first, count(*) OVER (PARTITION BY c.key) > 1 AS twice FROM c LEFT JOIN e ON e.key = c.key), b AS (SELECT *, CASE WHEN first AND shared = 0 THEN 'KEEP' WHEN there IS NOT NULL THEN 'REUSE' ELSE 'CREATE' END AS action FROM a)
    SELECT grp, cluster, action, CASE WHEN twice THEN 'DUPLICATE_PLANNED_KEY' WHEN there <> product AND action = 'KEEP' THEN 'KEY_OUTSIDE_PLAN' END AS collision FROM b""")
def product_plan(t: Tables) -> DataFrame:
    """Orders as groups of a plan, their parts as clusters; names and types make keys, some of which are taken."""
    key = F.concat_ws("/", "p_name", "p_type")
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("cluster")).agg(F.first("p_name").alias("product"), F.first(F.when(F.col("p_size") > 25, F.concat_ws("/", "p_name", "p_type", "p_brand")).otherwise(key)).alias("key"), F.count_if(F.col("l_returnflag") == "R").alias("shared"))
    taken = t.part.where("p_size % 3 = 0").groupBy(key.alias("key")).agg(F.min("p_brand").alias("product"))
    return ops.product_plan(rows, taken)


@query("attribution_blockers", """
    SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS observed, count(*) FILTER (WHERE l_returnflag <> 'R' AND n = 1) AS by_source, count(*) FILTER (WHERE l_returnflag <> 'R' AND n > 1) AS blockers
    FROM (SELECT l_suppkey, l_returnflag, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n FROM lineitem) GROUP BY 1""")
def attribution_blockers(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    rest = F.col("n") - F.col("r")
    return per.groupBy("l_suppkey").agg(F.sum("r").alias("observed"), F.sum(F.when(F.col("n") == 1, rest).otherwise(0)).alias("by_source"), F.sum(F.when(F.col("n") > 1, rest).otherwise(0)).alias("blockers"))


@query("media_gain", """
    WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem), seen AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS source FROM lineitem WHERE l_returnflag = 'R'), had AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_discount = 0),
    n AS (SELECT part, count(*) AS sources FROM seen GROUP BY 1), j AS (SELECT m.*, s.source IS NOT NULL AS matched, h.part IS NOT NULL AS attributed, n.sources FROM m LEFT JOIN seen s ON s.part = l_partkey AND s.source = l_suppkey LEFT JOIN had h ON h.part = l_partkey LEFT JOIN n ON n.part = l_partkey)
    SELECT l_suppkey, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS unattributable, count(*) FILTER (WHERE matched AND NOT attributed) AS new, count(*) FILTER (WHERE matched AND NOT attributed AND sources = 1) AS unblocked FROM j GROUP BY 1""")
def media_gain(t: Tables) -> DataFrame:
    """Media of each source that its own pages show, that none shows, whose provenance is new, and that would no longer block a split."""
    seen = t.lineitem.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct().withColumn("matched", F.lit(True))
    had = t.lineitem.where("l_discount = 0").select("l_partkey").distinct().withColumn("attributed", F.lit(True))
    sources = seen.groupBy("l_partkey").agg(F.count("*").alias("sources"))
    rows = t.lineitem.select("l_partkey", "l_suppkey").join(seen, ["l_partkey", "l_suppkey"], "left").join(had, "l_partkey", "left").join(sources, "l_partkey", "left")
    new = F.col("matched").isNotNull() & F.col("attributed").isNull()
    return rows.groupBy("l_suppkey").agg(F.count("matched").alias("matched"), F.count_if(F.col("matched").isNull()).alias("unattributable"), F.count_if(new).alias("new"), F.count_if(new & (F.col("sources") == 1)).alias("unblocked"))


@query("apply_split", """
    WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount = 0)
    SELECT CASE WHEN p.l_orderkey IS NOT NULL THEN l.l_orderkey * 10 + l.l_linenumber ELSE l.l_orderkey END AS owner, l.l_linenumber, l.l_partkey, p.l_orderkey IS NOT NULL AS split FROM lineitem l LEFT JOIN p USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def apply_split(t: Tables) -> DataFrame:
    """Records of a plan move to their new owner as one rewrite."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    plan = t.lineitem.where("l_discount = 0").select(*keys).distinct().withColumn("owner", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = t.lineitem.select(*keys, F.col("l_orderkey").alias("owner"))
    return ops.apply_split(rows, plan, keys, "owner").select("owner", "l_linenumber", "l_partkey", "split")


@query("record_evidence", """
    WITH l AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2)
    SELECT user_id, count(*) AS fields, coalesce(max(v) FILTER (WHERE event_type = 'purchase'), max(v) FILTER (WHERE event_type = 'click'), max(v) FILTER (WHERE event_type = 'view'), max(v)) AS preferred FROM l GROUP BY 1""")
def record_evidence(t: Tables) -> DataFrame:
    """The latest value of each field of a record as a map, and the preferred one of several names."""
    latest = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    facts = latest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("facts"))
    named = [F.try_element_at("facts", F.lit(n)) for n in ("purchase", "click", "view")]
    return facts.select("user_id", F.size("facts").cast("long").alias("fields"), F.coalesce(*named, F.array_max(F.map_values("facts"))).alias("preferred"))
