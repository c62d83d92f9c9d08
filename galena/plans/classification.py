"""Classification and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.operators import classification as ops
from galena.plans.base import query
from galena.sources.tables import materialize, report_long
from galena.sources.views import Tables, with_views

_FACTS = """tags AS (SELECT l_partkey, bool_or(l_linestatus = 'O') AS assigned, bool_or(l_discount > 0.09) AS animal, bool_or(l_quantity = 1) AS people, bool_or(l_tax > 0.07 AND l_returnflag = 'R') AS building, bool_or(l_quantity = 50) AS direct_building, bool_or(l_discount < 0.01) AS vehicle, bool_or(l_quantity = 49) AS strong_vehicle, bool_or(l_quantity = 48 AND l_tax > 0.05) AS accessory, bool_or(l_linenumber = 7) AS instructions, count(DISTINCT l_suppkey) AS part_types FROM lineitem GROUP BY 1),
    f AS (SELECT part.*, tags.*, CASE p_partkey % 8 WHEN 0 THEN 'CATALOGUE' WHEN 1 THEN 'PROMOTIONAL_ITEM' WHEN 2 THEN 'PART' WHEN 3 THEN 'FIGURE' ELSE 'SET' END AS kind, CASE p_size % 12 WHEN 0 THEN 'Carrying Case' WHEN 1 THEN 'DS' WHEN 2 THEN 'Magazin' WHEN 3 THEN 'Figures' WHEN 4 THEN 'Duo Pack' WHEN 5 THEN 'Blister' WHEN 6 THEN 'Keychains' WHEN 7 THEN NULL ELSE 'Standard Box' END AS form, CASE WHEN p_partkey % 31 = 0 THEN 'PROMOTION' ELSE 'BASE' END AS variant_kind, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 4 END AS figures, CASE WHEN p_size % 7 > 0 THEN p_size * 4 END AS pieces FROM part LEFT JOIN tags ON l_partkey = p_partkey)"""
_CLASS = _FACTS + """, c AS (SELECT *, CASE WHEN NOT coalesce(assigned, FALSE) THEN 'UNKNOWN' WHEN kind = 'CATALOGUE' OR form = 'Magazin' THEN 'CATALOGUE' WHEN kind IN ('PROMOTIONAL_ITEM', 'MERCHANDISE') OR variant_kind = 'PROMOTION' THEN 'PROMOTIONAL' WHEN kind IN ('PART', 'ACCESSORY') THEN kind
        WHEN form = 'DS' AND animal AND NOT people AND coalesce(figures, 0) < 2 AND NOT (building OR vehicle) THEN 'ANIMAL' WHEN kind = 'FIGURE' OR form = 'Figures' THEN CASE WHEN figures > 1 THEN 'FIGURE_PACK' ELSE 'SINGLE_FIGURE' END WHEN form = 'Duo Pack' THEN 'FIGURE_PACK'
        WHEN form = 'Blister' AND figures IS NOT NULL THEN CASE WHEN figures > 1 THEN 'FIGURE_PACK' ELSE 'SINGLE_FIGURE' END WHEN form = 'Keychains' OR accessory THEN 'ACCESSORY'
        WHEN kind = 'SET' AND form IN ('Standard Box', 'Carrying Case') THEN CASE WHEN pieces >= 150 THEN 'MAIN_SET' WHEN strong_vehicle THEN 'VEHICLE_SET' WHEN direct_building OR building AND (instructions OR part_types >= 8) THEN 'BUILDING_SET' WHEN vehicle AND (instructions OR part_types >= 8) THEN 'VEHICLE_SET' ELSE 'SMALL_SET' END
        WHEN kind = 'SET' AND form = 'DS' THEN 'ACCESSORY' ELSE 'UNKNOWN' END AS class FROM f)"""


def articles(t: Tables) -> DataFrame:
    """Parts as articles, with the facts of all their lines: each is read once and or-ed together."""
    quantity, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    flags = {"assigned": F.col("l_linestatus") == "O", "animal": discount > 0.09, "people": quantity == 1, "building": (tax > 0.07) & (F.col("l_returnflag") == "R"), "direct_building": quantity == 50, "vehicle": discount < 0.01, "strong_vehicle": quantity == 49, "accessory": (quantity == 48) & (tax > 0.05), "instructions": F.col("l_linenumber") == 7}
    tags = t.lineitem.groupBy("l_partkey").agg(*[F.bool_or(v).alias(k) for k, v in flags.items()], F.count_distinct("l_suppkey").alias("part_types"))
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = t.part.join(tags, F.col("l_partkey") == key, "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in flags})
    k = size % 12
    form = F.when(k == 0, "Carrying Case").when(k == 1, "DS").when(k == 2, "Magazin").when(k == 3, "Figures").when(k == 4, "Duo Pack").when(k == 5, "Blister").when(k == 6, "Keychains").when(k != 7, "Standard Box")
    kind = F.when(key % 8 == 0, "CATALOGUE").when(key % 8 == 1, "PROMOTIONAL_ITEM").when(key % 8 == 2, "PART").when(key % 8 == 3, "FIGURE").otherwise("SET")
    return rows.withColumns({"kind": kind, "format": form, "variant_kind": F.when(key % 31 == 0, "PROMOTION").otherwise("BASE"), "figures": F.when(key % 3 > 0, key % 4), "pieces": F.when(size % 7 > 0, size * 4), "part_types": F.coalesce("part_types", F.lit(0))})


def classes(t: Tables) -> DataFrame:
    return articles(t).withColumn("class", ops.classify(ops.CLASS_RULES, "UNKNOWN"))


@query("collector_class", f"WITH {_CLASS} SELECT p_partkey, class FROM c")
def collector_class(t: Tables) -> DataFrame:
    return classes(t).select("p_partkey", "class")


@query("collector_priority", f"WITH {_CLASS} SELECT p_partkey, CASE class WHEN 'MAIN_SET' THEN 110 WHEN 'BUILDING_SET' THEN 100 WHEN 'VEHICLE_SET' THEN 90 WHEN 'SMALL_SET' THEN 80 WHEN 'FIGURE_PACK' THEN 70 WHEN 'SINGLE_FIGURE' THEN 60 WHEN 'ANIMAL' THEN 50 WHEN 'ACCESSORY' THEN 40 WHEN 'PART' THEN 30 WHEN 'CATALOGUE' THEN 20 WHEN 'PROMOTIONAL' THEN 10 ELSE 0 END AS priority FROM c")
def collector_priority(t: Tables) -> DataFrame:
    priority = ops.priority_of(F.col("class"), ops.CLASS_ORDER)
    return classes(t).select("p_partkey", priority.alias("priority"))


_REF = "CASE p_size % 8 WHEN 0 THEN '000' WHEN 1 THEN ' n/a ' WHEN 2 THEN 'PM' || CAST(p_partkey AS VARCHAR) WHEN 3 THEN CAST(70000 + p_partkey % 4000 AS VARCHAR) ELSE CAST(100 + p_partkey % 9000 AS VARCHAR) END"


@query("reference_group", f"""WITH {_FACTS}, g AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'PLACEHOLDER' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'REUSED' ELSE 'ASSIGNED' END AS cls, upper(trim({_REF})) AS base, kind, form FROM f)
    SELECT p_partkey, CASE WHEN cls IN ('PLACEHOLDER', 'AMBIGUOUS') OR base IN ('N/A', 'NA', 'UNKNOWN', 'NONE', 'NULL', 'UNASSIGNED') OR regexp_full_match(base, '0+') THEN 'NON_COLLECTOR' WHEN (regexp_full_match(base, '[0-9]{{3,4}}') OR regexp_full_match(base, '[0-9]{{5}}') AND TRY_CAST(base AS INT) BETWEEN 70000 AND 72999) AND kind NOT IN ('PART', 'MERCHANDISE', 'CATALOGUE', 'PROMOTIONAL_ITEM') AND coalesce(form, '') NOT IN ('Magazin', 'Keychains', 'Decoration toy') THEN 'COMMERCIAL' ELSE 'SPECIAL' END AS grp FROM g""")
def reference_group(t: Tables) -> DataFrame:
    key, k = F.col("p_partkey"), F.col("p_size") % 8
    cls = F.when(key % 6 == 0, "PLACEHOLDER").when(key % 6 == 1, "AMBIGUOUS").when(key % 6 == 2, "REUSED").otherwise("ASSIGNED")
    number = F.when(k == 0, "000").when(k == 1, " n/a ").when(k == 2, F.concat(F.lit("PM"), key.cast("string"))).when(k == 3, (70000 + key % 4000).cast("string")).otherwise((100 + key % 9000).cast("string"))
    return articles(t).select("p_partkey", ops.reference_group(cls, number, F.lit(None).cast("string"), F.col("kind"), F.col("format")).alias("grp"))


@query("market_relation", """
    SELECT l_partkey, s_nationkey AS market, CASE WHEN bool_or(l_discount > 0.09) THEN 'ATTESTED_EXCLUSIVE' WHEN bool_or(l_returnflag = 'N') THEN 'MARKET_EDITION' ELSE 'PRESENCE' END AS relation, CASE WHEN bool_or(l_discount > 0.09) THEN 95 WHEN bool_or(l_returnflag = 'N') THEN 80 ELSE 70 END AS confidence, count(*) AS evidence
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def market_relation(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    claim, edition = F.bool_or(F.col("l_discount") > 0.09), F.bool_or(F.col("l_returnflag") == "N")
    return rows.groupBy("l_partkey", F.col("s_nationkey").alias("market")).agg(F.when(claim, "ATTESTED_EXCLUSIVE").when(edition, "MARKET_EDITION").otherwise("PRESENCE").alias("relation"), F.when(claim, 95).when(edition, 80).otherwise(70).alias("confidence"), F.count("*").alias("evidence"))


_LABELS = ["Carrefour", "  toys  r us", "WWF", "Yps 12", "Toy Fair 1999", "oui", "Stadt Bern", "Acme & Sons", "Exclusive Brazil Trol", "Promotional set", "", "Müller"]


@query("commercial_context", f"""WITH l AS (SELECT p_partkey, lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) AS low, p_size % 3 = 0 AS promoted FROM (SELECT *, ({_LABELS})[1 + p_size % 12] || CASE WHEN p_size % 12 = 7 THEN ' ' || p_name ELSE '' END AS label FROM part))
    SELECT p_partkey, CASE WHEN low = '' OR low = 'oui' THEN 'OTHER_DOCUMENTED_CONTEXT' WHEN regexp_matches(low, 'yps\\b') THEN 'MAGAZINE_PUBLICATION' WHEN contains(low, 'toy fair') THEN 'EVENT_VENUE' WHEN low IN ('carrefour', 'toys r us', 'müller') THEN 'RETAILER_DISTRIBUTOR' WHEN low = 'wwf' OR contains(low, 'stadt ') THEN 'ORGANIZATION_ASSOCIATION'
        WHEN promoted OR contains(low, 'promotional') THEN 'PROMOTIONAL_CAMPAIGN' WHEN low = 'exclusive brazil trol' THEN 'OTHER_DOCUMENTED_CONTEXT' ELSE 'BRAND_LICENSE_PARTNER' END AS context FROM l""")
def commercial_context(t: Tables) -> DataFrame:
    k = F.col("p_size") % 12
    label = F.concat(F.get(F.array(*map(F.lit, _LABELS)), k), F.when(k == 7, F.concat(F.lit(" "), F.col("p_name"))).otherwise(""))
    tags = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("new"), F.lit(" Promotional")))
    return t.part.select("p_partkey", ops.commercial_context(label, tags).alias("context"))


@query("rule_category", r"""
    WITH n AS (SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN 'Decoration toy' WHEN p_size % 3 = 0 THEN 'decoration toy' END AS format, CASE p_size % 7 WHEN 0 THEN p_name || ' XXL' WHEN 1 THEN 'xxl-' || p_name WHEN 2 THEN p_name || ' xxlarge' WHEN 3 THEN NULL ELSE p_name END AS variant, CASE WHEN p_size % 5 = 0 THEN '(XxL)' ELSE p_brand END AS product FROM part)
    SELECT p_partkey, coalesce(format = 'Decoration toy' AND regexp_matches(coalesce(variant, '') || ' ' || coalesce(product, ''), '(?i)(^|[^a-z0-9])xxl([^a-z0-9]|$)'), FALSE) AS xxl FROM n""")
def rule_category(t: Tables) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    form = F.when(F.col("p_type").isin("PROMO", "SMALL", "LARGE"), "Decoration toy").when(size % 3 == 0, "decoration toy")
    variant = F.when(size % 7 == 0, F.concat(name, F.lit(" XXL"))).when(size % 7 == 1, F.concat(F.lit("xxl-"), name)).when(size % 7 == 2, F.concat(name, F.lit(" xxlarge"))).when(size % 7 != 3, name)
    return t.part.select("p_partkey", ops.oversize_candidate(form, variant, F.when(size % 5 == 0, "(XxL)").otherwise(F.col("p_brand"))).alias("xxl"))


_STATUS = """e AS (SELECT l_partkey AS ref, bool_or(l_quantity = 50 AND l_discount > 0.08) AS i, bool_or(l_suppkey % 50 = 0) AS o, count(DISTINCT l_returnflag) AS claims, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1),
    st AS (SELECT ref, CASE WHEN i THEN 'IMPORTED' WHEN o THEN 'OFFICIAL' WHEN claims > 1 THEN 'CONFLICTING' WHEN sources > 1 THEN 'CORROBORATED' ELSE 'DISCOVERED' END AS status, sources FROM e)"""


def statuses(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("ref"), ((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.08)).alias("imported"), (F.col("l_suppkey") % 50 == 0).alias("official"), F.col("l_returnflag").alias("claim"), F.col("l_suppkey").alias("source"))
    return ops.candidate_status(rows, "ref")


@query("candidate_status", f"WITH {_STATUS} SELECT * FROM st")
def candidate_status(t: Tables) -> DataFrame:
    return statuses(t)


_MARKETS = ["fr-FR", "de-DE", "en-US"]


@query("candidate_plan", """
    WITH l AS (SELECT l_partkey // 3 AS ref, l_orderkey AS place, l_linenumber AS n, l_suppkey, l_quantity, CASE WHEN l_tax > 0.01 THEN year(l_shipdate) END AS announced FROM lineitem),
    d AS (SELECT ref, CASE WHEN n IN (1, 3) THEN 0 ELSE 1 END AS snapshot, place, n, announced, 'https://' || CAST(snapshot AS VARCHAR) || '/' || CAST(place AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS url FROM l WHERE n IN (1, 2, 3)),
    f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ref ORDER BY snapshot, place, n) = 1),
    k AS (SELECT ref, count(*) - 1 AS passed_over FROM d GROUP BY 1),
    c AS (SELECT ref, count(*) AS n, list(DISTINCT announced) FILTER (WHERE announced IS NOT NULL) AS years FROM l WHERE n = 4 GROUP BY 1),
    o AS (SELECT ref, count(*) AS n, list(DISTINCT l_suppkey % 3) AS markets FROM l WHERE n >= 5 AND l_quantity > 35 GROUP BY 1),
    loc AS (SELECT DISTINCT p_partkey // 3 AS ref FROM part WHERE p_size > 40),
    p AS (SELECT f.*, passed_over, coalesce(c.n, 0) AS community, coalesce(o.n, 0) AS official, loc.ref IS NOT NULL AS imported, list_sort(list_distinct(list_concat(coalesce(c.years, []), CASE WHEN announced IS NULL THEN [] ELSE [announced] END))) AS years,
        1 + CASE WHEN c.n > 0 THEN 2 ELSE 0 END + coalesce(list_sum(list_transform(o.markets, lambda m: CASE m WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 16 END)), 0) AS sources FROM f JOIN k USING (ref) LEFT JOIN c ON c.ref = f.ref LEFT JOIN o ON o.ref = f.ref LEFT JOIN loc ON loc.ref = f.ref)
    SELECT ref, url, announced, community, official, passed_over, CAST(sources AS INT) AS sources, CASE WHEN imported THEN 'IMPORTED' WHEN official > 0 THEN 'OFFICIAL_CONFIRMED' WHEN len(years) > 1 THEN 'CONFLICTING' WHEN sources > 1 THEN 'CORROBORATED' ELSE 'DISCOVERED' END AS status,
        CASE WHEN NOT imported AND official = 0 AND len(years) > 1 THEN array_to_string(years, ', ') END AS conflict FROM p WHERE NOT imported OR official > 0""")
def candidate_plan(t: Tables) -> DataFrame:
    """Two discovery snapshots (lines 1 and 3, then 2), a community one (line 4) and an official one (lines from 5 on), against what is there already.

    Lines may share order and number: the first of them, as the table has them, is the first entry.
    """
    rows = t.placed("lineitem").select(F.floor(F.col("l_partkey") / 3).alias("ref"), F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("n"), F.col("place").alias("row"), "l_suppkey", "l_quantity", F.when(F.col("l_tax") > 0.01, F.year("l_shipdate")).alias("announced"))
    snapshot = F.when(F.col("n").isin(1, 3), 0).otherwise(1)
    url = F.concat(F.lit("https://"), F.concat_ws("/", F.col("snapshot").cast("string"), F.col("place").cast("string"), F.col("n").cast("string")))
    discovered = rows.where("n <= 3").withColumn("snapshot", snapshot).select("ref", F.struct("snapshot", "place", "n", "row").alias("order"), "announced", url.alias("url"))
    community = rows.where("n = 4").select("ref", "announced")
    market = F.get(F.array(*map(F.lit, _MARKETS)), (F.col("l_suppkey") % 3).cast("int"))
    official = rows.where("n >= 5").select("ref", market.alias("market"), (F.col("l_quantity") > 35).alias("confirmed"))
    local = t.part.where("p_size > 40").select(F.floor(F.col("p_partkey") / 3).alias("ref"))
    return ops.candidate_plan(discovered, community, official, local, _MARKETS)


_NAMES = ["IMPORTED", "OFFICIAL", "CONFLICTING", "CORROBORATED", "DISCOVERED", "REJECTED"]


@query("recent_status", f"WITH {_STATUS} SELECT place - 1 AS place, name AS status, (SELECT count(*) FROM st WHERE status = name) AS n FROM (SELECT unnest({_NAMES}) AS name, unnest(range(1, 7)) AS place)")
def recent_status(t: Tables) -> DataFrame:
    return ops.with_zero_rows(statuses(t).groupBy("status").agg(F.count("*").alias("n")), "status", _NAMES)


@query("lookup_decision", """
    WITH found AS (SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2) GROUP BY 1), b AS (SELECT p_partkey, p_size, CASE WHEN p_size % 11 = 0 THEN 'X' || CAST(p_partkey AS VARCHAR) WHEN p_size % 13 = 0 THEN '000' WHEN p_size % 5 = 0 THEN CAST(100 + p_partkey // 10 AS VARCHAR) ELSE CAST(100000 + p_partkey AS VARCHAR) END AS base FROM part),
    u AS (SELECT *, count(*) OVER (PARTITION BY base) AS using_base FROM b)
    SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'SKIP' WHEN NOT regexp_full_match(base, '[0-9]{3,8}') OR regexp_full_match(base, '0+') THEN 'SKIP' WHEN using_base <> 1 THEN 'REVIEW' WHEN coalesce(n, 0) = 0 THEN 'ABSENT' WHEN n <> 1 THEN 'REVIEW' ELSE 'MATCH_UNIQUE' END AS status,
        CASE WHEN p_partkey % 7 = 0 THEN 'UNSAFE_IDENTITY' WHEN NOT regexp_full_match(base, '[0-9]{3,8}') OR regexp_full_match(base, '0+') THEN 'NON_NUMERIC_REFERENCE' WHEN using_base <> 1 THEN 'REUSED_BASE' WHEN coalesce(n, 0) > 1 THEN 'MULTIPLE_SOURCE_MATCHES' END AS reason FROM u LEFT JOIN found ON l_partkey = p_partkey""")
def lookup_decision(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    base = F.when(size % 11 == 0, F.concat(F.lit("X"), key.cast("string"))).when(size % 13 == 0, "000").when(size % 5 == 0, (100 + F.floor(key / 10)).cast("string")).otherwise((100000 + key).cast("string"))
    rows = t.part.select(key, base.alias("base"), F.when(key % 7 == 0, "REUSED").otherwise("ASSIGNED").alias("cls"))
    listed = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 2")
    found = listed.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("found"))
    using = rows.groupBy("base").agg(F.count("*").alias("using_base"))
    joined = rows.join(using, "base").join(found, "p_partkey", "left")
    return joined.select("p_partkey", ops.lookup_decision(F.col("cls"), F.col("base"), F.col("using_base"), F.coalesce("found", F.lit(0))).alias("d")).select("p_partkey", "d.*")


_WAVE = """items AS (SELECT DISTINCT l_orderkey AS wave, l_partkey // 2 + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS ref FROM lineitem),
    loc AS (SELECT p_partkey // 2 AS ref, count(*) AS variants, count(DISTINCT p_name) AS products, min(p_name) AS product, bool_and(p_size % 17 > 0) AS safe, arg_min(p_size % 10 = 0, p_partkey) AS market FROM part WHERE p_partkey % 11 > 0 GROUP BY 1),
    m AS (SELECT wave, ref, CASE WHEN variants IS NULL THEN 'ABSENT' WHEN NOT safe THEN 'BLOCKED_IDENTITY' WHEN variants = 1 AND market THEN 'MARKET_VARIANT_ONLY' WHEN variants = 1 THEN 'MATCH_UNIQUE' WHEN products = 1 THEN 'MATCH_PRODUCT_UNIQUE' ELSE 'MATCH_MULTIPLE' END AS status, CASE WHEN safe AND products = 1 THEN product END AS target, coalesce(variants, 0) AS variants FROM items LEFT JOIN loc USING (ref))"""


def waves(t: Tables) -> DataFrame:
    """Orders as waves: references of two parts each, some of them unknown here."""
    shift = F.when(F.col("l_linenumber") == 7, 1000000000).otherwise(0)
    items = t.lineitem.select(F.col("l_orderkey").alias("wave"), (F.floor(F.col("l_partkey") / 2) + shift).alias("ref")).distinct()
    local = t.part.where("p_partkey % 11 > 0").select(F.floor(F.col("p_partkey") / 2).alias("ref"), F.col("p_partkey").alias("variant_id"), F.col("p_name").alias("product_id"), F.when(F.col("p_size") % 10 == 0, "MARKET").otherwise("BASE").alias("variant_kind"), (F.col("p_size") % 17 > 0).alias("assigned"))
    return ops.wave_match(items, local)


@query("wave_match", f"WITH {_WAVE} SELECT * FROM m")
def wave_match(t: Tables) -> DataFrame:
    return waves(t)


@query("wave_summary", with_views("copies wishes", f""", {_WAVE}, {_CLASS}, o AS (SELECT DISTINCT variant_id // 2 AS ref FROM copies), w AS (SELECT DISTINCT variant_id // 2 AS ref FROM wishes), k AS (SELECT p_partkey // 2 AS ref, min(class) AS class FROM c GROUP BY 1)
    SELECT 'status' AS section, status AS key, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY 2 UNION ALL SELECT 'coverage', 'percent', round(100 * CAST(count(target) AS DOUBLE) / count(*), 2) FROM m
    UNION ALL SELECT 'class', coalesce(class, 'UNKNOWN'), CAST(count(*) AS DOUBLE) FROM m LEFT JOIN k USING (ref) WHERE target IS NOT NULL GROUP BY 2 UNION ALL SELECT 'state', CASE WHEN ref IN (SELECT ref FROM o) THEN 'owned' WHEN ref IN (SELECT ref FROM w) THEN 'wanted' ELSE 'missing' END, CAST(count(*) AS DOUBLE) FROM m GROUP BY 2"""))
def wave_summary(t: Tables) -> DataFrame:
    """Statuses, coverage, classes of what matched, and what of it is owned or wanted, in one pass each over the matches."""
    m = materialize(waves(t))
    half = F.floor(F.col("variant_id") / 2).alias("ref")
    owned, wanted = (df.select(half).distinct().withColumn(n, F.lit(True)) for df, n in ((t.copies(), "owned"), (t.wishes(), "wanted")))
    cls = classes(t).groupBy(F.floor(F.col("p_partkey") / 2).alias("ref")).agg(F.min("class").alias("class"))
    state = F.when(F.col("owned"), "owned").when(F.col("wanted"), "wanted").otherwise("missing")

    def counted(df: DataFrame, key: Column) -> DataFrame:
        return df.groupBy(key.alias("key")).agg(F.count("*").alias("value"))

    percent = m.agg(F.round(100 * F.count("target") / F.count("*"), 2).alias("value")).select(F.lit("percent").alias("key"), "value")
    return report_long({"status": counted(m, F.col("status")), "coverage": percent, "class": counted(m.where("target is not null").join(cls, "ref", "left"), F.coalesce("class", F.lit("UNKNOWN"))), "state": counted(m.join(owned, "ref", "left").join(wanted, "ref", "left"), state)})


@query("offer_match", """
    WITH o AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_partkey + 1 AS VARCHAR) END AS code, CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_partkey AS VARCHAR) END AS known,
        ' lot ' || CASE WHEN l_tax >= 0.02 THEN lower(p_brand) || ' ' ELSE 'toy ' END || CAST(l_partkey AS VARCHAR) || CASE WHEN l_discount > 0.05 THEN 'x' ELSE ' new' END || ' ' AS title, lower(p_brand) AS brand FROM lineitem JOIN part ON p_partkey = l_partkey),
    r AS (SELECT *, CASE WHEN code = known THEN 'GTIN' WHEN code IS NOT NULL AND known IS NOT NULL THEN 'GTIN_CONFLICT' WHEN contains(replace(title, '#', ' '), ' ' || replace(brand, '#', ' ') || ' ') AND contains(replace(title, '#', ' '), ' ' || CAST(l_partkey AS VARCHAR) || ' ') THEN 'BRAND_AND_REFERENCE' ELSE 'NONE' END AS reason FROM o)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE reason WHEN 'GTIN' THEN 100 WHEN 'BRAND_AND_REFERENCE' THEN 95 ELSE 0 END AS confidence, reason FROM r""")
def offer_match(t: Tables) -> DataFrame:
    n, part = F.col("l_linenumber") % 3, F.col("l_partkey")
    code = F.when(n == 0, F.array(F.concat(F.lit("0-"), part.cast("string")))).when(n == 1, F.array((part + 1).cast("string")))
    codes = F.transform(code, lambda c: F.regexp_replace(c, "^0-", ""))
    known = F.when(F.col("l_suppkey") % 5 > 0, F.array(part.cast("string")))
    title = F.concat(F.lit("Lot "), F.when(F.col("l_tax") >= 0.02, F.col("p_brand")).otherwise("Toy"), F.lit(" "), part.cast("string"), F.when(F.col("l_discount") > 0.05, "X").otherwise(" new"))
    rows = t.lineitem.join(t.part, F.col("p_partkey") == part)
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", ops.offer_match(codes, known, title, F.col("p_brand"), part.cast("string")).alias("m")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "m.*")


_IMPORT = """seen AS (SELECT l_partkey AS ref, l_discount < 0.08 AS confirmed, CASE s_nationkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'en' END AS locale, CASE WHEN l_tax > 0.06 THEN 'n' || CAST(l_suppkey AS VARCHAR) END AS name, l_orderkey * 100 + l_linenumber AS seq, CASE WHEN l_quantity > 40 THEN year(l_shipdate) END AS release_year, CASE WHEN l_quantity > 48 THEN l_quantity END AS pieces FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    g AS (SELECT ref, count(*) AS seen, coalesce(arg_min(name, seq) FILTER (WHERE locale = 'fr' AND name IS NOT NULL), arg_min(name, seq) FILTER (WHERE locale = 'de' AND name IS NOT NULL), arg_min(name, seq) FILTER (WHERE locale = 'en' AND name IS NOT NULL)) AS preferred, CASE WHEN min(release_year) = max(release_year) THEN min(release_year) END AS release_year, CASE WHEN min(pieces) = max(pieces) THEN min(pieces) END AS pieces FROM seen WHERE confirmed GROUP BY 1),
    plan AS (SELECT p_partkey AS ref, CASE WHEN p_size % 6 = 0 THEN 'COLLISION_LOCAL_REFERENCE' WHEN seen IS NULL THEN 'NO_OFFICIAL_CONFIRMATION' WHEN preferred IS NULL THEN 'MISSING_OFFICIAL_NAME' ELSE 'READY' END AS status, preferred, release_year, pieces FROM part LEFT JOIN g ON ref = p_partkey)"""


def planned(t: Tables) -> DataFrame:
    locale = F.when(F.col("s_nationkey") % 3 == 0, "fr").when(F.col("s_nationkey") % 3 == 1, "de").otherwise("en")
    seen = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("ref"), (F.col("l_discount") < 0.08).alias("confirmed"), locale.alias("locale"), F.when(F.col("l_tax") > 0.06, F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).alias("name"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_quantity") > 40, F.year("l_shipdate")).alias("release_year"), F.when(F.col("l_quantity") > 48, F.col("l_quantity")).alias("pieces"))
    parts = t.part.select(F.col("p_partkey").alias("ref"), "p_size")
    return ops.import_plan(parts, seen, parts.where("p_size % 6 = 0"), ["release_year", "pieces"])


@query("import_plan", f"WITH {_IMPORT} SELECT * FROM plan")
def import_plan(t: Tables) -> DataFrame:
    return planned(t)


@query("display_images", """
    WITH m AS (SELECT l_partkey AS variant_id, l_orderkey * 100 + l_linenumber AS seq, (['https://img.official.example/', 'https://cdn.example.org/', 'https://old.example.com/', 'http://img.official.example/', 'https://off.example.org/', '/collection-photos/', 'https://user@cdn.example.org/'])[1 + l_suppkey % 7] || CAST(l_suppkey AS VARCHAR) || '.jpg' AS url, (['Box_Front', 'box_back', 'main', 'gallery'])[1 + l_linenumber % 4] AS kind,
        CASE WHEN l_suppkey % 7 = 5 OR l_suppkey % 11 = 0 THEN 'personal' WHEN l_suppkey % 7 = 2 THEN 'community' ELSE 'shop' END AS source, CASE WHEN l_suppkey % 3 = 0 THEN 'OFFICIAL' ELSE 'RETAILER' END AS source_kind, CASE l_returnflag WHEN 'N' THEN TRUE WHEN 'R' THEN l_discount > 0.03 END AS can_display FROM lineitem),
    t AS (SELECT *, CASE WHEN source = 'personal' THEN CASE WHEN can_display AND (starts_with(url, 'https://') AND NOT contains(url, '@') OR starts_with(url, '/collection-photos/')) THEN 0 END WHEN source_kind = 'OFFICIAL' THEN CASE WHEN starts_with(url, 'https://img.official.example/') THEN 1 END WHEN starts_with(url, 'https://') AND NOT contains(url, '@') THEN CASE WHEN source = 'community' THEN 3 ELSE 2 END END AS tier, 1 AS r FROM m WHERE coalesce(can_display, TRUE) AND NOT starts_with(url, 'https://off.example.org/')
        UNION ALL SELECT p_partkey, -1, 'https://img.official.example/reviewed/' || CAST(p_partkey AS VARCHAR) || '.jpg', 'gallery', 'official', 'OFFICIAL', TRUE, 1, 0 FROM part WHERE p_size = 50),
    o AS (SELECT *, CASE lower(kind) WHEN 'box_front' THEN 0 WHEN 'box_back' THEN 1 WHEN 'main' THEN 2 ELSE 3 END AS k FROM t WHERE tier IS NOT NULL), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY variant_id, url ORDER BY tier, r, k, seq, kind) = 1)
    SELECT variant_id, row_number() OVER (PARTITION BY variant_id ORDER BY tier, r, k, seq, url) AS place, url, kind FROM f""")
def display_images(t: Tables) -> DataFrame:
    """Lines as media of their parts: suppliers are sources, and say whether theirs may be displayed."""
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    base = F.get(F.array(*map(F.lit, ["https://img.official.example/", "https://cdn.example.org/", "https://old.example.com/", "http://img.official.example/", "https://off.example.org/", "/collection-photos/", "https://user@cdn.example.org/"])), (s % 7).cast("int"))
    kind = F.get(F.array(*map(F.lit, ["Box_Front", "box_back", "main", "gallery"])), n % 4)
    source = F.when((s % 7 == 5) | (s % 11 == 0), "personal").when(s % 7 == 2, "community").otherwise("shop")
    shown = F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "R", F.col("l_discount") > 0.03)
    media = t.lineitem.select(F.col("l_partkey").alias("variant_id"), (F.col("l_orderkey") * 100 + n).alias("seq"), F.concat(base, s.cast("string"), F.lit(".jpg")).alias("url"), kind.alias("kind"), source.alias("source"), F.when(s % 3 == 0, "OFFICIAL").otherwise("RETAILER").alias("source_kind"), shown.alias("can_display"))
    reviewed = t.part.where("p_size = 50").select(F.col("p_partkey").alias("variant_id"), F.concat(F.lit("https://img.official.example/reviewed/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("url"), F.lit("gallery").alias("kind"))
    return ops.display_images(media, reviewed, ["img.official.example"], ["off.example.org"])


@query("url_profile", "SELECT split_part(split_part(url, '/', 3), '.', -1) AS tld, starts_with(url, 'https://') AS secure, count(*) AS n FROM pages GROUP BY 1, 2")
def url_profile(t: Tables) -> DataFrame:
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return t.pages.groupBy(F.split_part(host, F.lit("."), F.lit(-1)).alias("tld"), F.startswith("url", F.lit("https://")).alias("secure")).agg(F.count("*").alias("n"))


def materialized(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """The distinct variants of each wave with their places, and whether a copy is owned."""
    waves = lines.groupBy(F.col("l_orderkey").alias("wave")).agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    items = waves.select("wave", F.posexplode("refs").alias("at", "variant_id"))
    owned = copies.select("variant_id").distinct().withColumn("owned", F.lit(True))
    return items.join(owned, "variant_id", "left").select("wave", "variant_id", (F.col("at") + 1).cast("long").alias("place"), F.coalesce("owned", F.lit(False)).alias("owned"))


@query("manifest_materialize", with_views("copies", """
    , w AS (SELECT DISTINCT l_orderkey AS wave, l_partkey AS variant_id FROM lineitem)
    SELECT wave, variant_id, row_number() OVER (PARTITION BY wave ORDER BY variant_id) AS place, variant_id IN (SELECT variant_id FROM copies) AS owned FROM w"""))
def manifest_materialize(t: Tables) -> DataFrame:
    return materialized(t.lineitem, t.copies())


@query("manifest_materialize_all", with_views("copies", """
    , w AS (SELECT DISTINCT l_orderkey AS wave, l_partkey AS variant_id FROM lineitem)
    SELECT wave, variant_id, row_number() OVER (PARTITION BY wave ORDER BY variant_id) AS place, variant_id IN (SELECT variant_id FROM copies) AS owned FROM w"""))
def manifest_materialize_all(t: Tables) -> DataFrame:
    """Every order is a wave; the same as ``manifest_materialize``, which once had an id range."""
    return materialized(t.lineitem, t.copies())


TARGETS = ["product", "variant", "reference", "translation", "market", "record", "media", "identifier", "list_price"]


@query("import_apply", f"""WITH {_IMPORT}, ready AS (SELECT plan.*, p_name, p_brand, p_type, p_retailprice FROM plan JOIN part ON p_partkey = ref WHERE status = 'READY' AND ref NOT IN (SELECT ref FROM (SELECT p_partkey AS ref, count(*) OVER (PARTITION BY p_partkey // 3 * 3 + CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey % 3 END) AS n FROM part JOIN plan ON plan.ref = p_partkey WHERE status = 'READY') WHERE n > 1))
    SELECT ref, unnest({TARGETS}) AS target, unnest(['ref:' || CAST(ref AS VARCHAR), 'ref:' || CAST(ref AS VARCHAR) || ':' || p_type, CAST(ref AS VARCHAR), 'fr:' || preferred, p_brand, 'official:' || CAST(ref AS VARCHAR), 'https://www.example.org/' || CAST(ref AS VARCHAR) || '.jpg', CAST(ref // 3 * 3 + CASE WHEN ref IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0) THEN 0 ELSE ref % 3 END AS VARCHAR), CAST(CAST(p_retailprice * 100 AS BIGINT) AS VARCHAR)]) AS key FROM ready""")
def import_apply(t: Tables) -> DataFrame:
    """Rows of nine target tables for each READY reference; those whose identifier collides with another's stop."""
    ref_, text_ = F.col("ref"), F.col("ref").cast("string")
    identifier = F.floor(ref_ / 3) * 3 + F.when(F.col("p_size") % 5 == 0, 0).otherwise(ref_ % 3)
    ready = planned(t).where("status = 'READY'").join(t.part, F.col("p_partkey") == ref_).withColumn("identifier", identifier)
    unique = ready.groupBy("identifier").agg(F.count("*").alias("n")).where("n = 1").select("identifier")
    keys = [F.concat(F.lit("ref:"), text_), F.concat(F.lit("ref:"), text_, F.lit(":"), F.col("p_type")), text_, F.concat(F.lit("fr:"), F.col("preferred")), F.col("p_brand"), F.concat(F.lit("official:"), text_), F.concat(F.lit("https://www.example.org/"), text_, F.lit(".jpg")), F.col("identifier").cast("string"), (F.col("p_retailprice") * 100).cast("decimal(20, 0)").cast("string")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("target"), k.alias("key")) for n, k in zip(TARGETS, keys, strict=True)]))
    return ready.join(unique, "identifier").select("ref", rows.alias("r")).select("ref", "r.*")
