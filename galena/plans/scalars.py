"""Scalar functions over the driver's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions import reference as ref
from galena.functions import text, values
from galena.plans.base import query
from galena.sources.views import Tables

_FOLD = "nullif(trim(regexp_replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g')), '')"


@query("fold_text", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded, length({_FOLD.format('text')}) AS n FROM documents")
def fold_text(t: Tables) -> DataFrame:
    folded = text.fold_text(F.col("text"))
    return t.documents.select("doc_id", F.md5(folded).alias("folded"), F.length(folded).cast("long").alias("n"))


@query("slug", f"SELECT page_id, replace({_FOLD.format('url')}, ' ', '-') AS slug, substr(replace({_FOLD.format('url')}, ' ', '-'), 1, 20) AS short FROM pages")
def slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.slug(F.col("url")).alias("slug"), text.slug(F.col("url"), 20).alias("short"))


_TOK = "list_filter(string_split(coalesce({0}, ''), ' '), lambda x: length(x) > 1)"


@query("token_jaccard", f"""
    WITH f AS (SELECT p_partkey, {_FOLD.format('p_name')} AS a, {_FOLD.format("(p_type || ' ' || p_name || ' ' || p_brand)")} AS b FROM part), k AS (SELECT p_partkey, a, b, list_distinct({_TOK.format('a')}) AS x, list_distinct({_TOK.format('b')}) AS y FROM f)
    SELECT p_partkey, CASE WHEN len(x) = 0 OR len(y) = 0 THEN CAST(a IS NOT DISTINCT FROM b AS DOUBLE) ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END AS similarity FROM k""")
def token_jaccard(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.token_jaccard(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("similarity"))


@query("reference_normalize", "SELECT p_partkey, upper(regexp_replace(translate(trim('  ' || p_brand || ' – ' || CAST(p_size AS VARCHAR) || ' '), '‐‑‒–—', '-----'), '\\s+', '', 'g')) AS reference FROM part")
def reference_normalize(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("p_brand"), F.lit(" – "), F.col("p_size").cast("string"), F.lit(" "))
    return t.part.select("p_partkey", ref.reference_normalize(raw).alias("reference"))


def part_name() -> Column:
    """A name for a part, in the forms that names of a catalogue have, by its size."""
    k, size = F.col("p_size") % 12, F.col("p_size")
    noun, name = F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_name")
    form = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" (basic)"))).when(k == 2, F.concat(name, F.lit(" [Deluxe ]"))).when(k == 3, F.concat(name, F.lit(" cover ship"))).when(k == 4, F.concat(name, F.lit(" Cover castle"))).when(k == 5, F.concat(name, F.lit(" with "), F.lower("p_type")))
    form = form.when(k == 6, F.concat(F.lit("U "), (size % 3).cast("string"), F.lit(" "), noun)).when(k == 7, F.concat(name, F.lit(" edition "), (size % 4).cast("string"))).when(k == 8, F.concat(name, F.lit(" Heft "), (size % 5).cast("string"))).when(k == 9, F.concat(F.when(size % 2 == 0, "Blau").otherwise("rouge"), F.lit(" "), noun))
    return form.when(k == 10, F.lit(None)).otherwise(F.concat(F.lit("Été "), name, F.lit(" 3/1999")))


NAMES = """names AS (SELECT *, lower(strip_accents(name)) AS low, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS folded, string_split(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM (
        SELECT *, CASE p_size % 12 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (basic)' WHEN 2 THEN p_name || ' [Deluxe ]' WHEN 3 THEN p_name || ' cover ship' WHEN 4 THEN p_name || ' Cover castle' WHEN 5 THEN p_name || ' with ' || lower(p_type) WHEN 6 THEN 'U ' || CAST(p_size % 3 AS VARCHAR) || ' ' || split_part(p_name, ' ', 2)
        WHEN 7 THEN p_name || ' edition ' || CAST(p_size % 4 AS VARCHAR) WHEN 8 THEN p_name || ' Heft ' || CAST(p_size % 5 AS VARCHAR) WHEN 9 THEN CASE WHEN p_size % 2 = 0 THEN 'Blau' ELSE 'rouge' END || ' ' || split_part(p_name, ' ', 2) WHEN 10 THEN NULL ELSE 'Été ' || p_name || ' 3/1999' END AS name FROM part))"""
_COLOURS = ", ".join(f"'{c}'" for c in text.COLOURS)
_QUALIFIED = r"'^(.*?)\s*[(\[]\s*([^\])]+)\s*[)\]]\s*$'"


def _half(marker: str, side: int) -> str:
    return f"CASE WHEN len(string_split(folded, ' {marker} ')) = 2 THEN nullif(string_split(folded, ' {marker} ')[{side}], '') END"


DESCRIPTORS = f"""folded, nullif(trim(regexp_replace(lower(strip_accents(regexp_extract(name, {_QUALIFIED}, 1))), '[^a-z0-9]+', ' ', 'g')), '') AS stem, nullif(trim(regexp_replace(lower(strip_accents(regexp_extract(name, {_QUALIFIED}, 2))), '[^a-z0-9]+', ' ', 'g')), '') AS qualifier,
    nullif(lower(regexp_extract(name, '(?i)\\b(?:heft|folge|issue|no|nr)\\.?\\s*[0-9]+\\b|\\b[0-9]+/[0-9]{{4}}\\b')), '') AS issue, nullif(array_to_string(list_sort(list_distinct(list_filter(words, lambda x: x IN ({_COLOURS})))), ','), '') AS colours,
    CASE WHEN len(list_filter(words, lambda x: x IN ({_COLOURS}))) > 0 THEN array_to_string(list_filter(words, lambda x: x NOT IN ({_COLOURS})), ' ') END AS colour_core, coalesce(nullif(replace(regexp_extract(folded, '\\b[us] ?[0-9]+\\b'), ' ', ''), ''), CASE WHEN contains(folded, 'tram') THEN 'tram' END) AS route,
    {_half('cover', 1)} AS cover_core, {_half('cover', 2)} AS cover, {_half('with', 1)} AS with_core, {_half('with', 2)} AS with_, nullif(regexp_extract(folded, '\\b(?:edition|version|series|part|folge|issue|heft|nr|no) *[0-9]+\\b'), '') AS numbered"""


def raw_reference() -> Column:
    """The number of a line's part with a suffix by the place of the line."""
    n = F.col("l_linenumber")
    return F.concat(F.col("l_partkey").cast("string"), F.when(n == 1, " v2").when(n == 2, "-us").when(n == 3, "-a").when(n == 4, "/5").when(n == 5, "d").otherwise(""))


_RAW = "CAST(l_partkey AS VARCHAR) || CASE l_linenumber WHEN 1 THEN ' v2' WHEN 2 THEN '-us' WHEN 3 THEN '-a' WHEN 4 THEN '/5' WHEN 5 THEN 'd' ELSE '' END"


@query("reference_parse", f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, regexp_replace(upper({_RAW}), '\\s+', '', 'g') AS r FROM lineitem),
    s AS (SELECT *, regexp_matches(r, '^.+?V[0-9]+$') AS v, regexp_matches(r, '^[0-9]{{3,8}}-[A-Z][A-Z0-9-]*$') AS h, regexp_extract(r, '^[0-9]{{3,8}}-([A-Z][A-Z0-9-]*)$', 1) AS tail FROM r)
    SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN v THEN regexp_extract(r, '^(.+?)V([0-9]+)$', 1) WHEN h THEN regexp_extract(r, '^([0-9]+)-', 1) ELSE r END AS base, CASE WHEN v THEN 'V' || regexp_extract(r, '^(.+?)V([0-9]+)$', 2) WHEN h THEN tail END AS suffix,
        CASE WHEN v THEN TRY_CAST(regexp_extract(r, 'V([0-9]+)$', 1) AS BIGINT) END AS number, CASE WHEN v THEN 'version' WHEN h AND (length(tail) > 1 OR contains(tail, '-')) THEN 'market' WHEN h THEN 'edition' ELSE 'none' END AS signal,
        CASE WHEN NOT v AND NOT h AND NOT regexp_matches(r, '^[A-Z0-9-]+$') THEN ['unrecognised-characters'] ELSE [] END AS warnings FROM s""")
def reference_parse(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", ref.reference_parse(raw_reference()).alias("p")).select("l_orderkey", "l_linenumber", "l_suppkey", "p.*")


@query("placeholder", r"""
    WITH r AS (SELECT o_orderkey, regexp_replace(upper(CASE o_orderkey % 7 WHEN 0 THEN '000' WHEN 1 THEN ' n/a' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN '0 v2-de' WHEN 4 THEN '0001' WHEN 5 THEN 'NA-7' END), '\s+', '', 'g') AS r FROM orders)
    SELECT o_orderkey, coalesce(regexp_matches(r, '^(0+(V[0-9]+)?|N/?A)(-[A-Z0-9-]+)?$'), TRUE) AS placeholder FROM r""")
def placeholder(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 7
    raw = F.when(k == 0, "000").when(k == 1, " n/a").when(k == 2, F.col("o_orderkey").cast("string")).when(k == 3, "0 v2-de").when(k == 4, "0001").when(k == 5, "NA-7")
    return t.orders.select("o_orderkey", ref.placeholder(raw).alias("placeholder"))


@query("name_descriptors", f"WITH {NAMES} SELECT p_partkey, {DESCRIPTORS} FROM names")
def name_descriptors(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.descriptors(part_name()).alias("d")).select("p_partkey", "d.*")


_FORMS = ["Catalogue 12", "Sticker album", "Magazine", "Blister", "Figure bag", "Standard Box", ""]


@query("infer_kind", f"""WITH s AS (SELECT p_partkey, p_size % 11 = 0 AS promo, lower(trim(({_FORMS})[1 + p_size % 7] || ' ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN ' Promotional' ELSE '' END)) AS signal FROM part)
    SELECT p_partkey, CASE WHEN contains(signal, 'catalog') THEN 'CATALOGUE' WHEN regexp_matches(signal, 'merch|sticker|book|magazine|multimedia') THEN 'MERCHANDISE' WHEN contains(signal, 'promotion') OR promo THEN 'PROMOTIONAL_ITEM' WHEN contains(signal, 'figure') THEN 'FIGURE' ELSE 'SET' END AS kind FROM s""")
def infer_kind(t: Tables) -> DataFrame:
    form = F.get(F.array(*map(F.lit, _FORMS)), F.col("p_size") % 7)
    tags = F.when(F.col("p_partkey") % 5 == 0, F.array(F.col("p_name"), F.lit("Promotional"))).otherwise(F.array(F.col("p_name")))
    return t.part.select("p_partkey", values.product_kind(form, tags, F.col("p_size") % 11 == 0).alias("kind"))


@query("variant_kind", f"""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 2 THEN 'MARKET' WHEN l_linenumber IN (1, 3) THEN 'EDITION' WHEN l_discount > 0.05 THEN 'PROMOTION' WHEN l_tax > 0.05 THEN 'EXCLUSIVE' ELSE 'STANDARD' END AS kind FROM lineitem WHERE length(CAST(l_partkey AS VARCHAR)) >= 3 OR l_linenumber NOT IN (2, 3)
    UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_discount > 0.05 THEN 'PROMOTION' WHEN l_tax > 0.05 THEN 'EXCLUSIVE' ELSE 'STANDARD' END FROM lineitem WHERE length(CAST(l_partkey AS VARCHAR)) < 3 AND l_linenumber IN (2, 3)""")
def variant_kind(t: Tables) -> DataFrame:
    """Kinds by the signal of the parsed reference; numbers of one or two digits have no suffix that signals."""
    signal = ref.reference_parse(raw_reference())["signal"]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", values.variant_kind(signal, F.col("l_discount") > 0.05, F.col("l_tax") > 0.05).alias("kind"))


@query("record_qualifier", "SELECT l_partkey, substr(sha256(CAST(min(l_suppkey) AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR)), 1, 16) AS qualifier FROM lineitem GROUP BY 1")
def record_qualifier(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("source"))
    return first.select("l_partkey", ref.record_qualifier(F.col("source"), F.col("l_partkey")).alias("qualifier"))


def set_url(brand: Column, key: Column) -> Column:
    """A page address for a part, with its number, markets and words in the slug in several ways."""
    k = key % 8
    number = (key % 9000 + 100).cast("string")
    slug = F.when(k == 0, F.concat(number, F.lit("-2-pirate-ship"))).when(k == 1, F.concat(number, F.lit("-usa-castle"))).when(k == 2, F.concat(F.lit("n-a-"), number)).when(k == 3, F.concat(F.lit("pm"), number, F.lit("-ger-uk-farm"))).when(k == 4, F.concat(number, F.lit("-1-2-3-fra-ita-zoo"))).when(k == 5, F.lit("castle")).when(k == 6, F.concat(F.lit("--"), number, F.lit("--")))
    return F.concat(F.lit("https://www.example.org/"), F.when(k == 7, F.lit("about")).otherwise(F.lit("en/sets")), F.lit("/"), F.coalesce(slug, number), F.when(key % 3 == 0, F.lit("/?x=1")).otherwise(""))


SET_URL = """'https://www.example.org/' || CASE WHEN p_partkey % 8 = 7 THEN 'about' ELSE 'en/sets' END || '/' || CASE p_partkey % 8 WHEN 0 THEN num || '-2-pirate-ship' WHEN 1 THEN num || '-usa-castle' WHEN 2 THEN 'n-a-' || num WHEN 3 THEN 'pm' || num || '-ger-uk-farm' WHEN 4 THEN num || '-1-2-3-fra-ita-zoo' WHEN 5 THEN 'castle' WHEN 6 THEN '--' || num || '--' ELSE num END || CASE WHEN p_partkey % 3 = 0 THEN '/?x=1' ELSE '' END"""
_MARKETS = "(?:-(?:" + "|".join(ref.MARKETS) + ")(?:-|$))"
_URLREF = f"""u0 AS (SELECT p_partkey, p_size, {SET_URL} AS url FROM (SELECT *, CAST(p_partkey % 9000 + 100 AS VARCHAR) AS num FROM part)),
    u1 AS (SELECT *, list_filter(string_split(trim(lower(regexp_extract(url, '/sets/([^/?#]+)', 1)), '-'), '-'), lambda x: x <> '') AS s FROM u0),
    u2 AS (SELECT *, coalesce(nullif(list_position(list_transform(s[2:], lambda x: regexp_full_match(x, '[0-9]+')), FALSE), 0) - 1, greatest(len(s) - 1, 0)) AS numbers FROM u1),
    u3 AS (SELECT *, least(coalesce(nullif(list_position(list_transform(s[2 + numbers:], lambda x: x IN ({", ".join(f"'{m}'" for m in ref.MARKETS)})), FALSE), 0) - 1, greatest(len(s) - 1 - numbers, 0)), greatest(4 - numbers, 0)) AS markets FROM u2),
    u AS (SELECT p_partkey, p_size, url, CASE WHEN s[1] = 'n' AND s[2] = 'a' THEN 'N-A' WHEN regexp_full_match(s[1], '[a-z]*[0-9][a-z0-9.]*') THEN upper(array_to_string(s[1:1 + numbers + markets], '-')) END AS reference FROM u3)"""


@query("url_reference", f"WITH {_URLREF} SELECT p_partkey, url, reference FROM u")
def url_reference(t: Tables) -> DataFrame:
    url = set_url(F.col("p_brand"), F.col("p_partkey"))
    return t.part.select("p_partkey", url.alias("url"), ref.url_reference(url).alias("reference"))


DECLARED = "CASE p_size % 6 WHEN 0 THEN '000' WHEN 1 THEN NULL WHEN 2 THEN CAST(p_partkey % 9000 + 100 AS VARCHAR) || '-' || 'FAM' WHEN 3 THEN '77' ELSE CAST(p_partkey % 9000 + 100 AS VARCHAR) END"
EVIDENCE = """CASE WHEN coalesce(d, '') = '' OR coalesce(c, '') = '' THEN 'NONE' WHEN regexp_matches(d, '^(0+(V[0-9]+)?|N/?A)(-[A-Z0-9-]+)?$') OR regexp_matches(c, '^N-?A(-|$)') THEN 'WEAK' WHEN a = b THEN 'EXACT'
        WHEN starts_with(a, b) AND regexp_full_match(substr(a, length(b) + 1), '[A-Z][A-Z0-9]*') THEN 'COMPATIBLE_BASE' WHEN starts_with(b, a) AND regexp_full_match(substr(b, length(a) + 1), '[2-9]') THEN 'COMPATIBLE_BASE' ELSE 'STRONG_MISMATCH' END"""


def declared(key: Column, size: Column) -> Column:
    k, number = size % 6, (key % 9000 + 100).cast("string")
    return F.when(k == 0, "000").when(k == 1, F.lit(None)).when(k == 2, F.concat(number, F.lit("-FAM"))).when(k == 3, "77").otherwise(number)


EVIDENCE_OF_PARTS = f"""{_URLREF}, v AS (SELECT p_partkey, d, c, regexp_replace(upper(d), '[^A-Z0-9]+', '', 'g') AS a, regexp_replace(upper(c), '[^A-Z0-9]+', '', 'g') AS b FROM (SELECT p_partkey, {DECLARED} AS d, reference AS c FROM u)),
    w AS (SELECT p_partkey, {EVIDENCE} AS evidence FROM v)"""


def evidence_of_parts(t: Tables) -> DataFrame:
    candidate = ref.url_reference(set_url(F.col("p_brand"), F.col("p_partkey")))
    return t.part.select("p_partkey", declared(F.col("p_partkey"), F.col("p_size")).alias("d"), candidate.alias("c")).select("p_partkey", ref.url_evidence(F.col("d"), F.col("c")).alias("evidence"))


@query("url_evidence", f"WITH {EVIDENCE_OF_PARTS} SELECT p_partkey, evidence FROM w")
def url_evidence(t: Tables) -> DataFrame:
    return evidence_of_parts(t)


@query("gtin_valid", """
    WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7 AS VARCHAR), CASE WHEN p_size % 3 = 0 THEN 8 WHEN p_size % 3 = 1 THEN 13 ELSE 11 END, '0') AS code FROM part)
    SELECT p_partkey, code, length(code) IN (8, 12, 13, 14) AND list_sum(list_transform(range(1, length(code) + 1), lambda i: CAST(substr(reverse(code), i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 AS valid FROM c""")
def gtin_valid(t: Tables) -> DataFrame:
    width = F.when(F.col("p_size") % 3 == 0, 8).when(F.col("p_size") % 3 == 1, 13).otherwise(11)
    code = F.lpad((F.col("p_partkey") * 7).cast("string"), width, F.lit("0"))
    return t.part.select("p_partkey", code.alias("code")).select("p_partkey", "code", ref.gtin_valid(F.col("code")).alias("valid"))


@query("identifier_normalize", """
    WITH i AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'EAN' ELSE 'SKU' END AS kind, ' ' || lower(p_brand) || '-' || CAST(p_partkey + 1000000 AS VARCHAR) AS value FROM part), d AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM i)
    SELECT p_partkey, CASE WHEN kind IN ('GTIN', 'EAN') THEN CASE WHEN length(digits) IN (8, 12, 13, 14) THEN digits END ELSE nullif(upper(trim(value)), '') END AS identifier FROM d""")
def identifier_normalize(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "EAN").otherwise("SKU")
    value = F.concat(F.lit(" "), F.lower("p_brand"), F.lit("-"), (F.col("p_partkey") + 1000000).cast("string"))
    return t.part.select("p_partkey", ref.identifier_normalize(kind, value).alias("identifier"))


@query("observation_key", "SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || coalesce(CASE WHEN l_tax > 0.02 THEN l_returnflag END, 'global') AS key FROM lineitem")
def observation_key(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", ref.observation_key(F.col("l_suppkey"), F.col("l_partkey"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag"))).alias("key"))


@query("title_match", """
    SELECT o_orderkey, contains(' ' || regexp_replace(lower('Lot ' || CAST(o_orderkey AS VARCHAR) || '/' || o_orderpriority), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || CAST(o_custkey AS VARCHAR) || ' ') AS by_customer,
    contains(' ' || regexp_replace(lower('Lot ' || CAST(o_orderkey AS VARCHAR) || '/' || o_orderpriority), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || CAST(o_orderkey AS VARCHAR) || ' ') AS by_order FROM orders""")
def title_match(t: Tables) -> DataFrame:
    title = F.concat(F.lit("Lot "), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", text.title_match(title, F.col("o_custkey").cast("string")).alias("by_customer"), text.title_match(title, F.col("o_orderkey").cast("string")).alias("by_order"))


@query("condition_map", "SELECT l_returnflag || l_linestatus AS code, CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'NEW' WHEN 'NF' THEN 'NEW' WHEN 'RF' THEN 'USED' WHEN 'AF' THEN 'USED' ELSE 'UNKNOWN' END AS condition, count(*) AS n FROM lineitem GROUP BY 1, 2")
def condition_map(t: Tables) -> DataFrame:
    codes = t.spark.createDataFrame([("NO", "NEW"), ("NF", "NEW"), ("RF", "USED"), ("AF", "USED")], "code string, condition string")
    n = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("code")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(codes), "code", "left").select("code", F.coalesce("condition", F.lit("UNKNOWN")).alias("condition"), "n")


_STATUSES = ["in_stock", "pre_order", "available_on_order", "stock_on_order", "not_in_stock", "out_of_stock", "unknown_status"]


@query("availability_map", f"SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 8 < 4 THEN 'AVAILABLE' WHEN l_linenumber % 8 < 6 THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS availability FROM lineitem")
def availability_map(t: Tables) -> DataFrame:
    status = F.get(F.array(*map(F.lit, _STATUSES)), F.col("l_linenumber") % 8)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", values.availability(status).alias("availability"))


@query("parse_measures", """
    SELECT p_partkey, CAST(p_size AS BIGINT) * 10 + 5 AS length_mm, CAST(p_size + 1 AS BIGINT) * 10 AS width_mm, CAST(20 AS BIGINT) AS height_mm, CASE WHEN p_size % 3 > 0 THEN CAST(CASE WHEN p_size % 3 = 1 THEN p_size * 1000 + 500 ELSE p_size END AS BIGINT) END AS weight_g FROM part""")
def parse_measures(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    weight = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit(", "), n, F.lit(",5 kg"))).when(F.col("p_size") % 3 == 2, F.concat(F.lit(", "), n, F.lit(" g"))).otherwise("")
    raw = F.concat(n, F.lit(",5 x "), (F.col("p_size") + 1).cast("string"), F.lit(" x 2 cm"), weight)
    return t.part.select("p_partkey", values.parse_measures(raw).alias("m")).select("p_partkey", "m.*")


@query("parse_year", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def parse_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", values.parse_year(F.concat(F.lit("released in "), F.date_format("o_orderdate", "MM/yyyy"))).alias("year"))


@query("display_name", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE NULL END), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END), ''), p_brand) AS name FROM part")
def display_name(t: Tables) -> DataFrame:
    blank, name = F.when(F.col("p_size") % 3 == 0, "  "), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")
    return t.part.select("p_partkey", text.display_name(blank, name, F.col("p_brand")).alias("name"))


@query("preferred_translation", """
    SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, n_chars DESC, doc_id) = 1""")
def preferred_translation(t: Tables) -> DataFrame:
    from galena.operators.windows import latest_per_key

    locale = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "en", 1).otherwise(2)
    return latest_per_key(t.documents.select("source", "doc_id", "lang", "n_chars"), ["source"], [locale.asc(), F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", "lang")


@query("label_lookup", "SELECT s_suppkey, coalesce(r_name, n_name) AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_nationkey")
def label_lookup(t: Tables) -> DataFrame:
    labels = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.coalesce("r_name", "n_name").alias("label"))
    return t.supplier.join(F.broadcast(labels), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "label")


@query("market_code", "SELECT n_nationkey, substr(trim(regexp_replace(upper('(' || n_name || ') / ' || r_name), '[^A-Z0-9]+', '-', 'g'), '-'), 1, 16) AS code FROM nation JOIN region ON r_regionkey = n_regionkey")
def market_code(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("n_nationkey", text.market_code(F.concat(F.lit("("), F.col("n_name"), F.lit(") / "), F.col("r_name"))).alias("code"))


@query("era_bucket", "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '2020s' WHEN 1978 + p_size < 1990 THEN 'before-1990' ELSE CAST((1978 + p_size) // 10 * 10 AS VARCHAR) || 's' END AS era FROM part")
def era_bucket(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", values.era_bucket(F.when(F.col("p_size") % 9 > 0, 1978 + F.col("p_size"))).alias("era"))


@query("json_keys", "SELECT event_id, array_to_string(json_keys(props), ',') AS keys, json_exists(props, '$.k') AS has_k FROM events")
def json_keys(t: Tables) -> DataFrame:
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.array_join(keys, ",").alias("keys"), F.array_contains(keys, "k").alias("has_k"))


@query("tag_overlap", "SELECT event_id, (CAST(json_extract(props, '$.k') AS INT) % 10) IN (3, 5) OR (CAST(json_extract(props, '$.k') AS INT) // 10) IN (3, 5) AS tagged FROM events")
def tag_overlap(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", F.arrays_overlap(F.array(k % 10, F.floor(k / 10).cast("int")), F.array(F.lit(3), F.lit(5))).alias("tagged"))


@query("json_claim", """WITH c AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events)
    SELECT event_id, CASE WHEN k > 50 THEN event_type END AS exclusive, CASE WHEN k % 4 = 0 AND k % 3 > 0 THEN 'DE' END AS market, CASE WHEN k % 4 = 0 AND k % 3 > 0 THEN event_type END AS statement FROM c""")
def json_claim(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    claim = F.struct(F.when(k % 4 == 0, " de ").when(k % 4 == 1, "fr").otherwise("").alias("marketCode"), F.when(k % 3 > 0, F.concat(F.lit(" "), F.col("event_type"))).otherwise(" ").alias("statement"))
    payload = F.to_json(F.struct(F.when(k > 50, F.concat(F.col("event_type"), F.lit(" "))).otherwise("").alias("exclusive"), claim.alias("marketExclusive")))
    return t.events.select("event_id", values.exclusive_claims(payload, F.lit("DE")).alias("c")).select("event_id", "c.*")


@query("age_bucket", f"""
    WITH m AS (SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-02-01') // 60 AS m FROM events) SELECT event_id, CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min' WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || ' h' ELSE CAST(m // 1440 AS VARCHAR) || ' d' END AS age FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 60000000) AS BIGINT) AS m FROM events)""".replace("WITH m AS (SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-02-01') // 60 AS m FROM events) ", ""))
def age_bucket(t: Tables) -> DataFrame:
    return t.events.select("event_id", values.age_bucket(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("age"))


@query("mask_postcode", "SELECT c_custkey, substr(c_name, 1, 2) || repeat('*', length(c_name) - 2) AS masked FROM customer")
def mask_postcode(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.mask_postcode(F.col("c_name")).alias("masked"))


@query("numeric_exprs", """
    SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high, greatest(c_acctbal, 0) AS positive, least(greatest(c_nationkey, 0), 3) AS clamped, TRY_CAST(substr(c_name, 10) AS BIGINT) AS number, TRY_CAST(c_mktsegment AS INT) AS nothing FROM customer""")
def numeric_exprs(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.floor(b).alias("low"), F.ceil(b).alias("high"), F.greatest(b, F.lit(0.0)).alias("positive"), values.clamp(F.col("c_nationkey"), 0, 3).alias("clamped"), F.substring("c_name", 10, 99).try_cast("bigint").alias("number"), F.col("c_mktsegment").try_cast("int").alias("nothing"))


@query("date_exprs", f"""
    SELECT event_id, make_date(year(ts), 1, 1) AS new_year, CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) AS six_hours, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_number, year(ts) AS year FROM events""")
def date_exprs(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", F.make_date(F.year(ts), F.lit(1), F.lit(1)).alias("new_year"), F.floor(F.unix_seconds(ts.cast("timestamp")) / 21600).alias("six_hours"), F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("long").alias("day_number"), F.year(ts).alias("year"))
