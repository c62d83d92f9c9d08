"""Page extraction and snapshots, over the page table and data that Spark derives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.plans.base import query
from galena.sources import identifiers
from galena.sources import pages as jobs
from galena.sources.tables import normalize_payload, scratch, sitemap, snapshot, snapshot_sweep
from galena.sources.views import Tables


@query("page_scan", "SELECT page_id, sha256(html) AS digest, strlen(html) AS bytes FROM pages")
def page_scan(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))


def _part() -> tuple[Column, Column, Column]:
    return F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_size").cast("string")


def community_pages(t: Tables) -> DataFrame:
    """A community page for each part, with fields that are missing, doubtful or said to be nothing."""
    k, s, _ = _part()
    blister = F.when(s % 4 == 0, "N/A").when(s % 4 == 1, "Blister (wrong?)").otherwise("Standard  Box")
    market = F.when(s % 3 == 0, '<a href="/export-markets/ger/">Germany</a>, <a href="/export-markets/fra/">France</a>').when(s % 3 == 1, "Spain / Italy").otherwise("None")
    parts = [
        '<html><head><meta property="og:image" content="https://img.example.org/', k, '.jpg"></head><body><article><h1 class="entry-title">Brand ', (100 + F.col("p_partkey")).cast("string"), " - ", F.col("p_name"),
        '</h1><div class="info"><img alt="English"> ', F.col("p_name"), ' &amp; co<br><img alt="Deutsch"> ', F.when(s % 3 == 0, "(n/a)").otherwise(F.concat(F.col("p_name"), F.lit(" deutsch"))), '<br><img alt="Flag"> x<br><strong>Theme:</strong> <a href="/theme/1">',
        F.col("p_type"), '</a> <a aria-label="Edit" href="/editor/1">edit</a><br><strong>Format:</strong> ', blister, "<br><strong>Released:</strong> ", F.when(s % 5 == 0, "unknown").otherwise(F.concat(F.lit("May "), (1990 + s % 20).cast("string"))), "<br><strong>Discontinued:</strong> None<br><strong>Exclusive:</strong> ",
        F.when(s % 6 == 0, "Promotional").otherwise("none"), "<br><strong>Export Market:</strong> ", market, "<br><strong>Figures:</strong> ", (s % 7).cast("string"), '<br><div class="tags"><a href="/tag/1">', F.col("p_type"), '</a></div></div><a rel="lightbox[set]" title="Box" href="https://img.example.org/', k, '-box.jpg"><img alt="x"></a><a rel="lightbox[set]" href="https://img.example.org/', k,
        '-rear.jpg"><img title="rear side"></a><a rel="lightbox[set]" href="https://img.example.org/none.png"></a><a rel="lightbox[set]" href="https://img.example.org/', k, '.jpg"></a><a href="/files/', k, '.pdf">leaflet</a><h4>PARTS IN THIS SET</h4><div><a href="/parts/1" title="', k, " - ", F.col("p_brand"), ' part">x</a><a href="/other/1">1 - o</a></div><h4>Figures in this set</h4><div><a href="/figures/2">f', k, " - ", F.col("p_name"), "</a></div></article></body></html>",
    ]
    # A row of the table becomes a page of 2 kB, so rows are dealt out before that.
    return t.part.repartition(t.spark.sparkContext.defaultParallelism, "p_partkey").select(F.col("p_partkey").alias("page_id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("html"))


_RECORD = """rec AS (SELECT p_partkey AS page_id, CAST(100 + p_partkey AS VARCHAR) AS reference, p_name || ' & co' AS name, 'en=' || p_name || ' & co' || CASE WHEN p_size % 3 > 0 THEN '|de=' || p_name || ' deutsch' ELSE '' END AS translations, CASE WHEN p_size % 5 > 0 THEN 1990 + p_size % 20 END AS release_year, CAST(NULL AS INT) AS discontinued_year, p_type AS theme,
    CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Blister' ELSE 'Standard Box' END AS format, CASE WHEN p_size % 6 = 0 THEN 'Promotional' END AS exclusive, CASE p_size % 3 WHEN 0 THEN 'ger|fra' WHEN 1 THEN 'Spain|Italy' ELSE '' END AS markets, p_type AS tags, p_size % 6 = 0 AS promotion, p_size % 7 AS figure_count, 'f' || CAST(p_partkey AS VARCHAR) || ' - ' || p_name AS figures, CAST(p_partkey AS VARCHAR) || ' - ' || p_brand || ' part' AS parts,
    'main https://img.example.org/' || CAST(p_partkey AS VARCHAR) || '.jpg|box_front https://img.example.org/' || CAST(p_partkey AS VARCHAR) || '-box.jpg|box_back https://img.example.org/' || CAST(p_partkey AS VARCHAR) || '-rear.jpg' AS images, '/files/' || CAST(p_partkey AS VARCHAR) || '.pdf' AS instructions FROM part)"""
PLACEHOLDER = "https://img.example.org/none.png"


@query("page_record", f"WITH {_RECORD} SELECT * FROM rec")
def page_record(t: Tables) -> DataFrame:
    """Whole records, their lists joined to texts."""
    rows = jobs.page_records(community_pages(t), PLACEHOLDER)
    joined = {"translations": ("locale", "=", "name"), "figures": ("key", " - ", "name"), "parts": ("key", " - ", "name"), "images": ("kind", " ", "url")}

    def told(column: str, first: str, between: str, second: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat(x[first], F.lit(between), x[second])), "|")

    pairs = {c: told(c, *how) for c, how in joined.items()}
    return rows.withColumns(pairs | {c: F.array_join(c, "|") for c in ("markets", "tags", "instructions")})


@query("page_fields", f"WITH {_RECORD} SELECT page_id, theme || CASE WHEN TRUE THEN ' edit' END AS theme, format, CASE WHEN release_year IS NULL THEN 'unknown' ELSE 'May ' || CAST(release_year AS VARCHAR) END AS released, exclusive FROM rec")
def page_fields(t: Tables) -> DataFrame:
    """Single fields by expressions alone; ``page_record`` leaves the words of editing links out of them."""
    h = F.col("html")
    return community_pages(t).select("page_id", *[jobs.labelled_field(h, label).alias(label.lower()) for label in ("Theme", "Format", "Released", "Exclusive")])


@query("page_images", f"WITH {_RECORD}, i AS (SELECT page_id, unnest(string_split(images, '|')) AS x FROM rec) SELECT page_id, split_part(x, ' ', 1) AS kind, split_part(x, ' ', 2) AS url FROM i")
def page_images(t: Tables) -> DataFrame:
    rows = jobs.page_records(community_pages(t), PLACEHOLDER).select("page_id", F.explode("images").alias("i"))
    return rows.select("page_id", "i.kind", "i.url")


@query("page_linked_entities", "SELECT p_partkey AS page_id, 'part' AS kind, CAST(p_partkey AS VARCHAR) AS key, p_brand || ' part' AS name, '/parts/1' AS url FROM part UNION ALL SELECT p_partkey, 'figure', 'f' || CAST(p_partkey AS VARCHAR), p_name, '/figures/2' FROM part")
def page_linked_entities(t: Tables) -> DataFrame:
    rows = jobs.page_records(community_pages(t), PLACEHOLDER)

    def told(column: str, kind: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["key"].alias("key"), x["name"].alias("name"), x["url"].alias("url")))

    return rows.select("page_id", F.explode(F.concat(told("parts", "part"), told("figures", "figure"))).alias("e")).select("page_id", "e.*")


def official_pages(t: Tables) -> DataFrame:
    """An official page for each part: JSON-LD alone, in an array or in a graph, after a block that doesn't parse, or none."""
    k, s, size = _part()
    number = (70000 + F.col("p_partkey")).cast("string")
    kind = F.when(s % 2 == 0, '"Product"').otherwise('["Thing", "Product"]')
    product = F.concat(F.lit('{"@type": '), kind, F.lit(', "name": "'), F.col("p_name"), F.lit('", "sku": "'), number, F.lit('", "mpn": " M'), k, F.lit('", "gtin13": "40'), F.lpad(k, 11, F.lit("0")), F.lit('", "numberOfPieces": '), F.when(s % 4 == 0, F.concat(F.lit('"'), size, F.lit('"'))).otherwise(size), F.lit(', "image": ["https://i.example.org/box_front.jpg", "https://i.example.org/'), k, F.lit('.jpg"], "offers": {"priceCurrency": "EUR", "price": "'), size, F.lit(',50", "availability": "InStock"}}'))
    product = F.when(F.col("p_partkey") % 13 == 0, '{"@type": "Organization"}').otherwise(product)
    block = F.when(s % 3 == 0, product).when(s % 3 == 1, F.concat(F.lit('[{"@type": "Organization"}, '), product, F.lit("]"))).otherwise(F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, '), product, F.lit("]}")))
    parts = [
        '<html><body><nav class="breadcrumbs"><a href="/">Home</a><a href="/t">', F.col("p_type"), '</a><a href="/y">', (1990 + s % 20).cast("string"), "</a></nav><h1>Title ", F.col("p_name"), "</h1>", F.when(s % 10 == 0, '<div class="archive-info">old</div>').otherwise(""), F.when(s % 7 > 0, F.concat(F.lit("<p>Item number: PM"), number, F.lit("</p>"))).otherwise(""),
        '<div><span class="title">Package dimensions:</span> 25,5 x ', size, ' x 9.1 cm</div><div><span class="title">Weight:</span> ', size, ",5 kg</div><p>Figures: 2 knights, ", (s % 3 + 1).cast("string"), ' dogs Accessories: 3 swords</p>', F.when(s % 8 == 0, "").otherwise(F.concat(F.lit('<span class="price--list"><b class="value" content="'), size, F.lit('.99"></b></span>'))),
        F.when(s % 9 == 0, '<script type="application/ld+json">{"@type": </script>').otherwise(""), '<script type="application/ld+json">', block, "</script></body></html>",
    ]
    return t.dealt("part", "p_partkey").select(F.col("p_partkey").alias("page_id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("html"))


@query("page_jsonld", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 13 > 0 THEN CAST(70000 + p_partkey AS VARCHAR) END AS sku, CASE WHEN p_partkey % 13 > 0 THEN p_name END AS name FROM part")
def page_jsonld(t: Tables) -> DataFrame:
    product = jobs.json_ld_product(F.col("html"))
    return official_pages(t).select("page_id", product.alias("p")).select("page_id", *[F.try_variant_get("p", f"$.{c}", "string").alias(c) for c in ("sku", "name")])


@query("page_observation", """
    WITH o AS (SELECT *, p_partkey % 13 > 0 AS has, CAST(p_partkey AS VARCHAR) AS k FROM part), r AS (SELECT p_partkey AS page_id, CASE WHEN p_size % 7 > 0 THEN 'PM' || CAST(70000 + p_partkey AS VARCHAR) WHEN has THEN CAST(70000 + p_partkey AS VARCHAR) END AS reference, CASE WHEN has THEN p_name ELSE 'Title ' || p_name END AS name, 1990 + p_size % 20 AS release_year, 2 + p_size % 3 + 1 AS figure_count, CASE WHEN has THEN p_size END AS piece_count,
        '255 x ' || CAST(p_size * 10 AS VARCHAR) || ' x 91' AS package, CAST(p_size * 1000 + 500 AS BIGINT) AS weight_g, CASE WHEN has THEN 'box_front,gallery' ELSE '' END AS image_kinds, CASE WHEN has THEN 'box_front https://i.example.org/box_front.jpg,gallery https://i.example.org/' || k || '.jpg' ELSE '' END AS images, CASE WHEN has THEN CAST(70000 + p_partkey AS VARCHAR) END AS sku, CASE WHEN has THEN 'M' || k END AS mpn,
        CASE WHEN has THEN '40' || lpad(k, 11, '0') END AS gtin, 'Home,' || p_type || ',' || CAST(1990 + p_size % 20 AS VARCHAR) AS breadcrumbs, p_size % 10 = 0 AS archived, CASE WHEN has THEN CASE WHEN p_size % 8 = 0 THEN p_size + 0.5 ELSE p_size + 0.99 END END AS list_price, CASE WHEN has THEN p_size + 0.5 END AS current_price, CASE WHEN has THEN 'EUR' END AS currency, CASE WHEN has THEN 'InStock' END AS availability FROM o)
    SELECT * REPLACE (CAST(list_price AS DOUBLE) AS list_price, CAST(current_price AS DOUBLE) AS current_price) FROM r""")
def page_observation(t: Tables) -> DataFrame:
    pages = official_pages(t).withColumn("product", jobs.json_ld_product(F.col("html")))
    rows = pages.select("page_id", jobs.official_observation(F.col("html"), F.col("product")).alias("o")).select("page_id", "o.*")
    size = F.concat_ws(" x ", *[F.col(f"package_mm.{c}").cast("string") for c in ("width", "depth", "height")])
    return rows.withColumns({"package": size, **{c: F.array_join(c, ",") for c in ("image_kinds", "images", "breadcrumbs")}}).drop("package_mm", "product_mm", "description")


def listing_pages(t: Tables) -> DataFrame:
    """A listing page for each order, with a link for each of its lines, some of which are no offers."""

    def anchor(n: Column, p: Column) -> Column:
        tail = F.when(n % 3 == 0, " sortie prévue Août 2026").when(n % 3 == 1, " à partir de 9 &euro;").otherwise(" -20% -3")
        text = F.concat(F.lit("<b>Brand</b> Theme "), (n % 4).cast("string"), F.lit("\n "), F.when(n == 4, "?").otherwise((70000 + p % 3000).cast("string")), F.lit(" Castle "), p.cast("string"), F.lit("x"), tail)
        return F.concat(F.lit('<a class="c" href="'), F.when(n == 6, "/q").otherwise("/p"), p.cast("string"), F.lit('">'), text, F.lit("</a>"))

    # Numbers of lines are dealt out, and links written where the page is: they are many times as long. So the bytes that are
    # shuffled don't tell the work, and the number of tasks is given instead of found from them.
    parts = 4 * t.spark.sparkContext.defaultParallelism
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).repartition(parts, "l_orderkey")
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", "p", "s"))).alias("rows"))
    links = F.transform("rows", lambda r: anchor(r["n"], r["p"]))
    return rows.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("<html><body>"), F.array_join(links, "<br>"), F.lit("</body></html>")).alias("html"))


_LINES = "SELECT l_orderkey AS page_id, CAST(70000 + l_partkey % 3000 AS VARCHAR) AS reference, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber NOT IN (4, 6)"


@query("page_listing", f"""WITH r AS ({_LINES}) SELECT page_id, reference, 'Castle ' || CAST(l_partkey AS VARCHAR) || 'x' AS name, 'Theme ' || CAST(l_linenumber % 4 AS VARCHAR) AS theme, CASE WHEN l_linenumber % 3 = 0 THEN 'Août' END AS month, '/p' || CAST(l_partkey AS VARCHAR) AS url FROM r QUALIFY row_number() OVER (PARTITION BY page_id, reference ORDER BY place DESC) = 1""")
def page_listing(t: Tables) -> DataFrame:
    """Rows of each listing; of a reference that stands there twice the last one counts."""
    return listing_pages(t).select("page_id", F.inline(jobs.last_rows(jobs.listing_rows(F.col("html")), "reference")))


@query("page_manifest_diff", f"""
    WITH x AS (SELECT page_id, reference, row_number() OVER (PARTITION BY page_id ORDER BY min(place)) AS place FROM ({_LINES}) GROUP BY 1, 2), e AS (SELECT DISTINCT l_orderkey AS page_id, CAST(70000 + l_partkey % 3000 AS VARCHAR) AS reference FROM lineitem WHERE l_linenumber < 6)
    SELECT page_id, reference, CASE WHEN x.reference IS NULL THEN 'missing' WHEN e.reference IS NULL THEN 'unexpected' ELSE 'matched' END AS status, place FROM x FULL JOIN e USING (page_id, reference)""")
def page_manifest_diff(t: Tables) -> DataFrame:
    """References of each page, in the order that they stand there, against those that its manifest expects."""
    found = F.array_distinct(jobs.listing_references(F.col("html")))
    rows = listing_pages(t).select("page_id", F.posexplode(found).alias("at", "reference")).select("page_id", "reference", (F.col("at") + 1).cast("long").alias("place"))
    expected = t.lineitem.where("l_linenumber < 6").select(F.col("l_orderkey").alias("page_id"), (70000 + F.col("l_partkey") % 3000).cast("string").alias("reference")).distinct().withColumn("expected", F.lit(True))
    both = rows.join(expected, ["page_id", "reference"], "full_outer")
    return both.select("page_id", "reference", F.when(F.col("place").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("matched").alias("status"), "place")


@query("first_occurrence", """WITH m AS (SELECT page_id, regexp_extract_all(html, '<([a-z]+)[ >]', 1) AS f FROM pages) SELECT page_id, v AS value, list_position(f, v) AS place FROM (SELECT page_id, f, unnest(list_distinct(f)) AS v FROM m)""")
def first_occurrence(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.explode(jobs.first_occurrence(F.col("html"), "<([a-z]+)[ >]")).alias("o"))
    return rows.select("page_id", "o.value", F.col("o.place").cast("int").alias("place"))


@query("sitemap_urls", "SELECT page_id, 'url' AS kind, url AS loc, CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INT) AS VARCHAR) AS lastmod FROM pages")
def sitemap_urls(t: Tables) -> DataFrame:
    """Url sets made from the page table, then read as XML."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    bodies = t.pages.select("page_id", F.concat(F.lit("<urlset><url><loc> "), url, F.lit(" </loc><lastmod>"), day, F.lit("</lastmod></url></urlset>")).alias("xml"))
    return sitemap(bodies)


@query("offer_payload_normalize", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS code, event_type AS title, floor(value * 100) AS cents FROM events WHERE event_type <> 'error'""")
def offer_payload_normalize(t: Tables) -> DataFrame:
    """Payloads with the code at one of two places and no title for errors."""
    k = F.get_json_object("props", "$.k").cast("int")
    title = F.when(F.col("event_type") != "error", F.col("event_type"))
    flat = F.to_json(F.struct(k.alias("codeEan"), title.alias("title"), F.floor(F.col("value") * 100).alias("price")))
    nested = F.to_json(F.struct(F.struct(k.alias("ean")).alias("code"), title.alias("title"), F.floor(F.col("value") * 100).alias("price")))
    raw = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, flat).otherwise(nested).alias("payload"))
    out = normalize_payload(raw, "payload", {"code": (["$.codeEan", "$.code.ean"], "int"), "title": (["$.title"], "string"), "cents": (["$.price"], "double")}, ["title", "cents"])
    return out.select("event_id", "code", "title", "cents")


_CODE = "'40' || lpad(CAST(event_id % 1000000000 AS VARCHAR), 10, '0') || CAST(event_id % 10 AS VARCHAR)"
_FITS = "list_sum(list_transform(string_split(reverse(code), ''), lambda d, i: CAST(d AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0"
_WALKED = f"""e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, {_CODE} AS code FROM events), f AS (SELECT *, {_FITS} AS fits FROM e),
    w AS (SELECT event_id, '$.ean' AS path, 'ean' AS field, 'EAN' AS type, k AS raw, NULL AS normalized FROM f UNION ALL SELECT event_id, '$.a.b.c.d.e.EAN-13', 'EAN-13', 'EAN', code, CASE WHEN fits THEN code END FROM f
        UNION ALL SELECT event_id, '$.items[0].itemSku', 'itemSku', 'OFFICIAL_SKU', 's  ' || k, 'S ' || k FROM f UNION ALL SELECT event_id, '$.items[1].gtin[0]', 'gtin', 'GTIN', code, CASE WHEN fits THEN code END FROM f
        UNION ALL SELECT event_id, '$.items[1].gtin[1][0]', 'gtin', 'GTIN', '4008 7897-22164', '4008789722164' FROM f UNION ALL SELECT event_id, '$.items[1].gtin[2].mpn', 'mpn', 'MPN', '_' || k, NULL FROM f
        UNION ALL SELECT event_id, '$.officialIdentifiers[0].rawValue', 'officialIdentifiers', 'MPN', 'm-' || k, 'M-' || k FROM f UNION ALL SELECT event_id, '$.officialIdentifiers[1].rawValue[0]', 'officialIdentifiers', 'UNCLASSIFIED', k, NULL FROM f)"""


def walked(t: Tables) -> DataFrame:
    """Payloads with identifiers under keys in several spellings, in lists of lists, in typed entries and deep down."""
    k, code = F.get_json_object("props", "$.k"), F.expr("concat('40', lpad(cast(event_id % 1000000000 AS string), 10, '0'), cast(event_id % 10 AS string))")
    body = F.concat(
        F.lit('{"ean": '), k, F.lit(', "upc": true, "mpn": " ", "a": {"b": {"c": {"d": {"e": {"EAN-13": "'), code, F.lit('"}}}}}, "items": [{"itemSku": " s  '), k,
        F.lit('"}, {"gtin": ["'), code, F.lit('", ["4008 7897-22164"], {"mpn": "_'), k, F.lit('"}]}], "officialIdentifiers": [{"type": "MPN", "rawValue": "m-'), k, F.lit('"}, {"type": "OTHER", "rawValue": ['), k, F.lit("]}, {}, 7]}"),
    )
    return identifiers.identifier_walk(t.dealt("events", "event_id").select("event_id", F.parse_json(body).alias("v")), "event_id", "v")


@query("json_identifier_walk", f"WITH {_WALKED} SELECT *, normalized IS NOT NULL AS valid FROM w")
def json_identifier_walk(t: Tables) -> DataFrame:
    """Typed values of identifier-like keys at any depth, with their paths, normal form and whether they are valid."""
    return walked(t)


@query("identifier_report", f"WITH {_WALKED} SELECT type, count(*) AS found, count(normalized) AS valid, count(*) - count(normalized) AS invalid, count(DISTINCT normalized) AS different FROM w GROUP BY type")
def identifier_report(t: Tables) -> DataFrame:
    return identifiers.identifier_report(walked(t))


CHUNK = 10_000
_ENTRIES = "sourceRole string, observedAt string, entries array<struct<reference: string, name: string>>"


def snapshot_files(t: Tables, cut_off: str = "false") -> str:
    """A folder of snapshot files made from the part table: one for each brand and range of ids, so none grows with the table.

    The lines of a file are an envelope, an entry each, and the end, which files of ``cut_off`` lack.
    """
    rows = t.part.select("p_brand", F.floor(F.col("p_partkey") / CHUNK).alias("chunk"), F.col("p_partkey").alias("place"), F.to_json(F.struct(F.col("p_partkey").cast("string").alias("reference"), F.col("p_name").alias("name"))).alias("value"))
    files = rows.groupBy("p_brand", "chunk").agg(F.min("place").alias("first"))
    body = rows.join(files, ["p_brand", "chunk"]).select("p_brand", "chunk", "place", F.concat(F.when(F.col("place") > F.col("first"), ",").otherwise(""), "value").alias("value"))
    head = F.concat(F.lit('{"sourceRole": "'), "p_brand", F.lit('", "observedAt": "2024-01-01", "entries": ['))
    end = F.when(~F.expr(cut_off), F.struct(F.lit(1 << 62).alias("place"), F.lit("]}").alias("value")))
    ends = files.select("p_brand", "chunk", F.inline(F.filter(F.array(F.struct(F.lit(-1).cast("long").alias("place"), head.alias("value")), end), lambda e: e.isNotNull())))
    at = scratch(t.spark)
    body.unionByName(ends).repartition("p_brand", "chunk").sortWithinPartitions("p_brand", "chunk", "place").select("p_brand", "chunk", "value").write.partitionBy("p_brand", "chunk").text(at)
    return at


@query("snapshot_entries", "SELECT p_brand AS \"sourceRole\", '2024-01-01' AS \"observedAt\", CAST(p_partkey AS VARCHAR) AS reference, p_name AS name FROM part")
def snapshot_entries(t: Tables) -> DataFrame:
    return snapshot(t.spark, snapshot_files(t), schema=_ENTRIES).select("sourceRole", "observedAt", "reference", "name")


@query("snapshot_sweep", "SELECT p_brand AS role, count(*) AS entries FROM part WHERE p_brand NOT LIKE '%7' GROUP BY 1")
def snapshot_sweep_query(t: Tables) -> DataFrame:
    """A folder of snapshots of which some are cut off."""
    found = snapshot_sweep(t.spark, snapshot_files(t, "endswith(p_brand, '7')"), "*.txt")
    size = F.size(F.try_variant_get("payload", "$.entries", "array<variant>")).cast("long")
    return found.groupBy(F.try_variant_get("payload", "$.sourceRole", "string").alias("role")).agg(F.sum(size).alias("entries"))
