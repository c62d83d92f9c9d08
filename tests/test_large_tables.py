"""What a task holds doesn't grow with the number of groups, and expressions are evaluated once."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from galena.operators import aggregates
from galena.sources import pages
from galena.streaming import jobs


def test_masks_tell_the_groups_of_each_member(spark):
    rows = [(g, m) for m in range(40) for g in (0, 63, 64, -1, 1000) if (m + g) % 3]
    masks = aggregates.member_masks(spark.createDataFrame(rows + rows, "g int, m long"), "g", "m")
    assert sorted((r.g, r.m) for r in aggregates.groups_of(masks, "g").collect()) == sorted(rows)


def test_membership_totals_hold_a_number_for_each_member(spark):
    """Members that lie far apart: a bitmap for each bucket took 4 kB for each of these rows."""
    rows = spark.range(5000).select((F.col("id") % 7).cast("int").alias("g"), (F.col("id") * 1_000_003 - 7).alias("m"))
    held = rows.where("m % 2 = 0").select("m")
    got = {r.g: (r.total, r.missing) for r in aggregates.membership_totals(rows.unionByName(rows), held, "g", "m").collect()}
    want: dict = {}
    for i in range(5000):
        total, missing = want.get(i % 7, (0, 0))
        want[i % 7] = (total + 1, missing + ((i * 1_000_003 - 7) % 2))
    assert got == want


def test_each_page_is_read_once(spark):
    """Links of a page are found once, not again for each of its references; first places by sorting."""
    links = "".join(f'<a href="/p{i}">Brand Theme {70000 + i % 900} Castle {i}</a>' for i in range(3000))
    df = spark.createDataFrame([(f"<body>{links}</body>",), ("<p>none",), (None,)], "html string")
    got = [r.f for r in df.select(pages.listing_references(F.col("html")).alias("f")).collect()]
    assert got[0] == [str(70000 + i % 900) for i in range(3000)] and got[1] == [] and not got[2]
    plan = df.select(pages.listing_references(F.col("html")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    firsts = df.limit(1).select(F.explode(pages.first_occurrence(F.col("html"), "Brand Theme ([0-9]+)")).alias("o")).select("o.*").collect()
    assert [(r.value, r.place) for r in firsts] == [(str(70000 + i), i + 1) for i in range(900)]


def test_a_listing_row_is_read_once(spark):
    df = spark.createDataFrame([('<a href="/p1">Brand Theme 70001 Castle 1x sortie prévue Août 2026</a><a href="/p2">Brand x</a>',)], "html string")
    out = df.select(pages.listing_rows(F.col("html")).alias("r"))
    assert [tuple(x) for x in out.first().r] == [("70001", "Castle 1x", "Theme", "Août", "/p1")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("(.+?)") == 3


def test_links_of_a_listing_are_written_after_the_shuffle(spark):
    """Line numbers are shuffled once, not links and then rows again; the months of a row are looked for once for each use."""
    from galena.plans import QUERIES

    plan = QUERIES["page_listing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Septembre") == 2
    assert "Castle" not in plan[plan.index("Repartition") :]


def test_the_last_row_of_a_reference_counts(spark):
    tails = ["a mai", "b", "Mairie mai 2026 x", "C a partir decembre", "C à partir de 9 -20%", "C -20% sortie prevue AOUT", "c -5 à Partir de"]
    links = "".join(f'<A href="/p{i}"><b>Brand</b>\n Theme {70000 + i % 5} {tail}<i></A >\n</i></a>' for i, tail in enumerate(tails))
    df = spark.createDataFrame([(1, links), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    rows = df.select("page_id", F.inline(pages.last_rows(pages.listing_rows(F.col("html")), "reference"))).collect()
    want = [("70000", "C", "AOUT", "/p5"), ("70001", "c -5", None, "/p6"), ("70002", "Mairie", "Mai", "/p2"), ("70003", "C a partir", "decembre", "/p3"), ("70004", "C", None, "/p4")]
    assert sorted((r.reference, r.name, r.month, r.url) for r in rows) == want


def test_official_pages_are_dealt_out_and_parsed_once(spark):
    from galena.plans import QUERIES

    plan = QUERIES["page_observation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("ld\\+json.>") == 1


def test_few_records_are_held_as_objects(spark, monkeypatch):
    monkeypatch.setattr(pages, "RECORDS", 3)
    df = spark.range(20).coalesce(1).select(F.col("id").alias("page_id"), F.concat(F.lit("<h1>Brand 1 - Castle "), F.col("id"), F.lit("</h1>")).alias("html"))
    assert sorted((r.page_id, r.name) for r in pages.page_records(df).select("page_id", "name").collect()) == [(i, f"Castle {i}") for i in range(20)]


def test_an_offer_of_two_retailers_has_that_of_its_first_row(spark, tmp_path):
    """(3, 1000005) and (4, 5) are one offer. The later file is the larger one, which Spark reads first."""
    import duckdb

    from galena.plans import ORACLES, QUERIES

    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"COPY (SELECT range AS s_suppkey, 1 AS s_nationkey FROM range(30)) TO '{tmp_path}/supplier.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, n, lower in (("a", 400, 0), ("b", 4000, 1)):
        line = f"""SELECT i % 40 // 2 + 3 + CAST(i % 2 <> {lower} AS BIGINT) AS l_suppkey, i % 40 // 2 + CASE WHEN i % 2 <> {lower} THEN 0 ELSE 1000000 END AS l_partkey, i AS l_orderkey, 1 AS l_linenumber, 10.0::DOUBLE AS l_quantity, 100.0::DOUBLE AS l_extendedprice,
            0.0::DOUBLE AS l_discount, 0.04::DOUBLE AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2000-05-01' + INTERVAL (i % 3 * 40) DAY AS l_shipdate FROM (SELECT range AS i FROM range({n}))"""
        c.sql(f"COPY ({line}) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    for t, at in (("supplier", "supplier.parquet"), ("lineitem", "lineitem.parquet/*.parquet")):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{at}'")
    want = sorted(map(tuple, c.sql(ORACLES["offer_refresh"]).fetchall()))
    assert sorted(map(tuple, QUERIES["offer_refresh"](spark, str(tmp_path)).collect())) == want


def test_of_lines_with_one_place_the_first_speaks(spark, tmp_path):
    """The SQL leaves open which of them does. The later file is the larger one, which Spark reads first."""
    import duckdb

    from galena.plans import ORACLES, QUERIES

    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"COPY (SELECT range AS p_partkey, range % 50 AS p_size FROM range(120)) TO '{tmp_path}/part.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, start, n in (("a", 0, 700), ("b", 700, 7000)):
        line = f"SELECT hash(i) % 120 AS l_partkey, hash(i + 1) % 3 AS l_orderkey, hash(i + 2) % 7 + 1 AS l_linenumber, i % 9 AS l_suppkey, 36.0::DOUBLE AS l_quantity, hash(i + 3) % 10 / 100 AS l_tax, DATE '1990-01-01' + CAST(hash(i + 4) % 5000 AS INT) AS l_shipdate FROM (SELECT range AS i FROM range({start}, {start + n}))"
        c.sql(f"COPY (SELECT * REPLACE (CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber) FROM ({line})) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    for t, at in (("part", "part.parquet"), ("lineitem", "lineitem.parquet/*.parquet")):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{at}'")
    lines = c.sql(f"SELECT l_partkey // 3, l_linenumber = 2, l_orderkey, l_linenumber, filename, file_row_number, CASE WHEN l_tax > 0.01 THEN year(l_shipdate) END FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet', filename = true, file_row_number = true) WHERE l_linenumber <= 3 ORDER BY ALL DESC").fetchall()
    first = {r[0]: r[6] for r in lines}
    got = {r.ref: r for r in QUERIES["candidate_plan"](spark, str(tmp_path)).collect()}
    assert {k: r.announced for k, r in got.items()} == {k: first[k] for k in got}
    kept = "ref, url, community, official, passed_over, sources"
    want = c.sql(f"SELECT {kept} FROM ({ORACLES['candidate_plan']})").fetchall()
    assert sorted(tuple(r[x] for x in kept.split(", ")) for r in got.values()) == sorted(want)


def test_ended_keys_share_a_bucket(spark, tmp_path, monkeypatch):
    """Python is called for a bucket of keys, which end one by one; null users and types are keys as well."""
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    schema = "user_id long, event_type string, event_id long, ts timestamp"
    at, hour = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    large = (1 << 62) + 1
    keys = [(u, t) for u in (None, 0, 7, large) for t in ("a", None)]
    batches = [[(*k, 10 * i + j, at + (i + j % 2) * hour) for i, k in enumerate(keys) for j in range(3)], [(*keys[0], 900, at + 20 * hour), (*keys[7], 901, at + 26 * hour)], [(*keys[1], 902, at + 30 * hour)], [(9, "z", 903, at + 90 * hour)]]
    ended = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.ended_keys(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), hours=24)
        ended.append({tuple(r) for r in jobs.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/state").select("user_id", "event_type", "event_id").collect()})
    assert stream.columns == ["user_id", "event_type", "event_id", "last"]
    first = {(*keys[i], 10 * i + 1) for i in range(8)}
    late = {(*keys[0], 900), (*keys[7], 901), (*keys[1], 902)}
    # The watermark stands at 25 h 50 min after the second batch, at 29 h 50 min after the third and at 89 h 50 min at the end.
    assert ended[0] == ended[1] == set() and ended[2] == {x for x in first if x[:2] in keys[2:5]}
    assert ended[3] == {x for x in first if x[:2] in keys[2:7]} | late
