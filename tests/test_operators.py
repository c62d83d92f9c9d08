"""Rules that the SQL comparison doesn't reach: order, idempotence, nulls, malformed input."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from galena.functions import reference, text
from galena.operators import filters, identity, joins, resolution, windows
from galena.operators.components import components
from galena.sources import pages, tables
from galena.streaming import jobs
from galena.streaming.state import KeyedState


def test_upsert_is_idempotent_and_order_free(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, v int, s string")
    b = spark.createDataFrame([(2, 2, "z"), (3, 1, "w"), (2, 2, "z")], "k int, v int, s string")
    once = tables.upsert_latest(a, b, ["k"], "v", ["s"])
    twice = tables.upsert_latest(once, b.repartition(3), ["k"], "v", ["s"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1, "x"), (2, 2, "z"), (3, 1, "w")]


def test_append_new_adds_each_key_once(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert [r.k for r in tables.append_new(a, b, ["k"]).collect()] == [2]


def test_snapshots_skip_malformed_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"sourceRole": "a", "entries": [{"ref": "1"}, {"ref": "2"}]}')
    (tmp_path / "bad.json").write_text("{")
    assert [r.file for r in tables.snapshot_sweep(spark, str(tmp_path)).collect()] == ["good.json"]
    assert sorted((r.sourceRole, r.ref) for r in tables.snapshot(spark, str(tmp_path / "good.json")).collect()) == [("a", "1"), ("a", "2")]


def test_tristate_never_takes_null_for_false(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [df.where(filters.tristate("b", w)).count() for w in ("yes", "no", "unknown")] == [1, 1, 1]


def test_large_groups_are_reported_not_paired(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), "id")
    pairs, large = joins.pairs_within_group(df.where("g = 0 or id < 7"), "g", "id", max_group=10)
    assert pairs.count() == 3 and [r.g for r in large.collect()] == [0]


def test_resolution_reasons(spark):
    rows = [(1, 5, 1, 9, 1, 1), (2, 5, 1, 9, 1, 2), (2, 6, 2, 9, 1, 3), (3, 5, 1, 9, 1, 4), (3, 6, 1, 8, 1, 5), (4, 5, 1, 9, 1, 6), (4, 5, 1, 9, 2, 7), (5, None, 1, 9, 1, 8)]
    df = spark.createDataFrame(rows, "e int, v int, p int, c int, t int, id int")
    got = {r.e: (r.selected, r.conflict, r.reason, r.selected_id) for r in resolution.resolve_candidates(df, ["e"], "v", "p", "c", "t", "id").collect()}
    assert got == {1: (5, False, "single-value", 1), 2: (5, True, "priority", 2), 3: (5, True, "confidence", 4), 4: (5, False, "recency", 7)}


def clusters_of(nodes, pairs):
    """Clusters where every record is a class of its own."""
    classes = nodes.select("g", F.col("id").cast("string").alias("cls"), F.lit(1).cast("long").alias("n"), F.col("id").alias("first"))
    sides = [c for x in ("left", "right") for c in (F.col(x).cast("string").alias(f"{x}_cls"), F.lit(1).cast("long").alias(f"{x}_n"), F.col(x).alias(f"{x}_first"))]
    return identity.cluster_records(nodes.withColumn("cls", F.col("id").cast("string")), classes, pairs.select("g", "relation", *sides), "g", "id", "relation")


def test_clusters_are_components_and_accepted_only_if_cliques(spark):
    nodes = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)] + [("b", i) for i in (5, 6, 7)], "g string, id int")
    pairs = [("a", 1, 2, "MATCH"), ("a", 3, 4, "MATCH")] + [("a", x, y, "DISTINCT") for x, y in ((1, 3), (1, 4), (2, 3), (2, 4))]
    pairs += [("b", 5, 6, "MATCH"), ("b", 6, 7, "MATCH"), ("b", 5, 7, "DISTINCT")]
    df = spark.createDataFrame(pairs, "g string, left int, right int, relation string")
    got = {r.id: (r.cluster, r.accepted) for r in clusters_of(nodes, df).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (3, True), 4: (3, True), 5: (5, False), 6: (5, False), 7: (5, False)}
    clusters = clusters_of(nodes, df)
    for odd, action in ((None, "SPLIT"), ("STRONG_MISMATCH", "REVIEW"), ("WEAK", "REVIEW")):
        evidence = nodes.select("id", F.when((F.col("id") == 1) & F.lit(odd is not None), odd).otherwise("EXACT").alias("evidence"))
        assert {r.g: r.action for r in identity.group_verdict(clusters, evidence, "g", "id").collect()} == {"a": action, "b": "REVIEW"}


def test_digest_does_not_depend_on_order(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("x"))
    a, b = (resolution.table_digest(d, ["id", "x"]).first() for d in (df, df.repartition(7).orderBy(F.desc("x"))))
    assert a == b and a.rows == 500


def test_global_rank_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), "id")
    got = [(r.v, r.position) for r in windows.global_rank(df, ["v", "id"]).orderBy("position").collect()]
    assert got == [(i, i + 1) for i in range(1000)]


def test_references_and_identifiers(spark):
    df = spark.createDataFrame([("4006381333931",), ("4006381333932",), ("73513537",), ("x",), (None,)], "c string")
    assert [r.v for r in df.select(reference.gtin_valid(F.col("c")).alias("v")).collect()] == [True, False, True, False, False]
    row = spark.createDataFrame([(" 4321 – us ",)], "c string").select(reference.reference_parse(F.col("c")).alias("p")).first().p
    assert (row.base, row.suffix, row.number, row.signal) == ("4321", "US", None, "market")


def test_folding(spark):
    df = spark.createDataFrame([(" Éclair--ÇA ",), ("--",), (None,)], "c string")
    assert [r.f for r in df.select(text.fold_text(F.col("c")).alias("f")).collect()] == ["eclair ca", None, None]


def test_folding_follows_the_character_database(spark):
    """Every letter of the Latin blocks, ligatures and numerals, against the decomposition itself."""
    letters = [chr(c) for block in (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2150, 0x2189), range(0xFB00, 0xFB07), range(0xFF10, 0xFF5B)) for c in block]
    texts = [f"A{c}b" for c in letters] + ["e\u0301te\u0301", "a^b`c", "\u00b4", "", None]

    def plain(t):
        if t is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c) and c not in "^`")
        return re.sub("[^a-z0-9]+", " ", bare.lower()).strip() or None

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.fold_text(F.col("t")).alias("f")).collect()
    got = {r.i: r.f for r in rows}
    # Marks that count as diacritics without being combining go too.
    marks = {chr(c) for c in (0xAF, 0xB7, 0xB8, 0xA8, 0xB4, 0x149, 0x13F, 0x140, 0x1E9A)}
    assert [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t) and not (t and set(t) & marks)] == []


def test_references_are_composed(spark):
    rows = [("７１２３４ – usa", "71234-USA"), ("  5793\u2011v2 ", "5793-V2"), ("Ⅳ12", "IV12")]
    got = spark.createDataFrame(rows, "raw string, want string").select(reference.reference_normalize(F.col("raw")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    parsed = spark.createDataFrame([("PM2305D",), ("5793-USA",), ("123-a",), ("12-a",), ("77V3",), ("a/b",), ("",)], "raw string").select(reference.reference_parse(F.col("raw")).alias("p")).select("p.*").collect()
    assert [(r.base, r.suffix, r.number, r.signal) for r in parsed] == [("PM2305D", None, None, "none"), ("5793", "USA", None, "market"), ("123", "A", None, "edition"), ("12-A", None, None, "none"), ("77", "V3", 3, "version"), ("A/B", None, None, "none"), (None, None, None, None)]
    assert parsed[5].warnings == ["unrecognised-characters"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(i + 1, i) for i in range(20)] + [(50, 51), (51, 50)], "a int, b int")
    assert {r.id: r.cluster for r in components(edges).collect()} == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


def test_components_of_hubs_long_chains_and_nothing(spark):
    """A star whose hub has the largest id, one whose hub has the smallest, and a chain longer than any bound on rounds."""
    star = [(100_000, i) for i in range(10_000, 13_000)] + [(20_000, i) for i in range(20_001, 23_000)]
    chain = [(30_000 + 7 * i % 151, 30_000 + 7 * (i + 1) % 151) for i in range(150)]
    edges = spark.createDataFrame([*star, *chain, (5, 5), (None, 7), (9, 8), (9, 8)], "a int, b int")
    got = {r.id: r.cluster for r in components(edges).collect()}
    want = {**{i: 10_000 for i in (*range(10_000, 13_000), 100_000)}, **{i: 20_000 for i in range(20_000, 23_000)}, **{30_000 + i: 30_000 for i in range(151)}, 5: 5, 8: 8, 9: 8}
    assert got == want
    assert components(edges.limit(0)).count() == 0


def test_classes_stand_for_the_pairs_of_their_records(spark):
    """Counts and clusters by classes are those by records, with repeated facts, maps, nulls and classes that don't match themselves."""
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(3)}", i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), {"x": rng.randrange(2)}) for i in range(120)]
    told = spark.createDataFrame(rows, "g string, id int, name string, year int, m map<string,int>")

    def relation(a, b):
        if a[2] is None or b[2] is None:
            return "AMBIGUOUS"
        return "MATCH" if a[2] == b[2] and a[3] == b[3] and a[3] is not None and a[4] == b[4] else "DISTINCT"

    def compare(pairs):
        same = F.col("left_name") == F.col("right_name")
        alike = same & (F.col("left_year") == F.col("right_year")) & (F.element_at("left_m", "x") == F.element_at("right_m", "x"))
        return pairs.withColumn("relation", F.when(F.col("left_name").isNull() | F.col("right_name").isNull(), "AMBIGUOUS").when(F.coalesce(alike, F.lit(False)), "MATCH").otherwise("DISTINCT"))

    classes, members = identity.fold_classes(told, "g", "id")
    pairs = identity.class_pairs(classes, "g", compare)
    counts = identity.partners(pairs, "g", ["relation"]).groupBy("cls", "relation").agg(F.sum("partners").alias("partners"))
    got = {(r.id, r.relation): r.partners for r in members.join(counts, "cls").collect()}
    want: dict = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1]:
                want[a[1], relation(a, b)] = want.get((a[1], relation(a, b)), 0) + 1
    assert got == want
    assert classes.count() < 60 and pairs.agg(F.sum("pairs")).first()[0] == sum(want.values()) // 2
    label = {r[1]: r[1] for r in rows}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and relation(a, b) == "MATCH" and a[1] != b[1]:
                label[a[1]] = min(label[a[1]], b[1])  # matches are cliques here
    assert {r.id: r.cluster for r in identity.cluster_records(members, classes, pairs, "g", "id", "relation").collect()} == label


def test_many_records_of_one_group(spark):
    """A group's work depends on its different facts only."""
    told = spark.range(200_000).select(F.lit("g").alias("g"), "id", (F.col("id") % 5).alias("name"))
    classes, members = identity.fold_classes(told, "g", "id")
    pairs = identity.class_pairs(classes, "g", lambda p: p.withColumn("relation", F.when(F.col("left_name") == F.col("right_name"), "MATCH").otherwise("DISTINCT")))
    out = identity.cluster_records(members, classes, pairs, "g", "id", "relation")
    assert sorted(map(tuple, out.groupBy("cluster", "relationship", "accepted").count().collect())) == [(i, "MATCH", True, 40_000) for i in range(5)]


def test_clusters_of_a_chain_are_not_accepted(spark):
    nodes = spark.createDataFrame([("g", i) for i in (1, 2, 3, 4)], "g string, id int")
    pairs = spark.createDataFrame([("g", 1, 2, "MATCH"), ("g", 2, 3, "MATCH"), ("g", 1, 3, "AMBIGUOUS"), ("g", 1, 4, "DISTINCT"), ("g", 2, 4, "DISTINCT"), ("g", 3, 4, "DISTINCT")], "g string, left int, right int, relation string")
    got = {r.id: (r.cluster, r.relationship, r.accepted) for r in clusters_of(nodes, pairs).collect()}
    assert got == {1: (1, "AMBIGUOUS", False), 2: (1, "AMBIGUOUS", False), 3: (1, "AMBIGUOUS", False), 4: (4, "SINGLETON", False)}


def test_a_split_that_names_a_record_twice_stops(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10)], "id int, owner int")
    done = resolution.apply_split(rows, spark.createDataFrame([(1, 11)], "id int, owner int"), ["id"], "owner")
    assert sorted(map(tuple, done.select("id", "owner", "split").collect())) == [(1, 11, True), (2, 10, False)]
    with pytest.raises(ValueError):
        resolution.apply_split(rows, spark.createDataFrame([(1, 11), (1, 12)], "id int, owner int"), ["id"], "owner")


def test_digest_does_not_depend_on_the_order(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("s"))
    a, b, c = (resolution.table_digest(x, ["id", "s"]).first().digest for x in (df, df.repartition(7, "s"), df.where("id > 0")))
    assert a == b != c


def test_global_rank_with_ties_in_the_first_key(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    got = windows.global_rank(df, [F.desc("k"), F.asc("id")], part_rows=300)
    rows = sorted(got.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 5001)) and [(r.k, r.id) for r in rows] == sorted(((r.k, r.id) for r in rows), key=lambda x: (-x[0], x[1]))


def test_community_page_without_its_parts(spark):
    empty = pages.page_records(spark.createDataFrame([(1, None), (2, "<h1>Brand 12 - Castle<p><strong>Theme: <a href='/t/1'>x")], "page_id long, html string")).collect()
    assert [r.reference for r in sorted(empty)] == [None, "12"] and all(r.images == [] and r.parts == [] for r in empty)


def test_json_ld_is_found_in_any_shape(spark):
    blocks = ['{"@type": "Product", "sku": "1"}', '[{"@type": "A"}, {"@type": ["B", "Product"], "sku": "2"}]', '[{"@graph": [{"@type": "Product", "sku": "3"}]}]', '{"@type": "A"}', "{bad"]
    df = spark.createDataFrame([(i, f'<script type="application/ld+json">{{x</script><script type="application/ld+json">{b}</script>') for i, b in enumerate(blocks)], "i int, html string")
    got = df.select("i", F.try_variant_get(pages.json_ld_product(F.col("html")), "$.sku", "string").alias("sku")).orderBy("i").collect()
    assert [r.sku for r in got] == ["1", "2", "3", None, None]


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    """Many starts with a batch each: deleted keys stay deleted, runs and the files of the folder stay few, a batch is applied once."""
    at, schema = str(tmp_path), "k long, v long, dead boolean"
    want: dict = {}

    def fold(df):
        return windows.latest_per_key(df, ["k"], [F.desc("v")])

    for n in range(9):
        rows = [(n % 3, n, n % 4 == 3), (100 + n, n, False)]
        want |= {k: (v, dead) for k, v, dead in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        out = jobs.keyed_state(stream, fold, f"{at}/s", gone=F.col("dead"), fanout=2)
    state = KeyedState(spark, f"{at}/s", schema, fold, F.col("dead"), 2)
    live = {(k, v) for k, (v, dead) in want.items() if not dead}
    assert {(r.k, r.v) for r in out.collect()} == {(r.k, r.v) for r in state.rows().collect()} == live
    runs = state.runs()
    assert [level for level, _ in runs] == [3, 0] and sorted(tables.list_names(spark, f"{at}/s/runs")) == sorted(name for _, name in runs)
    stored = spark.read.schema(schema).parquet(f"{at}/s/runs/{runs[0][1]}")
    assert stored.where("dead").count() == 0
    state.apply(spark.createDataFrame([(7, 99, False)], schema), 8)
    assert state.runs() == runs
