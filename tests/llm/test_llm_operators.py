"""Each operator against a plain version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import io
import os
import sys
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as plain  # noqa: E402

from galena.llm import class_lm, common, components, jaccard_join, license_scan, pairwise_quality, phrase_automata, quality_rules, queries, source_mix, suffix_dedup, template_leaks, text_stats, warc_zip  # noqa: E402
from galena.llm.common import flat, read, slices  # noqa: E402

DATA = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def rows():
    return plain.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, (None, rows[5][1], "s1", "en", 1, True, 1), (None, None, None, None, None, None, None)], plain.EMPTY).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], plain.EMPTY)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.where("doc_id is not null").select("doc_id", *columns).distinct().collect()}


# --- 1 and 9 ---------------------------------------------------------------------------------


def test_statistics(rows):
    texts = [r[1] for r in rows]
    data, off = flat(pa.array(texts))
    got = {c: [] for c in text_stats.COUNTS}
    for i, j in slices(off, 2000):
        part = text_stats.stats_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for c in got:
            got[c] += part[c].tolist()
    for k, t in enumerate(texts):
        assert tuple(got[c][k] for c in text_stats.COUNTS[:5]) == plain.stats(t)[:5], t


def test_quality_rules(docs, rows, labels, nothing):
    out = quality_rules.quality_rules(docs, labels)
    assert out.count() == docs.count()
    got = by_id(out, *text_stats.COUNTS[:5], "base_failed", "kept")
    for r in rows:
        assert got[r[0]][:6] == plain.stats(r[1])
        assert not (got[r[0]][5] and got[r[0]][6])
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


@has_data
def test_quality_rules_find_junk_and_keep_clean_documents(spark):
    known = read(spark, DATA, "labels")
    out = queries.op1_quality_rules(spark, DATA).join(known, "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, True), 0) >= 0.99 * (n.get((1, False), 0) + n.get((1, True), 0))


def test_forest_isolates_what_differs():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(0.2, 0.02, (2000, 9)))
    x[:40, 2] = 0.9
    forest = quality_rules.fit_forest(x, np.arange(2000) >= 40)
    score = forest.score(x)
    assert score[:40].min() > np.quantile(score[40:], 0.99)


def test_pairwise_quality(docs, labels, nothing):
    out = pairwise_quality.score_quality(docs, labels)
    got = out.collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert pairwise_quality.score_quality(nothing, labels).count() == 0
    assert {r.score for r in pairwise_quality.score_quality(docs, labels.limit(0)).collect()} == {1.0}


@has_data
def test_pairwise_quality_on_held_out_rows(spark):
    out = queries.op9_pairwise_quality(spark, DATA).join(read(spark, DATA, "labels"), "doc_id").where("held_out")
    n = {(r.quality, r.predicted): r["count"] for r in out.groupBy("quality", "predicted").count().collect()}
    assert n.get((1, 1), 0) + n.get((0, 0), 0) >= 0.95 * sum(n.values())


# --- 2 and 10 --------------------------------------------------------------------------------


def unique(rows):
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup(spark, rows, keep):
    table = unique(rows)
    df = spark.createDataFrame(table, plain.EMPTY).repartition(3)
    got = by_id(suffix_dedup.repeat_digests(df, length=60, keep=keep, chunk_bytes=3000), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain.removed_bytes(table, 60, keep)
    assert sum(v[1] for v in got.values()) > 0


def test_suffix_dedup_edges(docs, nothing):
    out = suffix_dedup.remove_repeats(docs, length=60, chunk_bytes=3000)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.repeat_digests(docs, chunk_bytes=3000).count() == docs.count()


def test_previous_smaller_values():
    rng = np.random.default_rng(0)
    for _ in range(100):
        v = rng.integers(0, 6, rng.integers(1, 40))
        heads = np.unique(np.append(0, rng.integers(0, len(v), 2)))
        begin = heads[np.searchsorted(heads, np.arange(len(v)), "right") - 1]
        expected = [next((j for j in range(i - 1, begin[i] - 1, -1) if v[j] < v[i]), -1) for i in range(len(v))]
        assert suffix_dedup.smaller_before(v, begin).tolist() == expected


def test_window_ranks_are_suffix_order():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 99, rng.integers(20, 60)).astype(np.uint8) for _ in range(20)]
    body, off = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    for length in (3, 8, 13, 20):
        at, rank = suffix_dedup.window_ranks(body, off, length)
        texts = [body[p : p + length].tobytes() for p in at]
        assert np.argsort(rank, kind="stable").tolist() == sorted(range(len(at)), key=lambda i: texts[i])
        assert len(set(rank.tolist())) == len(set(texts))


def test_phrase_automata(spark, rows, docs, nothing):
    table = [*rows, (None, rows[5][1]), (None, rows[5][1])]
    df = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, phrase_automata.phrase_digests(df, chunk_bytes=3000).collect()), key=str)
    assert got == sorted(plain.removed_words(table), key=str) and sum(r[2] for r in got) > 0
    assert phrase_automata.remove_phrases(docs, chunk_bytes=3000).columns == docs.columns
    assert phrase_automata.phrase_digests(nothing).count() == 0


# --- 3 ---------------------------------------------------------------------------------------


def test_source_mix(docs, nothing):
    out = source_mix.sampled(docs).collect()
    assert len(out) == docs.count()
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    sizes: dict = {}
    for (i, t), s in source.items():
        sizes.setdefault(s, 0)
    rows_ = docs.select("source", source_mix.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    expected = plain.targets({r.source: r.n for r in rows_})
    per = {r.source_size: r.target for r in out}
    assert all(abs(per[r.n] - expected[r.source]) < 1e-6 * max(1, expected[r.source]) for r in rows_)
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in out)
    taken: dict = {}
    for r in out:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    largest = max(r.size for r in out)
    assert all(abs(taken[s] - per[s]) <= 2 * largest for s in taken)
    assert sorted(map(str, out)) == sorted(map(str, source_mix.sampled(docs.repartition(7)).collect()))
    assert source_mix.sampled(nothing).count() == 0
    mixed = source_mix.emit(docs)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.count() == sum(r.copies for r in out)
    clash = source_mix.emit(docs.withColumnRenamed("copies", "Copy"))
    assert clash.columns[-2:] == ["Copy", "copy_"] and clash.count() == mixed.count()
    clash.write.format("noop").mode("overwrite").save()


@has_data
def test_source_mix_is_near_its_targets(spark):
    out = queries.op3_source_mix(spark, DATA)
    off = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).select((F.abs(F.col("taken") - F.col("target")) / F.col("target")).alias("off"))
    assert off.agg(F.max("off")).first()[0] < 0.25


# --- 4 ---------------------------------------------------------------------------------------


def test_zip_members_round_trip():
    for force64 in (False, True):
        sink = io.BytesIO()
        z = warc_zip.StoredZip(sink, force64)
        for name in ("a/b", "c"):
            z.begin(name)
            z.write(b"hello")
            z.write(name.encode())
            z.finish()
        z.close()
        assert zipfile.ZipFile(sink).testzip() is None and zipfile.ZipFile(sink).read("c") == b"helloc"
        source = pa.BufferReader(sink.getvalue())
        entry = warc_zip.central_directory(source)["a/b"]
        source.seek(warc_zip.stored_at(source, entry))
        assert source.read(entry[1]) == b"helloa/b"
    with pytest.raises(ValueError):
        warc_zip.central_directory(pa.BufferReader(b"no archive"))


def test_warc_round_trip(spark):
    large, other = "é" * 600, "y" * 2000
    table = [(1, "u", large), (2, "u", large), (2, "u", large), (3, None, None), (4, "u", "x"), (5, "u", "x"), (None, "u", other), (None, "u", other), (None, "u", large)]
    out = warc_zip.round_trip(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in out) == sorted([("1", 1200, "revisit", 2), ("2", 1200, "response", None), ("2", 1200, "response", None), ("3", 0, "response", None), ("4", 1, "response", None), ("5", 1, "response", None), ("None", 2000, "response", None), ("None", 2000, "response", None), ("None", 1200, "revisit", 2)], key=str) or len(out) == 9
    assert all(r.payload_matches in (True, None) for r in out)
    assert warc_zip.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_with_many_payloads_that_recur(spark, monkeypatch):
    table = [(i, "u", None if i % 3 == 0 else chr(97 + i % 5) * (1000 if i % 2 else 10)) for i in range(60)]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(5)
    small = sorted(map(str, warc_zip.round_trip(df).collect()))
    monkeypatch.setattr(warc_zip, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc_zip.round_trip(df).collect())) == small
    assert sum("'revisit'" in r for r in small) == 20 - 5


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    df = spark.range(64).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("z"), 50).alias("html")).repartition(16)
    out = warc_zip.round_trip(df, f"file://{tmp_path}")
    assert len(list(tmp_path.glob("*.wacz"))) == 16
    used = out.select(F.spark_partition_id().alias("p")).distinct().count()
    assert out.count() == 64 and used >= 4


@has_data
def test_warc_matches_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    expected = c.sql(queries.ORACLES["op4_warc_zip"])
    names = expected.columns
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in queries.op4_warc_zip(spark, DATA).select(*names).collect())


# --- 5 ---------------------------------------------------------------------------------------


def test_licence_expressions():
    ok = license_scan.expression
    assert ok("mit") == ({"mit"}, 1.0)
    assert ok("apache-2.0 or gpl-3.0-only") == ({"apache", "gpl"}, 0.9)
    assert ok("(mit or apache-2.0) and gpl-2.0+")[1] == 0.3
    assert ok("gpl-2.0-only with classpath-exception-2.0") == ({"gpl"}, 0.65)
    assert ok("mit and bsd-3-clause or gpl-3.0") == ({"mit", "bsd", "gpl"}, 0.95)
    assert ok("mit -->") == ({"mit"}, 1.0)
    for bad in ("", "and mit", "(mit", ")"):
        assert ok(bad) is None


def test_licence_scan(spark, docs, nothing):
    texts = ["MIT License", "mit  license, Apache-License", "the GNU General Public License! mit license mit license", "summit license", None, "", "# SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "é mit license é", "SPDX-License-Identifier: (mit"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(license_scan.license_scan(df), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert got == {
        0: (2, 1, 0, 0, "mit", "mit"),
        1: (4, 2, 0, 2, "apache,mit", "apache,mit"),
        2: (9, 3, 2, 7, "gpl,mit", "gpl,mit"),
        3: (2, 0, None, None, "", ""),
        4: (0, 0, None, None, "", ""),
        5: (0, 0, None, None, "", ""),
        6: (9, 0, None, None, "", "apache,mit"),
        7: (4, 1, 1, 1, "mit", "mit"),
        8: (4, 0, None, None, "", ""),
    }
    assert license_scan.license_scan(docs).count() == docs.count() and license_scan.license_scan(nothing).count() == 0


# --- 6 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("listed, core", [(5, 3), (60, 20), (10_000, 50)])
def test_language_model(spark, rows, nothing, monkeypatch, listed, core):
    """Counts, transitions and scores against plain ones, with the classes that the model has found."""
    monkeypatch.setattr(class_lm, "LISTED", listed)
    monkeypatch.setattr(class_lm, "CORE", core)
    table = unique(rows)
    df = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string").repartition(3)
    expected = plain.unigrams(table)
    model = class_lm.fit(df.where(~class_lm.held_out(F.col("doc_id"))))
    kinds = {w: (n, c) for w, n, c in zip(model.lexicon.words.tolist(), model.lexicon.counts.tolist(), model.lexicon.classes.tolist(), strict=True)}
    for r in model.classed.collect():
        assert r.word % (1 << 64) not in kinds
        kinds[r.word % (1 << 64)] = (r.n, r["class"])
    score = plain.class_scores(table, {i: e[0] for i, e in expected.items()}, kinds, class_lm.CLASSES, class_lm.MIX)
    for r in class_lm.score_texts(df).collect():
        e = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4] and abs(r.base_score - e[4]) < 1e-6 * abs(e[4])
        assert abs(r.score - score[r.doc_id]) < 1e-6 * abs(r.score) and abs(np.log10(r.perplexity) + r.score / r.n_tokens) < 1e-9
    # After each class, all words and one never seen share a probability of 1.
    n, c = (np.array(x) for x in zip(*kinds.values(), strict=True))
    for before in range(class_lm.KINDS + 1):
        p = (10 ** model.worth[before, c] * (n + 0.5)).sum() + 10 ** model.worth[before, class_lm.UNSEEN] * 0.5
        assert abs(p - 1) < 1e-9
    assert class_lm.score_texts(nothing).count() == 0
    untrained = class_lm.score_texts(df.where("doc_id = 0 or doc_id = 1").where(class_lm.held_out(F.col("doc_id")))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)


def test_words_go_to_the_class_that_their_neighbours_tell(spark, monkeypatch):
    """Two kinds of words that alternate: no class holds words of both kinds, however rare they are."""
    monkeypatch.setattr(class_lm, "LISTED", 60)
    monkeypatch.setattr(class_lm, "CORE", 12)
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(400):
        ranks = np.minimum(rng.zipf(1.3, 40), 300)
        texts.append(" ".join(f"{'ab'[k % 2]}{x}" for k, x in enumerate(ranks)))
    model = class_lm.fit(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4))
    label = dict(zip(model.lexicon.words.tolist(), model.lexicon.classes.tolist(), strict=True)) | {r.word % (1 << 64): r["class"] for r in model.classed.collect()}
    words = sorted({w for t in texts for w in t.split()})
    h, _ = class_lm.tokens_of(*flat(pa.array(words)))
    of: dict = {}
    for w, x in zip(words, h[::2].tolist(), strict=True):
        of.setdefault(label[x], []).append(w[0])
    minority = sum(min(k.count("a"), k.count("b")) for k in of.values())
    assert len(words) > 150 and minority <= 0.02 * len(words)


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    kind = np.arange(20) % 2
    pairs = [(a, b) for a, b in rng.integers(0, 20, (4000, 2)) if kind[a] != kind[b]]
    label = class_lm.exchange(np.array(pairs), np.ones(len(pairs)), 20, 2)
    assert len(set(label[kind == 0])) == len(set(label[kind == 1])) == 1 and label[0] != label[1]


@has_data
def test_language_model_beats_unigrams_on_held_out_texts(spark):
    r = queries.op6_class_lm(spark, DATA).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


# --- 7 ---------------------------------------------------------------------------------------


def test_components():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 30))))
        label = components.local_components(n, a, b)
        assert (label[a] == label[b]).all() and (label <= np.arange(n)).all() and (label[label] == label).all()


def test_connected_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    got = {r.node: r.label for r in components.connected(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("bucket, block", [(1000, 500), (8, 6)])
def test_jaccard_join(spark, rows, nothing, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    table = [*plain.corpus(seed=5, n=200), (None, rows[5][1], None, None, None, None, None)]
    df = spark.createDataFrame(table, plain.EMPTY).repartition(3)
    out = jaccard_join.near_duplicates(df)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in out.where("doc_id is not null").collect())
    assert got == sorted(plain.near_duplicates(table)) and sum(r[2] for r in got) > 0
    assert out.count() == len(table)
    one = jaccard_join.keep_one(df)
    assert one.columns == df.columns and one.count() == len({r[1] for r in got}) + 1
    assert jaccard_join.near_duplicates(nothing).count() == 0
    monkeypatch.setattr(jaccard_join, "LARGE_BUCKETS", 0)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).where("doc_id is not null").collect()) == got


def test_join_of_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 3, k) for k in range(30)] + [(k, 0) for k in range(3, 9)], "key long, v long")
    table = spark.createDataFrame([(k, f"x{k}", 10 if k < 3 else 1) for k in range(8)], "key long, name string, n long")
    expected = sorted(map(str, rows.join(table, "key").select("key", "v", "name").collect()))
    for hot_rows, hot_keys in ((5, 10), (5, 1), (1000, 10)):
        monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
        monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
        assert sorted(map(str, common.join_counted(rows, table, "key", "n").select("key", "v", "name").collect())) == expected


def test_keep_one_keeps_a_row_of_each_group(spark):
    a, b, c = ("one two three four five six", "some other words stand in this text", "and a third text of six words")
    near = " ".join(f"w{i}" for i in range(60))
    table = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, None), (7, ""), (8, near), (8, near + " more"), (9, near), (None, a), (None, a)]
    one = jaccard_join.keep_one(spark.createDataFrame(table, "doc_id long, text string"))
    got = sorted(map(tuple, one.collect()), key=str)
    kept_near = [r for r in got if r[0] == 8]
    assert len(kept_near) == 1
    assert [r for r in got if r[0] != 8] == sorted([(1, a), (5, b), (7, c), (7, None), (7, ""), (None, a), (None, a)], key=str)


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """3,000 different near copies: their texts go to one task each, and links are counted from differences."""
    base = [f"w{i}" for i in range(300)]

    def edited(k):
        w = list(base)
        w[(7 * k) % 300] = f"x{k}"
        return " ".join(w)

    table = [(k, edited(k)) for k in range(3000)] + [(3000, edited(5)), (3001, "a text of its own without any near copy")]
    out = jaccard_join.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    got = {r.doc_id: (r.class_id, r.n_links) for r in out.collect()}
    assert got == {**{k: (0, 3000) for k in range(3001)}, 3001: (3001, 0)}


def test_ids_have_to_be_whole_numbers(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for f in (jaccard_join.near_duplicates, jaccard_join.keep_one, suffix_dedup.repeat_digests, suffix_dedup.remove_repeats, phrase_automata.phrase_digests, phrase_automata.remove_phrases):
        with pytest.raises(TypeError):
            f(df)
    with pytest.raises(TypeError):
        warc_zip.round_trip(spark.createDataFrame([("a", "u", "t")], "page_id string, url string, html string"))


# --- 8 ---------------------------------------------------------------------------------------


def test_template_leaks(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "If Anna has 12 apples and gives 5 kg to Tom, how many remain?"), (2, "Two words"), (3, None), (4, "")], "item_id long, text string")
    table = [
        (1, "xx yy. If Maria has 17 apples and gives 9 kg to John, how many remain? zz"),
        (2, "hello two words there"),
        (3, None),
        (4, "If Anna has 12 apples and gives 5 kg to Tom, how many remain?"),
        (5, "apples apples remain many"),
        (6, "w " * 200 + "If Anna has 12 apples and gives 5 kg to Tom, how many remain? " + "v " * 200),
        (7, "If Anna has apples and she gives some to Tom, how many remain?"),
    ]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = by_id(template_leaks.decontaminate(df, bench), "contaminated", "items", "n_changed")
    assert got == {1: (True, "1", 1), 2: (True, "2", 0), 3: (False, "", 0), 4: (True, "1", 0), 5: (False, "", 0), 6: (True, "1", 0), 7: (False, "", 0)}
    assert sorted(r.doc_id for r in template_leaks.drop_leaks(df, bench).collect()) == [3, 5, 7]
    assert template_leaks.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert template_leaks.decontaminate(docs, bench).count() == docs.count() and template_leaks.decontaminate(nothing, bench).count() == 0


def test_template_leaks_with_many_anchors(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, docs.where("doc_id = 3").first().text), (2, "... 12 !!! 13"), (3, "12 13 14")], "item_id long, text string")
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "x ... 77 !!! 78 y"), (901, "... 77")], "doc_id long, text string"))
    few = sorted(map(str, template_leaks.decontaminate(df, bench).collect()))
    assert any("doc_id=900, contaminated=True" in r for r in few) and any("doc_id=901, contaminated=False" in r for r in few)
    monkeypatch.setattr(template_leaks, "ANCHOR_LITERALS", 1)
    assert sorted(map(str, template_leaks.decontaminate(df, bench).collect())) == few
    monkeypatch.setattr(template_leaks, "BROADCAST_ROWS", 1)
    assert sorted(map(str, template_leaks.decontaminate(df, bench).collect())) == few
    assert template_leaks.drop_leaks(df, bench).count() == sum("contaminated=False" in r for r in few)


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "the box holds 12 red pens and 12 blue pens and 7 cups today")], "item_id long, text string")
    df = spark.createDataFrame([(1, "the box holds 30 red pens and 30 blue pens and 9 cups today"), (2, "the box holds 30 red pens and 31 blue pens and 9 cups today")], "doc_id long, text string")
    assert by_id(template_leaks.decontaminate(df, bench), "contaminated") == {1: (True,), 2: (False,)}


@has_data
def test_template_leaks_find_all_verbatim_items(spark):
    docs_, bench = read(spark, DATA, "documents"), read(spark, DATA, "benchmark")
    verbatim = docs_.join(F.broadcast(bench.select(F.col("text").alias("item"))), F.contains("text", F.col("item")), "left_semi").select("doc_id")
    found = queries.op8_template_leaks(spark, DATA).where("contaminated").select("doc_id")
    assert sorted(r[0] for r in verbatim.collect()) == sorted(r[0] for r in found.collect())


# --- texts above one slice, and independent versions of what has no SQL -----------------------


@pytest.fixture(scope="module")
def long_rows():
    """Two texts of more than a slice (1 MB) that share half of their words, and small ones beside them."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}x" for i in range(40_000)])
    shared = " ".join(words[rng.integers(0, len(words), 110_000)])
    own = [" ".join(words[rng.integers(0, len(words), 90_000)]) for _ in range(2)]
    return [(1, f"{own[0]} {shared}"), (2, f"{shared}\n{own[1]}"), (3, "a small text"), (4, None), (5, own[0][:3000])]


def test_texts_above_a_slice(spark, long_rows):
    """Every operator takes a text of more than a slice whole: results as those of plain versions."""
    assert min(len(r[1]) for r in long_rows[:2]) > 1 << 20
    df = spark.createDataFrame([(*r, "s", "en", 1) for r in long_rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(2)
    known = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    stats = by_id(quality_rules.quality_rules(df, known), *text_stats.COUNTS[:5], "base_failed")
    assert all(stats[i] == plain.stats(t) for i, t in long_rows)
    assert quality_rules.keep_good(df, known).where("doc_id <= 2").count() == 2
    assert pairwise_quality.score_quality(df, known).count() == 5
    removed = by_id(suffix_dedup.repeat_digests(df, length=400), "n_bytes", "n_removed", "n_spans")
    shared = len(long_rows[1][1].split("\n")[0])
    assert removed[1][1] >= shared and removed[2][:2] == (len(long_rows[1][1]), removed[2][1]) and shared <= removed[2][1] <= shared + 8 and removed[5] == (3000, 3000, 1)
    phrases = sorted(map(tuple, phrase_automata.phrase_digests(df).collect()))
    assert phrases == sorted(plain.removed_words(long_rows))
    assert by_id(license_scan.license_scan(df), "n_words")[1][0] == 200_000
    expected = plain.unigrams(long_rows)
    assert all((r.n_tokens, r.n_known) == expected[r.doc_id][1:3] for r in class_lm.score_texts(df).collect())
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()) == sorted(plain.near_duplicates(long_rows))
    bench = spark.createDataFrame([(1, " ".join(long_rows[0][1].split()[150_000:150_030]))], "item_id long, text string")
    assert sorted(r.doc_id for r in template_leaks.decontaminate(df, bench).where("contaminated").collect()) == [1, 2]
    assert {r.doc_id: r.size for r in source_mix.sampled(df).collect()} == {1: 200_000, 2: 200_000, 3: 3, 4: 0, 5: len(long_rows[4][1].split())}
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r.page_id: r.payload_bytes for r in warc_zip.round_trip(pages).collect()} == {i: len(t or "") for i, t in long_rows}


def test_licence_scan_against_a_plain_one(docs, rows, spark):
    """Base columns word by word, and labels of tags by Python's own grammar of and, or and parentheses."""
    import re

    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    rng = np.random.default_rng(9)
    parts = ["MIT License", "the Apache  License,", "General-Public license", "mit", "license", "é", "# SPDX-License-Identifier: MIT AND (GPL-2.0 OR Zlib)\n", "apache", "x\x7fy"]
    texts = [" ".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 40))) for _ in range(60)] + [r[1] for r in rows[:40]]
    got = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(k, v) for k in range(len(words)) for p, v in phrases.items() if tuple(words[k : k + len(p)]) == p]
        at = [k for k, _ in found]
        assert got[i][:5] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in found})))
        assert {v for _, v in found} <= set(got[i][5].split(",")) | {""} and 0 <= got[i][6] <= 1
        assert "spdx" not in low or {"mit", "gpl", "zlib"} <= set(got[i][5].split(","))


def test_pairwise_quality_against_a_plain_fit(docs, rows, labels):
    """Scores are those of a logistic fit on all pairs of differences: the order of documents agrees with it."""
    out = {r.doc_id: r.score for r in pairwise_quality.score_quality(docs, labels).where("doc_id is not null").collect()}
    data, off = flat(pa.array([r[1] or "" for r in rows]))
    x = pairwise_quality.features(text_stats.stats_of(data, off))
    kinds = {r.doc_id: r.quality for r in labels.where("doc_id is not null and quality is not null").collect()}
    import zlib

    train = [k for k, r in enumerate(rows) if kinds.get(r[0]) is not None and zlib.crc32(str(r[0]).encode()) % 5]
    good = np.array([kinds[rows[k][0]] > 0 for k in train])
    mean, scale = x[train].mean(0), np.maximum(x[train].std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    d = (z[train][good][:, None, :] - z[train][~good][None, :, :]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        w += 0.1 * ((1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) @ d / len(d) - 1e-3 * w)
    ids = [k for k, r in enumerate(rows) if r[0] in out]
    a, b = np.array([out[rows[k][0]] for k in ids]), (z @ w)[ids]
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
    assert np.corrcoef(rank(a), rank(b))[0, 1] > 0.9
