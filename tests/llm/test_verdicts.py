"""Samples with repeats and rare labels, and verdicts of forests, mixes and rankings told again by plain loops."""

from __future__ import annotations

import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as plain  # noqa: E402

from galena.llm import common, pairwise_quality, quality_rules, source_mix, text_stats, warc_zip  # noqa: E402
from galena.llm.segments import anchor_places  # noqa: E402

DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*plain.corpus(), (None, None, None, None, None, None, None)], plain.EMPTY).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")


def kinds(df):
    return {r.g: r["count"] for r in df.groupBy("g").count().collect()}


def test_samples_of_repeats_and_rare_kinds(spark):
    one = spark.range(20_000).select(F.lit(1).alias("x"), F.lit(True).alias("g"))
    few = spark.range(4).select((F.col("id") + 100).cast("int").alias("x"), F.lit(False).alias("g"))
    many = spark.range(60_000).select((F.col("id") + 1000).cast("int").alias("x"), F.lit(True).alias("g"))
    other = spark.range(30_000).select((F.col("id") + 200_000).cast("int").alias("x"), F.lit(False).alias("g"))
    for seed in range(3):
        assert kinds(common.bounded_sample(one, 100, ["x"], seed, "g")) == {True: 1}
        assert kinds(common.bounded_sample(one.union(few), 100, ["x"], seed, "g")) == {True: 1, False: 4}
        assert kinds(common.bounded_sample(many.union(few), 1000, ["x"], seed, "g")) == {True: 996, False: 4}
        assert kinds(common.bounded_sample(many.union(other), 1000, ["x"], seed, "g")) == {True: 666, False: 333}
    assert common.bounded_sample(one.limit(0), 100, ["x"], 1, "g").count() == 0
    twice = [sorted(map(tuple, common.bounded_sample(many.union(other).repartition(n), 50, ["x"], 5, "g").collect())) for n in (2, 7)]
    assert twice[0] == twice[1]


def test_a_few_bad_documents_beside_many_repeats(spark):
    good = " ".join(f"A plain sentence about topic {i} that reads well, word by word." for i in range(12))
    bad = "$$$ ### BUY NOW *** <<<>>> " * 30
    rows = [(1, good, "s")] * 3000 + [(10 + i, good + f" more {i}", "s") for i in range(8)] + [(100 + i, bad + str(i), "s") for i in range(8)]
    marks = [(1, 1)] + [(10 + i, 1) for i in range(8)] + [(100 + i, 0) for i in range(8)]
    out = pairwise_quality.score_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int"))
    got = {r.doc_id: r.predicted for r in out.select("doc_id", "predicted").distinct().collect()}
    assert got == {i: q for i, q in marks}


def test_forest_verdicts_by_a_plain_walk(spark, docs, labels):
    stats = text_stats.with_stats(docs).cache()
    model = quality_rules.fit(stats, labels)
    rows = quality_rules.judge(stats, model).collect()
    forest = model.forest

    def path(x) -> float:
        total = 0.0
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + int(x[forest.feature[node]] >= forest.split[node])
            total += float(forest.path[node])
        return float(total / len(forest.roots))

    for r in rows:
        ratio = text_stats.ratios({c: np.array([r[c]]) for c in text_stats.COUNTS})[0]
        x = np.sqrt(ratio[quality_rules.RULES]).astype(np.float32)
        score = 2.0 ** (-path(x) / forest.norm) if len(forest.roots) else 0.0
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert math.isclose(score, r.score, rel_tol=1e-6) and r.base_failed == failed
        assert r.kept == (not failed and score < model.threshold)


def test_scores_of_pairs_by_a_plain_formula(spark, docs, labels):
    stats = text_stats.with_stats(docs).cache()
    ranking = pairwise_quality.fit(stats, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in pairwise_quality.score_quality(docs, labels).where("doc_id is not null").collect()}
    for r in stats.where("doc_id is not null").collect():
        x = pairwise_quality.features({c: np.array([r[c]]) for c in text_stats.COUNTS})[0]
        raw = sum(max(-8.0, min(8.0, (v - m) / s)) * w for v, m, s, w in zip(x, ranking.mean, ranking.scale, ranking.weights, strict=True))
        z = max(-30.0, min(30.0, (raw - ranking.cut) / ranking.spread)) + math.log(pairwise_quality.CUT / (1 - pairwise_quality.CUT))
        score = 1 / (1 + math.exp(-z))
        if got[r.doc_id][0] != pytest.approx(score, rel=1e-6):  # ids that several texts have may show another text's score
            assert stats.where(F.col("doc_id") == r.doc_id).count() > 1
        assert got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.3)


def test_copies_by_a_plain_running_sum(spark, docs):
    """Documents of a source in the order of size and hash; one copy for each whole number that the running sum crosses."""
    offset = F.pmod(F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit(18)), F.lit(1 << source_mix.OFFSET_BITS)) / float(1 << source_mix.OFFSET_BITS)
    told = docs.select("doc_id", "source", source_mix.word_count(F.col("text")).alias("size"), source_mix.row_hash(docs).alias("hash"), offset.alias("offset")).collect()
    sizes: dict = {}
    for r in told:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = plain.targets(sizes)
    want = []
    for s in sizes:
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        own = sorted((r for r in told if r.source == s), key=lambda r: (r.size, r.hash))
        for k, r in enumerate(own):
            copies = min(2, math.floor((k + 1) * rate + r.offset) - math.floor(k * rate + r.offset))
            want.append((r.doc_id, r.size, sizes[s], copies * r.size))
    got = [(r.doc_id, r.size, r.source_size, r.taken) for r in source_mix.sampled(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_anchors_in_stretches():
    """The leftmost least hash of each window, however few places a stretch has."""
    rng = np.random.default_rng(0)
    for bits in (6, 8, 24):
        for n, w in ((500, 5), (1000, 30), (3, 5), (40, 33), (70, 1)):
            grams = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            high = grams >> np.uint64(bits)
            assert anchor_places(grams, w, bits).tolist() == [i + int(np.argmin(high[i : i + w])) for i in range(n - w + 1)]


def test_a_payload_that_does_not_match_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", None)], "page_id long, payload_digest string, payload_matches boolean")
    assert [r.payload_digest for r in warc_zip.verified(rows).orderBy("page_id").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="payload of record 3"):
        warc_zip.verified(spark.createDataFrame([(3, "c", False)], rows.schema)).collect()
