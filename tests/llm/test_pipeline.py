"""The pipeline's stages on their own input, and the whole run."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from galena.llm import queries, source_mix, suffix_dedup  # noqa: E402
from galena.llm.common import read  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    docs = read(spark, DATA, "documents")
    columns, schema = docs.columns, docs.schema
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), schema)
        assert docs.columns == columns, name
        assert docs.select("doc_id").distinct().count() == docs.count(), name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.3 * counts[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.columns == [*columns, "copy"]
    size = source_mix.word_count(F.col("text"))
    taken, kept = mixed.agg(F.sum(size)).first()[0], docs.agg(F.sum(size)).first()[0]
    assert abs(taken - 1.5 * kept) < 0.1 * kept


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run_is_the_stages(spark):
    docs = read(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    key = lambda df: sorted((r.doc_id, r.copy, hash(r.text)) for r in df.collect())
    assert key(docs) == key(corpus_pipeline.run(spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run_against_plain_versions(spark):
    """Each stage after the forest by a plain version on what the stages before it have kept; the forest by its verdicts."""
    docs = read(spark, DATA, "documents")
    kept = {r.doc_id for r in queries.op1_quality_rules(spark, DATA).where("kept").select("doc_id").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    rows = [r for r, (i, low, _) in zip(rows, plain.near_duplicates(rows), strict=True) if i == low]
    rows = plain.without_repeats(rows, suffix_dedup.LENGTH)
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    leaked = {r[0] for r in c.sql(f"SELECT doc_id FROM ({queries.ORACLES['op8_template_leaks']}) WHERE contaminated").fetchall()}
    rows = [r for r in rows if r[0] not in leaked]
    assert leaked and len(rows) > 50
    got = corpus_pipeline.run(spark, DATA).collect()
    text = {i: t for i, t, _ in rows}
    assert {r.doc_id for r in got} <= set(text) and all(r.text == text[r.doc_id] for r in got)
    size = {i: len(plain.words(t)) for i, t, _ in rows}
    sizes: dict = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    target, source = plain.targets(sizes), {i: s for i, _, s in rows}
    taken: dict = dict.fromkeys(sizes, 0)
    copies: dict = {}
    for r in got:
        taken[source[r.doc_id]] += size[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    largest = max(size.values())
    assert max(copies.values()) <= 2 and all(abs(taken[s] - target[s]) <= 2 * largest for s in sizes)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
