"""Pairs of records are whole, and their work doesn't grow with facts that no comparison reads."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galena.operators import identity as ops
from galena.plans import QUERIES, identity
from galena.sources.views import Tables

DATA = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@has_data
@pytest.mark.parametrize(("key", "facts"), [("compare_identity", "signals"), ("compare_records", "relation, reason")])
def test_every_pair_of_records_can_be_told(spark, key, facts):
    """Pairs of classes and members give what the SQL says of each single pair of records."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{DATA}/part.parquet'")
    want = {(a, b): tuple(f) for a, b, *f in c.sql(f'WITH {identity._PAIRS} SELECT "left", "right", {facts} FROM pairs').fetchall()}
    rows = [r.asDict() for r in QUERIES[key](spark, DATA).collect()]
    members: dict = {}
    for r in rows:
        if r["relation"] == "MEMBER":
            members.setdefault(r["right"], []).append(r["left"])
    got: dict = {}
    for r in rows:
        if r["relation"] != "MEMBER":
            left, right = members[r["left"]], members[r["right"]]
            pairs = {(min(a, b), max(a, b)) for a in left for b in right if a != b}
            assert len(pairs) == r["pairs"]
            got |= dict.fromkeys(pairs, (r["relation"], *([r["reason"]] if "reason" in r else [])))
    assert got == want


def test_classes_do_not_grow_with_the_brands_of_a_group(spark, tmp_path):
    """Brands stand in the names by language only, and all records of the group have one English name."""
    n = 1000
    columns = {"p_partkey": list(range(n)), "p_name": ["red box"] * n, "p_type": ["a"] * n, "p_brand": [f"brand {i}" for i in range(n)], "p_size": [3] * n}
    types = {"p_partkey": pa.int64(), "p_name": pa.string(), "p_type": pa.string(), "p_brand": pa.string(), "p_size": pa.int32()}
    pq.write_table(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}), tmp_path / "part.parquet")
    for evidence in (False, True):
        classes, members, pairs = identity.compared(Tables(spark, str(tmp_path)), evidence)
        assert classes.count() == 12 and members.count() == n  # year or none, themes or none, three formats
        assert pairs.agg(F.sum("pairs")).first()[0] == n * (n - 1) // 2


def test_names_stay_where_they_can_diverge(spark):
    rows = [("one", 1, {"en": "a", "de": "x"}), ("one", 2, {"en": "a", "de": "y"}), ("many", 3, {"en": "a", "de": "x"}), ("many", 4, {"en": "b", "de": "x"}), ("many", 5, {"en": "b"}), ("blank", 6, {"en": "-"}), ("blank", 7, {"en": "-"}), ("none", 8, None)]
    got = {r.id: r.names for r in ops.without_common_names(spark.createDataFrame(rows, "g string, id int, names map<string,string>"), "g").collect()}
    assert got == {i: None if g == "one" else names for g, i, names in rows}


@has_data
@pytest.mark.parametrize("block", [3, 500])
@pytest.mark.parametrize(("key", "facts"), [("compare_identity", ["signals"]), ("compare_records", ["relation", "reason"])])
def test_every_pair_of_records_is_a_row(spark, key, facts, block, monkeypatch):
    """No row stands for several pairs, also where a class is dealt into blocks; every record is named."""
    monkeypatch.setattr(ops, "PAIR_BLOCK", block, raising=False)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{DATA}/part.parquet'")
    want = c.sql(f'WITH {identity._PAIRS} SELECT grp, "left", "right", {", ".join(facts)} FROM pairs').fetchall()
    rows = [r.asDict() for r in QUERIES[key](spark, DATA).collect()]
    told = ["grp", "left", "right", "relation", *facts[1:]]
    assert sorted(tuple(r[x] for x in told) for r in rows if r["relation"] != "MEMBER") == sorted(want)
    assert sorted(r["left"] for r in rows if r["relation"] == "MEMBER") == sorted(x for x, in c.sql("SELECT p_partkey FROM part").fetchall())


def test_blocks_of_a_class_are_paired_once(spark, monkeypatch):
    monkeypatch.setattr(ops, "PAIR_BLOCK", 4)
    monkeypatch.setattr(ops, "TASK_PAIRS", 100)
    members = spark.range(90).select(F.lit("g").alias("grp"), "id", F.when(F.col("id") < 50, 0).when(F.col("id") < 89, 50).otherwise(89).cast("long").alias("cls"))
    classes = spark.createDataFrame([("g", 0, 50, 0), ("g", 50, 39, 50), ("g", 89, 1, 89)], "grp string, cls long, n long, first long")
    pairs = ops.class_pairs(classes, "grp", lambda p: p.withColumn("relation", F.concat_ws("-", "left_cls", "right_cls")))
    got = sorted((r.left, r.right, r.relation) for r in ops.record_pairs(members, classes, pairs, "grp", "id", ["relation"]).where("relation <> 'MEMBER'").collect())
    cls = [0] * 50 + [50] * 39 + [89]
    assert got == sorted((a, b, f"{cls[a]}-{cls[b]}") for b in range(90) for a in range(b))
