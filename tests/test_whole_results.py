"""Results stay whole where a group, a line or an expression is large."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galena.operators import joins
from galena.plans import ORACLES, QUERIES
from galena.streaming import jobs

DATA = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_pair_of_a_large_group_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_BLOCK", 50)
    rows = [("large", i) for i in range(301)] + [("small", i) for i in range(3)] + [(None, 1), (None, 2)]
    pairs, large = joins.pairs_within_group(spark.createDataFrame(rows, "g string, id int"), "g", "id")
    got = sorted((r.g, r.left_id, r.right_id) for r in pairs.collect())
    assert got == [(g, i, j) for g, n in (("large", 301), ("small", 3)) for i in range(n) for j in range(i + 1, n)]
    assert large.count() == 0


@has_data
def test_pairs_within_group_covers_every_nation(spark):
    sizes = {r.c_nationkey: r["count"] for r in spark.read.parquet(f"{DATA}/customer.parquet").groupBy("c_nationkey").count().collect()}
    assert max(sizes.values()) > 60
    got = {r.c_nationkey: r.n for r in QUERIES["pairs_within_group"](spark, DATA).groupBy("c_nationkey").agg(F.sum("pairs").alias("n")).collect()}
    assert got == {k: n * (n - 1) // 2 for k, n in sizes.items()}


@pytest.fixture(scope="module")
def large_parts(tmp_path_factory):
    """130 parts of one name and type, 200 of another, 1,001 of one brand and size."""
    rows = [(i, "red box", "a", "c", i % 6) for i in range(130)] + [(4 * i + 1001, "blue box", "a", "d", 3) for i in range(200)] + [(i + 10_000, f"name {i}", "b", "e", 1) for i in range(1001)]
    folder = tmp_path_factory.mktemp("parts")
    columns = zip(*rows, strict=True)
    types = {"p_partkey": pa.int64(), "p_name": pa.string(), "p_type": pa.string(), "p_brand": pa.string(), "p_size": pa.int32()}
    pq.write_table(pa.table({k: pa.array(list(v), t) for (k, t), v in zip(types.items(), columns, strict=True)}), folder / "part.parquet")
    return str(folder)


@pytest.mark.parametrize("key", ["compare_identity", "assign_identity", "cluster_records", "safe_action", "merged_audit", "reclassify_references", "compare_records"])
def test_identity_of_large_groups(spark, large_parts, key):
    """The rows of the SQL, where groups are large and facts repeat."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{large_parts}/part.parquet'")
    df = QUERIES[key](spark, large_parts)
    expected = c.sql(ORACLES[key])
    order = [df.columns.index(x) for x in expected.columns]
    assert sorted(tuple(r[i] for i in order) for r in df.collect()) == sorted(expected.fetchall())


@has_data
def test_manifest_of_every_order(spark):
    expected = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()
    assert QUERIES["manifest_materialize_all"](spark, DATA).count() == expected


def test_page_intake_tells_what_has_changed(spark, tmp_path):
    at = str(tmp_path)
    for rows in ([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], [(1, 1, "a"), (2, 1, "x"), (2, 2, "y"), (4, 1, "d")], [(2, 3, "y"), (3, 3, "z"), (1, 3, "a")]):
        spark.createDataFrame(rows, "page_id int, version int, digest string").write.mode("append").parquet(f"{at}/in")
        out = jobs.page_intake(spark.readStream.schema("page_id int, version int, digest string").parquet(f"{at}/in"), at)
    got = {(r.round, r.page_id): r.status for r in out.collect()}
    assert got == {(0, 1): "created", (0, 2): "created", (0, 3): "created", (1, 1): "unchanged", (1, 2): "updated", (1, 4): "created", (2, 1): "unchanged", (2, 2): "unchanged", (2, 3): "updated"}
