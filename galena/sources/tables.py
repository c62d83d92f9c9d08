"""Reading tables and snapshots, writing current state and append-only logs."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def snapshot(spark: SparkSession, path: str, entries: str = "entries", schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON snapshots ``{..envelope, entries: [..]}`` as one row for each entry with the envelope's columns.

    One snapshot for each file, or for each line with ``lines``.
    """
    reader = spark.read.option("multiLine", not lines)
    whole = (reader.schema(schema) if schema else reader).json(path)
    rest = [c for c in whole.columns if c != entries]
    return whole.select(*rest, F.explode(entries).alias("__e")).select(*rest, "__e.*")


def snapshot_sweep(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Every file of a folder and its subfolders as (file, payload variant); malformed files are skipped."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.try_parse_json("value").alias("payload")).where(F.col("payload").isNotNull())


def sitemap(bodies: DataFrame, xml: str = "xml") -> DataFrame:
    """(kind, loc, lastmod) of the entries of sitemap indexes and url sets, one or many per body."""
    entry = "loc STRING, lastmod STRING"
    parsed = F.from_xml(F.col(xml), f"sitemap ARRAY<STRUCT<{entry}>>, url ARRAY<STRUCT<{entry}>>")
    rows = bodies.select("*", parsed.alias("__map"))
    both = [rows.select(*bodies.columns, F.lit(kind).alias("kind"), F.explode(f"__map.{kind}").alias("__e")) for kind in ("sitemap", "url")]
    return reduce(DataFrame.unionByName, both).select(*[c for c in bodies.columns if c != xml], "kind", F.trim("__e.loc").alias("loc"), F.trim("__e.lastmod").alias("lastmod"))


def normalize_payload(df: DataFrame, json: str, spec: dict[str, tuple[list[str], str]], required: list[str]) -> DataFrame:
    """Typed columns from a JSON column. ``spec``: name -> (alternative paths, type); rows without a required field go."""
    payload = F.try_parse_json(json)
    typed = {name: F.coalesce(*[F.try_variant_get(payload, p, kind) for p in paths]) for name, (paths, kind) in spec.items()}
    out = df.withColumns(typed)
    return out.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in required]))


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared place that the session names; a local session that names none has one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="galena-")
    return f"{shared.rstrip('/')}/galena-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and its lineage ends there."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at  # type: ignore[attr-defined]
    return out


def _path(spark: SparkSession, at: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in whatever store Spark reaches; none if it isn't there."""
    path, store = _path(spark, folder)
    return [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []


def delete_path(spark: SparkSession, at: str) -> None:
    path, store = _path(spark, at)
    store.delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing may read ``df`` any more."""
    delete_path(df.sparkSession, df._written_at)  # type: ignore[attr-defined]


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: list[str], version: str, ties: list[str]) -> DataFrame:
    """Current state after an upsert by natural key: the row with the latest version wins, later input over earlier."""
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.desc("__new"), *[F.col(c).desc_nulls_last() for c in ties])
    return both.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", "__new")


def append_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet, one for each key."""
    return incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def report_long(sections: dict[str, DataFrame]) -> DataFrame:
    """Aggregates as (section, key, value) rows; each section has the columns key and value."""
    parts = [df.select(F.lit(name).alias("section"), F.col("key").cast("string"), F.col("value").cast("double")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, parts)
