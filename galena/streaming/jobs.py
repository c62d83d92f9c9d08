"""Streams over append-only logs. All read time from the events, never from the clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators.resolution import change_detect
from galena.operators.windows import latest_per_key
from galena.sources.tables import discard, materialize
from galena.streaming.processors import EndedKeys, PriceDrops
from galena.streaming.state import FANOUT, KeyedState

#: Buckets of keys that a stateful job calls Python for. A checkpoint goes on with the number that it was begun with.
BUCKETS = 1024
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's folder or file as a stream, with event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rpartition("/")
    stream = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def dedupe(events: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first of the rows with one key; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def tumbling(events: DataFrame, width: str = "6 hours", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window and type; rows later than the delay are left out."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no gap longer than ``gap``."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def price_drops(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alerts (user_id, event_id, current, previous): a purchase cheaper than the user's one before. See ``PriceDrops``."""
    rows = events.where("event_type = 'purchase'").withWatermark("ts", delay).select("user_id", "event_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    return rows.groupBy("user_id").transformWithStateInPandas(PriceDrops(), "user_id long, event_id long, current long, previous long", "Append", "None")


def ended_keys(events: DataFrame, hours: int = 24, delay: str = "10 minutes") -> DataFrame:
    """(user_id, event_type, event_id, last): the last event of a key once it hasn't been seen for ``hours``. See ``EndedKeys``."""
    rows = events.withWatermark("ts", delay).select("user_id", "event_type", "event_id", "ts", F.unix_millis("ts").alias("millis"))
    bucketed = rows.withColumns({"bucket": F.pmod(F.xxhash64("user_id", "event_type"), F.lit(BUCKETS)), "nobody": F.col("user_id").isNull(), "user_id": F.coalesce("user_id", F.lit(0))})
    out = bucketed.groupBy("bucket").transformWithStateInPandas(EndedKeys(hours), "user_id long, nobody boolean, event_type string, event_id long, last long", "Append", "EventTime")
    return out.select(F.when(~F.col("nobody"), F.col("user_id")).alias("user_id"), "event_type", "event_id", "last")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there through a stream into Parquet, and read it. State is kept by RocksDB."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_each(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro batch to ``merge``, which must be idempotent for a batch id."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keyed_state(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], at: str, gone: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """The rows that ``fold`` keeps of the stream, brought up to date by each micro batch, without those that are ``gone``.

    See ``KeyedState``: a batch reads nothing of the state, and what is stored is merged by levels.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    state = KeyedState(stream.sparkSession, at, schema, fold, gone, fanout)
    upsert_each(stream, state.apply, f"{at}/state")
    return state.rows()


def page_intake(stream: DataFrame, at: str) -> DataFrame:
    """(round, page_id, status) of the pages of each micro batch so far: created, updated or unchanged.

    ``stream``: page_id, version, digest. The latest version of a page in a batch is compared with the digest stored before. Only
    digests that are new or changed are written, as a run of the stored ones (see ``KeyedState``).
    """
    spark = stream.sparkSession
    latest = lambda rows: latest_per_key(rows, ["page_id"], [F.desc("round"), F.desc("version"), F.desc("digest")])
    state = KeyedState(spark, f"{at}/digests", f"page_id {stream.schema['page_id'].dataType.simpleString()}, version {stream.schema['version'].dataType.simpleString()}, digest string, round long", latest)

    def merge(batch: DataFrame, number: int) -> None:
        if number in state.batches():
            return
        new = materialize(latest_per_key(batch, ["page_id"], [F.desc("version"), F.desc("digest")]).select("page_id", "version", "digest", F.lit(number).cast("long").alias("round")))
        undated = [F.lit(None).cast("timestamp").alias("lastmod")]
        told = materialize(change_detect(state.stored(new, ["page_id"]).select("page_id", "digest", *undated), new.select("page_id", "digest", *undated), "page_id", "lastmod", "digest"))
        told.write.mode("overwrite").parquet(f"{at}/status/round={number}")
        state.apply(new.join(told.where("status <> 'unchanged'").select("page_id"), "page_id", "left_semi").select(new.columns), number)
        discard(told)
        discard(new)

    upsert_each(stream, merge, f"{at}/state")
    return spark.read.parquet(f"{at}/status")
