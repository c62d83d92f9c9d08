"""Streams over the event log, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators.windows import latest_per_key
from galena.plans.base import query
from galena.sources.tables import scratch
from galena.sources.views import Tables
from galena.streaming import jobs


def _stream(t: Tables) -> DataFrame:
    return jobs.read_stream(t.spark, f"{t.folder}/events.parquet")


def _text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


@query("stream_tumbling", """
    WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, cents FROM w WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def stream_tumbling(t: Tables) -> DataFrame:
    """Windows that the watermark has closed."""
    at = scratch(t.spark)
    out = jobs.run_once(jobs.tumbling(_stream(t)), f"{at}/out", f"{at}/state")
    return out.select(_text("start").alias("start"), "event_type", "n", "cents")


@query("stream_session", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def stream_session(t: Tables) -> DataFrame:
    at = scratch(t.spark)
    out = jobs.run_once(jobs.sessions(_stream(t)), f"{at}/out", f"{at}/state")
    return out.select("user_id", _text("start").alias("start"), "n")


@query("stream_dedupe", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """Every event twice in, once out."""
    twice = _stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    at = scratch(t.spark)
    out = jobs.run_once(jobs.dedupe(twice, ["event_id"]).select("event_id"), f"{at}/out", f"{at}/state")
    return out.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("total"))


@query("stream_edits", """
    WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(json_extract(props, '$.k') AS INT) % 20 AS copy FROM events) SELECT user_id, copy, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id, copy ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""")
def stream_edits(t: Tables) -> DataFrame:
    """The last edit of each copy; one that was deleted is a tombstone until its runs are merged with the oldest."""
    at = scratch(t.spark)
    batch = _stream(t).select("user_id", "event_id", "ts", "event_type", (F.get_json_object("props", "$.k").cast("int") % 20).alias("copy"))
    state = jobs.keyed_state(batch, lambda rows: latest_per_key(rows, ["user_id", "copy"], [F.desc("ts"), F.desc("event_id")]), at, gone=F.col("event_type") == "error")
    return state.select("user_id", "copy", "event_id", "event_type")


def _versions(pages: DataFrame, number: int) -> DataFrame:
    return pages.select("page_id", F.lit(number).alias("version"), F.sha2("html", 256).alias("digest"))


@query("stream_page_changes", """
    SELECT 0 AS round, page_id, 'created' AS status FROM pages UNION ALL SELECT 1, page_id, CASE WHEN page_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END FROM pages WHERE page_id % 2 = 0""")
def stream_page_changes(t: Tables) -> DataFrame:
    """All pages, and then half of them again, a third of those with other html."""
    at = scratch(t.spark)
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<!-- 2 -->"))).otherwise(F.col("html"))
    again = t.pages.where("page_id % 2 = 0").withColumn("html", html)
    for number, pages in enumerate((t.pages, again)):
        rows = _versions(pages, number)
        rows.write.mode("append").parquet(f"{at}/in")
        out = jobs.page_intake(t.spark.readStream.schema(rows.schema).parquet(f"{at}/in"), at)
    return out.select("round", "page_id", "status")


@query("stream_change_detect", """
    SELECT 'created' AS status, count(*) AS n FROM pages UNION ALL SELECT CASE WHEN page_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END, count(*) FROM pages WHERE page_id % 2 = 0 GROUP BY 1""")
def stream_change_detect(t: Tables) -> DataFrame:
    """How many pages of both intakes are new, changed or as they were."""
    return stream_page_changes(t).groupBy("status").agg(F.count("*").alias("n"))


@query("stream_price_drop", """
    SELECT user_id, event_id, CAST(c AS BIGINT) AS current, CAST(p AS BIGINT) AS previous FROM (SELECT user_id, event_id, floor(value * 100) AS c, lag(floor(value * 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'purchase') WHERE p > 0 AND c < p""")
def stream_price_drop(t: Tables) -> DataFrame:
    at = scratch(t.spark)
    return jobs.run_once(jobs.price_drops(_stream(t)), f"{at}/out", f"{at}/state")


@query("stream_latest_ttl", """
    SELECT user_id, event_type, max_by(event_id, (epoch_ms(ts), event_id)) AS event_id FROM events GROUP BY 1, 2 HAVING epoch_ms(max(ts)) + 24 * 3600000 < (SELECT epoch_ms(max(ts)) - 600000 FROM events)""")
def stream_latest_ttl(t: Tables) -> DataFrame:
    """Keys whose last event was more than 24 hours before the final watermark."""
    at = scratch(t.spark)
    return jobs.run_once(jobs.ended_keys(_stream(t)), f"{at}/out", f"{at}/state").select("user_id", "event_type", "event_id")
