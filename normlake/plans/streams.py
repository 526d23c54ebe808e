"""Streaming queries: each drains its feed with availableNow and is compared with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scan
from ..functions.text import ratio4
from ..sources.tables import table
from ..streaming import feeds as fd
from . import adapters as ad
from . import sqltext as sq
from .registry import query
from .versions import ORIGIN_SQL


@query("str01_change_feed", "STR01", sql="""
SELECT event_id, event_type, ts::DATE::VARCHAR AS published FROM events WHERE event_type <> 'error'""")
def str01_change_feed(spark, sf):
    feed = fd.read_feed(spark, sf, "events").filter("event_type <> 'error'").select("event_id", "event_type", F.to_date("ts").cast("string").alias("published"))
    return fd.run_append(feed, fd.feed_folder(spark, "feed", sf, feed))


@query("str02_incremental_capture", "STR02", sql=f"WITH {ORIGIN_SQL} SELECT regulation_id, capture_id, change_origin, version_no FROM v")
def str02_incremental_capture(spark, sf):
    captures = ad.as_captures(fd.read_feed(spark, sf, "orders"))
    rows = fd.run_incremental(captures, fd.feed_folder(spark, "captures", sf, captures), fd.capture_step)
    return rows.select("regulation_id", "capture_id", "change_origin", "version_no")


@query("str03_refresh_report", "STR03", sql="""
SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FETCHED' END AS status, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def str03_refresh_report(spark, sf):
    feed = ad.with_utc(fd.read_feed(spark, sf, "events"), "ts").withColumn("status", F.when(F.col("event_type") == "error", "FAILED").otherwise("FETCHED"))
    days = fd.windowed(feed, "ts", None, "1 day", None, ["status"], F.count(F.lit(1)).alias("n"))
    return fd.run_updates(days, fd.feed_folder(spark, "refresh-days", sf, days), ["window_start", "window_end", "status"]).select(F.to_date("window_start").cast("string").alias("day"), "status", "n")


@query("str04_horizon_windows", "STR04", sql="""
WITH w AS (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events)
SELECT s::DATE::VARCHAR AS window_start, event_type, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
def str04_horizon_windows(spark, sf):
    feed = ad.with_utc(fd.read_feed(spark, sf, "events"), "ts")
    spans = fd.windowed(feed, "ts", None, "2 days", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"))
    return fd.run_updates(spans, fd.feed_folder(spark, "horizon-spans", sf, spans), ["window_start", "window_end", "event_type"]).select(F.to_date("window_start").cast("string").alias("window_start"), "event_type", "n")


@query("str05_call_monitor", "STR05", sql=f"""
WITH {sq.CALLS}
SELECT date_trunc('day', "at")::DATE::VARCHAR AS day, run_id, count(*)::BIGINT AS calls, count(*) FILTER (status <> 'OK')::BIGINT AS failures, sum(elapsed_ms)::BIGINT AS model_ms,
  {sq.ratio4("count(*) FILTER (status <> 'OK')", 'count(*)')} AS failure_rate FROM calls GROUP BY ALL""")
def str05_call_monitor(spark, sf):
    calls = ad.with_utc(ad.as_calls(fd.read_feed(spark, sf, "events")), "at")
    failed = F.col("status") != "OK"
    days = fd.windowed(
        calls, "at", None, "1 day", None, ["run_id"], F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("failures"), F.sum("elapsed_ms").alias("model_ms"))
    return fd.run_updates(days, fd.feed_folder(spark, "monitor-days", sf, days), ["window_start", "window_end", "run_id"]).select(
        F.to_date("window_start").cast("string").alias("day"), "run_id", "calls", "failures", "model_ms", ratio4(F.col("failures"), F.col("calls")).alias("failure_rate"))


@query("str05_model_sessions", "STR05", sql=f"""
WITH {sq.CALLS},
g AS (SELECT *, CASE WHEN "at" - lag("at") OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM calls WINDOW w AS (PARTITION BY run_id, model ORDER BY "at")),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, model ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS no FROM g),
n AS (SELECT run_id, model, no, min("at") AS a, max("at") + INTERVAL 20 MINUTE AS b, count(*)::BIGINT AS calls, count(*) FILTER (failure_code IS NOT NULL)::BIGINT AS coded, sum(load_duration_ms)::BIGINT AS load_ms FROM s GROUP BY ALL)
SELECT run_id, model, strftime(a, '%Y-%m-%d %H:%M:%S') AS since, calls, coded, load_ms FROM n WHERE b <= (SELECT max("at") - INTERVAL 6 HOUR FROM calls)""")
def str05_model_sessions(spark, sf):
    """Consecutive use of a model in a run: calls of which none comes 20 minutes or more after the one before."""
    calls = ad.with_utc(ad.as_calls(fd.read_feed(spark, sf, "events")), "at")
    used = fd.sessions(calls, "at", "6 hours", "20 minutes", ["run_id", "model"], F.count(F.lit(1)).alias("calls"), F.count("failure_code").alias("coded"), F.sum("load_duration_ms").alias("load_ms"))
    return fd.run_append(used, fd.feed_folder(spark, "sessions", sf, used)).select("run_id", "model", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("since"), "calls", "coded", "load_ms")


@query("str06_audit_continuity", "STR06", sql="""
WITH l AS (SELECT user_id, event_id, lag(sha256(event_id || '|' || event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, event_id FROM l WHERE CASE WHEN event_id % 97 = 0 THEN 'tampered' ELSE b END IS DISTINCT FROM b""")
def str06_audit_continuity(spark, sf):
    # the log stores the hash of the entry before; every 97th link has been tampered with
    entry = F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("entry_hash")
    written = table(spark, sf, "events").select("user_id", "event_id", "ts", F.date_trunc("hour", "ts").alias("hour"), entry)
    chained = scan.previous(written, ["user_id"], "hour", [F.col("ts"), F.col("event_id")], "entry_hash", "_before")
    links = chained.select("event_id", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(F.col("_before")).alias("previous_hash"))
    log = fd.read_feed(spark, sf, "events").select("user_id", "event_id", "ts", F.date_trunc("hour", "ts").alias("hour"), entry).join(links, "event_id")
    return fd.run_incremental(log, fd.feed_folder(spark, "audit", sf, log), fd.continuity_step)


@query("str07_retention_expiry", "STR07", sql="""
SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND event_type <> 'purchase'""")
def str07_retention_expiry(spark, sf):
    def step(batch, state):
        seen = batch.select("event_id", "ts", "event_type")
        waiting = seen if state is None else seen.unionByName(state.select("event_id", "ts", "event_type"))
        newest = waiting.agg(F.max("ts").alias("_now"))
        dated = waiting.join(F.broadcast(newest))
        old = F.col("ts") < F.col("_now") - F.expr("INTERVAL 10 DAYS")
        gone = dated.filter(old & (F.col("event_type") != "purchase")).select("event_id")
        return gone, dated.filter(~old).select("event_id", "ts", "event_type")

    feed = fd.read_feed(spark, sf, "events")
    return fd.run_incremental(feed, fd.feed_folder(spark, "retention", sf, feed), step)


@query("str08_changed_provisions", "STR08", sql=f"""
WITH {sq.provisions('old_p')}, {sq.provisions('new_p', later=True)}, o AS (SELECT version_id, number, min(text) AS was FROM old_p GROUP BY ALL)
SELECT version_id, number, text, was IS NULL AS is_new FROM new_p LEFT JOIN o USING (version_id, number) WHERE was IS DISTINCT FROM text""")
def str08_changed_provisions(spark, sf):
    stored = ad.provisions(spark, sf).groupBy("version_id", "number").agg(F.min("text").alias("was"))
    arriving = ad.as_provisions(fd.read_feed(spark, sf, "lineitem"), later=True).select("version_id", "number", "text")
    joined = arriving.join(stored, ["version_id", "number"], "left").filter(~F.col("was").eqNullSafe(F.col("text")))
    changed = joined.select("version_id", "number", "text", F.col("was").isNull().alias("is_new"))
    return fd.run_append(changed, fd.feed_folder(spark, "changed", sf, changed))
