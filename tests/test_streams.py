"""Feeds that arrive in several files give what the batch twin gives, also when files are replayed."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from normlake.operators import versions as vs
from normlake.plans import adapters as ad
from normlake.plans import load_all
from normlake.plans.registry import REGISTRY
from normlake.sources.tables import SCHEMAS
from normlake.streaming import feeds as fd

SF_DIR = "/root/testdata/sf0.001"


def parts(spark, name, order):
    """The table as four files in time order, in a new folder."""
    folder = tempfile.mkdtemp(prefix="normlake-parts-")
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{SF_DIR}/{name}.parquet").toPandas().sort_values(order)
    size = len(df) // 4 + 1
    for i in range(4):
        df.iloc[i * size:(i + 1) * size].to_parquet(f"{folder}/{name}-{i}.parquet", index=False, coerce_timestamps="us")
    return folder


def test_capture_over_several_batches(spark):
    folder = parts(spark, "orders", ["o_orderdate", "o_orderkey"])
    stream = ad.as_captures(fd.read_feed(spark, folder, "orders", files_per_batch=1))
    got = fd.run_incremental(stream, tempfile.mkdtemp(prefix="normlake-run-") + "/x", fd.capture_step)
    columns = ["regulation_id", "capture_id", "change_origin", "version_no"]
    want = vs.label_captures(ad.captures(spark, SF_DIR), "year").select(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_continuity_over_several_batches(spark):
    folder = parts(spark, "events", ["ts", "event_id"])
    chained = lambda df: df.select(
        "user_id", "event_id", "ts", F.date_trunc("hour", "ts").alias("hour"), F.sha2(F.col("event_id").cast("string"), 256).alias("entry_hash"),
        F.lit(None).cast("string").alias("previous_hash"))
    got = fd.run_incremental(chained(fd.read_feed(spark, folder, "events", 1)), tempfile.mkdtemp(prefix="normlake-run-") + "/x", fd.continuity_step)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    assert got.count() == events.count() - events.select("user_id").distinct().count()


def test_late_captures_open_no_version(spark):
    captures = ad.captures(spark, SF_DIR).cache()
    times = sorted(r.fetched_at for r in captures.select("fetched_at").collect())
    middle = times[len(times) // 2]
    newer, older = captures.filter(F.col("fetched_at") > middle), captures.filter(F.col("fetched_at") <= middle)
    _, state = fd.capture_step(newer, None)
    known = {r.regulation_id: (r.capture_id, r.version_no) for r in state.collect()}
    out, after = fd.capture_step(older, state)
    assert all((r.change_origin == "LATE") == (r.regulation_id in known) for r in out.collect())
    heads = {r.regulation_id: (r.capture_id, r.version_no) for r in after.collect()}
    assert all(heads[k] == v for k, v in known.items())


def daily(spark, folder, per_batch=None):
    feed = ad.with_utc(fd.read_feed(spark, folder, "events", per_batch), "ts")
    return fd.windowed(feed, "ts", "1 hour", "1 day", None, [], F.count(F.lit(1)).alias("n"))


def test_a_late_file_is_dropped(spark):
    """A file that arrives after its days have come out adds nothing; without the delay's order the same rows count."""
    folder, late = parts(spark, "events", ["ts", "event_id"]), tempfile.mkdtemp(prefix="normlake-late-")
    events = spark.read.schema(SCHEMAS["events"]).parquet(folder).toPandas().sort_values("ts")
    half, more = len(events) // 2, 3 * len(events) // 4
    for n, rows in enumerate((events.iloc[half:more], events.iloc[more:], events.iloc[:half])):  # what is late is known one batch after the newest row
        rows.to_parquet(f"{late}/events-{n}.parquet", index=False, coerce_timestamps="us")
        os.utime(f"{late}/events-{n}.parquet", (n + 1, n + 1))
    run = lambda source: {r.window_start: r.n for r in fd.run_append(daily(spark, source, 1), tempfile.mkdtemp(prefix="normlake-run-") + "/x").collect()}
    in_order, out_of_order = run(folder), run(late)
    first_day = min(out_of_order)
    assert sum(in_order.values()) > sum(out_of_order.values()) and min(in_order) < first_day
    assert all(in_order[d] == n for d, n in out_of_order.items() if d != first_day)


def test_a_feed_that_runs_again_adds_only_what_is_new(spark):
    source, folder = parts(spark, "events", ["ts", "event_id"]), tempfile.mkdtemp(prefix="normlake-grow-")
    target = tempfile.mkdtemp(prefix="normlake-run-") + "/x"
    seen = []
    for i in range(4):
        shutil.copy(f"{source}/events-{i}.parquet", folder)
        seen.append({(r.window_start, r.n) for r in fd.run_append(daily(spark, folder), target).collect()})
        again = {(r.window_start, r.n) for r in fd.run_append(daily(spark, folder), target).collect()}
        assert again == seen[-1]
    assert all(a < b for a, b in zip(seen, seen[1:]))
    whole = {(r.window_start, r.n) for r in fd.run_append(daily(spark, source), tempfile.mkdtemp(prefix="normlake-run-") + "/x").collect()}
    assert seen[-1] == whole


def test_open_windows_and_late_files_count(spark):
    """Every row counts: of the last days too, and of a file that arrives after days that are long over."""
    source, folder = parts(spark, "events", ["ts", "event_id"]), tempfile.mkdtemp(prefix="normlake-late-")
    target = tempfile.mkdtemp(prefix="normlake-run-") + "/x"
    for i in (3, 1, 0, 2):
        shutil.copy(f"{source}/events-{i}.parquet", folder)
        feed = ad.with_utc(fd.read_feed(spark, folder, "events"), "ts")
        days = fd.windowed(feed, "ts", None, "1 day", None, ["event_type"], F.count(F.lit(1)).alias("n"))
        got = {tuple(r) for r in fd.run_updates(days, target, ["window_start", "window_end", "event_type"]).select("window_start", "event_type", "n").collect()}
        events = spark.read.schema(SCHEMAS["events"]).parquet(folder)
        assert got == {tuple(r) for r in ad.with_utc(events, "ts").groupBy(F.date_trunc("day", "ts"), "event_type").count().collect()}


def test_the_reports_hold_every_event(spark):
    load_all()
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    for name, column, times in (("str03_refresh_report", "n", 1), ("str04_horizon_windows", "n", 2), ("str05_call_monitor", "calls", 1)):
        assert REGISTRY[name].run(spark, SF_DIR).agg(F.sum(column)).first()[0] == times * events


def test_a_folder_follows_name_source_and_columns(spark):
    class Named:
        conf = type("C", (), {"get": staticmethod(lambda *a: "/shared/")})

    a, b = spark.createDataFrame([], "x int"), spark.createDataFrame([], "x bigint")
    names = [fd.feed_folder(Named, n, s, f) for n, s, f in (("n", "/in", a), ("n", "/in/", a), ("n", "/in", b), ("m", "/in", a), ("n", "/on", a))]
    assert names[0] == names[1] and len(set(names)) == 4 and names[0].startswith("/shared/feeds/n-")
