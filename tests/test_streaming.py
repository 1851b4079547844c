"""Streaming jobs against their batch twins, over several files, out of order, repeated and late."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from faresight.operators import joins
from faresight.sources import star
from faresight.sources.tables import latest_batches
from faresight.streaming import jobs, state


def feed(spark, tmp_path, frames, name="in"):
    """A directory with one Parquet file per frame and a stream that takes one file per batch."""
    folder = str(tmp_path / name)
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("file-"):
                target = os.path.join(folder, f"file-{i:03d}-{f}")
                os.rename(os.path.join(folder, f), target)
                os.utime(target, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def events(spark, sf):
    return star.events(spark, sf).cache()


@pytest.fixture(scope="module")
def parts(events):
    """Five files: in order, but with the middle pair swapped and the first file delivered twice."""
    cuts = ["2024-01-01", "2024-01-07", "2024-01-13", "2024-01-19", "2024-02-01"]
    files = [events.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, cuts[1:])]
    return [files[0], files[2], files[1], files[0], files[3]]


def same(a, b, *columns):
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert key(a) == key(b)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_alerts_fire_per_batch_and_notify_once(spark, sf, tmp_path, events, parts):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    alerts = star.alerts(spark, sf)
    ticks = star.fare_ticks(feed(spark, tmp_path, parts))
    finish(jobs.alert_stream(ticks, lambda: alerts, out, log, every=None))
    fired = spark.read.parquet(f"{out}/hits")
    assert fired.select("batch_id").distinct().count() == 5
    assert fired.groupBy("batch_id", "alert_id").count().filter("count > 1").isEmpty()
    batch = joins.match_alerts(alerts, star.fare_ticks(events))
    first = jobs.notify_once(fired, ts="batch_id")
    same(first.select("alert_id"), batch.select(F.col("id").alias("alert_id")), "alert_id")
    same(first, fired.groupBy("alert_id").agg(F.min("batch_id").alias("batch_id")), "alert_id", "batch_id")
    # Every check counts once, and the last fare seen stays.
    left = jobs.alert_state(spark, out, 4)
    hits = fired.groupBy(F.col("alert_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    want = alerts.join(hits, "id", "left").select("id", (F.col("triggered_count") + F.coalesce("hits", F.lit(0))).cast("int").alias("triggered_count"))
    same(left, want, "id", "triggered_count")
    last = fired.groupBy(F.col("alert_id").alias("id")).agg(F.max_by("current_price", "batch_id").alias("seen"), F.max("batch_id").alias("b")).filter("b = 4")
    assert last.count() and last.join(left, "id").filter("seen <> last_price").isEmpty()
    assert sorted(os.listdir(f"{out}/state")) == ["0", "1"]


def test_alerts_added_after_the_start_are_matched(spark, tmp_path):
    """Each batch reads the alert table as it is then; a repeated batch leaves the same state."""
    t = dt.datetime(2026, 1, 1)
    ticks = [spark.createDataFrame([(t + dt.timedelta(hours=i), "A", "B", 1000.0 - i)], "ts timestamp, origin_code string, destination_code string, price double") for i in range(3)]
    shape = "id int, user_id int, origin_code string, destination_code string, target_price double, is_active boolean, triggered_count int, last_price double"
    rows = [(1, 1, "A", "B", 1000.0, True, 0, None), (2, 1, "A", "C", 1e9, True, 0, None), (3, 2, "A", "B", 1e9, False, 0, 5.0)]
    asked = []

    def table():
        asked.append(1)
        return spark.createDataFrame(rows + [(4, 2, "A", "B", 999.0, True, 7, None)] * (len(asked) > 1), shape)

    out = str(tmp_path / "out")
    stream = feed(spark, tmp_path, ticks)
    for log in ("log1", "log2"):
        asked.clear()
        finish(jobs.alert_stream(stream, table, out, str(tmp_path / log), every=None))
        hits = sorted((r.batch_id, r.alert_id, r.current_price) for r in spark.read.parquet(f"{out}/hits").collect())
        assert hits == [(0, 1, 1000.0), (1, 1, 999.0), (1, 4, 999.0), (2, 1, 998.0), (2, 4, 998.0)]
        left = {r.id: (r.last_price, r.triggered_count) for r in jobs.alert_state(spark, out, 2).collect()}
        assert left == {1: (998.0, 3), 2: (None, 0), 3: (5.0, 0), 4: (998.0, 9)}


def to_batches(stream, out, log):
    sink = stream.writeStream.outputMode("update").option("checkpointLocation", log)
    finish(sink.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}")).trigger(availableNow=True).start())


def test_notify_once_on_a_stream_takes_the_earliest(spark, tmp_path, events, parts):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    # The files come out of order, so the watermark waits for the late ones.
    triggers = feed(spark, tmp_path, parts).select("ts", F.col("user_id").alias("alert_id"), "event_id")
    to_batches(state.first_triggers(triggers, "60 days", "20 days"), out, log)
    first = events.groupBy(F.col("user_id").alias("alert_id")).agg(F.min("ts").alias("ts"))
    limit = events.agg(F.max("ts") - F.expr("INTERVAL 20 DAYS")).first()[0]
    got = spark.read.parquet(out)
    assert got.count() and got.groupBy("alert_id").count().filter("count > 1").isEmpty()
    same(got, first.filter(F.col("ts") < F.lit(limit)), "alert_id", "ts")


def test_notify_once_starts_anew_after_its_horizon(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    hour = lambda h: t + dt.timedelta(hours=h)
    make = lambda rows: spark.createDataFrame(rows, "ts timestamp, alert_id int, price double")
    frames = [make([(hour(2), 1, 2.0), (hour(1), 1, 1.0)]), make([(hour(5), 1, 5.0), (hour(4), 2, 4.0)]), make([(hour(40), 1, 40.0)]), make([(hour(60), 9, 0.0)]), make([(hour(99), 9, 0.0)])]
    out = str(tmp_path / "out")
    to_batches(jobs.notify_once(feed(spark, tmp_path, frames), "1 day"), out, str(tmp_path / "log"))
    assert sorted((r.alert_id, r.price) for r in spark.read.parquet(out).collect()) == [(1, 1.0), (1, 40.0), (2, 4.0), (9, 0.0)]


@pytest.mark.parametrize("zone,ahead", [("UTC", 0), ("Asia/Kolkata", 330)])
def test_alerts_expire_after_they_were_read(spark, tmp_path, zone, ahead):
    """A given moment is the same in every time zone; a day of departure ends when it does in the session's."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        expire_later(spark, tmp_path, dt.timedelta(minutes=ahead))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def expire_later(spark, tmp_path, ahead):
    t = dt.datetime(2026, 1, 1)
    day = lambda d: t + dt.timedelta(days=d)
    make = lambda rows: spark.createDataFrame(rows, "id int, is_active boolean, departure_date date, expires_at timestamp, created_at timestamp")
    frames = [
        make([(1, True, day(9).date(), day(2), day(0)), (2, True, day(3).date(), None, day(0)), (3, False, day(1).date(), day(1), day(0)), (4, True, day(90).date(), day(90), day(0)), (6, True, None, None, day(0))]),
        make([(5, True, day(0).date(), day(0), day(1)), (1, True, day(9).date(), day(6), day(1))]),  # 5 has ended already, 1 is prolonged
        make([(9, False, None, None, day(5))]), make([(9, False, None, None, day(20))]),
    ]
    out = str(tmp_path / "out")
    finish(jobs.alert_expiry_stream(feed(spark, tmp_path, frames), out, str(tmp_path / "log")))
    got = {r.id: (r.expired_at, r.batch_id) for r in spark.read.parquet(out).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: day(6), 2: day(4) - ahead, 5: day(0)}
    assert got[5][1] < got[2][1] < got[1][1]


def test_payments_settle_once_across_batches(spark, sf, tmp_path, events, parts):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    booked = star.bookings(spark, sf).withColumn("order_id", F.col("id").cast("string"))
    stream = jobs.parse_payments(star.payment_bodies(feed(spark, tmp_path, parts)))
    finish(jobs.payment_stream(stream, booked, out, log, every=None))
    settled = spark.read.parquet(out)
    batch = joins.match_payments(jobs.parse_payments(star.payment_bodies(events)), booked)
    assert settled.groupBy("order_id").count().filter("count > 1").isEmpty()
    same(settled, batch, "id")
    assert {r[0] for r in settled.select("payment_status").distinct().collect()} == {"PAID"}


def test_a_repeated_batch_changes_nothing(spark, sf, tmp_path, events, parts):
    """A restart without the log replays every batch over the same folders."""
    out = str(tmp_path / "out")
    booked = star.bookings(spark, sf).withColumn("order_id", F.col("id").cast("string"))
    stream = jobs.parse_payments(star.payment_bodies(feed(spark, tmp_path, parts)))
    finish(jobs.payment_stream(stream, booked, out, str(tmp_path / "log1"), every=None))
    first = sorted(map(tuple, spark.read.parquet(out).select("id", "new_payment_id", "batch_id").collect()))
    finish(jobs.payment_stream(stream, booked, out, str(tmp_path / "log2"), every=None))
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "new_payment_id", "batch_id").collect())) == first


def test_retry_state_over_batches(spark, tmp_path, events):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    queue = star.notification_queue(events)
    halves = [events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")]
    finish(jobs.retry_stream(star.outcomes(feed(spark, tmp_path, halves)), queue, out, log, every=None))
    written = spark.read.parquet(out)
    latest = jobs.latest_versions(written)
    assert written.groupBy("id").count().filter("count > 1").count() > 0
    twin = jobs.retry_queue(queue, jobs.retry_state(star.outcomes(events)))
    touched = twin.join(star.outcomes(events).select(F.col("notification_id").alias("id")).distinct(), "id")
    same(latest, touched, "id", "status", "retry_count")


def test_challenges(spark, tmp_path, events):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    tries = star.code_attempts(events)
    cut = dt.datetime(2024, 1, 8)
    frames = [events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut)]
    stream = jobs.challenge_stream(star.code_attempts(feed(spark, tmp_path, frames)))
    sink = stream.writeStream.outputMode("update").option("checkpointLocation", log)
    finish(sink.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}")).trigger(availableNow=True).start())
    latest = spark.read.parquet(out).groupBy("challenge_id").agg(F.max(F.struct("batch_id", "attempts", "is_used")).alias("s"))
    same(latest.select("challenge_id", "s.attempts", "s.is_used"), jobs.challenge_results(tries), "challenge_id", "attempts", "is_used")


def test_challenge_rules(spark):
    t = dt.datetime(2026, 1, 1)
    end = t + dt.timedelta(minutes=10)
    make = lambda c, spec: [(c, t + dt.timedelta(minutes=m), i, ok, end) for i, (m, ok) in enumerate(spec)]
    data = make(1, [(0, False), (1, True), (2, True)]) + make(2, [(i, False) for i in range(6)] + [(7, True)]) + make(3, [(11, True)]) + make(4, [(10, True)])
    df = spark.createDataFrame(data, "challenge_id int, ts timestamp, attempt_id int, is_match boolean, expires_at timestamp")
    got = {r["challenge_id"]: (r["attempts"], r["is_used"]) for r in jobs.challenge_results(df).collect()}
    assert got == {1: (2, True), 2: (5, False), 4: (1, True)}


def test_windows_drop_late_rows(spark, tmp_path, events):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    day = lambda d: events.filter(F.col("ts").cast("date") == d)
    # The second delivery of day 2 comes a week late and must not change its closed window.
    frames = [day("2024-01-02"), day("2024-01-10"), day("2024-01-11"), day("2024-01-02"), day("2024-01-20")]
    closed = jobs.windowed_fares(star.fare_ticks(feed(spark, tmp_path, frames)), lateness="1 hour")
    finish(closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start())
    kept = events.filter(F.col("ts").cast("date").isin(*[dt.date(2024, 1, d) for d in (2, 10, 11)]))
    same(spark.read.parquet(out), jobs.windowed_fares(star.fare_ticks(kept)), "origin_code", "destination_code", "window_start", "low", "high", "fares")


def test_ingest_appends_each_file_once(spark, tmp_path, events, parts):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    stream = star.fare_ticks(feed(spark, tmp_path, parts))
    for _ in range(2):  # the second run finds nothing new
        finish(jobs.fare_ingest_stream(stream, out, log, ["origin_code"], every=None))
    expected = sum(p.count() for p in parts)
    assert spark.read.parquet(out).count() == expected


def test_latest_batches_before_the_first(spark, tmp_path):
    assert latest_batches(spark, str(tmp_path / "nothing")) is None


def test_alert_versions_over_batches(spark, tmp_path):
    """The newest version counts, a switched-off alert never ends, a late one is dropped, and no batch starts Python for a key."""
    t = dt.datetime(2026, 1, 1)
    day = lambda d: t + dt.timedelta(days=d)
    make = lambda rows: spark.createDataFrame([(i, on, None, end, at) for i, on, end, at in rows], "id int, is_active boolean, departure_date date, expires_at timestamp, created_at timestamp")
    frames = [
        make([(1, True, day(9), day(0)), (1, True, day(3), day(1)), (2, True, day(4), day(1)), (4, True, day(8), day(1))]),
        make([(1, True, day(20), day(0)), (2, False, day(4), day(2)), (4, True, day(2), day(2))]),  # 1 is older than what is known, 4 is cut short
        make([(9, False, None, day(5))]), make([(9, False, None, day(6)), (5, True, day(1), day(1))]), make([(9, False, None, day(30))]),
    ]
    out = str(tmp_path / "out")
    query = jobs.alert_expiry_stream(feed(spark, tmp_path, frames), out, str(tmp_path / "log"))
    finish(query)
    got = sorted((r.id, r.expired_at, r.batch_id) for r in spark.read.parquet(out).collect())
    assert got == [(1, day(3), 2), (4, day(2), 2)]
    assert not any(p.stateOperators for p in query.recentProgress)
