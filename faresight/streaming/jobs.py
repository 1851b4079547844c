"""Structured Streaming versions of the alert, payment, retry and ingestion jobs.

Every foreachBatch job writes one folder per batch id and overwrites it, so a batch repeated after
a failure leaves the same result. Sinks and checkpoints live in folders the caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import evaluate_alerts
from ..operators.joins import lowest_fares, match_payments
from ..operators.ordered import top_k
from ..sources.tables import latest_batches
from .state import alert_versions, delivery_state, first_payments, first_triggers, newest_versions, seconds

ROUTE = ("origin_code", "destination_code")

PAYMENT = (
    "struct<event:string,payload:struct<payment:struct<entity:struct<order_id:string,id:string>>>>"
)


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], every: str | None, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return trigger.start()


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def alert_state(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """(id, last_price, triggered_count) of all alerts checked up to a batch, or None before the first."""
    return latest_batches(spark, f"{path}/state/{batch % 2}") if batch >= 0 else None


def alert_stream(
    ticks: DataFrame,
    alerts: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ROUTE,
    every: str | None = "30 minutes",
) -> StreamingQuery:
    """Checks each batch of fare ticks against the alerts as they are then; one row in ``path/hits`` per alert met.

    ``alerts`` reads the alert table and is asked for every batch, so alerts that were added, changed or switched off since
    count at once. What a check leaves behind, last fare and number of triggers, is written as a new version of
    ``path/state`` next to the one it was read from: two versions are kept, a batch costs one pass over the alerts however
    long the stream has run, and a batch that is repeated reads the version before it and writes the same again.
    Ticks are reduced to the lowest fare per key before the join, so a busy route costs one row.
    ``every=None`` handles what is available and stops.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        known = alerts()
        before = alert_state(batch.sparkSession, path, batch_id - 1)
        if before is not None:
            seen = before.select("id", F.col("last_price").alias("_last"), F.col("triggered_count").alias("_count"))
            known = known.join(seen, "id", "left").withColumns(
                {"last_price": F.coalesce(F.col("_last"), F.col("last_price").cast("double")), "triggered_count": F.coalesce("_count", "triggered_count")}
            ).drop("_last", "_count")
        priced = known.join(lowest_fares(batch, list(keys)), list(keys), "left")
        updated, hits = evaluate_alerts(priced)
        shape = hits.select(F.col("id").alias("alert_id"), "user_id", *keys, "target_price", "current_price")
        _write_batch(shape, f"{path}/hits", batch_id)
        state = updated.select("id", F.col("last_price").cast("double").alias("last_price"), F.col("triggered_count").cast("int").alias("triggered_count"))
        state.write.mode("overwrite").parquet(f"{path}/state/{batch_id % 2}")

    return _run(ticks, checkpoint, check, every)


def notify_once(triggers: DataFrame, horizon: str | None = None, ts: str = "ts", key: str = "alert_id") -> DataFrame:
    """The earliest trigger of every alert: for good on a table, or within ``horizon`` on a stream, whose state then expires."""
    if triggers.isStreaming:
        return first_triggers(triggers, horizon or "1 day", ts=ts, key=key)
    return top_k(triggers, key, [ts, *[c for c in triggers.columns if c not in (ts, key)]], 1)


def parse_payments(raw: DataFrame, body: str = "body", ts: str = "ts") -> DataFrame:
    """(ts, event, order_id, payment_id) from webhook bodies."""
    parsed = raw.withColumn("_b", F.from_json(body, PAYMENT))
    entity = F.col("_b.payload.payment.entity")
    return parsed.select(
        ts, F.col("_b.event").alias("event"), entity["order_id"].alias("order_id"), entity["id"].alias("payment_id")
    )


def payment_stream(
    events: DataFrame, bookings: DataFrame, path: str, checkpoint: str, every: str | None = "1 minute"
) -> StreamingQuery:
    """Settles each unpaid booking once, with the first captured payment of its order: its new version, PAID, goes to ``path``.

    Which orders are settled is keyed state of the stream (``state.first_payments``), so a batch costs what it brings and
    nothing that was written before is read again.
    """

    def settle(batch: DataFrame, batch_id: int) -> None:
        settled = match_payments(batch.withColumn("event", F.lit("payment.captured")), bookings)
        _write_batch(settled.withColumns({"payment_status": F.lit("PAID"), "paid_at": F.col("paid_at")}), path, batch_id)

    return _run(first_payments(events), checkpoint, settle, every, "update")


def retry_state(outcomes: DataFrame) -> DataFrame:
    """Delivery failures and success per notification; a keyed streaming aggregate, or the same in batch."""
    return outcomes.groupBy("notification_id").agg(
        F.count_if(F.col("outcome") == "FAILED").alias("failures"),
        F.max((F.col("outcome") == "SENT").cast("int")).alias("sent"),
    )


def retry_queue(queue: DataFrame, state: DataFrame) -> DataFrame:
    """Queue after the outcomes: sent is final, failures count up to the maximum, the rest stays pending."""
    joined = queue.join(state.withColumnRenamed("notification_id", "id"), "id", "left")
    tried = F.least(F.col("retry_count") + F.coalesce("failures", F.lit(0)), F.greatest("retry_count", "max_retries"))
    sent = F.coalesce(F.col("sent"), F.lit(0)) == 1
    return joined.withColumn("retry_count", tried.cast("int")).withColumn(
        "status",
        F.when(F.col("status") != "PENDING", F.col("status"))
        .when(sent, "SENT")
        .when(F.col("retry_count") >= F.col("max_retries"), "FAILED")
        .otherwise("PENDING"),
    ).drop("failures", "sent")


def retry_stream(
    outcomes: DataFrame, queue: DataFrame, path: str, checkpoint: str, every: str | None = "1 minute"
) -> StreamingQuery:
    """Writes a new version of every notification touched by a batch; counts are forgotten some time after the last outcome."""

    def write(batch: DataFrame, batch_id: int) -> None:
        touched = queue.join(batch.select(F.col("notification_id").alias("id")), "id", "left_semi")
        _write_batch(retry_queue(touched, batch), path, batch_id)

    return _run(delivery_state(outcomes), checkpoint, write, every, "update")


def latest_versions(written: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of every row that a job wrote, by batch."""
    return top_k(written, key, [F.desc("batch_id")], 1)


def challenge_results(attempts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """One-time codes after their attempts: tries counted up to the first success, and whether it was used.

    ``attempts``: challenge_id, ts, attempt_id, is_match, expires_at. Tries after expiry, after a
    success or beyond the maximum change nothing, so only the first few of a code are kept.
    """
    in_time = attempts.filter(F.col("ts") <= F.col("expires_at"))
    tries = top_k(in_time, "challenge_id", ["ts", "attempt_id"], max_attempts, rank="n")
    won = F.min(F.when(F.col("is_match"), F.col("n")))
    return tries.groupBy("challenge_id").agg(
        F.coalesce(won, F.count(F.lit(1)).cast("int")).alias("attempts"),
        won.isNotNull().alias("is_used"),
    )


def challenge_stream(attempts: DataFrame, max_attempts: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """The same on a stream, with keyed state that expires with the code. Emits the state after each batch.

    Tries are trimmed to the earliest few per code before the shuffle, and the keyed step again
    holds no more than that, so a code under attack stays small.
    """

    def trim(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            yield chunk.sort_values(["ts", "attempt_id"]).groupby("challenge_id", sort=False).head(max_attempts)

    def count(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tried, used = state.get if state.exists else (0, False)
        first = None
        expires = None
        for chunk in chunks:
            expires = max(int(chunk["due"].max()), expires or 0)
            first = chunk if first is None else pd.concat([first, chunk])
            first = first.nsmallest(max_attempts, ["ts", "attempt_id"])
        for hit in first["is_match"]:
            if used or tried >= max_attempts:
                break
            tried += 1
            used = bool(hit)
        state.update((tried, used))
        # A watermark past the expiry means no countable try can still arrive.
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"challenge_id": [key[0]], "attempts": [tried], "is_used": [used]})

    kind = attempts.schema["challenge_id"].dataType.simpleString()
    # The session's time zone is left behind here: moments go on as milliseconds.
    in_time = attempts.filter(F.col("ts") <= F.col("expires_at")).withColumn("due", F.unix_millis("expires_at"))
    return (
        in_time.mapInPandas(trim, in_time.schema)
        .withWatermark("ts", lateness)
        .groupBy("challenge_id")
        .applyInPandasWithState(
            count,
            f"challenge_id {kind}, attempts int, is_used boolean",
            "attempts int, is_used boolean",
            "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def fare_ingest_stream(
    fares: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ("departure_date",),
    every: str | None = "1 hour",
) -> StreamingQuery:
    """Appends fare observations exactly once through the file sink."""
    writer = (
        fares.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .outputMode("append")
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def alert_expiry_stream(
    alerts: DataFrame, path: str, checkpoint: str, every: str | None = None, lateness: str = "0 seconds", ts: str = "created_at"
) -> StreamingQuery:
    """Writes (id, expired_at) when an alert ends. Event time runs with the versions of alerts that arrive, by ``ts``; an alert that is
    alive when it is read expires later, and a later version of it moves its end.

    The alerts that wait are a table beside the log, of which two versions are kept: a batch reads the one before it, takes the
    newest version of every alert, and writes those that wait on and those that event time has passed. A batch costs one pass
    over what it brings and what waits, and a batch that is repeated writes the same again.
    """
    kind = alerts.schema["id"].dataType.simpleString()
    held, delay = f"{checkpoint}/waiting", seconds(lateness) * 1000

    def expire(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = lambda n: spark.read.schema(f"id {kind}, ms bigint, due bigint, ended boolean").parquet(f"{held}/{n % 2}/alerts")
        clock, late, waiting = None, None, None
        if batch_id > 0:
            clock, late = spark.read.schema("clock bigint, late bigint").parquet(f"{held}/{(batch_id - 1) % 2}/clock").first()
            waiting = known(batch_id - 1).filter(~F.col("ended"))
        versions = alert_versions(batch, ts)
        # Rows are late by the watermark of the batch before, as in Spark's own state.
        versions = versions if late is None else versions.filter(F.col("at") > F.timestamp_millis(F.lit(late)))
        seen = versions.agg(F.max("ms")).first()[0]
        now = max((m for m in (clock, None if seen is None else seen - delay) if m is not None), default=None)
        ended = F.lit(False) if now is None else F.col("due") < now
        checked = newest_versions(waiting, versions).withColumn("ended", ended)
        checked.write.mode("overwrite").partitionBy("ended").parquet(f"{held}/{batch_id % 2}/alerts")
        moments = spark.createDataFrame([(now, clock)], "clock bigint, late bigint")
        moments.coalesce(1).write.mode("overwrite").parquet(f"{held}/{batch_id % 2}/clock")
        over = known(batch_id).filter("ended").select("id", F.timestamp_millis("due").alias("expired_at"))
        _write_batch(over, path, batch_id)

    return _run(alerts, checkpoint, expire, every)


def windowed_fares(
    ticks: DataFrame, width: str = "1 day", lateness: str | None = None, ts: str = "ts", keys: Sequence[str] = ROUTE
) -> DataFrame:
    """Low, high and mean fare per key and time window, in batch or on a stream with ``lateness``."""
    source = ticks.withWatermark(ts, lateness) if lateness else ticks
    stats = source.groupBy(*keys, F.window(ts, width)).agg(
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.avg("price").alias("mean"),
        F.count(F.lit(1)).alias("fares"),
    )
    return stats.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")
