"""Keyed state with an end: what a stream must remember about an order, an alert or a notification, and for how long.

Each function is an event-time state machine. A batch hands it the new rows of a key, a timer tells it that the watermark has
passed the moment it set. State is dropped by timer, so it holds the keys of one horizon and not of all time. Moments come as
milliseconds that Spark made of the timestamps, so the session's time zone decides nothing here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def _timer(state: GroupState, due: int) -> None:
    """A timer has to lie after the watermark; one that is due already fires with the next batch."""
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def _keyed(stream: DataFrame, key: str, ts: str, lateness: str, fn: Callable, out: str, state: str) -> DataFrame:
    keyed = stream.withWatermark(ts, lateness).groupBy(key)
    return keyed.applyInPandasWithState(fn, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def seconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds())


def _earliest(chunks: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame | None:
    """The first row by ``order``; no more than a chunk and a row are held."""
    first = None
    for chunk in chunks:
        best = chunk.sort_values(list(order)).head(1)
        first = best if first is None else pd.concat([first, best]).sort_values(list(order)).head(1)
    return first


def first_payments(events: DataFrame, horizon: str = "90 days", lateness: str = "1 hour") -> DataFrame:
    """(order_id, payment_id, ts) once per order: the earliest captured payment of the batch that brings the order's first one.

    An order is remembered for ``horizon`` after its payment, which is as long as the sender repeats a message.
    """
    keep = seconds(horizon) * 1000

    def settle(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = _earliest(chunks, ["ms", "payment_id"])
        if state.exists or first is None:
            return
        paid = first.iloc[0]
        state.update((paid["payment_id"],))
        _timer(state, int(paid["ms"]) + keep)
        yield pd.DataFrame({"order_id": [key[0]], "payment_id": [paid["payment_id"]], "ts": [paid["ts"]]})

    captured = events.filter(F.col("event").isin("payment.captured", "order.paid") & F.col("order_id").isNotNull())
    captured = captured.select("order_id", "payment_id", "ts", F.unix_millis("ts").alias("ms"))
    return _keyed(captured, "order_id", "ts", lateness, settle, "order_id string, payment_id string, ts timestamp", "payment_id string")


def first_triggers(triggers: DataFrame, horizon: str = "1 day", lateness: str = "0 seconds", ts: str = "ts", key: str = "alert_id") -> DataFrame:
    """The earliest trigger of every alert within ``horizon``, given out once the watermark says that no earlier one can come.

    Triggers that follow within the horizon are silent; the first one after it starts anew. The state of an alert is at most
    two triggers, the one that counts and the next that will, and goes when the horizon ends without another. A check gives an
    alert one trigger, so the triggers of one alert in one batch are few.
    """
    span = seconds(horizon) * 1000
    columns = [c for c in triggers.columns if c != key] + ["__ms"]
    at, ms = columns.index(ts), len(columns) - 1
    kinds = {f.name: f.dataType.simpleString() for f in triggers.schema} | {"__ms": "bigint"}
    row = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def plain(v):
        return v.to_pydatetime() if isinstance(v, pd.Timestamp) else (v.item() if hasattr(v, "item") else v)

    def watch(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, told, later = None, False, None
        if state.exists:
            held = list(state.get)
            first, told = held[: len(columns)], held[len(columns)]
            later = held[len(columns) + 2 :] if held[len(columns) + 1] else None
        given = None
        if state.hasTimedOut:
            if told:
                first, told, later = later, False, None
            else:
                given, told = first, True
        for new in sorted((list(map(plain, r)) for c in chunks for r in c[columns].itertuples(index=False)), key=lambda r: r[at]) if not state.hasTimedOut else []:
            if first is None:
                first = new
            elif not told and new[at] < first[at]:
                if first[ms] > new[ms] + span and (later is None or first[at] < later[at]):
                    later = first
                first = new
            elif new[ms] > first[ms] + span and (later is None or new[at] < later[at]):
                later = new
        if first is None:
            state.remove()
            return
        state.update((*first, told, later is not None, *(later or first)))
        _timer(state, first[ms] + (span if told else 0))
        if given is not None:
            yield pd.DataFrame([[k[0], *given]], columns=[key, *columns])

    ordered = triggers.withColumn("__ms", F.unix_millis(ts)).select(key, *columns).filter(F.col(ts).isNotNull())
    out = ", ".join([f"`{key}` {kinds[key]}", row])
    next_row = ", ".join(f"`next_{c}` {kinds[c]}" for c in columns)
    return _keyed(ordered, key, ts, lateness, watch, out, f"{row}, told boolean, follows boolean, {next_row}").select(*triggers.columns)


def delivery_state(outcomes: DataFrame, horizon: str = "30 days", lateness: str = "1 hour") -> DataFrame:
    """(notification_id, failures, sent) after each batch that brings outcomes; forgotten ``horizon`` after the last one."""
    keep = seconds(horizon) * 1000
    kind = outcomes.schema["notification_id"].dataType.simpleString()

    def count(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, sent, last = state.get if state.exists else (0, 0, 0)
        for chunk in chunks:
            failures += int((chunk["outcome"] == "FAILED").sum())
            sent = max(sent, int((chunk["outcome"] == "SENT").any()))
            last = max(last, int(chunk["ms"].max()))
        state.update((failures, sent, last))
        _timer(state, last + keep)
        yield pd.DataFrame({"notification_id": [key[0]], "failures": [failures], "sent": [sent]})

    known = outcomes.select("notification_id", "outcome", "ts", F.unix_millis("ts").alias("ms")).filter(F.col("ts").isNotNull())
    return _keyed(known, "notification_id", "ts", lateness, count, f"notification_id {kind}, failures bigint, sent int", "failures bigint, sent int, last bigint")


def alert_versions(alerts: DataFrame, ts: str = "created_at") -> DataFrame:
    """(id, ms, due) of every version of an alert, both moments in milliseconds; ``due`` is null where that version waits for no end.

    An alert ends at ``expires_at`` or with the day of its departure, whichever comes first; one without either, or one that is
    not active, has no end to wait for.
    """
    due = F.least(F.col("expires_at").cast("timestamp"), F.date_add("departure_date", 1).cast("timestamp"))
    return alerts.filter(F.col(ts).isNotNull()).select(
        "id", F.col(ts).alias("at"), F.unix_millis(ts).alias("ms"), F.when(F.col("is_active"), F.unix_millis(due)).alias("due")
    )


def newest_versions(waiting: DataFrame | None, versions: DataFrame) -> DataFrame:
    """(id, ms, due) of alerts that wait for an end, after ``versions`` were read: the newest version of an alert counts, and among
    those of one moment the one that was read last.
    """
    fresh = versions.select("id", "ms", F.lit(1).alias("read"), "due")
    both = fresh if waiting is None else waiting.select("id", "ms", F.lit(0).alias("read"), "due").unionByName(fresh)
    newest = both.groupBy("id").agg(F.max(F.struct("ms", "read", "due")).alias("_n"))
    return newest.select("id", "_n.ms", "_n.due").filter(F.col("due").isNotNull())
