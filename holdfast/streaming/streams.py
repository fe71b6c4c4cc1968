"""Structured Streaming forms of the ingest steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from holdfast.config import SETTINGS, Settings
from holdfast.operators import quality as q
from holdfast.schemas import RAW_EVENT

LAG = "1 day"
SESSION_BUCKETS = 1024


def read_raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(RAW_EVENT).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


# ------------------------------------------------------------------- contract split, two sinks
def split_stream(raw: DataFrame, events_path: str, rejects_path: str, checkpoint: str,
                 dedupe: bool = True):
    """Land each micro-batch in `events` and `rejects`; returns the started query.

    A landed event id never lands twice: the batch is deduplicated, then anti-joined with the
    table (unbounded horizon). A batch replayed after a failure overwrites its own folder, so
    retries add nothing.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = q.check_contract(batch)
        checked.persist()
        try:
            good = q.keep_first(q.contract_survivors(checked).select(*q.EVENT_COLUMNS),
                                ["event_id"], ["customer_id", "ts", "event_id"])
            if dedupe:
                before = _earlier(spark, events_path, batch_id)
                if before is not None:
                    good = good.join(before.select("event_id"), "event_id", "left_anti")
            good.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
            q.contract_rejects(checked).drop("event_id").write.mode("overwrite").parquet(
                f"{rejects_path}/batch={batch_id}")
        finally:
            checked.unpersist()

    return (raw.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath):
        return None
    return spark.read.parquet(path).where(F.col("batch") < batch_id)


def dedupe_stream(events: DataFrame, lag: str = LAG) -> DataFrame:
    """Idempotent append within the watermark; state is bounded by the lag."""
    return events.withWatermark("ts", lag).dropDuplicatesWithinWatermark(["event_id"])


# ---------------------------------------------------------------------- session monotonicity
ORDER_SCHEMA = ("event_id string, customer_id string, session_id string, ts timestamp,"
                "accepted boolean, reason string")


def session_order_stream(events: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Flag events that do not advance their session, within and across micro-batches.

    State per session is one instant. It expires once the watermark passes it by the session
    span; a session that reappears behind the watermark is flagged. Spark's operator itself leaves
    out rows behind the watermark of the batch before.
    Sessions are many and short, so a call judges all of a hash bucket's as whole arrays, and the
    bucket's state lists its live sessions.
    """
    span_ms = settings.session_max_span_seconds * 1000
    none = np.iinfo("int64").min

    def judge(key: tuple, batches: Iterator[pd.DataFrame],
              state: GroupState) -> Iterator[pd.DataFrame]:
        now_ms = max(state.getCurrentWatermarkMs(), 0)
        held = {name: (last, until) for name, last, until in zip(
            *state.get)} if state.exists else {}
        seen = set()
        if not state.hasTimedOut:
            frame = pd.concat(list(batches), ignore_index=True)
            codes, found = pd.factorize(frame["session_id"], use_na_sentinel=False)
            names = [None if pd.isna(name) else name for name in found]
            frame = frame.assign(_code=codes).sort_values(["_code", "ts", "event_id"],
                                                          kind="stable")
            codes = frame["_code"].to_numpy()
            micros = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            last = np.array([held[n][0] if n in held else none for n in names])
            new = last[codes] == none
            behind = new & (micros < (now_ms - span_ms) * 1000)
            # sorted by instant, so only the first event of each instant can advance the session
            first = np.append(True, (micros[1:] != micros[:-1]) | (codes[1:] != codes[:-1]))
            fresh = first & ~behind & (new | (micros > last[codes]))
            np.maximum.at(last, codes[fresh], micros[fresh])
            seen = set(names)
            held.update({n: (t, max(t // 1000 + span_ms, now_ms + 1))
                         for n, t in zip(names, last.tolist()) if t != none})
            reason = np.where(fresh, None, np.where(
                behind, "session reappeared behind the watermark",
                "timestamp does not strictly advance"))
            yield frame.assign(accepted=fresh, reason=reason)[
                ["event_id", "customer_id", "session_id", "ts", "accepted", "reason"]]
        held = {n: v for n, v in held.items() if n in seen or v[1] >= now_ms}
        if held:
            state.update((list(held), [v[0] for v in held.values()],
                          [v[1] for v in held.values()]))
            state.setTimeoutTimestamp(max(min(v[1] for v in held.values()), now_ms + 1))
        elif state.exists:
            state.remove()

    bucket = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_BUCKETS)).alias("bucket")
    stream = events.select("event_id", "customer_id", "session_id", "ts", bucket)
    return stream.withWatermark("ts", LAG).groupBy("bucket").applyInPandasWithState(
        judge, ORDER_SCHEMA, "sessions array<string>, last_us array<long>, until_ms array<long>",
        "append", GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------------- fresh counters
def fatigue_stream(events: DataFrame, lag: str = LAG) -> DataFrame:
    """Messages per customer in sliding 14-day windows, one window per day."""
    messages = events.where(F.col("type").isin("campaign_exposure", "action_delivered"))
    return messages.withWatermark("ts", lag).groupBy(
        "customer_id", F.window("ts", "14 days", "1 day")).agg(
        F.count(F.lit(1)).alias("message_fatigue_count")).select(
        "customer_id", F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"), "message_fatigue_count")


# ---------------------------------------------------------------------------- reject alarm
def observed(checked: DataFrame, name: str = "ingest") -> DataFrame:
    """Attach per-micro-batch metrics: rows in and rows rejected."""
    return checked.observe(name, F.count(F.lit(1)).alias("rows_in"),
                           F.count_if(F.size("errors") > 0).alias("rows_rejected"))


def reject_alarm(progress: dict, settings: Settings = SETTINGS, name: str = "ingest") -> bool:
    """True when a micro-batch passed the reject-rate ceiling (from a query progress record)."""
    metrics = (progress.get("observedMetrics") or {}).get(name)
    if not metrics or not metrics["rows_in"]:
        return False
    return metrics["rows_rejected"] / metrics["rows_in"] > settings.max_reject_rate
