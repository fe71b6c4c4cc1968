from datetime import datetime, timedelta

from pyspark.sql import functions as F

from holdfast.operators import features as ft
from holdfast.operators import quality as q
from holdfast.sources import fixtures
from holdfast.streaming import streams as st
from tests.conftest import ROOT


def raw_folder(spark, tmp_path, parts=3):
    path = str(tmp_path / "raw")
    fixtures.raw_events(spark, ROOT).repartition(parts).write.parquet(path)
    return path


def test_split_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    path = raw_folder(spark, tmp_path)
    ev, rej, cp = (str(tmp_path / n) for n in ("events", "rejects", "cp"))
    for checkpoint in (cp, cp + "2"):  # a second full run re-reads every file
        if checkpoint != cp:
            ev2 = str(tmp_path / "events2")
            st.split_stream(st.read_raw_stream(spark, path), ev2, rej + "2", checkpoint
                            ).awaitTermination()
            got = spark.read.parquet(ev2)
        else:
            st.split_stream(st.read_raw_stream(spark, path), ev, rej, checkpoint
                            ).awaitTermination()
            got = spark.read.parquet(ev)
        checked = q.check_contract(spark.read.schema(st.RAW_EVENT).parquet(path))
        want = q.contract_survivors(checked).select("event_id").distinct()
        assert got.count() == got.select("event_id").distinct().count() == want.count()
    assert spark.read.parquet(rej).select("reject_id").distinct().count() == q.contract_rejects(
        checked).select("reject_id").distinct().count()


def run_memory(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
        return df.sparkSession.table(name), query.lastProgress
    finally:
        query.stop()


def typed_stream(spark, rows, tmp_path, schema, name):
    path = str(tmp_path / name)
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_session_order_across_micro_batches(spark, tmp_path):
    t = datetime(2024, 1, 5)
    schema = "event_id string, customer_id string, session_id string, ts timestamp"
    s = lambda m: t + timedelta(minutes=m)
    batches = [[("a", "c", "s1", s(0)), ("b", "c", "s1", s(1)), ("c", "c", "s2", s(0))],
               [("d", "c", "s1", s(1)), ("e", "c", "s1", s(2)), ("f", "c", "s2", s(5))]]
    out, _ = run_memory(st.session_order_stream(
        typed_stream(spark, batches, tmp_path, schema, "order")), "session_order")
    got = {r.event_id: r.accepted for r in out.collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": True, "f": True}


def test_one_very_long_session_and_forgotten_ones(spark, tmp_path):
    path = str(tmp_path / "long")
    at = lambda x: (F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(
        secs=x)).alias("ts")
    rows = lambda n, name, sec: spark.range(n).select(
        F.concat(F.lit(name), F.format_string("%06d", "id")).alias("event_id"),
        F.lit("c").alias("customer_id"), F.lit(name[0]).alias("session_id"), at(sec))
    # two events each second, three files; then the same seconds again and one more
    rows(100_000, "s-a", F.floor(F.col("id") / 2)).repartition(3).write.parquet(path)
    rows(10, "s-b", F.col("id") + 49_995).repartition(3).write.mode("append").parquet(path)
    rows(3, "x", F.lit(9_000_000)).repartition(3).write.mode("append").parquet(path)
    rows(3, "t-c", F.col("id")).repartition(3).write.mode("append").parquet(path)
    schema = "event_id string, customer_id string, session_id string, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(path)
    out, _ = run_memory(st.session_order_stream(stream), "long_session")
    counts = {(r[0], r[1], r[2]): r[3] for r in out.groupBy(
        F.substring("event_id", 1, 3), "accepted", "reason").count().collect()}
    late, old = "timestamp does not strictly advance", "session reappeared behind the watermark"
    assert counts["s-a", True, None] == counts["s-a", False, late] == 50_000
    assert counts["s-b", True, None] == counts["s-b", False, late] == 5
    assert counts["t-c", False, old] == 3


def test_many_sessions_share_few_state_rows(spark, tmp_path):
    """20,000 sessions, twice: nothing of the second file advances; expired ones are forgotten."""
    path = str(tmp_path / "many")
    rows = lambda n, name, hour: spark.range(n).select(
        F.concat(F.lit(name), F.col("id").cast("string")).alias("event_id"),
        F.lit("c").alias("customer_id"),
        F.when(F.col("id") > 0, F.col("id").cast("string")).alias("session_id"),
        (F.lit("2024-01-05").cast("timestamp") + F.make_interval(hours=F.lit(hour))).alias("ts"))
    # the batch after the one that moves the watermark finds the old sessions without events
    for n, name, hour in ((20_000, "a", 0), (20_000, "b", 0), (1, "c", 2_000), (1, "e", 2_001)):
        rows(n, name, hour).coalesce(1).write.mode("append").parquet(path)
    schema = "event_id string, customer_id string, session_id string, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = st.session_order_stream(stream).writeStream.format("memory").queryName(
        "many_sessions").outputMode("append").start()
    try:
        query.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress
                if p["stateOperators"]]
    finally:
        query.stop()
    out = spark.table("many_sessions").groupBy(F.substring("event_id", 1, 1), "accepted").count()
    counts = {(r[0], r[1]): r[2] for r in out.collect()}
    assert counts == {("a", True): 20_000, ("b", False): 20_000, ("c", True): 1,
                      ("e", True): 1}
    assert max(held) <= st.SESSION_BUCKETS and held[-1] == 1


def test_dedupe_within_watermark(spark, tmp_path):
    t = datetime(2024, 1, 5)
    schema = "event_id string, ts timestamp"
    batches = [[("a", t), ("b", t), ("a", t)], [("a", t), ("c", t)]]
    out, _ = run_memory(st.dedupe_stream(
        typed_stream(spark, batches, tmp_path, schema, "dupes")), "deduped")
    assert sorted(r.event_id for r in out.collect()) == ["a", "b", "c"]


def test_fatigue_windows_match_batch(spark, ws, tmp_path):
    path = str(tmp_path / "log")
    cols = ["customer_id", "type", "ts"]
    early = ws.events.select(*cols)
    flush = early.limit(1).withColumn("ts", F.lit("2025-01-01").cast("timestamp")).withColumn(
        "type", F.lit("campaign_exposure"))
    early.coalesce(1).write.parquet(path)
    flush.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(early.schema).parquet(path)
    out, _ = run_memory(st.fatigue_stream(stream, "0 seconds"), "fatigue")
    grid = ft.feature_grid(ws.events).where("day between 14 and 30").select(
        "customer_id", F.col("as_of_ts").alias("window_end"), "message_fatigue_count")
    joined = out.join(grid.withColumnRenamed("message_fatigue_count", "want"),
                      ["customer_id", "window_end"])
    assert joined.count() > 0
    assert joined.where("message_fatigue_count <> want").count() == 0


def test_reject_alarm(spark, tmp_path):
    path = raw_folder(spark, tmp_path, 1)
    watched = st.observed(q.check_contract(st.read_raw_stream(spark, path))).select("event_id")
    _, progress = run_memory(watched, "alarm")
    record = {"observedMetrics": {"ingest": {"rows_in": 100, "rows_rejected": 1}}}
    assert st.reject_alarm(record)
    record["observedMetrics"]["ingest"]["rows_rejected"] = 0
    assert not st.reject_alarm(record)
    assert progress is not None
