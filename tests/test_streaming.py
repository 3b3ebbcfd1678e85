"""Streams against their batch twins, row by row, in one and in many micro-batches."""

from collections import defaultdict

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from terroir.functions import features as FX
from terroir.operators import timeops as TO
from terroir.session import shared_path
from terroir.sources import proxies as P
from terroir.streaming import streams as Z


@pytest.fixture(scope="module", params=[(1, None), (4, 1)], ids=["one batch", "many batches"])
def events(request, spark):
    parts, files = request.param
    path = Z.replay_events(spark, SMALL, f"test{parts}", parts)
    return lambda: Z.event_stream(spark, path, files)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """A state store for each partition: two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return sorted(map(str, df.collect()))


def test_session_memory_is_w1_w3_w4(spark, events):
    out = Z.run_to_completion(Z.session_memory_stream(events()), "test_z1", spark)
    h = TO.session_history(P.telemetry(spark, SMALL))
    d = TO.drift(F.col("history"))
    twin = h.select("event_id", F.size("history").alias("hist_len"), F.col("history")[0]["event_id"].alias("first_event"), d["temp_drift"].alias("temp_drift"),
                    d["rainfall_trend"].alias("rainfall_trend"), F.array_join(TO.recurring_deficiencies(F.col("history")), ",").alias("recurring"))
    assert rows(out.select(*twin.columns)) == rows(twin)


def test_cell_dedup_keeps_the_earliest_per_ttl(spark, events):
    out = Z.run_to_completion(Z.cell_dedup_stream(events()), "test_z2", spark)
    cells = defaultdict(list)
    for r in P.observations(spark, SMALL).select(FX.grid_key().alias("cell"), "ts_us", "obs_id").orderBy("ts_us", "obs_id").collect():
        if not cells[r.cell] or r.ts_us - cells[r.cell][-1][0] > TO.TTL_US:
            cells[r.cell].append((r.ts_us, r.obs_id))
    assert sorted(r.event_id for r in out.collect()) == sorted(i for c in cells.values() for _, i in c)


def test_weather_join_is_j12_and_metrics_are_those_of_a_batch(spark, events):
    out = Z.run_to_completion(Z.weather_join_stream(events()), "test_z3", spark)
    twin = TO.asof_weather(P.requests(spark, SMALL), P.observations(spark, SMALL)).withColumn("obs_id", F.col("obs.obs_id"))
    names = ["req_id", "cell", "obs_id", "is_error", "latency_ms", "predicted_crop", "ts"]
    assert rows(out.select(*names)) == rows(twin.select(*names))
    assert 0 < out.filter("obs_id is not null").count() < out.count()
    for sliding in (False, True):
        assert rows(Z.run_to_completion(Z.metrics_stream(events(), sliding), "test_z4", spark)) == rows(Z.metrics(twin, sliding))


def test_sessions_are_those_of_a_batch(spark, events):
    out = Z.run_to_completion(Z.sessions_stream(events()), "test_z5", spark)
    assert rows(out) == rows(Z.sessions(P.telemetry(spark, SMALL).withColumn("user_id", F.col("field_id"))))


def test_late_and_shuffled_rows(spark):
    """Rows within the delay may come in any order; a row behind the watermark is dropped."""
    path = shared_path(spark, "test-late")
    minute = 60_000_000
    base = 1_700_000_000_000_000

    def write(batch):
        spark.createDataFrame([(i, base + m * minute, 5, kind, 1.0) for i, m, kind in batch], "event_id long, ts_us long, user_id long, event_type string, value double").select(
            "event_id", F.timestamp_micros("ts_us").alias("ts"), "user_id", "event_type", "value", "ts_us").coalesce(1).write.mode("append").parquet(path)

    write([(4, 8, "purchase"), (0, 1, "view")])
    write([(8, 5, "view"), (12, 12, "purchase")])                  # the view of minute 5 comes after the request of minute 8
    write([(16, 60, "view"), (-1, 3000, Z.HEARTBEAT)])
    write([(20, 70, "purchase")])                                 # behind the watermark by then
    out = Z.run_to_completion(Z.weather_join_stream(Z.event_stream(spark, path, 1)), "test_late", spark)
    assert {r.req_id: r.obs_id for r in out.collect()} == {4: 8, 12: 8}


def test_quarantine_is_written_once(spark):
    """A replayed epoch and a second run leave the counts as they are."""
    base = shared_path(spark, "test-z06")
    path = Z.replay_events(spark, SMALL, "test_z6", 3)

    def counts():
        return [Z.EpochSink.read(spark, base, t).count() for t in Z.EpochSink.TABLES]

    Z.run_into_sink(Z.validation_input(Z.event_stream(spark, path, 1)), spark, base, "first")
    want = counts()
    assert sum(want) == P._events(spark, SMALL).count() and min(want) > 0
    bad = Z.EpochSink.read(spark, base, "quarantine")
    assert bad.filter(F.size("errors") == 0).count() == 0
    # an epoch again: what was written before its checkpoint was committed
    batch = Z.validation_input(spark.read.parquet(path).orderBy("ts_us").limit(5))
    sink = Z.EpochSink(spark, base, "first")
    sink(batch, 7)
    once = counts()
    sink(batch, 7)
    assert counts() == once and sum(once) == sum(want) + 5
    # files without a manifest entry are not read
    spark.range(9).write.parquet(f"{base}/good/first/99")
    assert counts() == once
    # the same checkpoint has nothing new, another run replaces the first
    Z.run_into_sink(Z.validation_input(Z.event_stream(spark, path, 1)), spark, base, "first")
    assert counts() == once
    Z.run_into_sink(Z.validation_input(Z.event_stream(spark, path, None)), spark, base, "second")
    assert counts() == want


def test_a_key_of_the_weather_join_holds_a_short_time(spark):
    """a key is a cell's part of time, and a request still meets every observation of its TTL."""
    ttl = 1000
    span = Z.PART_TTLS * ttl
    times = [-span, -1, 0, 1, ttl, span - ttl - 1, span - ttl, span - 1, span, span + 1, span + ttl, 3 * span - 1, 3 * span]
    rows = spark.createDataFrame([("c", t, 2 * i + r, bool(r)) for i, t in enumerate(times) for r in (0, 1)], "cell string, ts_us long, event_id long, is_request boolean")
    keys = defaultdict(list)
    for r in Z._in_parts(rows, ttl).collect():
        keys[r.cell, r.part].append(r)
    assert all(max(r.ts_us for r in k) - min(r.ts_us for r in k) < span + ttl for k in keys.values())
    asked = [(k, r) for k, rs in keys.items() for r in rs if r.is_request]
    assert sorted(r.event_id for _, r in asked) == [2 * i + 1 for i in range(len(times))]     # once
    for k, r in asked:
        assert {o.ts_us for o in keys[k] if not o.is_request and 0 <= r.ts_us - o.ts_us <= ttl} == {t for t in times if 0 <= r.ts_us - t <= ttl}
    out = Z.weather_join_stream(Z.event_stream(spark, Z.replay_events(spark, SMALL, "test_parts"), None))
    assert "part" in out._jdf.queryExecution().analyzed().toString()
