"""Structured Streaming versions of the stateful operators.

Input: the events table replayed as a file stream (``replay_events``): files of successive times, written one after the
other, so that one file a trigger is time order, and last an end mark, a heartbeat that moves the watermark past all
events so that nothing stays open.  Every stream has a batch twin in ``operators``; the tests hold them against it in
one and in many micro-batches.

* Z1, Z2, Z3 are one kind of state machine (``InTimeOrder``, transformWithState): rows of a key wait in a list state until the
  watermark has passed them - an event-time timer wakes the key - and are then taken in time order.  So results do not depend on
  how the rows were dealt to micro-batches or shuffled within the watermark's delay.  Z1 keeps the field's last 10 entries (list
  state), Z2 the observation kept for a cell until its TTL ends, Z3 the latest observation of a cell for the requests, in parts of 12 TTLs.
* Z4 request metrics per 5-minute window (tumbling) and 10-minute window sliding by 5, on Z3's output (hits of the cache).
* Z5 field work sessions: ``session_window`` with a 30-minute gap.
* Z6 incremental validation: good rows and quarantine, exactly once (``EpochSink``).

Rows without a time or key are left out: they have no place in the order.  Rows later than the watermark are dropped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import features as FX
from ..operators import timeops as TO
from ..operators import validate as V
from ..session import shared_path
from ..sources import dims
from ..sources import knowledge as K
from ..sources import proxies as P
from ..sources.tables import read_table

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("ts_us", T.LongType()),
])
HEARTBEAT = "heartbeat"
#: How late a row may come; far less than the replayed span and than the end mark's lead.
DELAY = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay_events(spark: SparkSession, sf_dir: str, name: str = "replay", parts: int = 1) -> str:
    """Write ``events`` as ``parts`` files of successive times, and an end mark, under the shared folder.

    The file source reads files in the order in which they were written; each part is a job of its own."""
    path = shared_path(spark, f"terroir-stream/{name}-{uuid.uuid4().hex}/{os.path.basename(sf_dir.rstrip('/'))}")
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    ev = ev.withColumn("ts_us", us).withColumn("ts", F.timestamp_micros("ts_us")).select(*EVENT_SCHEMA.names)
    span = ev.agg(F.min("ts_us"), F.max("ts_us")).first()
    low, high = span[0] or 0, (span[1] or 0) + 1
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    for i in range(parts):
        files = ev.filter(F.col("ts_us").between(cuts[i], cuts[i + 1] - 1))
        (files.coalesce(1) if parts > 1 else files).write.mode("append").parquet(path)
    end = high + 2 * 86_400_000_000
    mark = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(end)).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
                                 F.lit(HEARTBEAT).alias("event_type"), F.lit(0.0).alias("value"), F.lit(end).cast("long").alias("ts_us"))
    mark.write.mode("append").parquet(path)
    return path


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The replay as a stream, by default all of it in one trigger."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def timed(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """``events`` with a watermark that the heartbeat moves, too; the heartbeat itself goes."""
    # an alternative that names ts, so that no part of it is pushed below the watermark, which would then not see the heartbeat
    real = (F.coalesce(F.col("event_type"), F.lit("")) != HEARTBEAT) | (F.col("ts") < F.timestamp_micros(F.lit(-(1 << 55))))
    return events.withWatermark("ts", delay).filter(F.col("ts").isNotNull() & real)


# --- rows of a key in time order ------------------------------------------------------------------
class InTimeOrder(StatefulProcessor):
    """Rows wait until the watermark has passed them; ``step(rows)`` gets them in the order of ``place(row)``."""

    def __init__(self, row_schema: T.StructType) -> None:
        self.row_schema = row_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further states."""

    def place(self, row: Row) -> tuple:
        return (row.ts_us, row.event_id)

    def step(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        raise NotImplementedError

    def close_before(self, watermark_us: int) -> int | None:
        """What ends with time; the time in microseconds at which to wake again."""
        return None

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new, first, take = [], None, None
        for row in rows:
            take = take or itemgetter(*[row.__fields__.index(n) for n in self.row_schema.names])
            if row.ts_us > passed:
                new.append(take(row))
                first = row.ts_us if first is None else min(first, row.ts_us)
        if new:
            self.waiting.appendList(new)
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        make = Row(*self.row_schema.names)
        rows = [make(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r.ts_us <= passed), key=self.place)
        later = [r for r in rows if r.ts_us > passed]
        if due:
            self.waiting.put([tuple(r) for r in later]) if later else self.waiting.clear()
            yield from self.step(key, due)
        again = [t for t in (self.close_before(passed), min((r.ts_us for r in later), default=None)) if t is not None]
        if again:
            self._wake(max(min(again), passed + 1000))

    def close(self) -> None:
        pass


def _in_time_order(rows: DataFrame, key: str | list[str], machine: InTimeOrder, out: T.StructType) -> DataFrame:
    """The state lives in RocksDB: transformWithState has no other store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(key).transformWithState(machine, out, "Append", "EventTime", eventTimeColumnName="ts")


# --- Z1 -------------------------------------------------------------------------------------------
def _telemetry(events: DataFrame) -> DataFrame:
    """The readings of ``proxies.telemetry``, of a stream."""
    return P.telemetry_of(events)


ENTRY = T.StructType([T.StructField("ts_us", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("temperature", T.DoubleType()),
                      T.StructField("humidity", T.DoubleType()), T.StructField("rainfall", T.DoubleType()), T.StructField("deficiency", T.StringType())])


class History(InTimeOrder):
    """The field's last entries; each row goes out with those up to it."""

    def __init__(self) -> None:
        super().__init__(T.StructType([*ENTRY.fields, T.StructField("ts", T.TimestampType())]))

    def open(self, handle):
        self.history = handle.getListState("history", ENTRY)

    def step(self, key, rows):
        entry, reading = Row(*ENTRY.names), Row("field_id", "event_id", "ts", "history")
        last = [entry(*r) for r in self.history.get()] if self.history.exists() else []
        for row in rows:
            last = [*last[1 - K.HISTORY_CAPACITY:], entry(*row[:len(ENTRY.names)])]     # a row begins with its entry
            yield reading(key[0], row.event_id, row.ts, last)
        self.history.put([tuple(e) for e in last])


def session_memory_stream(events: DataFrame) -> DataFrame:
    """History, drift and recurring deficiencies per reading; twin of W1/W3/W4, whose expressions it shares."""
    out = T.StructType([T.StructField("field_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                        T.StructField("history", T.ArrayType(ENTRY))])
    rows = _telemetry(timed(events)).filter("field_id is not null").select("field_id", *ENTRY.names, "ts")
    h = _in_time_order(rows, "field_id", History(), out)
    d = TO.drift(F.col("history"))
    return h.select("field_id", "event_id", "ts", F.size("history").alias("hist_len"), F.col("history")[0]["event_id"].alias("first_event"), d["temp_drift"].alias("temp_drift"),
                    d["drought_trend"].alias("drought_trend"), d["rainfall_trend"].alias("rainfall_trend"),
                    F.array_join(TO.recurring_deficiencies(F.col("history")), ",").alias("recurring"))


# --- Z2 / Z3 --------------------------------------------------------------------------------------
LOCATED = T.StructType([T.StructField("ts_us", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("is_request", T.BooleanType()),
                        T.StructField("is_error", T.BooleanType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("predicted_crop", T.StringType()),
                        T.StructField("ts", T.TimestampType())])


def _located(events: DataFrame, *kinds: str) -> DataFrame:
    """Observations (``view``) and requests (``purchase``, ``error``) with their grid cell, under the watermark."""
    # kinds are chosen before the watermark, with the heartbeat among them: a later filter would be pushed there and lose it
    some = events.filter(F.col("event_type").isin(*kinds, HEARTBEAT))
    crop = dims.crop_name(((F.col("user_id") * 3 + F.col("event_id")) % 22).cast("int"))
    rows = P.location_of(some).select(FX.grid_key().alias("cell"), "ts_us", "event_id", (F.col("event_type") != "view").alias("is_request"),
                                      (F.col("event_type") == "error").alias("is_error"), F.col("value").alias("latency_ms"), crop.alias("predicted_crop"), "ts", "event_type")
    return timed(rows.filter("cell is not null")).drop("event_type")


class KeptForTtl(InTimeOrder):
    """The first row of a key is kept and answers for the others until it is older than the TTL."""

    def __init__(self, ttl_us: int) -> None:
        super().__init__(LOCATED)
        self.ttl_us = ttl_us

    def open(self, handle):
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("ts_us", T.LongType())]))

    def step(self, key, rows):
        kept = self.kept.get()[0] if self.kept.exists() else None
        for row in rows:
            if kept is None or row.ts_us - kept > self.ttl_us:
                kept = row.ts_us
                yield Row(cell=key[0], event_id=row.event_id, ts=row.ts)
        self.kept.update((kept,))

    def close_before(self, watermark_us):
        if not self.kept.exists():
            return None
        ends = self.kept.get()[0] + self.ttl_us
        if ends < watermark_us:     # the next row is later and kept in any case
            self.kept.clear()
            return None
        return ends + 1000


def cell_dedup_stream(events: DataFrame, ttl_us: int = TO.TTL_US) -> DataFrame:
    """The observations that a TTL cache of grid cells takes in: the earliest, then the first one older than the TTL, ..."""
    out = T.StructType([T.StructField("cell", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType())])
    return _in_time_order(_located(events, "view"), "cell", KeptForTtl(ttl_us), out)


class LatestObservation(InTimeOrder):
    """Each request with the latest observation of its cell, if that is at most the TTL old; ties take the largest id."""

    def __init__(self, ttl_us: int) -> None:
        super().__init__(LOCATED)
        self.ttl_us = ttl_us

    def open(self, handle):
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("ts_us", T.LongType()), T.StructField("obs_id", T.LongType())]))

    def place(self, row):
        return (row.ts_us, row.is_request, row.event_id)

    def step(self, key, rows):
        latest = before = tuple(self.latest.get()) if self.latest.exists() else None
        for row in rows:
            if not row.is_request:
                latest = (row.ts_us, row.event_id)
                continue
            fresh = latest is not None and row.ts_us - latest[0] <= self.ttl_us
            yield Row(req_id=row.event_id, ts=row.ts, cell=key[0], is_error=row.is_error, latency_ms=row.latency_ms, predicted_crop=row.predicted_crop,
                      obs_id=latest[1] if fresh else None)
        if latest != before:
            self.latest.update(latest)

    def close_before(self, watermark_us):
        if not self.latest.exists():
            return None
        ends = self.latest.get()[0] + self.ttl_us
        if ends < watermark_us:
            self.latest.clear()
            return None
        return ends + 1000


#: Length of a part of a cell's time, in TTLs.
PART_TTLS = 12


def _in_parts(rows: DataFrame, ttl_us: int) -> DataFrame:
    """``rows`` with the ``part`` (its start) of their time; observations of a part's last TTL are in the next part, too.

    A request meets only observations of its own part then, so a key holds the rows of a short time, however many come in a
    micro-batch, and few cells make many keys."""
    span = F.lit(PART_TTLS * ttl_us).cast("long")
    at = F.pmod("ts_us", span)
    own = F.col("ts_us") - at
    both = ~F.col("is_request") & (at >= span - F.lit(ttl_us))
    return rows.select("*", F.explode(F.when(both, F.array(own, own + span)).otherwise(F.array(own))).alias("part"))


def weather_join_stream(events: DataFrame, ttl_us: int = TO.TTL_US) -> DataFrame:
    """Z3: every request once, with its cell's latest observation or none; twin of J12."""
    out = T.StructType([T.StructField("req_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("cell", T.StringType()),
                        T.StructField("is_error", T.BooleanType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("predicted_crop", T.StringType()),
                        T.StructField("obs_id", T.LongType())])
    return _in_time_order(_in_parts(_located(events, "view", "purchase", "error"), ttl_us), ["cell", "part"], LatestObservation(ttl_us), out)


# --- Z4 / Z5 --------------------------------------------------------------------------------------
def _mean(c: str) -> Column:
    """The mean from an exact decimal sum (12 places), so that it does not depend on the order of the rows; of numbers beyond 1e16 or NaN, ``avg``."""
    exact = F.col(c).try_cast("decimal(28,12)")
    return F.when(F.count(exact) < F.count(c), F.avg(c)).otherwise(F.sum(exact).cast("double") / F.nullif(F.count(c), F.lit(0)))


def metrics(served: DataFrame, sliding: bool = False) -> DataFrame:
    """Z4 on served requests, batch or stream: counts, error rate, mean latency, cache-hit ratio and counts per predicted class."""
    win = F.window("ts", "10 minutes", "5 minutes") if sliding else F.window("ts", "5 minutes")
    counts = [F.count_if((F.col("predicted_crop") == c) & ~F.col("is_error")).alias(f"n{i}") for i, c in enumerate(K.CROP_CLASSES)]
    g = served.groupBy(win.alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"), _mean("latency_ms").alias("mean_latency"),
                                           F.count("obs_id").alias("hits"), *counts)
    pairs = F.array(*[F.struct(F.lit(c).alias("crop"), F.col(f"n{i}").alias("n")) for i, c in enumerate(K.CROP_CLASSES)])
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "errors",
                    F.round(F.col("errors") / F.col("requests") * 100.0, 2).alias("error_rate_percent"), "mean_latency",
                    F.round(F.col("hits") / F.col("requests"), 2).alias("cache_hit_ratio"), F.filter(pairs, lambda p: p["n"] > 0).alias("predictions"))


def metrics_stream(events: DataFrame, sliding: bool = False) -> DataFrame:
    """The metrics of Z3's requests, each window when the watermark has passed it."""
    return metrics(weather_join_stream(events), sliding)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Z5, batch or stream: field work sessions - a session ends after ``gap`` without readings."""
    return events.filter("user_id is not null").groupBy(F.col("user_id").alias("field_id"), F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("readings")).select("field_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "readings")


def sessions_stream(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return sessions(timed(events), gap)


# --- Z6 -------------------------------------------------------------------------------------------
class EpochSink:
    """P5-valid rows and the quarantine, exactly once.

    An epoch of a run is written to its own folder (a replay overwrites it) and counts once its manifest entry
    is there.  A run is what one checkpoint stands for.  Readers follow the manifest: the epochs of the run that
    finished last, or, if none has, of the one that began last."""

    TABLES = ("good", "quarantine")

    def __init__(self, spark: SparkSession, base: str, run: str) -> None:
        self.spark, self.base, self.run = spark, base.rstrip("/"), run

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        checked = V.row_errors(batch)
        for table, rows in (("good", checked.filter("valid").drop("errors", "valid")), ("quarantine", checked.filter(~F.col("valid")))):
            rows.write.mode("overwrite").parquet(f"{self.base}/{table}/{self.run}/{epoch}")
        self._note("epoch", epoch)

    def finish(self) -> None:
        self._note("finished", -1)

    def _note(self, kind: str, epoch: int) -> None:
        entry = self.spark.range(1).select(F.lit(self.run).alias("run"), F.lit(kind).alias("kind"), F.lit(epoch).cast("long").alias("epoch"), F.current_timestamp().alias("at"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/{self.run}-{kind}-{epoch}")

    @classmethod
    def read(cls, spark: SparkSession, base: str, table: str) -> DataFrame:
        base = base.rstrip("/")
        noted = spark.read.parquet(f"{base}/manifest/*").groupBy("run").agg(      # one row for each run
            F.max(F.when(F.col("kind") == "finished", F.col("at"))).alias("finished"), F.min("at").alias("began"),
            F.collect_set(F.when(F.col("kind") == "epoch", F.col("epoch"))).alias("epochs"))
        last = noted.orderBy(F.col("finished").desc_nulls_last(), F.col("began").desc()).first()
        return spark.read.parquet(*[f"{base}/{table}/{last['run']}/{e}" for e in sorted(last["epochs"])])


def validation_input(events: DataFrame) -> DataFrame:
    """Stream of field records to validate (temperature outside bounds for some events)."""
    eid = F.col("event_id")
    return events.filter(F.col("event_type") != HEARTBEAT).select("event_id", (F.col("value") / F.lit(5.0) - F.lit(20.0)).alias("temperature"),
                                                                  ((eid * 7) % 120).cast("double").alias("humidity"), ((eid * 11) % 220).cast("double").alias("N"))


def run_to_completion(df: DataFrame, name: str, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a streaming query over all available input into a Parquet table; return it as a batch frame."""
    run = uuid.uuid4().hex  # a run reads its own replay: nothing of an earlier run is read again
    out = shared_path(spark, f"terroir-stream/out/{name}-{run}")
    ckpt = shared_path(spark, f"terroir-stream/ckpt/{name}-{run}")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_into_sink(df: DataFrame, spark: SparkSession, base: str, run: str | None = None) -> None:
    """Run a streaming query over all available input into the ``EpochSink`` of ``base``."""
    run = run or uuid.uuid4().hex
    sink = EpochSink(spark, base, run)
    ckpt = f"{base.rstrip('/')}/checkpoints/{run}"
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    sink.finish()
