"""Structured Streaming forms of the incremental needs: resumable ingestion, windows, spells, lock-outs, upserts.

Each function builds a streaming DataFrame or starts a query that stops when its input is read (availableNow), with its checkpoint beside its
output, so a rerun goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

c = F.col
#: Microseconds.
HOUR = 3_600_000_000
#: A row that waits; from PACKED rows at once on they are kept as blocks of up to BLOCK.
ROW = np.dtype([("ts", np.int64), ("event_id", np.int64), ("value", np.float64)])
PACKED, BLOCK = 1000, 1 << 15
#: Rows of a block of an interval join, and rows that a task sorts at once to cut blocks.
PAIR_BLOCK, HELD = 8192, 1 << 18
#: Pairs of blocks go to files of so many rows: Spark decodes up to 4,096 rows of a file at once, which would be 1 GB a task.
PAIRS_APART = {"maxRecordsPerFile": "64"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def events(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 100) -> DataFrame:
    """A folder's event files as a stream: sensor, stream, ts, value, event_id."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.select("event_id", c("user_id").alias("sensor"), c("event_type").alias("stream"), c("ts").cast("timestamp").alias("ts"), "value")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB, outside the heap; several state variables a key need it."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run(df: DataFrame, path: str, mode: str = "append", options: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream to its end into Parquet under path, written with the options, and returns what has been written."""
    with rocksdb(df.sparkSession):
        q = df.writeStream.outputMode(mode).format("parquet").options(**(options or {})).option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def daily(df: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling sums and means; rows later than the watermark are dropped."""
    g = df.withWatermark("ts", late).groupBy(F.window("ts", width), "stream").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return g.select(c("window.start").alias("start"), "stream", "n", "mean", "peak")


def trailing(df: DataFrame, width: str = "12 hours", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = df.withWatermark("ts", late).groupBy(F.window("ts", width, step), "stream").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(c("window.start").alias("start"), c("window.end").alias("end"), "stream", "n", "total")


def spells(df: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Spells end when nothing comes for a gap."""
    g = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "stream").agg(F.count("*").alias("n"))
    return g.select(c("session_window.start").alias("start"), c("session_window.end").alias("end"), "stream", "n")


def once(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _packed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (slot, ts, ...), sorted and cut to blocks of one slot and at most size rows: slot, at (the last ts) and a list of each other column."""

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([("slot", "ascending"), ("ts", "ascending")]).combine_chunks()
        slot = t["slot"].to_numpy()
        starts = np.flatnonzero(np.diff(slot, prepend=slot[0] - 1))
        cuts = np.concatenate([np.arange(a, b, size) for a, b in zip(starts, [*starts[1:], len(slot)])])
        ends = np.append(cuts[1:], len(slot))
        names = [n for n in t.column_names if n not in ("slot", "ts")]
        edges = pa.array(np.append(cuts, len(slot)), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, t[n].combine_chunks()) for n in names]
        return pa.RecordBatch.from_arrays([t["slot"].take(cuts).combine_chunks(), t["ts"].take(ends - 1).combine_chunks(), *lists], names=["slot", "at", *names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return pack


def blocks_in_interval(scenes: DataFrame, weather: DataFrame, hours: int = 12, late: str = "1 hour", size: int = PAIR_BLOCK) -> DataFrame:
    """Blocks of scenes with blocks of weather rows of which some may lie in the hours before them; pairs() makes the pairs.

    Pairs grow with the square of the rows an hour, pairs of blocks are fewer by the square of the block's size, so they are what a stream joins and writes. Time is
    cut into slots of a sixth of the hours, for streams join by equality; a block of scenes looks in seven slots. A block is a list of each column, in order of time (microseconds), and late when all its rows are.
    """
    width = hours * 600

    def blocks(df: DataFrame, ids: str, times: str, *values: Column) -> DataFrame:
        us = F.unix_micros("ts")
        rows = df.where("ts IS NOT NULL").select(F.floor(us / (width * 1_000_000)).alias("slot"), "ts", us.alias(times), c("event_id").alias(ids), *values)
        slot, ts, *kept = rows.schema.fields
        schema = T.StructType([slot, T.StructField("at", ts.dataType), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in kept]])
        return rows.repartition("slot").mapInArrow(_packed(size), schema).withWatermark("at", late)

    s = blocks(scenes, "scenes", "scene_times").select(c("at").alias("scene_at"), "scenes", "scene_times", F.explode(F.sequence(c("slot") - 6, c("slot"))).alias("slot"))
    w = blocks(weather, "weathers", "weather_times", c("value").alias("values")).withColumnsRenamed({"at": "weather_at", "slot": "weather_slot"})
    # what the last times of two blocks with a pair fulfil; by it the state goes
    near = f"slot = weather_slot AND weather_at > scene_at - INTERVAL {hours * 3600 + width} SECONDS AND weather_at < scene_at + INTERVAL {width} SECONDS"
    return s.join(w, F.expr(near)).select("scenes", "scene_times", "weathers", "weather_times", "values")


def pairs(blocks: DataFrame, hours: int = 12) -> DataFrame:
    """The pairs of blocks_in_interval: scene, scene_ts, weather, weather_ts, value.

    Five of the seven slots of a block of scenes lie within the hours of every scene, so the pairs of two blocks there need no times: checked is null for them.
    transform isn't compiled, so Spark hands the scenes on one by one and a task holds the pairs of one scene and one block; two plain explodes would be compiled to one loop that holds those of two blocks.
    """
    first, last = (lambda name: F.element_at(name, 1)), (lambda name: F.element_at(name, -1))
    whole = (last("weather_times") <= first("scene_times")) & (first("weather_times") > last("scene_times") - hours * HOUR)
    s = F.transform(F.arrays_zip("scenes", "scene_times"), lambda x: F.struct(x["scenes"].alias("scene"), x["scene_times"].alias("at"), (x["scene_times"] - hours * HOUR).alias("from")))
    met = blocks.withColumn("checked", F.when(~whole, c("weather_times"))).select(F.explode(s).alias("s"), "checked", "weathers", "weather_times", "values")
    s = met.select("s.scene", "s.at", "s.from", "checked", "weathers", "weather_times", "values").where(c("checked").isNull() | (first("checked") <= c("at")) & (last("checked") > c("from")))
    met = s.select("*", F.posexplode("weathers").alias("k", "weather")).where("checked IS NULL OR checked[k] > from AND checked[k] <= at")
    return met.select("scene", F.timestamp_micros("at").alias("scene_ts"), "weather", F.timestamp_micros(c("weather_times")[c("k")]).alias("weather_ts"), c("values")[c("k")].alias("value"))


def in_interval(scenes: DataFrame, weather: DataFrame, hours: int = 12, late: str = "1 hour") -> DataFrame:
    """Scenes with the weather rows of the hours before them."""
    return pairs(blocks_in_interval(scenes, weather, hours, late), hours)


class _Ordered(StatefulProcessor):
    """Rows of a key in the order of (ts, event_id), however they arrive within the watermark.

    Rows that the watermark hasn't passed are appended to a list and touched again only when the timer of the oldest goes off: then judge(key, rows, memory) ->
    (result, memory) sees those that are passed, and the others wait on. Many rows at once wait as blocks of bytes, for a list's items are handed over one by one. The memory is a value of its own. It goes once it can't matter any more, at the
    event time that until(memory) names, or after idle microseconds without rows.
    """

    def __init__(self, judge: Callable, until: Callable, start: tuple, kinds: str, idle: int | None) -> None:
        self.judge, self.until, self.start, self.kinds, self.idle = judge, until, start, kinds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, value double")
        self.blocks = handle.getListState("blocks", "rows binary")
        self.memory = handle.getValueState("memory", f"{self.kinds}, seen long")

    def _keep(self, rows: pd.DataFrame) -> None:
        """Appends rows to those that wait."""
        if len(rows) < PACKED or rows["event_id"].dtype != np.int64:
            self.waiting.appendList(list(rows[["ts", "event_id", "value"]].itertuples(index=False, name=None)))
            return
        packed = np.empty(len(rows), dtype=ROW)
        for name in ROW.names:
            packed[name] = rows[name].to_numpy()
        self.blocks.appendList([(packed[lo : lo + BLOCK].tobytes(),) for lo in range(0, len(packed), BLOCK)])

    def _kept(self) -> pd.DataFrame:
        """All rows that wait."""
        rows = pd.DataFrame(list(self.waiting.get()), columns=list(ROW.names))
        blocks = [np.frombuffer(bytes(b[0]), dtype=ROW) for b in self.blocks.get()]
        if not blocks:
            return rows
        whole = np.concatenate(blocks)
        packed = pd.DataFrame({name: whole[name] for name in ROW.names})
        return pd.concat([packed, rows], ignore_index=True) if len(rows) else packed

    def _wake(self, at: int | None) -> None:
        """The key's only timer: the first millisecond at which the microsecond is passed."""
        known = list(self.handle.listTimers())
        new = None if at is None else -(-at // 1000)
        for t in known:
            if t != new:
                self.handle.deleteTimer(t)
        if new is not None and new not in known:
            self.handle.registerTimer(new)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        closed = 1000 * timerValues.getCurrentWatermarkInMs()
        first = None
        for p in rows:
            p = p[p["ts"] > closed]  # the successors of older rows have been judged
            if len(p):
                self._keep(p)
                first = min(int(p["ts"].min()), first or int(p["ts"].min()))
        if first is not None:
            known = [1000 * t for t in self.handle.listTimers()]
            # a timer of the memory alone gives way: its key has rows again
            self._wake(min([first, *known]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = 1000 * timerValues.getCurrentWatermarkInMs()
        rows = self._kept()
        done = (rows["ts"] <= closed).to_numpy(dtype=bool)
        ready, rest = rows[done].sort_values(["ts", "event_id"], ignore_index=True), rows[~done]
        *memory, seen = self.memory.get() if self.memory.exists() else (*self.start, None)
        out = []
        if len(ready):
            # silences longer than idle part the rows however they are batched
            gaps = np.diff(ready["ts"].to_numpy(dtype=np.int64), prepend=ready["ts"].iloc[0] if seen is None else seen) > (np.inf if self.idle is None else self.idle)
            for _, part in ready.groupby(np.cumsum(gaps)):
                if gaps[part.index[0]]:
                    memory = self.start
                result, memory = self.judge(key, part.reset_index(drop=True), tuple(memory))
                out.append(result)
            seen = int(ready["ts"].iloc[-1])
            self.memory.update((*memory, seen))
            self.waiting.clear()
            self.blocks.clear()
            if len(rest):
                self._keep(rest)
        ends = [t for t in (self.until(tuple(memory)), None if self.idle is None or seen is None else seen + self.idle) if t is not None]
        if ends and min(ends) <= closed:
            self.memory.clear()
            ends = []
        self._wake(min([*ends, *([int(rest["ts"].min())] if len(rest) else [])], default=None))
        return iter(out)

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, schema: str, judge: Callable, until: Callable, start: tuple, kinds: str, late: str, idle_hours: float | None = None) -> DataFrame:
    """Rows of each stream judged in order; see _Ordered. Rows older than the watermark are dropped, as windowed aggregates drop them."""
    timed = df.withWatermark("ts", late).select("stream", "event_id", "value", F.unix_micros("ts").alias("us"), "ts").withColumnsRenamed({"ts": "_at", "us": "ts"})
    idle = None if idle_hours is None else int(idle_hours * HOUR)
    return timed.groupBy("stream").transformWithStateInPandas(_Ordered(judge, until, start, kinds, idle), schema, "append", "eventTime")


def lockout(df: DataFrame, hours: float = 12.0, wet: float = 60.0, late: str = "1 hour") -> DataFrame:
    """dry for each row: nothing above wet came in the hours before it, per stream. The last wet time is the state, and goes when the hours are over; rows the watermark hasn't passed yet are withheld."""
    span = int(hours * HOUR)

    def judge(key: tuple, rows: pd.DataFrame, memory: tuple) -> tuple[pd.DataFrame, tuple]:
        (last,) = memory
        wet_at = rows["ts"].where(rows["value"] > wet)
        wet_at = wet_at.groupby(rows["ts"]).transform("max").ffill()  # rows of one time see each other
        if last is not None:
            wet_at = wet_at.fillna(last)
        dry = ~((rows["ts"] - wet_at) <= span)
        last = int(wet_at.iloc[-1]) if pd.notna(wet_at.iloc[-1]) else None
        return pd.DataFrame({"stream": key[0], "event_id": rows["event_id"], "dry": dry}), (last,)

    # rows to come are later than the watermark: a wet time that lies further back than the hours is as good as none
    return _in_order(df, "stream string, event_id long, dry boolean", judge, lambda memory: (memory[0] or -span) + span, (None,), "last long", late)


def departures(df: DataFrame, limit: float, calm: float, late: str = "1 hour", idle_hours: float | None = None) -> DataFrame:
    """Alerts by stream: 'onset' when a value reaches limit, 'recovery' at the second of two values in a row under calm (less than limit); order and delay as in lockout.

    A stream that has been silent for idle_hours of event time is forgotten and begins anew; None keeps every stream's state for good.
    """
    if calm >= limit:
        raise ValueError("calm must be below limit")

    def judge(key: tuple, rows: pd.DataFrame, memory: tuple) -> tuple[pd.DataFrame, tuple]:
        away, before = memory
        v, ids, at, out = rows["value"].to_numpy(), rows["event_id"].to_numpy(), 0, []
        quiet = v <= calm
        # an onset's value isn't calm, so two calm values in a row lie both before or both after it
        high, low = np.flatnonzero(v >= limit), np.flatnonzero(quiet & np.append(before, quiet[:-1]))
        while True:  # from one alert to the next
            marks = low if away else high
            k = np.searchsorted(marks, at)
            if k == len(marks):
                break
            out.append((key[0], int(ids[marks[k]]), "recovery" if away else "onset"))
            at, away = int(marks[k]) + 1, not away
        return pd.DataFrame(out, columns=["stream", "event_id", "alert"]), (bool(away), bool(quiet[-1]))

    return _in_order(df, "stream string, event_id long, alert string", judge, lambda memory: None, (False, False), "away boolean, calm boolean", late, idle_hours)


def upsert(df: DataFrame, path: str, by: list[str], keys: list[str]) -> None:
    """A table of by and keys that each micro-batch's rows enter: new keys are added, known ones replaced, other rows of the same partitions stay.

    Only the partitions a batch touches are read, merged and replaced. A batch that is run again after a failure writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, panel = batch.sparkSession, f"{path}/panel"
        batch = batch.persist()
        try:
            try:
                known = spark.read.schema(batch.schema).parquet(panel)
            except AnalysisException:  # the first batch finds no table
                known = None
            merged = batch
            if known is not None:
                touched = known.join(batch.select(*by).distinct(), by, "left_semi")
                merged = batch.unionByName(touched.join(batch.select(*by, *keys), [*by, *keys], "left_anti"))
            # written aside first: a partition can't be replaced while it is read
            aside = f"{path}/merged/{number}"
            merged.write.mode("overwrite").parquet(aside)
            spark.read.schema(batch.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(panel)
        finally:
            batch.unpersist()

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
