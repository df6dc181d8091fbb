"""Queries on streams (R): each reads the event files as a stream to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..streaming import jobs
from .registry import query

c = F.col
R6 = lambda x: F.round(x, 6)
FILE_ROWS = 500_000
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM obs)"


def _out(v, name: str) -> str:
    """A new folder where executors and driver meet."""
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def _late(v, name: str):
    """The events as files of five days each, where every other row comes up to a day too late; a trigger takes the files of five days, so there are as many triggers however large the table."""
    folder, e = _out(v, name), v.spark.read.parquet(f"{v.path}/events.parquet")
    days = F.unix_date(F.to_date("ts")) + F.pmod(F.xxhash64("event_id"), F.lit(2))
    e = e.withColumn("_slot", F.floor(days / 5)).where("_slot IS NOT NULL")
    slots = sorted(tuple(r) for r in e.groupBy("_slot").count().collect())  # a row for every five days
    files = max([1, *[-(-n // FILE_ROWS) for _, n in slots]])
    for slot, _ in slots:  # one after the other, as they would arrive
        e.where(c("_slot") == slot).drop("_slot").repartition(files, "event_id").write.mode("append").parquet(folder)
    return jobs.events(v.spark, folder, "*.parquet", files)


LATE = "7 days"
JUDGED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 7 DAY FROM obs)"


@query("R01_ingestion", "SELECT event_id, sensor, stream, value FROM obs", "obs")
def _(v):
    return jobs.run(jobs.events(v.spark, v.path), _out(v, "ingest")).select("event_id", "sensor", "stream", "value")


@query("R02_daily_windows", f"SELECT CAST(ts AS DATE) AS d, stream, count(*) AS n, round(avg(value), 6) AS mean FROM obs GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {CLOSED}", "obs")
def _(v):
    """The window that is still open at the end is withheld."""
    return jobs.run(jobs.daily(jobs.events(v.spark, v.path)), _out(v, "daily")).select(F.to_date("start").alias("d"), "stream", "n", R6("mean").alias("mean"))


@query("R03_sliding_windows", f"+w AS (SELECT stream, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM obs) SELECT strftime(s, '%Y-%m-%d %H') AS start, stream, count(*) AS n, round(sum(value), 6) AS total FROM w WHERE s + INTERVAL 12 HOUR <= {CLOSED} GROUP BY 1, 2", "obs")
def _(v):
    return jobs.run(jobs.trailing(jobs.events(v.spark, v.path)), _out(v, "trailing")).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "stream", "n", R6("total").alias("total"))


@query("R04_spells", f"+x AS (SELECT stream, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS k FROM obs WINDOW w AS (PARTITION BY stream ORDER BY ts)), s AS (SELECT stream, ts, sum(k) OVER (PARTITION BY stream ORDER BY ts) AS id FROM x) SELECT stream, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY stream, id HAVING max(ts) + INTERVAL 2 HOUR <= {CLOSED}", "obs")
def _(v):
    return jobs.run(jobs.spells(jobs.events(v.spark, v.path)), _out(v, "spells")).select("stream", F.date_format("start", STAMP).alias("start"), "n")


@query("R05_lockout", f"+w AS (SELECT stream, event_id, ts, NOT coalesce(max(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW), 0) = 1 AS dry FROM obs) SELECT stream, event_id, dry FROM w WHERE ts <= {JUDGED}", "obs")
def _(v):
    """Rows that the watermark hasn't passed at the end are withheld."""
    return jobs.run(jobs.lockout(_late(v, "late"), late=LATE), _out(v, "lockout"))


R06 = f"""+o AS (SELECT stream, event_id, ts, value >= 60 AS high, value <= 20 AND lag(value) OVER (PARTITION BY stream ORDER BY ts, event_id) <= 20 AS low FROM obs WHERE ts <= {JUDGED}),
m AS (SELECT *, CASE WHEN high THEN 'onset' ELSE 'recovery' END AS alert FROM o WHERE high OR low)
SELECT stream, event_id, alert FROM (SELECT *, lag(alert, 1, 'recovery') OVER (PARTITION BY stream ORDER BY ts, event_id) AS last FROM m) WHERE alert <> last"""


@query("R06_alerts", R06, "obs")
def _(v):
    """The first of each run of marks of one kind is an alert; rows that the watermark hasn't passed at the end are withheld."""
    return jobs.run(jobs.departures(_late(v, "late"), limit=60.0, calm=20.0, late=LATE), _out(v, "alerts"))


@query("R07_once", "SELECT event_id, sensor FROM obs", "obs")
def _(v):
    """Every file's rows come twice; each event stays once."""
    e = jobs.events(v.spark, v.path)
    return jobs.run(jobs.once(e.unionAll(e), ["event_id"]), _out(v, "once")).select("event_id", "sensor")


@query("R08_interval_join", "SELECT s.event_id AS scene, w.event_id AS weather FROM obs s JOIN obs w ON s.stream = 'purchase' AND w.stream = 'error' AND w.ts > s.ts - INTERVAL 12 HOUR AND w.ts <= s.ts", "obs")
def _(v):
    """The stream finds the pairs of blocks; pairs of rows are made where they are read, and stored nowhere."""
    e = jobs.events(v.spark, v.path)
    met = jobs.run(jobs.blocks_in_interval(e.where("stream = 'purchase'"), e.where("stream = 'error'")), _out(v, "join"), options=jobs.PAIRS_APART)
    tasks = 4 * int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    return jobs.pairs(met.repartition(tasks)).select("scene", "weather")  # few blocks make many pairs


@query("R09_upsert", "SELECT CAST(ts AS DATE) AS d, stream, count(*) AS n FROM obs GROUP BY 1, 2", "obs")
def _(v):
    path = _out(v, "upsert")
    jobs.upsert(jobs.daily(_late(v, "late"), late=LATE).withColumn("d", F.to_date("start").cast("string")), path, ["d"], ["stream"])
    return v.spark.read.parquet(f"{path}/panel").select(c("d").cast("date").alias("d"), "stream", "n")
