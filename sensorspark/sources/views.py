"""The sensor-network views over the star-schema tables: observation streams, panels, rasters, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazy views over one folder of Parquet tables; nothing is read until a result is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        """Event times are stored without a zone; streams need instants."""
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def obs(self) -> DataFrame:
        return self.events.select("event_id", F.col("user_id").alias("sensor"), F.col("event_type").alias("stream"), "ts", "value")

    @property
    def dirty(self) -> DataFrame:
        bad = F.when(F.col("event_id") % 17 == 0, F.lit(-9999.0)).when(F.col("event_id") % 23 == 0, F.lit(None)).otherwise(F.col("value"))
        return self.obs.withColumn("value", bad)

    @property
    def clocks(self) -> DataFrame:
        """Wall clocks in Berlin, read in six-hour nights: back to standard time, on to summer time (by clocks that don't follow), and in July. seq is the order of reading."""
        c = F.col
        e = self.obs.withColumns({"yr": (2019 + c("event_id") % 5).cast("int"), "kind": F.floor(c("event_id") / 5) % 3, "secs": F.floor(F.pmod(F.unix_seconds("ts"), F.lit(21600)) / 300) * 300})
        end = F.make_date("yr", F.when(c("kind") == 0, 10).when(c("kind") == 1, 3).otherwise(7), F.lit(31))
        night = F.when(c("kind") == 2, F.date_sub(end, 16)).otherwise(F.date_sub(end, F.dayofweek(end) - 1))
        wall = night.cast("timestamp_ntz") + F.make_dt_interval(secs=c("secs") - F.when((c("kind") == 0) & (c("secs") >= 10800), 3600).otherwise(0))
        return e.select("event_id", "sensor", (c("secs") * 1_000_000_000 + c("event_id")).cast("long").alias("seq"), F.when(c("event_id") % 29 != 0, wall).alias("wall"))

    @property
    def rain(self) -> DataFrame:
        return self.events.where("event_type = 'error'").select("event_id", "ts", F.when(F.col("value") > 60, F.col("value") / 100).otherwise(F.lit(0.0)).alias("mm"))

    @property
    def humid(self) -> DataFrame:
        return self.events.where("event_type = 'view'").select("event_id", "ts", F.least(F.lit(100.0), F.lit(50.0) + F.col("value") / 3).alias("rh"))

    @property
    def scenes(self) -> DataFrame:
        orbit = F.when(F.col("event_id") % 2 == 0, "ASCENDING").otherwise("DESCENDING")
        return self.events.where("event_type = 'purchase'").select("event_id", "ts", orbit.alias("orbit"), "value")

    @property
    def radiation(self) -> DataFrame:
        return self.events.where("event_type = 'click'").select("event_id", "ts", "value")

    @property
    def daily(self) -> DataFrame:
        return self.obs.groupBy(F.to_date("ts").alias("d"), "stream").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"))

    @property
    def panel(self) -> DataFrame:
        return self.table("orders").groupBy(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("variable")).agg(F.avg("o_totalprice").alias("value"))

    @property
    def pixels(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "value"))
        return e.select(F.col("vec_id").alias("scene"), (F.col("label") % 2).alias("orbit"), (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), F.col("value").cast("double").alias("value"))

    @property
    def refl(self) -> DataFrame:
        c = F.col
        return self.table("lineitem").select(
            "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("scene"), (c("l_extendedprice") / 105000).alias("N"), (c("l_quantity") / 100).alias("R"), c("l_discount").alias("B"), (c("l_tax") + 0.05).alias("G"), (c("l_quantity") / 80).alias("RE1"), (c("l_discount") + 0.1).alias("S1")
        )

    @property
    def radar(self) -> DataFrame:
        c = F.col
        return self.table("lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("scene"), (-5 - c("l_quantity") / 10).alias("VV"), (-12 - c("l_quantity") / 12).alias("VH"), (30 + c("l_linenumber")).cast("double").alias("angle"))

    @property
    def profile(self) -> DataFrame:
        """Cumulative leaf area by height, one row for each scan and height."""
        from pyspark.sql import Window

        per = self.table("lineitem").groupBy(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("height")).agg(F.max("l_quantity").alias("q"))
        up = Window.partitionBy("scan").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
        per = per.withColumn("lin_pai", F.sum("q").over(up) / 50)
        scans = self.table("orders").select(F.col("o_orderkey").alias("scan"), F.to_date("o_orderdate").alias("d"))
        return per.join(scans, "scan")

    @property
    def shots(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("scan"), (F.col("l_quantity") * 1.6).alias("zenith"), (F.col("l_returnflag") == "R").alias("is_gap"), (F.col("l_extendedprice") / 6000).alias("range"))

    @property
    def ensembles(self) -> DataFrame:
        low = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return self.table("lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), low.alias("u05"), (low * (1 + F.col("l_tax"))).alias("u50"), F.col("l_extendedprice").alias("u95"))

    @property
    def hier(self) -> DataFrame:
        """depth (customer) -> profile (nation) -> plot (region)."""
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("depth"), F.col("n_name").alias("profile"), F.col("r_name").alias("plot"), F.col("c_acctbal").alias("value"))

    @property
    def drivers(self) -> DataFrame:
        li, p = self.table("lineitem"), self.table("part").select("p_partkey", "p_retailprice")
        j = li.join(p, li["l_partkey"] == p["p_partkey"])
        y = 2 * F.col("l_quantity") + F.col("p_retailprice") / 10 + 100 * F.col("l_discount")
        return j.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), y.alias("y"), F.col("l_quantity").alias("x1"), F.col("p_retailprice").alias("x2"))


#: The same views in SQL, by name; each may name earlier ones.
SQL = {
    "obs": "SELECT event_id, user_id AS sensor, event_type AS stream, ts, value FROM events",
    "dirty": "SELECT event_id, sensor, stream, ts, CASE WHEN event_id % 17 = 0 THEN -9999.0 WHEN event_id % 23 = 0 THEN NULL ELSE value END AS value FROM obs",
    "clocks": "SELECT event_id, sensor, CAST(secs * 1000000000 + event_id AS BIGINT) AS seq, CASE WHEN event_id % 29 <> 0 THEN night + to_seconds(secs - CASE WHEN kind = 0 AND secs >= 10800 THEN 3600 ELSE 0 END) END AS wall, kind, night FROM (SELECT *, CAST(CASE kind WHEN 0 THEN make_date(yr, 10, 31) - CAST(dayofweek(make_date(yr, 10, 31)) AS INT) WHEN 1 THEN make_date(yr, 3, 31) - CAST(dayofweek(make_date(yr, 3, 31)) AS INT) ELSE make_date(yr, 7, 15) END AS TIMESTAMP) AS night FROM (SELECT *, 2019 + event_id % 5 AS yr, event_id // 5 % 3 AS kind, CAST(floor(epoch(ts)) AS BIGINT) % 21600 // 300 * 300 AS secs FROM obs))",
    "rain": "SELECT event_id, ts, CASE WHEN value > 60 THEN value / 100 ELSE 0.0 END AS mm FROM events WHERE event_type = 'error'",
    "humid": "SELECT event_id, ts, least(100.0, 50.0 + value / 3) AS rh FROM events WHERE event_type = 'view'",
    "scenes": "SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit, value FROM events WHERE event_type = 'purchase'",
    "radiation": "SELECT event_id, ts, value FROM events WHERE event_type = 'click'",
    "daily": "SELECT CAST(ts AS DATE) AS d, stream, avg(value) AS mean, max(value) AS peak FROM obs GROUP BY 1, 2",
    "panel": "SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS variable, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2",
    "pixels": "SELECT vec_id AS scene, label % 2 AS orbit, CAST(p % 8 AS INT) AS x, CAST(p // 8 AS INT) AS y, CAST(embedding[p + 1] AS DOUBLE) AS value FROM embeddings, range(64) r(p)",
    "refl": "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS scene, l_extendedprice / 105000 AS N, l_quantity / 100 AS R, l_discount AS B, l_tax + 0.05::DOUBLE AS G, l_quantity / 80 AS RE1, l_discount + 0.1::DOUBLE AS S1 FROM lineitem",
    "radar": "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS scene, -5 - l_quantity / 10 AS VV, -12 - l_quantity / 12 AS VH, CAST(30 + l_linenumber AS DOUBLE) AS angle FROM lineitem",
    "profile": "SELECT scan, height, q, sum(q) OVER (PARTITION BY scan ORDER BY height) / 50 AS lin_pai, CAST(o_orderdate AS DATE) AS d FROM (SELECT l_orderkey AS scan, l_linenumber AS height, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) JOIN orders ON scan = o_orderkey",
    "shots": "SELECT l_suppkey AS scan, l_quantity * 1.6::DOUBLE AS zenith, l_returnflag = 'R' AS is_gap, l_extendedprice / 6000 AS range FROM lineitem",
    "ensembles": "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, l_extendedprice * (1 - l_discount) AS u05, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS u50, l_extendedprice AS u95 FROM lineitem",
    "hier": "SELECT c_custkey AS depth, n_name AS profile, r_name AS plot, c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "drivers": "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, 2 * l_quantity + p_retailprice / 10 + 100 * l_discount AS y, l_quantity AS x1, p_retailprice AS x2 FROM lineitem JOIN part ON l_partkey = p_partkey",
}


def with_views(query: str, *names: str) -> str:
    """query under WITH clauses of the named views and those that they need."""
    if set(names) & {"dirty", "daily", "clocks"}:
        names = ("obs", *[n for n in names if n != "obs"])
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in names) + (", " if query.startswith("+") else " ") + query.removeprefix("+")
