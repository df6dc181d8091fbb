"""Queries on joins and alignment, sorts, limits and sets (J, K, U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins
from .registry import query

c = F.col
R6 = lambda x: F.round(x, 6)
STREAMS = ["click", "error", "purchase", "signup", "view"]


@query("J01_outer_alignment", "SELECT CAST(ts AS DATE) AS d, round(avg(value) FILTER (stream = 'click'), 6) AS click, round(avg(value) FILTER (stream = 'error'), 6) AS error, round(avg(value) FILTER (stream = 'view'), 6) AS view FROM obs GROUP BY 1", "obs")
def _(v):
    """Long form and one pivot instead of a chain of outer joins."""
    return v.obs.groupBy(F.to_date("ts").alias("d")).pivot("stream", ["click", "error", "view"]).agg(R6(F.avg("value")))


@query("J02_outer_with_zeros", "SELECT d, coalesce(n, 0) AS n, coalesce(mm, 0.0) AS mm FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM humid WHERE rh > 95 GROUP BY 1) FULL JOIN (SELECT CAST(ts AS DATE) AS d, round(sum(mm), 6) AS mm FROM rain WHERE mm > 0.8 GROUP BY 1) USING (d)", "humid rain")
def _(v):
    a = v.humid.where("rh > 95").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    b = v.rain.where("mm > 0.8").groupBy(F.to_date("ts").alias("d")).agg(R6(F.sum("mm")).alias("mm"))
    return a.join(b, "d", "full").select("d", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mm", F.lit(0.0)).alias("mm"))


@query("J03_inner_on_day", "SELECT a.d, a.variable AS va, b.variable AS vb, round(a.value - b.value, 4) AS diff FROM panel a JOIN panel b ON a.d = b.d AND a.variable = '1-URGENT' AND b.variable = '2-HIGH'", "panel")
def _(v):
    a = v.panel.where("variable = '1-URGENT'").select("d", c("variable").alias("va"), c("value").alias("x"))
    b = v.panel.where("variable = '2-HIGH'").select("d", c("variable").alias("vb"), c("value").alias("y"))
    return a.join(b, "d").select("d", "va", "vb", F.round(c("x") - c("y"), 4).alias("diff"))


@query("J04_left_flags", "SELECT event_id, coalesce(wet, false) AS wet FROM scenes LEFT JOIN (SELECT CAST(ts AS DATE) AS d, max(mm) > 1 AS wet FROM rain GROUP BY 1) ON d = CAST(ts AS DATE)", "scenes rain")
def _(v):
    wet = v.rain.groupBy(F.to_date("ts").alias("d")).agg((F.max("mm") > 1).alias("wet"))
    return v.scenes.withColumn("d", F.to_date("ts")).join(wet, "d", "left").select("event_id", F.coalesce("wet", F.lit(False)).alias("wet"))


@query("J05_outer_paired", "SELECT d, round(a, 4) AS urgent_mean, round(b, 4) AS low_mean FROM (SELECT d, value AS a FROM panel WHERE variable = '1-URGENT') FULL JOIN (SELECT d, value AS b FROM panel WHERE variable = '5-LOW') USING (d)", "panel")
def _(v):
    pick = lambda k, n: v.panel.where(c("variable") == k).select("d", F.round("value", 4).alias(n))
    return pick("1-URGENT", "urgent_mean").join(pick("5-LOW", "low_mean"), "d", "full")


@query(
    "J06_nearest_asof",
    """+n AS (SELECT s.event_id, r.ts AS rts, r.mm, abs(epoch_us(r.ts) - epoch_us(s.ts)) AS gap FROM scenes s, rain r WHERE r.ts BETWEEN s.ts - INTERVAL 31 MINUTE AND s.ts + INTERVAL 31 MINUTE),
    b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, rts DESC) = 1)
    SELECT s.event_id, CASE WHEN gap <= 1800000000 THEN mm END AS mm FROM scenes s LEFT JOIN b USING (event_id)""",
    "scenes rain",
)
def _(v):
    return joins.nearest(v.scenes, v.rain, "ts", ["mm"], tolerance_s=1800).select("event_id", "mm")


@query("J06_nearest_without_tolerance", "+n AS (SELECT s.event_id, h.rh, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(h.ts) - epoch_us(s.ts)), h.ts DESC) AS k FROM scenes s, humid h) SELECT event_id, round(rh, 6) AS rh FROM n WHERE k = 1", "scenes humid")
def _(v):
    return joins.nearest(v.scenes, v.humid, "ts", ["rh"]).select("event_id", R6("rh").alias("rh"))


@query("J07_exact_reindex", "+e AS (SELECT variable, min(d) AS a, max(d) AS b FROM panel GROUP BY 1), k AS (SELECT variable, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM e) SELECT variable, d, round(value, 4) AS value FROM k LEFT JOIN panel USING (variable, d)", "panel")
def _(v):
    return joins.reindex(v.panel, "d", ["variable"]).select("variable", "d", F.round("value", 4).alias("value"))


@query(
    "J08_trailing_windows",
    "SELECT s.event_id, round((SELECT sum(mm) FROM rain r WHERE r.ts > s.ts - INTERVAL 12 HOUR AND r.ts <= s.ts), 6) AS rain_12h, round((SELECT avg(rh) FROM humid h WHERE h.ts > s.ts - INTERVAL 1 HOUR AND h.ts <= s.ts), 6) AS rh_1h FROM scenes s",
    "scenes rain humid",
)
def _(v):
    """Only scenes are asked for, as differences of running sums."""
    rows = v.rain.select("ts", "mm").unionByName(v.humid.select("ts", "rh"), allowMissingColumns=True)
    out = joins.trailing_at(v.scenes, rows, "event_id", "ts", {"rain_12h": ("sum", "mm", 12 * 3600), "rh_1h": ("avg", "rh", 3600)})
    return out.select("event_id", R6("rain_12h").alias("rain_12h"), R6("rh_1h").alias("rh_1h"))


@query("J09_interval_context", "SELECT s.event_id, count(r.ts) AS n, round(coalesce(sum(r.mm), 0), 6) AS mm FROM scenes s LEFT JOIN rain r ON r.ts BETWEEN s.ts - INTERVAL 3 HOUR AND s.ts + INTERVAL 30 MINUTE GROUP BY 1", "scenes rain")
def _(v):
    """Counts and sums as differences of running sums: no pair is formed."""
    met = joins.trailing_at(v.scenes, v.rain, "event_id", "ts", {"n": ("count", "mm", 3 * 3600), "mm": ("sum", "mm", 3 * 3600)}, after_s=30 * 60, half_open=False)
    return met.select("event_id", "n", R6(F.coalesce("mm", F.lit(0.0))).alias("mm"))


@query(
    "J10_predawn_window",
    """+rise AS (SELECT CAST(ts AS DATE) AS d, min(ts) AS sunrise FROM radiation WHERE value > 5 GROUP BY 1),
    m AS (SELECT d, sensor, avg(value) AS m FROM rise JOIN obs ON ts BETWEEN date_trunc('minute', sunrise) - INTERVAL 2 HOUR AND date_trunc('minute', sunrise) GROUP BY 1, 2)
    SELECT d, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(1.96::DOUBLE * stddev_samp(m) / sqrt(count(*)), 6) AS ci FROM m GROUP BY 1""",
    "obs radiation",
)
def _(v):
    rise = v.radiation.where("value > 5").groupBy(F.to_date("ts").alias("d")).agg(F.date_trunc("minute", F.min("ts")).alias("sunrise"))
    met = joins.interval_join(rise, v.obs.select("ts", "sensor", "value"), c("sunrise") - F.expr("INTERVAL 2 HOURS"), c("sunrise"), "ts", 2 * 3600, "inner")
    m = met.groupBy("d", "sensor").agg(F.avg("value").alias("m"))
    return m.groupBy("d").agg(F.count("*").alias("n"), R6(F.avg("m")).alias("mean"), R6(F.stddev_samp("m")).alias("std"), R6(1.96 * F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("ci"))


@query("J11_labelled_periods", "SELECT label, variable, count(*) AS n, round(avg(value), 4) AS mean FROM panel JOIN (VALUES ('early', DATE '1992-03-01', DATE '1993-02-28'), ('late', DATE '1996-01-01', DATE '1996-12-31')) p(label, a, b) ON d BETWEEN a AND b GROUP BY 1, 2", "panel")
def _(v):
    periods = v.spark.createDataFrame([("early", "1992-03-01", "1993-02-28"), ("late", "1996-01-01", "1996-12-31")], "label string, a string, b string").select("label", c("a").cast("date"), c("b").cast("date"))
    met = v.panel.join(F.broadcast(periods), c("d").between(c("a"), c("b")))  # a handful of literal rows
    return met.groupBy("label", "variable").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("J12_semi", "SELECT DISTINCT d FROM panel WHERE variable = '1-URGENT' AND d IN (SELECT d FROM panel WHERE variable = '5-LOW')", "panel")
def _(v):
    pick = lambda k: v.panel.where(c("variable") == k).select("d")
    return pick("1-URGENT").join(pick("5-LOW"), "d", "left_semi").distinct()


@query("J13_anti", "SELECT sensor, CAST(d AS DATE) AS d FROM (SELECT DISTINCT sensor FROM obs), (SELECT DISTINCT CAST(ts AS DATE) AS d FROM obs) WHERE (sensor, d) NOT IN (SELECT (sensor, CAST(ts AS DATE)) FROM obs)", "obs")
def _(v):
    """Pending (sensor, day) tasks: the grid of keys less those with output."""
    done = v.obs.select("sensor", F.to_date("ts").alias("d")).distinct()
    days = F.broadcast(v.obs.select(F.to_date("ts").alias("d")).distinct())  # a row a day
    return done.select("sensor").distinct().join(days).join(done, ["sensor", "d"], "left_anti")


@query("J14_first_match", "SELECT s.event_id, min(h.event_id) AS first_id FROM scenes s LEFT JOIN humid h ON CAST(s.ts AS DATE) = CAST(h.ts AS DATE) AND hour(s.ts) = hour(h.ts) GROUP BY 1", "scenes humid")
def _(v):
    slot = lambda df: df.withColumn("d", F.to_date("ts")).withColumn("h", F.hour("ts"))
    first = slot(v.humid).groupBy("d", "h").agg(F.min("event_id").alias("first_id"))
    return slot(v.scenes).join(first, ["d", "h"], "left").select("event_id", "first_id")


@query("J15_grid", "SELECT stream, model, CAST(pen AS DOUBLE) AS pen, n FROM (SELECT stream, count(*) AS n FROM obs GROUP BY 1), (VALUES ('l1'), ('l2'), ('rbf'), ('normal')) m(model), (VALUES (0.5), (1), (2)) p(pen)", "obs")
def _(v):
    """A literal grid, exploded: no join at all."""
    n = v.obs.groupBy("stream").agg(F.count("*").alias("n"))
    return n.withColumn("model", F.explode(F.array(*map(F.lit, ["l1", "l2", "rbf", "normal"])))).withColumn("pen", F.explode(F.array(*map(F.lit, [0.5, 1.0, 2.0]))))


@query("J16_unordered_pairs", "SELECT a.variable AS x, b.variable AS y FROM (SELECT DISTINCT variable FROM panel) a JOIN (SELECT DISTINCT variable FROM panel) b ON a.variable < b.variable", "panel")
def _(v):
    names = F.sort_array(F.collect_set("variable"))  # of variables, not of rows
    return v.panel.agg(names.alias("n")).select(F.explode("n").alias("x"), "n").select("x", F.explode("n").alias("y")).where("x < y")


@query("J17_lagged_pairs", "SELECT lag, count(*) AS n, round(avg(a.value - b.value), 4) AS diff FROM panel a, range(-3, 4) l(lag), panel b WHERE a.variable = '1-URGENT' AND b.variable = '2-HIGH' AND b.d = a.d + CAST(lag AS INT) GROUP BY 1", "panel")
def _(v):
    pick = lambda k: v.panel.where(c("variable") == k)
    return joins.lagged_pairs(pick("1-URGENT"), pick("2-HIGH"), range(-3, 4)).groupBy(c("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.round(F.avg(c("vx") - c("vy")), 4).alias("diff"))


@query("J18_spatial_mask", "SELECT scene, count(*) AS n, round(avg(value), 6) AS mean FROM pixels WHERE (x - 3) ** 2 + (y - 4) ** 2 <= 6.3::DOUBLE GROUP BY 1", "pixels")
def _(v):
    return v.pixels.where((c("x") - 3) * (c("x") - 3) + (c("y") - 4) * (c("y") - 4) <= 6.3).groupBy("scene").agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean"))


@query("J19_nearest_pixel", "SELECT scene, round(value, 6) AS value FROM pixels WHERE x = 2 AND y = 5", "pixels")
def _(v):
    """The pixel nearest to (2.3, 5.4)."""
    grid = v.pixels.select("x", "y").distinct()
    best = grid.agg(F.min_by(F.struct("x", "y"), F.struct(F.pow(c("x") - 2.3, F.lit(2)) + F.pow(c("y") - 5.4, F.lit(2)), "x", "y")).alias("p")).select("p.*")
    return v.pixels.join(F.broadcast(best), ["x", "y"], "left_semi").select("scene", R6("value").alias("value"))


@query("J20_nearest_height", "SELECT scan, arg_min(lin_pai, struct_pack(a := abs(height - 3.4::DOUBLE), b := height)) AS pai FROM profile GROUP BY 1", "profile")
def _(v):
    return v.profile.groupBy("scan").agg(F.min_by("lin_pai", F.struct(F.abs(c("height") - 3.4), "height")).alias("pai"))


@query("K02_top_edges", "SELECT event_id, value FROM obs ORDER BY value DESC, event_id LIMIT 45", "obs")
def _(v):
    return v.obs.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(45)


@query("K03_argmax", "SELECT stream, arg_max(event_id, struct_pack(a := value, b := -event_id)) AS best FROM obs GROUP BY 1", "obs")
def _(v):
    return v.obs.groupBy("stream").agg(F.max_by("event_id", F.struct("value", -c("event_id"))).alias("best"))


@query("K04_best_of_pair", "SELECT lo, hi, arg_max(l_orderkey, struct_pack(a := l_extendedprice, b := -l_orderkey, c := -l_linenumber)) AS best FROM (SELECT *, least(l_suppkey, l_partkey % 100) AS lo, greatest(l_suppkey, l_partkey % 100) AS hi FROM lineitem) GROUP BY 1, 2")
def _(v):
    pair = v.table("lineitem").withColumn("k", c("l_partkey") % 100).withColumn("lo", F.least("l_suppkey", "k")).withColumn("hi", F.greatest("l_suppkey", "k"))
    return pair.groupBy("lo", "hi").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -c("l_orderkey"), -c("l_linenumber"))).alias("best"))


@query("K05_longest_then_chronological", "SELECT variable, d, value FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY value DESC, d) AS k FROM panel) WHERE k <= 2", "panel")
def _(v):
    w = Window.partitionBy("variable").orderBy(F.desc("value"), "d")
    return v.panel.withColumn("k", F.row_number().over(w)).where("k <= 2").select("variable", "d", "value").orderBy("variable", "d")


@query("U01_union_with_provenance", "SELECT orbit, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT 'ASCENDING' AS orbit, value FROM scenes WHERE orbit = 'ASCENDING' UNION ALL SELECT 'DESCENDING', value FROM scenes WHERE orbit = 'DESCENDING') GROUP BY 1", "scenes")
def _(v):
    part = lambda o: v.scenes.where(c("orbit") == o).drop("orbit").withColumn("orbit", F.lit(o))
    return part("ASCENDING").unionByName(part("DESCENDING"), allowMissingColumns=True).groupBy("orbit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("U02_distinct_union", "SELECT variable AS name FROM panel UNION SELECT stream FROM obs", "panel obs")
def _(v):
    return v.panel.select(c("variable").alias("name")).union(v.obs.select("stream")).distinct()


@query("U03_intersection", "SELECT CAST(ts AS DATE) AS d FROM rain WHERE mm > 0.9 INTERSECT SELECT CAST(ts AS DATE) FROM humid WHERE rh > 99", "rain humid")
def _(v):
    return v.rain.where("mm > 0.9").select(F.to_date("ts").alias("d")).intersect(v.humid.where("rh > 99").select(F.to_date("ts").alias("d")))


@query("U04_difference", "SELECT sensor FROM obs EXCEPT SELECT sensor FROM obs WHERE stream = 'purchase' AND value > 20", "obs")
def _(v):
    return v.obs.select("sensor").distinct().join(v.obs.where("stream = 'purchase' AND value > 20").select("sensor"), "sensor", "left_anti")
