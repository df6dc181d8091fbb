"""Queries on aggregations (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timefns as t
from ..operators import joins, profiles, rowwise
from ..operators import statistics as st
from .registry import query

c = F.col
R6 = lambda x: F.round(x, 6)


def day():
    return F.to_date("ts").alias("d")



@query("A01_sum_with_min_count", "SELECT sensor, CAST(ts AS DATE) AS d, count(value) AS n, CASE WHEN count(value) >= 3 THEN round(sum(value), 6) END AS total FROM (SELECT sensor, ts, CASE WHEN abs(value + 9999) < 1 THEN NULL ELSE value END AS value FROM dirty) GROUP BY 1, 2", "dirty")
def _(v):
    return t.replace_sentinels(v.dirty).groupBy("sensor", day()).agg(F.count("value").alias("n"), F.when(F.count("value") >= 3, R6(F.sum("value"))).alias("total"))


@query(
    "A02_resample",
    "SELECT sensor, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M') AS bin, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS hi, min(value) AS lo, round(sum(value), 6) AS total, round(quantile_cont(value, 0.5), 6) AS med FROM obs GROUP BY 1, 2",
    "obs",
)
def _(v):
    g = v.obs.groupBy("sensor", F.window("ts", "30 minutes").alias("w"))
    out = g.agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean"), F.max("value").alias("hi"), F.min("value").alias("lo"), R6(F.sum("value")).alias("total"), R6(F.percentile("value", F.lit(0.5))).alias("med"))
    return out.select("sensor", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bin"), "n", "mean", "hi", "lo", "total", "med")


@query(
    "A03_diurnal_metrics",
    "SELECT sensor, d, round(pre, 6) AS predawn, round(aft, 6) AS afternoon, round(aft - pre, 6) AS amplitude, round(med, 6) AS daily FROM (SELECT sensor, CAST(ts AS DATE) AS d, quantile_cont(value, 0.5) FILTER (hour(ts) >= 1 AND hour(ts) < 5) AS pre, quantile_cont(value, 0.5) FILTER (hour(ts) >= 12 AND hour(ts) < 16) AS aft, quantile_cont(value, 0.5) AS med FROM obs GROUP BY 1, 2)",
    "obs",
)
def _(v):
    med = lambda x: F.percentile(x, F.lit(0.5))
    h = F.hour("ts")
    g = v.obs.groupBy("sensor", day()).agg(med(F.when(t.in_hours(h, 1, 5), c("value"))).alias("pre"), med(F.when(t.in_hours(h, 12, 16), c("value"))).alias("aft"), med("value").alias("med"))
    return g.select("sensor", "d", R6("pre").alias("predawn"), R6("aft").alias("afternoon"), R6(c("aft") - c("pre")).alias("amplitude"), R6("med").alias("daily"))


@query("A04_window_stats", "SELECT d, coalesce(mm, 0) AS mm, coalesce(rh, 0) AS rh, coalesce(mm, 0) < 1 AND coalesce(rh, 0) < 99 AS ok FROM (SELECT CAST(ts AS DATE) AS d, round(sum(mm), 6) AS mm FROM rain WHERE hour(ts) BETWEEN 6 AND 17 GROUP BY 1) FULL JOIN (SELECT CAST(ts AS DATE) AS d, round(max(rh), 6) AS rh FROM humid WHERE hour(ts) BETWEEN 6 AND 17 GROUP BY 1) USING (d)", "rain humid")
def _(v):
    noon = F.hour("ts").between(6, 17)
    a = v.rain.where(noon).groupBy(day()).agg(R6(F.sum("mm")).alias("mm"))
    b = v.humid.where(noon).groupBy(day()).agg(R6(F.max("rh")).alias("rh"))
    j = a.join(b, "d", "full").select("d", F.coalesce("mm", F.lit(0.0)).alias("mm"), F.coalesce("rh", F.lit(0.0)).alias("rh"))
    return j.withColumn("ok", (c("mm") < 1) & (c("rh") < 99))


@query("A05_daily_window_mean", "SELECT stream, CAST(ts AS DATE) AS d, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM obs WHERE hour(ts) >= 10 AND hour(ts) < 14 GROUP BY 1, 2", "obs")
def _(v):
    return v.obs.where(t.in_hours(F.hour("ts"), 10, 14)).groupBy("stream", day()).agg(R6(F.avg("value")).alias("mean"), R6(F.stddev_samp("value")).alias("std"))


@query("A06_ensemble_percentile", "SELECT d, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std FROM (SELECT CAST(ts AS DATE) AS d, stream, quantile_cont(value, 0.9) AS p FROM obs GROUP BY 1, 2) GROUP BY 1", "obs")
def _(v):
    p = v.obs.groupBy(day(), "stream").agg(F.percentile("value", F.lit(0.9)).alias("p"))
    return p.groupBy("d").agg(R6(F.avg("p")).alias("mean"), R6(F.stddev_samp("p")).alias("std"))


@query("A07_profile_total", "SELECT scan, max(lin_pai) AS total, arg_min(q, height) AS first FROM profile GROUP BY 1", "profile")
def _(v):
    return v.profile.groupBy("scan").agg(F.max("lin_pai").alias("total"), F.min_by("q", "height").alias("first"))


@query(
    "A08_layer_split",
    "+g AS (SELECT scan, max(lin_pai) AS total, max(height) FILTER (height <= 3.5) AS ha, arg_max(lin_pai, height) FILTER (height <= 3.5) AS va, min(height) FILTER (height >= 3.5) AS hb, arg_min(lin_pai, height) FILTER (height >= 3.5) AS vb FROM profile GROUP BY 1), u AS (SELECT scan, total, CASE WHEN ha IS NULL THEN vb WHEN hb IS NULL THEN va ELSE va + (vb - va) / (hb - ha) * (3.5::DOUBLE - ha) END AS under FROM g) SELECT scan, round(under, 6) AS under, round(greatest(total - under, 0), 6) AS over FROM u",
    "profile",
)
def _(v):
    return profiles.layer_split(v.profile, "scan", 3.5).select("scan", R6("under").alias("under"), R6("over").alias("over"))


@query("A09_height_band", "+n AS (SELECT scan, arg_min(lin_pai, struct_pack(a := abs(height - 2), b := height)) AS lo, arg_min(lin_pai, struct_pack(a := abs(height - 5), b := height)) AS hi FROM profile GROUP BY 1) SELECT scan, round(hi - lo, 6) AS band FROM n", "profile")
def _(v):
    near = lambda z: F.min_by("lin_pai", F.struct(F.abs(c("height") - z), "height"))
    return v.profile.groupBy("scan").agg(R6(near(5) - near(2)).alias("band"))


@query("A10_layer_integral", "SELECT scan, coalesce(sum(q) FILTER (height >= 2 AND height < 5), 0) * 0.5::DOUBLE AS area FROM profile GROUP BY 1", "profile")
def _(v):
    return v.profile.groupBy("scan").agg((F.coalesce(F.sum(F.when((c("height") >= 2) & (c("height") < 5), c("q"))), F.lit(0.0)) * 0.5).alias("area"))


@query("A11_gap_fraction", "SELECT scan, floor(abs(zenith) / 5) * 5 + 2.5::DOUBLE AS ring, count(*) AS shots, count(*) FILTER (is_gap) AS gaps, round(count(*) FILTER (is_gap) / count(*), 6) AS pgap FROM shots GROUP BY 1, 2", "shots")
def _(v):
    return profiles.gap_fraction(v.shots, "scan", 5.0).withColumn("pgap", R6("pgap"))


@query(
    "A12_miller",
    "+g AS (SELECT scan, floor(abs(zenith) / 5) * 5 + 2.5::DOUBLE AS ring, count(*) FILTER (is_gap) / count(*) AS pgap FROM shots GROUP BY 1, 2), f AS (SELECT scan, radians(ring) AS a, -ln(greatest(pgap, 1e-6)) * cos(radians(ring)) * sin(radians(ring)) AS f FROM g), q AS (SELECT scan, (f + lag(f) OVER w) / 2 * (a - lag(a) OVER w) AS q FROM f WINDOW w AS (PARTITION BY scan ORDER BY a)) SELECT scan, round(2 * coalesce(sum(q), 0), 6) AS pai FROM q GROUP BY 1",
    "shots",
)
def _(v):
    return profiles.miller(profiles.gap_fraction(v.shots, "scan", 5.0), "scan").select("scan", R6("pai").alias("pai"))


@query("A13_hinge", "SELECT scan, round(-ln(greatest(avg(CASE WHEN is_gap THEN 1.0 ELSE 0.0 END), 1e-6)), 6) AS pai FROM shots WHERE abs(abs(zenith) - 57.5::DOUBLE) <= 2 GROUP BY 1", "shots")
def _(v):
    return profiles.hinge(v.shots, "scan").select("scan", R6("pai").alias("pai"))


@query("A14_height_profile", "SELECT scan, height, round((coalesce(lead(lin_pai) OVER w, lin_pai) - coalesce(lag(lin_pai) OVER w, lin_pai)) / nullif(coalesce(lead(height) OVER w, height) - coalesce(lag(height) OVER w, height), 0), 6) AS density FROM profile WINDOW w AS (PARTITION BY scan ORDER BY height)", "profile")
def _(v):
    return profiles.density(v.profile, "scan").select("scan", "height", R6("density").alias("density"))


@query("A15_ratios", "+n AS (SELECT scan, max(lin_pai) FILTER (height = 6) AS hi, max(lin_pai) FILTER (height = 4) AS mid FROM profile GROUP BY 1) SELECT scan, round(hi / nullif(mid, 0), 6) AS ratio FROM n WHERE hi IS NOT NULL", "profile")
def _(v):
    n = v.profile.groupBy("scan").agg(F.max(F.when(c("height") == 6, c("lin_pai"))).alias("hi"), F.max(F.when(c("height") == 4, c("lin_pai"))).alias("mid"))
    return n.where("hi IS NOT NULL").select("scan", R6(F.try_divide("hi", "mid")).alias("ratio"))


@query("A16_interception", "SELECT month(d) AS m, height, round(quantile_cont(pct, 0.5), 6) AS pct FROM (SELECT d, height, (1 - least(exp(-lin_pai) / lag(exp(-lin_pai)) OVER (PARTITION BY scan ORDER BY height), 1)) * 100 AS pct FROM profile) WHERE pct IS NOT NULL GROUP BY 1, 2", "profile")
def _(v):
    p = F.exp(-c("lin_pai"))
    pct = (1 - F.least(p / F.lag(p).over(Window.partitionBy("scan").orderBy("height")), F.lit(1.0))) * 100
    return v.profile.withColumn("pct", pct).where("pct IS NOT NULL").groupBy(F.month("d").alias("m"), "height").agg(R6(F.percentile("pct", F.lit(0.5))).alias("pct"))


@query("A17_group_means", "SELECT weekofyear(d) AS w, height, round(avg(lin_pai), 6) AS mean, round(quantile_cont(lin_pai, 0.25), 6) AS q1, round(quantile_cont(lin_pai, 0.75), 6) AS q3 FROM profile GROUP BY 1, 2", "profile")
def _(v):
    q = F.percentile("lin_pai", F.array(F.lit(0.25), F.lit(0.75)))
    g = v.profile.groupBy(F.weekofyear("d").alias("w"), "height").agg(R6(F.avg("lin_pai")).alias("mean"), q.alias("q"))
    return g.select("w", "height", "mean", R6(c("q")[0]).alias("q1"), R6(c("q")[1]).alias("q3"))


@query("A18_pivot", "SELECT d, round(avg(value) FILTER (variable = '1-URGENT'), 4) AS urgent, round(avg(value) FILTER (variable = '5-LOW'), 4) AS low FROM panel GROUP BY 1", "panel")
def _(v):
    return v.panel.groupBy("d").pivot("variable", ["1-URGENT", "5-LOW"]).agg(F.round(F.avg("value"), 4)).toDF("d", "urgent", "low")


@query("A19_amplitude", "SELECT sensor, fortnight, round(quantile_cont(amp, 0.5), 6) AS amp FROM (SELECT sensor, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 14 AS fortnight, CAST(ts AS DATE) AS d, CASE WHEN count(*) >= 4 THEN max(value) - min(value) END AS amp FROM obs GROUP BY 1, 2, 3) WHERE amp IS NOT NULL GROUP BY 1, 2", "obs")
def _(v):
    a = v.obs.groupBy("sensor", day()).agg(F.when(F.count("*") >= 4, F.max("value") - F.min("value")).alias("amp")).where("amp IS NOT NULL")
    fortnight = F.floor(F.datediff("d", F.lit("2024-01-01")) / 14).alias("fortnight")
    return a.groupBy("sensor", fortnight).agg(R6(F.percentile("amp", F.lit(0.5))).alias("amp"))


@query(
    "A20_hour_pairs",
    "+h AS (SELECT CAST(ts AS DATE) AS d, hour(ts) AS h, avg(value) AS m FROM obs GROUP BY 1, 2), p AS (SELECT a.h AS h1, b.h AS h2, count(*) AS n, quantile_cont(b.m - a.m, 0.5) AS med FROM h a JOIN h b ON a.d = b.d AND a.h < b.h GROUP BY 1, 2) SELECT h1, h2, n, round(med, 6) AS med FROM p WHERE n >= 10",
    "obs",
)
def _(v):
    h = v.obs.groupBy(day(), F.hour("ts").alias("h")).agg(F.avg("value").alias("m"))
    a, b = h.select("d", c("h").alias("h1"), c("m").alias("m1")), h.select("d", c("h").alias("h2"), c("m").alias("m2"))
    g = a.join(b, "d").where("h1 < h2").groupBy("h1", "h2").agg(F.count("*").alias("n"), R6(F.percentile(c("m2") - c("m1"), F.lit(0.5))).alias("med"))
    return g.where("n >= 10")


@query("A21_period_summary", "SELECT quarter(d) AS q, variable, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS med, round(stddev_pop(value), 4) AS std FROM panel GROUP BY 1, 2 HAVING count(*) >= 400", "panel")
def _(v):
    g = v.panel.groupBy(F.quarter("d").alias("q"), "variable").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("med"), F.round(F.stddev_pop("value"), 4).alias("std"))
    return g.where("n >= 400")


@query("A22_dominant_key", "SELECT d, orbit FROM (SELECT CAST(ts AS DATE) AS d, orbit, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY count(*) DESC, orbit) AS k FROM scenes GROUP BY 1, 2) WHERE k = 1", "scenes")
def _(v):
    n = v.scenes.groupBy(day(), "orbit").agg(F.count("*").alias("n"))
    return n.groupBy("d").agg(F.min_by("orbit", F.struct(-c("n"), "orbit")).alias("orbit"))


@query("A23_fill_rate", "SELECT count(*) AS n, count(value) AS filled, round(count(value) / count(*), 6) AS rate, count(DISTINCT sensor) AS sensors, min(value) AS lo, max(value) AS hi FROM dirty", "dirty")
def _(v):
    return v.dirty.agg(F.count("*").alias("n"), F.count("value").alias("filled"), R6(F.count("value") / F.count("*")).alias("rate"), F.count_distinct("sensor").alias("sensors"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("A24_roi_stats", "SELECT scene, orbit, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM pixels WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6 GROUP BY 1, 2", "pixels")
def _(v):
    return v.pixels.where("x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6").groupBy("scene", "orbit").agg(R6(F.avg("value")).alias("mean"), R6(F.stddev_pop("value")).alias("std"))


@query("A25_stack_scalars", "SELECT round(quantile_cont(abs(N - R), 0.5), 6) AS sigma, round(max(N), 6) AS top, round(avg(R), 6) AS mean FROM refl", "refl")
def _(v):
    sigma = st.quantile(v.refl, F.abs(c("N") - c("R")), 0.5)
    return v.refl.agg(R6(F.lit(sigma).cast("double")).alias("sigma"), R6(F.max("N")).alias("top"), R6(F.avg("R")).alias("mean"))


@query("A26_colour_ratio", "SELECT scene, round(avg(G) / nullif(avg(R) + avg(G) + avg(B), 0), 3) AS gcc FROM refl GROUP BY 1", "refl")
def _(v):
    m = F.avg
    return v.refl.groupBy("scene").agg(F.round(F.try_divide(m("G"), m("R") + m("G") + m("B")), 3).alias("gcc"))


@query("A27_gridded_minimum", "SELECT zx, zy, round(stddev_pop(m), 6) AS std FROM (SELECT scene, x // 2 AS zx, y // 2 AS zy, min(value) AS m FROM pixels GROUP BY 1, 2, 3) GROUP BY 1, 2", "pixels")
def _(v):
    half = lambda k: F.floor(c(k) / 2).alias(f"z{k}")
    m = v.pixels.groupBy("scene", half("x"), half("y")).agg(F.min("value").alias("m"))
    return m.groupBy("zx", "zy").agg(R6(F.stddev_pop("m")).alias("std"))


@query(
    "A28_day_height_grid",
    "+g AS (SELECT CAST(h AS INT) AS height, CAST(dd AS DATE) AS d FROM range(1, 8) a(h), unnest(generate_series((SELECT min(d) FROM profile), (SELECT max(d) FROM profile), INTERVAL 1 DAY)) b(dd)), m AS (SELECT d, height, avg(lin_pai) AS v FROM profile GROUP BY 1, 2) SELECT d, height, round(v, 6) AS v FROM g LEFT JOIN m USING (d, height)",
    "profile",
)
def _(v):
    m = v.profile.groupBy("d", "height").agg(R6(F.avg("lin_pai")).alias("v"))
    grid = joins.calendar(v.profile.select("d"), "d").withColumn("height", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return grid.join(m, ["d", "height"], "left").select("d", "height", "v")


@query("A29_representative_day", "SELECT variable, y, m, d, round(value, 4) AS value FROM (SELECT *, year(d) AS y, month(d) AS m, row_number() OVER (PARTITION BY variable, year(d), month(d) ORDER BY abs(day(d) - 20), d) AS k FROM panel) WHERE k = 1", "panel")
def _(v):
    p = v.panel.withColumn("y", F.year("d")).withColumn("m", F.month("d")).withColumn("off", F.abs(F.day("d") - 20))
    return rowwise.keep_one(p, ["variable", "y", "m"], ["off", "d"]).select("variable", "y", "m", "d", F.round("value", 4).alias("value"))


@query("A30_rollup", "SELECT plot, profile, count(*) AS n, round(avg(value), 6) AS mean FROM hier GROUP BY ROLLUP (plot, profile)", "hier")
def _(v):
    return v.hier.rollup("plot", "profile").agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean"))
