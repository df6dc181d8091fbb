"""Queries on optical and radar indices and neighbourhoods (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as ix
from ..operators import profiles, rasters
from ..operators import statistics as st
from .registry import query

c = F.col
R6 = lambda x: F.round(x, 6)
ID = ("l_orderkey", "l_linenumber")
RATIO = lambda a, b: f"({a} - {b}) / nullif({a} + {b}, 0)"
PIX = "SELECT l_orderkey, l_linenumber, "


@query("X01_normalised", f"{PIX}round({RATIO('N', 'R')}, 6) AS ndvi, round({RATIO('N', 'S1')}, 6) AS ndwi, round({RATIO('G', 'RE1')}, 6) AS cci FROM refl", "refl")
def _(v):
    return v.refl.select(*ID, *[R6(ix.OPTICAL[k]()).alias(k) for k in ("ndvi", "ndwi", "cci")])


@query("X02_evi", f"{PIX}round(2.5::DOUBLE * (N - R) / nullif(N + 6 * R - 7.5::DOUBLE * B + 1, 0), 6) AS evi FROM refl", "refl")
def _(v):
    return v.refl.select(*ID, R6(ix.OPTICAL["evi"]()).alias("evi"))


@query("X03_vegetation", f"{PIX}round({RATIO('N', 'R')} * N, 6) AS nirv, round(1.5::DOUBLE * (N - R) / (N + R + 0.5::DOUBLE), 6) AS savi, round(N / nullif(RE1, 0) - 1, 6) AS cire, round((N - RE1) / nullif(RE1 - R, 0), 6) AS mtci, round(((RE1 - R) - 0.2::DOUBLE * (RE1 - G)) * (RE1 / (CASE WHEN R = 0 THEN 1e-6::DOUBLE ELSE R END)), 6) AS mcari FROM refl", "refl")
def _(v):
    return v.refl.select(*ID, *[R6(ix.OPTICAL[k]()).alias(k) for k in ("nirv", "savi", "cire", "mtci", "mcari")])


@query("X04_kernel_ndvi", f"+s AS (SELECT quantile_cont(abs(N - R), 0.5) AS sigma FROM refl), k AS (SELECT *, exp(-((N - R) ** 2) / (2 * sigma * sigma)) AS k FROM refl, s) {PIX}round(tanh(pow({RATIO('N', 'R')}, 2)), 6) AS kndvi, round((1 - k) / (1 + k), 6) AS kernel FROM k", "refl")
def _(v):
    sigma = F.lit(st.quantile(v.refl, F.abs(c("N") - c("R")), 0.5)).cast("double")
    return v.refl.select(*ID, R6(ix.kndvi("N", "R")).alias("kndvi"), R6(ix.kernel_ndvi("N", "R", sigma)).alias("kernel"))


@query("X05_scale", "+m AS (SELECT max(N) AS top FROM refl) SELECT l_orderkey, l_linenumber, round(CASE WHEN top > 0.5 THEN N / 10000 ELSE N END, 9) AS scaled FROM refl, m", "refl")
def _(v):
    top = v.refl.agg(F.max("N").alias("top"))
    return v.refl.join(F.broadcast(top)).select(*ID, F.round(F.when(c("top") > 0.5, c("N") / 10000).otherwise(c("N")), 9).alias("scaled"))


@query("X06_radar", f"+p AS (SELECT *, pow(10.0::DOUBLE, VV / 10) AS a, pow(10.0::DOUBLE, VH / 10) AS b FROM radar) {PIX}round(VV - VH, 6) AS ratio_db, round(10 * log10(a + b), 6) AS span, round(4 * b / (a + b), 6) AS rvi FROM p", "radar")
def _(v):
    return v.radar.select(*ID, R6(c("VV") - c("VH")).alias("ratio_db"), R6(ix.RADAR["span"]()).alias("span"), R6(ix.RADAR["rvi"]()).alias("rvi"))


@query("X07_cross_ratios", f"+p AS (SELECT *, pow(10.0::DOUBLE, VV / 10) AS a, pow(10.0::DOUBLE, VH / 10) AS b FROM radar) {PIX}round(VH - VV, 6) AS cr_db, round(b / a, 6) AS vh_vv, round(a / b, 6) AS vv_vh FROM p", "radar")
def _(v):
    return v.radar.select(*ID, *[R6(ix.RADAR[k]()).alias(k) for k in ("cr_db", "vh_vv", "vv_vh")])


@query("X08_angle", f"{PIX}round(VV + 20 * log10(cos(radians(40)) / cos(radians(angle))), 6) AS vv40 FROM radar", "radar")
def _(v):
    return v.radar.select(*ID, R6(ix.angle_normalised("VV", "angle")).alias("vv40"))


@query("X09_mask", f"{PIX}CASE WHEN CAST(l_linenumber AS INT) NOT IN (1, 3) AND R < 0.4 THEN N END AS clear FROM refl", "refl")
def _(v):
    return v.refl.select(*ID, F.when(~c("l_linenumber").isin(1, 3) & (c("R") < 0.4), c("N")).alias("clear"))


@query("X10_lee", "+n AS (SELECT p.scene, p.x, p.y, any_value(p.value) AS value, avg(q.value) AS m, var_pop(q.value) AS v FROM pixels p JOIN pixels q ON q.scene = p.scene AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3), s AS (SELECT scene, var_pop(value) AS sv FROM pixels GROUP BY 1) SELECT scene, x, y, round(m + v / (v + sv) * (value - m), 6) + 0.0::DOUBLE AS filtered FROM n JOIN s USING (scene)", "pixels")
def _(v):
    return rasters.lee(v.pixels, ["scene"], 3).select("scene", "x", "y", (R6("filtered") + 0.0).alias("filtered"))


@query("X10_lee_mosaic", "+mo AS (SELECT scene % 5 AS mosaic, CAST(scene // 5 % 40 * 8 + x AS INT) AS x, CAST(scene // 200 * 8 + y AS INT) AS y, value FROM pixels), n AS (SELECT p.mosaic, p.x, p.y, any_value(p.value) AS value, avg(q.value) AS m, var_pop(q.value) AS v FROM mo p JOIN mo q ON q.mosaic = p.mosaic AND abs(q.x - p.x) <= 3 AND abs(q.y - p.y) <= 3 GROUP BY 1, 2, 3), s AS (SELECT mosaic, var_pop(value) AS sv FROM mo GROUP BY 1) SELECT mosaic, x, y, round(m + v / (v + sv) * (value - m), 6) + 0.0::DOUBLE AS filtered FROM n JOIN s USING (mosaic)", "pixels")
def _(v):
    """The 7 x 7 filter over mosaics of the scenes, which span several tiles."""
    return rasters.lee(mosaics(v), ["mosaic"], 7).select("mosaic", "x", "y", (R6("filtered") + 0.0).alias("filtered"))


def mosaics(v):
    """Five rasters of forty scenes a row."""
    return v.pixels.select((c("scene") % 5).alias("mosaic"), (F.floor(c("scene") / 5) % 40 * 8 + c("x")).cast("int").alias("x"), (F.floor(c("scene") / 200) * 8 + c("y")).cast("int").alias("y"), "value")


@query("X11_focal", "SELECT p.scene, p.x, p.y, round(min(q.value), 6) AS lo, round(quantile_cont(q.value, 0.5), 6) AS med FROM pixels p JOIN pixels q ON q.scene = p.scene AND abs(q.x - p.x) + abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3", "pixels")
def _(v):
    f = rasters.focal(v.pixels, ["scene"], rasters.circle(1), {"lo": "min", "med": "median"})
    return f.select("scene", "x", "y", R6("lo").alias("lo"), R6("med").alias("med"))


@query("X12_collection", "SELECT event_id FROM scenes WHERE orbit = 'DESCENDING' AND ts >= DATE '2024-01-10' AND ts < DATE '2024-01-20'", "scenes")
def _(v):
    return v.scenes.where((c("orbit") == "DESCENDING") & (c("ts") >= F.lit("2024-01-10").cast("timestamp")) & (c("ts") < F.lit("2024-01-20").cast("timestamp"))).select("event_id")


@query("X13_band_response", "SELECT scene, round(sum(value * w) / sum(w), 6) AS band FROM pixels JOIN (SELECT CAST(i AS INT) AS x, exp(-((i - 3.5::DOUBLE) ** 2) / 4) AS w FROM range(8) r(i)) USING (x) GROUP BY 1", "pixels")
def _(v):
    srf = v.spark.range(8).select(c("id").cast("int").alias("x"), F.exp(-F.pow(c("id") - 3.5, F.lit(2)) / 4).alias("w"))
    return v.pixels.join(F.broadcast(srf), "x").groupBy("scene").agg(R6(F.sum(c("value") * c("w")) / F.sum("w")).alias("band"))


@query("X14_explained_fraction", "SELECT plot, round((avg(value) FILTER (depth % 2 = 0) - avg(value) FILTER (depth % 2 = 1)) / 500, 6) AS fraction, sign(avg(value) FILTER (depth % 2 = 0) - avg(value) FILTER (depth % 2 = 1)) > 0 AS agrees FROM hier GROUP BY 1", "hier")
def _(v):
    delta = F.avg(F.when(c("depth") % 2 == 0, c("value"))) - F.avg(F.when(c("depth") % 2 == 1, c("value")))
    return v.hier.groupBy("plot").agg(delta.alias("_d")).select("plot", R6(c("_d") / 500).alias("fraction"), (F.signum("_d") > 0).alias("agrees"))


#: Leaf area indices of the sweep.
SWEEP = [2.0, 2.5, 3.0, 4.0, 5.0, 6.0]


@query(
    "X14_sweep",
    "WITH tb AS (SELECT l_returnflag AS k, CAST(l_linenumber AS DOUBLE) AS x, floor(l_quantity / 10) * 10 AS y, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3), "
    "cs AS (SELECT l_returnflag AS k, avg(l_quantity) FILTER (l_linestatus = 'O') AS a, avg(l_quantity) FILTER (l_linestatus <> 'O') + 7.5::DOUBLE AS b, avg(l_tax) FILTER (l_linenumber = 1) - avg(l_tax) FILTER (l_linenumber = 2) AS d FROM lineitem GROUP BY 1), "
    f"pt AS (SELECT * FROM cs, (VALUES {', '.join(f'({s}::DOUBLE)' for s in SWEEP)}) w(x)), "
    "ev AS (SELECT k, x, d, w, t, greatest(ceil(x) - 1, 1) AS x0, greatest((ceil(t / 10) - 1) * 10, 0) AS y0 FROM (SELECT k, x, d, unnest(['b', 'e']) AS w, unnest([a, b]) AS t FROM pt)), "
    "iv AS (SELECT e.k, e.x, e.d, e.w, v00.v * (1 - e.x + e.x0) * (1 - (t - y0) / 10) + v01.v * (1 - e.x + e.x0) * (t - y0) / 10 + v10.v * (e.x - e.x0) * (1 - (t - y0) / 10) + v11.v * (e.x - e.x0) * (t - y0) / 10 AS s FROM ev e "
    "LEFT JOIN tb v00 ON v00.k = e.k AND v00.x = x0 AND v00.y = y0 LEFT JOIN tb v01 ON v01.k = e.k AND v01.x = x0 AND v01.y = y0 + 10 LEFT JOIN tb v10 ON v10.k = e.k AND v10.x = x0 + 1 AND v10.y = y0 LEFT JOIN tb v11 ON v11.k = e.k AND v11.x = x0 + 1 AND v11.y = y0 + 10), "
    "p AS (SELECT k, x, any_value(d) AS d, max(s) FILTER (w = 'b') AS sb, max(s) FILTER (w = 'e') AS se FROM iv GROUP BY 1, 2) "
    "SELECT k AS \"index\", x AS lai, round(sb, 6) AS sim_baseline, round(se, 6) AS sim_event, round(se - sb, 6) AS d_sim, round(d, 6) AS d_obs, round(CASE WHEN abs(d) > 1e-6 THEN (se - sb) / d END, 4) AS fraction, CASE WHEN (se - sb) * d > 0 THEN 'same' ELSE 'opp' END AS sign FROM p",
)
def _(v):
    """Three indices over a table of leaf area by leaf angle: what the change of angle explains of the observed change, for each assumed leaf area."""
    li = v.table("lineitem")
    lut = li.groupBy(c("l_returnflag").alias("index"), c("l_linenumber").cast("double").alias("lai"), (F.floor(c("l_quantity") / 10) * 10).cast("double").alias("angle")).agg(F.avg("l_discount").alias("value"))
    early = c("l_linestatus") == "O"
    mean = lambda x, when: F.avg(F.when(when, c(x)))
    cases = li.groupBy(c("l_returnflag").alias("index")).agg(mean("l_quantity", early).alias("before"), (mean("l_quantity", ~early) + 7.5).alias("after"), (mean("l_tax", c("l_linenumber") == 1) - mean("l_tax", c("l_linenumber") == 2)).alias("d_obs"))
    out = profiles.explained_fractions(cases, lut, "index", "lai", "angle", SWEEP)
    return out.select("index", "lai", *[R6(k).alias(k) for k in ("sim_baseline", "sim_event", "d_sim", "d_obs")], F.round("fraction", 4).alias("fraction"), "sign")


@query("X15_change_report", "SELECT variable, round(b - a, 6) AS change, round(100 * (b - a) / nullif(a, 0), 6) AS pct FROM (SELECT variable, avg(value) FILTER (year(d) = 1994) AS a, avg(value) FILTER (year(d) = 1995) AS b FROM panel GROUP BY 1)", "panel")
def _(v):
    s = v.panel.groupBy("variable").agg(F.avg(F.when(F.year("d") == 1994, c("value"))).alias("a"), F.avg(F.when(F.year("d") == 1995, c("value"))).alias("b"))
    return s.select("variable", R6(c("b") - c("a")).alias("change"), R6(100 * F.try_divide(c("b") - c("a"), "a")).alias("pct"))


@query("X16_catalogue", f"{PIX}round({RATIO('N', 'R')}, 6) AS ndvi, round({RATIO('N', 'R')} * N, 6) AS nirv, round(tanh(pow({RATIO('N', 'R')}, 2)), 6) AS kndvi FROM refl", "refl")
def _(v):
    return ix.attach(v.refl, {k: ix.OPTICAL[k] for k in ("ndvi", "nirv", "kndvi")}).select(*ID, *[R6(k).alias(k) for k in ("ndvi", "nirv", "kndvi")])


