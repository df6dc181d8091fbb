"""Queries on time handling, scalar functions, projections and row-wise reductions (T and P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefns as t
from ..operators import ordering, rowwise
from .registry import query

c = F.col
R6 = lambda x: F.round(x, 6)
STAMP = "yyyy-MM-dd HH:mm:ss"


@query(
    "T01_parse_mixed",
    "SELECT event_id, strftime(CASE WHEN event_id % 5 = 0 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
)
def _(v):
    text = F.when(c("event_id") % 5 == 0, F.date_format("ts", "M/d/yyyy")).otherwise(F.date_format("ts", "M/d/yyyy H:mm"))
    return v.events.select("event_id", F.date_format(t.parse_mixed(text), STAMP).alias("parsed"))


@query("T02_fixed_offset_to_utc", "SELECT event_id, strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def _(v):
    return v.events.select("event_id", F.date_format(t.fixed_to_utc(c("ts")), STAMP).alias("utc"))


@query("T03_sentinels", "SELECT event_id, CASE WHEN abs(value + 9999) < 1 THEN NULL ELSE value END AS value FROM dirty", "dirty")
def _(v):
    return t.replace_sentinels(v.dirty).select("event_id", "value")


@query(
    "T04_daylight_saving",
    "+z AS (SELECT *, kind = 0 AND wall >= night + INTERVAL 2 HOUR AND wall < night + INTERVAL 3 HOUR AS twice FROM clocks), "
    "b AS (SELECT event_id, sensor, night, seq, wall < lag(wall) OVER (PARTITION BY sensor, night ORDER BY seq) AS back FROM z WHERE twice), p AS (SELECT event_id, coalesce(bool_or(back) OVER (PARTITION BY sensor, night ORDER BY seq), false) AS again FROM b) "
    "SELECT event_id, strftime(CASE WHEN kind = 2 THEN wall - INTERVAL 2 HOUR WHEN kind = 1 AND wall >= night + INTERVAL 2 HOUR AND wall < night + INTERVAL 3 HOUR THEN night + INTERVAL 1 HOUR WHEN kind = 1 AND wall >= night + INTERVAL 3 HOUR THEN wall - INTERVAL 2 HOUR "
    "WHEN kind = 1 THEN wall - INTERVAL 1 HOUR WHEN again OR wall >= night + INTERVAL 3 HOUR THEN wall - INTERVAL 1 HOUR ELSE wall - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc FROM z LEFT JOIN p USING (event_id)",
    "clocks",
)
def _(v):
    """Both changes of five years and summer days: skipped times become the gap's end, twice-shown ones are told by the order of reading."""
    return t.local_to_utc(v.clocks, ["sensor"], "seq", "wall", "Europe/Berlin").select("event_id", F.date_format("utc", STAMP).alias("utc"))


@query("T05_ensure_utc", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def _(v):
    return v.events.select("event_id", F.unix_micros("ts").alias("micros"))


@query("T06_floor", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, CAST(ts AS DATE) AS d, strftime(ts, '%Y%m%d') AS ymd FROM events")
def _(v):
    return v.events.select("event_id", F.date_format(F.date_trunc("minute", "ts"), STAMP).alias("minute"), F.to_date("ts").alias("d"), F.date_format("ts", "yyyyMMdd").alias("ymd"))


@query("T07_calendar_parts", "SELECT event_id, year(ts) AS y, month(ts) AS m, dayofyear(ts) AS doy, weekofyear(ts) AS w, hour(ts) AS h, round(hour(ts) + minute(ts) / 60.0::DOUBLE, 6) AS dec_hour FROM events")
def _(v):
    return v.events.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofyear("ts").alias("doy"), F.weekofyear("ts").alias("w"), F.hour("ts").alias("h"), R6(t.decimal_hour(c("ts"))).alias("dec_hour"))


@query("T08_day_of_instant", "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1")
def _(v):
    return v.events.groupBy(c("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))


@query("T09_numeric_coercion", "SELECT page_id, try_cast(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS DOUBLE) AS number, try_cast(substr(url, 1, 4) AS DOUBLE) AS nothing FROM pages")
def _(v):
    number = F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1)
    return v.table("pages").select("page_id", number.try_cast("double").alias("number"), F.substring("url", 1, 4).try_cast("double").alias("nothing"))


@query(
    "T10_strings",
    "SELECT page_id, lower(url) AS low, starts_with(url, 'https') AS secure, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape, lpad(CAST(page_id AS VARCHAR), 6, '0') AS padded FROM pages",
)
def _(v):
    return v.table("pages").select(
        "page_id", F.lower("url").alias("low"), c("url").startswith("https").alias("secure"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_replace("url", "[0-9]+", "#").alias("shape"), F.lpad(c("page_id").cast("string"), 6, "0").alias("padded")
    )


@query(
    "T11_maths",
    "SELECT event_id, round(sqrt(value), 6) AS root, round(log10(1 + value), 6) AS lg, round(ln(1 + value), 6) AS ln, round(exp(-value), 6) AS e, round(tanh(value / 100), 6) AS th, round(cos(radians(value)), 6) AS co, sign(value - 10) AS sg, greatest(5.0, least(20.0, value)) AS clipped, round(pow(value, 1.5::DOUBLE), 4) AS pw FROM events",
)
def _(v):
    x = c("value")
    return v.events.select("event_id", R6(F.sqrt(x)).alias("root"), R6(F.log10(1 + x)).alias("lg"), R6(F.log(1 + x)).alias("ln"), R6(F.exp(-x)).alias("e"), R6(F.tanh(x / 100)).alias("th"), R6(F.cos(F.radians(x))).alias("co"), F.signum(x - 10).cast("int").alias("sg"), t.clip(x, 5.0, 20.0).alias("clipped"), F.round(F.pow(x, F.lit(1.5)), 4).alias("pw"))


@query("T12_decibels", "SELECT l_orderkey, l_linenumber, round(pow(10.0::DOUBLE, VV / 10), 6) AS linear, round(10 * log10(pow(10.0::DOUBLE, VV / 10) + pow(10.0::DOUBLE, VH / 10)), 6) AS back FROM radar", "radar")
def _(v):
    lin = t.db_to_linear(c("VV"))
    return v.radar.select("l_orderkey", "l_linenumber", R6(lin).alias("linear"), R6(t.linear_to_db(lin + t.db_to_linear(c("VH")))).alias("back"))


@query("T13_std_to_decibels", "SELECT scene, round(10 / ln(10) * stddev_pop(p) / avg(p), 6) AS std_db FROM (SELECT scene, pow(10.0::DOUBLE, VV / 10) AS p FROM radar) GROUP BY scene", "radar")
def _(v):
    p = v.radar.select("scene", t.db_to_linear(c("VV")).alias("p"))
    return p.groupBy("scene").agg(R6(t.std_to_db(F.avg("p"), F.stddev_pop("p"))).alias("std_db"))


@query("T14_encoder_offset", "SELECT scan, count(*) AS n, round(min(zenith - mid), 6) AS lo, round(max(zenith - mid), 6) AS hi FROM (SELECT scan, zenith, (min(zenith) OVER w + max(zenith) OVER w) / 2 AS mid FROM shots WINDOW w AS (PARTITION BY scan)) GROUP BY scan", "shots")
def _(v):
    shifted = rowwise.centre(v.shots, "scan", "zenith")
    return shifted.groupBy("scan").agg(F.count("*").alias("n"), R6(F.min("zenith")).alias("lo"), R6(F.max("zenith")).alias("hi"))


@query("T15_registry", "SELECT stream, coalesce(label, 'Other') AS label, coalesce(rank, 99) AS rank, count(*) AS n FROM obs LEFT JOIN (VALUES ('click', 'Clicks', 1), ('view', 'Views', 2)) r(s, label, rank) ON s = stream GROUP BY 1, 2, 3", "obs")
def _(v):
    reg = v.spark.createDataFrame([("click", "Clicks", 1), ("view", "Views", 2)], "stream string, label string, rank int")
    return rowwise.look_up(v.obs, reg, "stream", {"label": "Other", "rank": 99}).groupBy("stream", "label", "rank").agg(F.count("*").alias("n"))


@query("T16_seasons", "SELECT CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) <= 5 THEN 'spring' WHEN month(d) <= 8 THEN 'summer' ELSE 'autumn' END AS season, count(*) AS n, round(avg(value), 4) AS mean FROM panel GROUP BY 1", "panel")
def _(v):
    return v.panel.groupBy(t.season(F.month("d")).alias("season")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("T17_hours_past_midnight", "SELECT stream, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 3) AS night, count(*) FILTER (hour(ts) >= 12 AND hour(ts) < 16) AS noon FROM obs GROUP BY 1", "obs")
def _(v):
    h = F.hour("ts")
    return v.obs.groupBy("stream").agg(F.count_if(t.in_hours(h, 22, 3)).alias("night"), F.count_if(t.in_hours(h, 12, 16)).alias("noon"))


@query("P01_select_available", "SELECT event_id, value AS reading, user_id AS sensor FROM events")
def _(v):
    return rowwise.select_available(v.table("events"), {"event_id": "event_id", "value": "reading", "user_id": "sensor", "tair": "tair_c"})


@query("P02_depth_profiles", "SELECT 'A' AS profile, CAST(l_linenumber * 5 AS INT) AS depth_cm, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 2")
def _(v):
    wide = v.table("lineitem").groupBy("l_orderkey").pivot("l_linenumber", list(range(1, 8))).agg(F.sum("l_quantity")).withColumnsRenamed({f"{i}": f"VWCSoil_A_{5 * i}cm" for i in range(1, 8)})
    return rowwise.depth_profiles(wide, ["l_orderkey"]).groupBy("profile", "depth_cm").agg(F.round(F.sum("value"), 4).alias("total"))


@query("P03_ensemble_stats", "SELECT l_orderkey, l_linenumber, round((u05 + u50 + u95) / 3, 7) AS mean, round(sqrt(((u05 - m) ** 2 + (u50 - m) ** 2 + (u95 - m) ** 2) / 2), 4) AS std FROM (SELECT *, (u05 + u50 + u95) / 3 AS m FROM ensembles)", "ensembles")
def _(v):
    s = rowwise.family(["u05", "u50", "u95"])
    return v.ensembles.select("l_orderkey", "l_linenumber", F.round(s["mean"], 7).alias("mean"), F.round(s["std"], 4).alias("std"))


@query("P04_row_reductions", "SELECT event_id, round(CASE WHEN value IS NULL THEN event_id % 7 ELSE (value + event_id % 7) / 2 END, 6) AS mean, round(list_median(list_filter([value, CAST(event_id % 7 AS DOUBLE), 3.0], lambda x: x IS NOT NULL)), 6) AS median FROM (SELECT event_id, CASE WHEN abs(value + 9999) < 1 THEN NULL ELSE value END AS value FROM dirty)", "dirty")
def _(v):
    d = t.replace_sentinels(v.dirty).withColumn("b", (c("event_id") % 7).cast("double")).withColumn("k", F.lit(3.0))
    return d.select("event_id", R6(rowwise.family(["value", "b"])["mean"]).alias("mean"), R6(rowwise.family(["value", "b", "k"])["median"]).alias("median"))


@query("P05_two_stage_mean", "SELECT plot, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, count(*) AS profiles FROM (SELECT plot, profile, avg(value) AS m FROM hier GROUP BY 1, 2) GROUP BY 1", "hier")
def _(v):
    return rowwise.two_stage_mean(v.hier, "plot", "profile").select("plot", R6("mean").alias("mean"), R6("std").alias("std"), "profiles")


@query("P06_iqr_guard", "SELECT profile, count(*) FILTER (ok) AS kept, round(avg(value) FILTER (ok), 6) AS mean FROM (SELECT profile, value, abs(value - quantile_cont(value, 0.5) OVER w) <= 0.8::DOUBLE * (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) AS ok FROM hier WINDOW w AS (PARTITION BY profile)) GROUP BY 1", "hier")
def _(v):
    return rowwise.iqr_guard(v.hier, ["profile"], "value", 0.8).groupBy("profile").agg(F.count("*").alias("kept"), R6(F.avg("value")).alias("mean"))


@query("P07_threshold", "SELECT count(*) AS n, round(avg(zenith), 6) AS mean FROM shots WHERE zenith >= 30", "shots")
def _(v):
    return v.shots.where("zenith >= 30").agg(F.count("*").alias("n"), R6(F.avg("zenith")).alias("mean"))


@query("P08_date_slice", "SELECT event_id FROM obs WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-08' AND hour(ts) BETWEEN 6 AND 18", "obs")
def _(v):
    return rowwise.between_days(v.obs, "ts", "2024-01-05", "2024-01-07").where(F.hour("ts").between(6, 18)).select("event_id")


@query("P09_scene_allow_list", "SELECT event_id, orbit FROM scenes WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM humid WHERE rh > 90)", "scenes humid")
def _(v):
    days = v.humid.where("rh > 90").select(F.to_date("ts").alias("d")).distinct()
    return v.scenes.withColumn("d", F.to_date("ts")).join(days, "d", "left_semi").select("event_id", "orbit")


@query("P10_families", "SELECT variable, count(*) AS n, ends_with(variable, 'HIGH') AS urgent FROM panel WHERE variable NOT LIKE '4%' GROUP BY 1", "panel")
def _(v):
    return v.panel.where(~c("variable").startswith("4")).groupBy("variable").agg(F.count("*").alias("n")).withColumn("urgent", c("variable").endswith("HIGH"))


@query("P12_quality_flags", "SELECT CAST(ts AS DATE) AS d, max(mm) > 1 AS flag_rain, NOT (max(mm) > 1) AND count(*) > 10 AS good FROM rain GROUP BY 1", "rain")
def _(v):
    g = v.rain.groupBy(F.to_date("ts").alias("d")).agg((F.max("mm") > 1).alias("flag_rain"), F.count("*").alias("n"))
    return g.select("d", "flag_rain", (~c("flag_rain") & (c("n") > 10)).alias("good"))


@query("P13_optional_criteria", "SELECT stream, count(*) AS n FROM obs WHERE value >= 5 GROUP BY 1", "obs")
def _(v):
    return v.obs.where(rowwise.criteria(value=(5.0, None), sensor=(None, None))).groupBy("stream").agg(F.count("*").alias("n"))


@query("P15_null_fill", "SELECT event_id, round(coalesce(value, avg(value) OVER (PARTITION BY stream)), 6) AS mean_filled, coalesce(value, 0.0) AS zero_filled FROM (SELECT event_id, stream, CASE WHEN abs(value + 9999) < 1 THEN NULL ELSE value END AS value FROM dirty)", "dirty")
def _(v):
    d = t.replace_sentinels(v.dirty)
    return rowwise.fill_mean(d, ["stream"], "value").select("event_id", R6("filled").alias("mean_filled"), F.coalesce("value", F.lit(0.0)).alias("zero_filled"))


@query("P16_drop_null_rows", "SELECT event_id FROM (SELECT event_id, CASE WHEN abs(value + 9999) < 1 THEN NULL ELSE value END AS value FROM dirty) WHERE value IS NOT NULL", "dirty")
def _(v):
    return t.replace_sentinels(v.dirty).na.drop(thresh=1, subset=["value"]).select("event_id")


@query("P17_keep_first", "SELECT sensor, d, event_id, value FROM (SELECT sensor, CAST(ts AS DATE) AS d, event_id, value, row_number() OVER (PARTITION BY sensor, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM obs) WHERE k = 1", "obs")
def _(v):
    return rowwise.keep_one(v.obs.withColumn("d", F.to_date("ts")), ["sensor", "d"], ["ts", "event_id"]).select("sensor", "d", "event_id", "value")


@query("P11_mask_negative", "SELECT depth, CASE WHEN value < 0 THEN NULL ELSE value END AS masked FROM hier", "hier")
def _(v):
    return v.hier.select("depth", F.when(c("value") >= 0, c("value")).alias("masked"))


@query("P18_optional_columns", "SELECT event_id, value, round(value * 2, 6) AS doubled FROM events")
def _(v):
    e = v.table("events")
    extra = [R6(c("value") * 2).alias("doubled")] if "value" in e.columns else []
    return e.select("event_id", "value", *extra, *[c(x) for x in ("u_star",) if x in e.columns])


@query("K01_sorts", "SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place FROM obs", "obs")
def _(v):
    return ordering.places(v.obs.select("event_id", "value"), [F.desc_nulls_last("value"), F.asc("event_id")]).select("event_id", "place")
