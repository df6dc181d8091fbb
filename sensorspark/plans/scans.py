"""Queries on scans, files and user-defined functions (S, V), on the tables that stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers
from .registry import query

c = F.col
R6 = lambda x: F.round(x, 6)


@query("S02_row_mean", "SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS flag, round((l_quantity + l_discount) / 2, 6) AS mean FROM lineitem")
def _(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("flag"), R6((c("l_quantity").try_cast("double") + c("l_discount")) / 2).alias("mean"))


@query("S04_first_value_wide", "+f AS (SELECT CAST(ts AS DATE) AS d, stream, arg_min(value, event_id) AS v FROM obs GROUP BY 1, 2) SELECT d, max(v) FILTER (stream = 'click') AS click, max(v) FILTER (stream = 'view') AS view FROM f GROUP BY 1", "obs")
def _(v):
    return v.obs.groupBy(F.to_date("ts").alias("d")).pivot("stream", ["click", "view"]).agg(F.min_by("value", "event_id"))


@query("S05_wide_to_long", "SELECT l_orderkey, l_linenumber, 'swp_' || name AS sensor, value FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_discount, l_tax))")
def _(v):
    li = v.table("lineitem")
    found = [n for n in li.columns if n in ("l_discount", "l_tax")]
    return li.unpivot(["l_orderkey", "l_linenumber"], found, "name", "value").select("l_orderkey", "l_linenumber", F.concat(F.lit("swp_"), "name").alias("sensor"), "value")


@query("S06_id_from_name", "SELECT receiver, count(*) AS n FROM (SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS receiver, page_id FROM pages) WHERE receiver IN ('en', 'de') AND page_id >= 30 GROUP BY 1")
def _(v):
    p = v.table("pages").select(F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("receiver"), "page_id")
    return p.where(c("receiver").isin("en", "de") & (c("page_id") >= 30)).groupBy("receiver").agg(F.count("*").alias("n"))


@query("S07_year_filter", "SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders WHERE year(o_orderdate) = 1996")
def _(v):
    """Bounds on the column itself, so the scan skips row groups."""
    o = v.table("orders").where((c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return o.select(F.to_date("o_orderdate").alias("d"), "o_orderkey")


@query("S09_filter_ordered_export", "SELECT event_id, sensor, value FROM obs WHERE hour(ts) = 5", "obs")
def _(v):
    return v.obs.where(F.hour("ts") == 5).orderBy("ts", "event_id").select("event_id", "sensor", "value")


@query("S10_column_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(v):
    return v.table("lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("S11_first_scene", "SELECT l_partkey, l_suppkey, arg_min(l_quantity, struct_pack(a := l_orderkey, b := l_linenumber)) AS q FROM lineitem GROUP BY 1, 2")
def _(v):
    """Of rows that several sources hold, the first source's."""
    li = v.table("lineitem").select("l_partkey", "l_suppkey", F.struct(c("l_orderkey").alias("a"), c("l_linenumber").alias("b")).alias("source"), c("l_quantity").alias("q"))
    return readers.first_scenes(li, ["l_partkey", "l_suppkey"], "source").select("l_partkey", "l_suppkey", "q")


@query("S12_band_selection", "SELECT scene, round(avg(value) FILTER (x = 1), 6) AS b1, round(avg(value) FILTER (x = 2), 6) AS b2 FROM pixels WHERE x IN (1, 2) GROUP BY 1", "pixels")
def _(v):
    return v.pixels.where("x IN (1, 2)").groupBy("scene").pivot("x", [1, 2]).agg(R6(F.avg("value"))).toDF("scene", "b1", "b2")


@query("S13_json_frames", "SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def _(v):
    e = v.events.select("event_type", F.from_json("props", "k int").getField("k").alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean"))


@query("S13_nested_turns", "SELECT role, count(*) AS n, sum(turn)::BIGINT AS turns FROM conversations GROUP BY 1")
def _(v):
    """Grouped to arrays of structs and exploded back."""
    nested = v.table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("frames"))
    return nested.select(F.explode("frames").alias("f")).groupBy("f.role").agg(F.count("*").alias("n"), F.sum("f.turn").alias("turns"))


@query("S14_frame_metadata", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute FROM events WHERE event_type = 'click'")
def _(v):
    return v.events.where("event_type = 'click'").select("event_id", F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute"))


@query("S17_pending_tasks", "SELECT stream, d FROM (SELECT DISTINCT stream FROM obs), (SELECT DISTINCT CAST(ts AS DATE) AS d FROM obs) EXCEPT SELECT stream, CAST(ts AS DATE) FROM obs WHERE value > 50", "obs")
def _(v):
    days = v.obs.select(F.to_date("ts").alias("d")).distinct()
    tasks = days.withColumn("stream", F.explode(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])))).join(v.obs.select("stream").distinct(), "stream", "left_semi")
    done = v.obs.where("value > 50").select("stream", F.to_date("ts").alias("d")).distinct()
    return tasks.join(done, ["stream", "d"], "left_anti").select("stream", "d")


@query("S18_names_histogram", "SELECT CAST(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS INT) % 24 AS h, count(*) AS n FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]+') GROUP BY 1")
def _(v):
    p = v.table("pages").where(c("url").rlike("/(en|fr)/[0-9]+"))
    return p.groupBy((F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).cast("int") % 24).alias("h")).agg(F.count("*").alias("n"))


@query("S22_iso_times", "SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS seconds FROM events WHERE event_type = 'error'")
def _(v):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return v.events.where("event_type = 'error'").select("event_id", F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))).alias("seconds"))


@query("P14_coordinate_check", "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(greatest(abs(x), abs(y))) <= 360 AS degrees FROM pixels", "pixels")
def _(v):
    return v.pixels.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.max(F.greatest(F.abs("x"), F.abs("y"))) <= 360).alias("degrees"))
