"""Steps whose work or memory would grow faster than the input: plans are looked at on the small tables, results held against brute force."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.operators import joins
from sensorspark.operators import statistics as st
from sensorspark.plans import catalog, streams
from sensorspark.sources import readers
from sensorspark.sources.views import Views
from sensorspark.streaming import jobs


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["G04_rain_lockout", "G19_weather_filter", "G20_scene_filter", "J06_nearest_without_tolerance", "J06_nearest_asof"])
def test_frames_only_grow(spark, tiny, name):
    """A frame that looks ahead, or slides over a maximum, is read anew for every row."""
    starts = re.findall(r"specifiedwindowframe\(\w+, ([^,]*),", optimized(catalog.queries()[name](spark, tiny)))
    assert starts and set(starts) == {"unboundedpreceding$()"}


def crowded(spark, n=600):
    """Rows of half a day, of which most share a few seconds; times repeat."""
    r = np.random.default_rng(4)
    at = np.where(r.random(n) < 0.7, 20_000 + r.integers(0, 20, n), r.integers(0, 43_200, n))
    v = np.round(r.random(n) * 10, 3)
    day = pd.Timestamp("2024-01-01")
    rows = [(i, (day + pd.Timedelta(seconds=int(s))).to_pydatetime(), float(x)) for i, (s, x) in enumerate(zip(at, v))]
    return at, v, spark.createDataFrame(rows + [(n, None, 9.9)], "id int, ts timestamp, v double")


def test_windows_around_a_time_match_brute_force(spark):
    at, v, df = crowded(spark)
    got = {x.id: x for x in joins.trailing_at(df, df, "id", "ts", {"n": ("count", "v", 600), "total": ("sum", "v", 600)}, after_s=60, half_open=False).collect()}
    assert len(got) == len(at) + 1 and got[len(at)].n == 0
    for i, s in enumerate(at):
        met = v[(at >= s - 600) & (at <= s + 60)]
        assert got[i].n == len(met) and got[i].total == pytest.approx(met.sum())


def test_time_since_the_last_flag_matches_brute_force(spark):
    at, v, df = crowded(spark)
    got = {x.id: x.since for x in joins.since_last(df, "ts", F.col("v") > 9.5).collect()}
    assert len(got) == len(at) + 1 and got[len(at)] is None
    for i, s in enumerate(at):
        flagged = at[(v > 9.5) & (at <= s)]
        assert got[i] == (1_000_000 * int(s - flagged.max()) if len(flagged) else None)


def test_interval_context_forms_no_pairs(spark, tiny):
    assert "sequence(" not in optimized(catalog.queries()["J09_interval_context"](spark, tiny))


def test_compaction_of_files_beyond_the_target(spark, tmp_path):
    for day in range(5):
        (tmp_path / "in" / "a").mkdir(parents=True, exist_ok=True)
        pd.DataFrame({"t": np.arange(500) + 1000 * day}).to_parquet(tmp_path / "in" / "a" / f"{day}.parquet")
    report = readers.compact(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", "/(a)/", "t", target_bytes=64, least_files=2).toPandas()
    sizes = report.groupby("bin").size().tolist()
    assert report["length"].min() > 64 and len(sizes) > 1 and min(sizes[:-1]) >= 2
    files = list((tmp_path / "out").rglob("*.parquet"))
    assert len(files) == len(sizes) and sum(len(pd.read_parquet(f)) for f in files) == 2500


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_quantiles_of_a_whole_table_are_exact(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    for q in (0.0, 0.31, 0.5, 1.0):
        assert st.quantile(df, F.col("x"), q) == (pytest.approx(np.quantile(x, q)) if n else None)


@pytest.mark.parametrize("name", ["A25_stack_scalars", "X04_kernel_ndvi"])
def test_no_median_of_a_whole_table_in_one_task(spark, tiny, name):
    assert "percentile(" not in optimized(catalog.queries()[name](spark, tiny))


def test_late_files_come_in_a_set_number_of_triggers(spark, tiny, monkeypatch):
    """A larger table has larger triggers, not more of them."""
    monkeypatch.setattr(streams, "FILE_ROWS", 50)  # several files for five days
    df = streams._late(Views(spark, tiny), "late")
    seen = []
    q = df.writeStream.foreachBatch(lambda batch, i: seen.append(batch.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) <= 7 and sum(seen) == 1000


def test_rows_wait_in_blocks(spark, tmp_path):
    """Many rows at once give the alerts that few at a time give."""
    at = np.arange(4000)
    v = np.random.default_rng(2).choice([0.0, 10.0, 30.0, 70.0], len(at))
    day = pd.Timestamp("2024-01-01")
    rows = [(int(i), (day + pd.Timedelta(minutes=int(i))).to_pydatetime(), 1, "a", float(x), "{}") for i, x in zip(at, v)]
    rows.append((9999, (day + pd.Timedelta(days=9)).to_pydatetime(), 1, "a", 30.0, "{}"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    got = []
    for name, sizes in (("many", [2500, 1500, 1]), ("few", [900] * 4 + [400, 1])):
        lo = 0
        for n in sizes:
            spark.createDataFrame(rows[lo : lo + n], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
            lo += n
        out = jobs.run(jobs.departures(jobs.events(spark, f"file://{tmp_path}/{name}", "*.parquet", 1), 60, 20, late="10 hours"), f"file://{tmp_path}/{name}-out")
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] and len(got[0]) > 100


@pytest.mark.parametrize("size", [1, 7, 2048])
def test_interval_join_writes_blocks_and_loses_no_pair(spark, tmp_path, size):
    """Three triggers of crowded rows, with ones exactly at both ends of the hours, of one time, without time and without id."""
    r = np.random.default_rng(size)
    day = pd.Timestamp("2024-01-01")
    at = [0, 43_200, 43_201, 86_400, 86_400, *map(int, r.choice(np.r_[np.full(60, 50_000), r.integers(0, 172_800, 60)], 175))]
    rows = [(i, (day + pd.Timedelta(seconds=s)).to_pydatetime(), 1, "purchase" if r.random() < 0.5 else "error", float(i), "{}") for i, s in enumerate(at)]
    rows += [(None, day.to_pydatetime(), 1, "error", 1.0, "{}"), (998, None, 1, "purchase", 1.0, "{}"), (999, None, 1, "error", 1.0, "{}")]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    e = jobs.events(spark, f"file://{tmp_path}/in", "*.parquet", 1)
    met = jobs.run(jobs.blocks_in_interval(e.where("stream = 'purchase'"), e.where("stream = 'error'"), late="5 days", size=size), f"file://{tmp_path}/out")
    pick = lambda kind: [(i, t, v) for i, t, _, s, v, _ in rows if s == kind and t is not None]
    want = [(s, w, v) for s, t, _ in pick("purchase") for w, u, v in pick("error") if t - pd.Timedelta(hours=12) < u <= t]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted((tuple(x) for x in jobs.pairs(met).select("scene", "weather", "value").collect()), key=key) == sorted(want, key=key)
    sizes = met.selectExpr("size(scenes) AS s", "size(weathers) AS w").toPandas()
    assert sizes.to_numpy().max() <= size and (size == 1 or len(sizes) < len(want) / 2)


def test_interval_join_stores_no_pairs(spark, tiny):
    """Pairs of rows grow with the square of the rows an hour: they are made where they are read."""
    assert optimized(catalog.queries()["R08_interval_join"](spark, tiny)).count("explode(") == 2


def test_interval_join_compares_times_only_at_the_ends(spark):
    """Blocks wholly within the hours, at either end of them (a weather row of the scene's time fits, one 12 hours before it doesn't), around a scene, and without any pair."""
    h = jobs.HOUR
    scenes, weather = [(1, 13 * h), (2, 13 * h + 5), (None, 14 * h)], [[2 * h, 9 * h], [h - 1, h, h + 1, h + 5, h + 6], [13 * h, 13 * h + 1, 13 * h + 5, 14 * h], [0, 20 * h], [14 * h + 1], [h]]
    rows, want = [], []
    for k, at in enumerate(weather):
        ids = [100 * k + i for i in range(len(at))]
        rows.append(([s for s, _ in scenes], [t for _, t in scenes], ids, at, [float(i) for i in ids]))
        want += [(s, t, w, u, float(w)) for s, t in scenes for w, u in zip(ids, at) if t - 12 * h < u <= t]
    blocks = spark.createDataFrame(rows, "scenes array<long>, scene_times array<long>, weathers array<long>, weather_times array<long>, values array<double>")
    got = jobs.pairs(blocks).select("scene", F.unix_micros("scene_ts"), "weather", F.unix_micros("weather_ts"), "value")
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    # a block whose pairs all fit carries no times to the loop over pairs
    assert "isnull(checked" in optimized(jobs.pairs(blocks).select("scene", "weather"))


def test_interval_join_writes_few_pairs_of_blocks(spark, tmp_path):
    """What the stream writes of a crowded slot grows with the square of its blocks: 3,000 rows of each kind are one block each."""
    at = pd.Timestamp("2024-01-01 01:00").to_pydatetime()
    rows = [(i, at, 1, "purchase" if i % 2 else "error", 1.0, "{}") for i in range(6000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    e = jobs.events(spark, f"file://{tmp_path}/in", "*.parquet", 1)
    met = jobs.run(jobs.blocks_in_interval(e.where("stream = 'purchase'"), e.where("stream = 'error'")), f"file://{tmp_path}/out")
    assert met.count() == 1 and jobs.pairs(met).count() == 9_000_000


def test_interval_join_reads_few_blocks_at_once(spark, tiny):
    """Spark decodes up to 4,096 rows of a file at once, and a row holds two blocks."""
    files = catalog.queries()["R08_interval_join"](spark, tiny.replace("sf0.001", "sf0.01")).inputFiles()
    rows = [spark.read.parquet(f).count() for f in files]
    assert sum(rows) > 1000 and max(rows) <= 64
