"""Operators whose results SQL can't give, and readers, on small inputs of their own."""

import itertools
import subprocess
import sys
import time
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.functions import timefns
from sensorspark.operators import changepoints as cp
from sensorspark.operators import joins, profiles, rasters, statistics, windows
from sensorspark.sources import readers
from sensorspark.streaming import jobs


def cost_of(y, model, edges):
    c = cp.segment_cost(y, model)
    return sum(float(np.atleast_1d(c(np.array([a]), b))[0]) for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("model", ["l2", "l1", "rbf", "normal"])
def test_breaks_are_optimal(model):
    r = np.random.default_rng(3)
    for _ in range(6):
        y = np.concatenate([r.normal(m, 1, 5) for m in r.normal(0, 3, 3)])
        n, size, pen = len(y), 2, 2.0
        every = [e for k in range(5) for e in itertools.combinations(range(size, n - size + 1), k) if all(b - a >= size for a, b in zip((0, *e), (*e, n)))]
        best = min(cost_of(y, model, (0, *e, n)) + pen * len(e) for e in every)
        got = cp.penalised_breaks(y, model, pen, size)
        assert cost_of(y, model, (0, *got, n)) + pen * len(got) <= best + 1e-9
        two = cp.fixed_breaks(y, model, 2, size)
        assert len(two) == 2 and cost_of(y, model, (0, *two, n)) <= min(cost_of(y, model, (0, *e, n)) for e in every if len(e) == 2) + 1e-9


def table_cost(y, model):
    """All segments' costs at once, the plain way."""
    n = len(y)
    if model == "l1":
        return lambda i, j: np.array([np.abs(y[a:j] - np.median(y[a:j])).sum() for a in np.atleast_1d(i)])
    d = (y[:, None] - y[None, :]) ** 2
    k = np.exp(-np.clip(d / np.median(d[np.triu_indices(n, 1)]), 1e-2, 1e2))
    np.fill_diagonal(k, 1)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = k.cumsum(0).cumsum(1)
    return lambda i, j: (j - i) - (area[j, j] - area[i, j] - area[j, i] + area[i, i]) / np.maximum(j - i, 1)


@pytest.mark.parametrize("model", ["l1", "rbf"])
def test_costs_in_linear_memory_equal_the_table(model):
    r = np.random.default_rng(8)
    for y in (np.concatenate([r.normal(m, 1, 400) for m in r.normal(0, 2, 5)]), r.integers(0, 4, 300).astype(float), np.arange(40.0), np.array([1.0, 5.0])):
        cost, table = cp.segment_cost(y, model), table_cost(y, model)
        for j in sorted(r.integers(1, len(y) + 1, 60)):
            i = np.arange(j)
            assert np.allclose(cost(i, j), table(i, j), atol=1e-6)
        if len(y) > 100:
            for scale in (1.0, 3.0):
                pen = cp.penalty_for(table, len(y), scale)
                assert np.isclose(cp.penalty_for(cost, len(y), scale), pen) and cp.penalised_breaks(y, model, pen, 5, cost) == cp.penalised_breaks(y, model, pen, 5, table)


def test_median_of_all_distances():
    r = np.random.default_rng(2)
    for y in (r.normal(0, 1, 501), r.integers(0, 3, 50).astype(float), np.zeros(4), np.array([3.0, 7.5]), np.array([1.0, 2.0, 4.0])):
        i = np.triu_indices(len(y), 1)
        assert np.isclose(cp.median_distance(y), np.median((y[i[0]] - y[i[1]]) ** 2), rtol=1e-12, atol=0)


@pytest.mark.parametrize("model", ["l1", "rbf"])
def test_long_series_stay_small(model):
    """50,000 rows, in a process of its own; a table of all segments would take 20 GB."""
    code = f"""
import resource
import numpy as np
from sensorspark.functions import timefns
from sensorspark.operators import changepoints as cp
r = np.random.default_rng(4)
y = np.concatenate([r.normal(m, 1, 500) for m in np.tile([0.0, 6.0], 50)])
found = cp.penalised_breaks(y, {model!r}, 40.0, 5)
assert len(found) == 99 and all(abs(b - 500 * (i + 1)) <= 3 for i, b in enumerate(found))
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 500_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])


@pytest.mark.parametrize("model", ["l2", "l1", "rbf"])
def test_units_change_no_break(model):
    r = np.random.default_rng(6)
    y = np.concatenate([r.normal(m, 1, 40) for m in (0, 4, 1)])
    assert [cp.series_onset(f * y + 7, "auto", model, [1.0, 3.0]) for f in (1e-3, 1.0, 1e4)] == [cp.series_onset(y, "auto", model, [1.0, 3.0])] * 3


def test_normal_cost_finds_one_jump():
    """The penalty is that of the series in its own unit: a scaled one's would be next to nothing, and breaks as many as fit."""
    r = np.random.default_rng(5)
    y = np.concatenate([r.normal(0, 3, 90), r.normal(40, 3, 90)])
    for scale in (1.0, 2.0, 4.0):
        ((onset, found),) = cp.series_onset(y, "increase", "normal", [scale])
        assert onset == 90 and len(found) <= 2


@pytest.mark.parametrize("direction", ["decrease", "increase", "auto"])
@pytest.mark.parametrize("rule", ["acute", "departure"])
def test_replicates_together_equal_one_by_one(direction, rule):
    r = np.random.default_rng(7)
    y = np.array([np.concatenate([r.normal(m, 1, 30) for m in r.normal(0, 2, 4)]) for _ in range(40)] + [np.zeros(120)])
    one = [cp.series_onset(x, direction, "l2", [1.0], rule)[0][0] for x in y]
    assert cp.replicate_onsets(y, direction, 1.0, rule, 5, cells=1000).tolist() == [-1 if o is None else o for o in one]


def test_bootstrap_finds_a_clear_break(spark):
    r = np.random.default_rng(0)
    rows = [("a", int(i), float(r.normal(0 if i < 30 else 5, 0.5))) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    b = cp.bootstrap_single_break(df, ["k"], "i", "v", replicates=40).first()
    assert abs(b.mid - 30) <= 1 and b.lo <= b.mid <= b.hi and b.replicates == 40


def test_student_tail(spark):
    df = spark.createDataFrame([(0.0, 10.0), (2.228139, 10.0), (-12.7062, 1.0), (1.96, 1e6)], "t double, d double")
    p = [r.p for r in df.select(statistics.student_p("t", "d").alias("p")).collect()]
    assert np.allclose(p, [1.0, 0.05, 0.05, 0.05], atol=1e-4)


def test_nearest_prefers_the_later_of_equals(spark):
    at = lambda s: pd.Timestamp(s if " " in s else f"2024-01-01 {s}").to_pydatetime()
    left = spark.createDataFrame([(1, at("10:00")), (2, at("23:59"))], "id int, ts timestamp")
    right = spark.createDataFrame([(at("09:50"), 1.0), (at("10:10"), 2.0), (at("2024-01-03 00:00"), 3.0)], "ts timestamp, v double")
    assert {r.id: r.v for r in joins.nearest(left, right, "ts", ["v"]).collect()} == {1: 2.0, 2: 2.0}
    assert {r.id: r.v for r in joins.nearest(left, right, "ts", ["v"], tolerance_s=660).collect()} == {1: 2.0, 2: None}


def test_savgol_keeps_parabolas_and_short_series(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(9)] + [("b", i, float(i % 2)) for i in range(4)], "k string, i int, v double")
    rows = windows.savgol(df, ["k"], "i", "v", 5).collect()
    assert all(abs(r.smooth - r.v) < 1e-9 for r in rows)


def write(path, name, text):
    (path / name).write_text(text)
    return f"file://{path}"


def test_readers(spark, tmp_path):
    station = write(tmp_path, "station.tsv", "Date Time\tTair\trH\n--\tdeg\t%\n1/2/2025 0:30\t3.5\t-9999\n1/2/2025\t-9999.3\t80\n")
    got = {(str(r.ts), r.name): r.value for r in readers.station(spark, f"{station}/station.tsv").collect()}
    assert got == {("2025-01-01 23:30:00", "Tair"): 3.5, ("2025-01-01 23:30:00", "rH"): None, ("2025-01-01 23:00:00", "Tair"): None, ("2025-01-01 23:00:00", "rH"): 80.0}
    d = tmp_path / "trees"
    d.mkdir()
    write(d, "a.csv", "Ts,TreeID,Species,Js_outer_cor,Js_inner_cor\n1/1/2025,H1,Oak,2,4\n1/1/2025 0:30,H1,Oak,,6\n")
    write(d, "b.csv", "Ts,TreeID,Species,Js_outer_cor,Js_inner_cor\nbad,H2,Oak,1,1\n1/1/2025,H2,Oak,x,\n")
    assert sorted((r.tree, r.value) for r in readers.trees(spark, f"file://{d}").collect() if r.value) == [("h1", 3.0), ("h1", 6.0)]
    p = write(tmp_path, "twd.csv", "TS,ID,twd\n1/1/2025,A,\n1/1/2025,A,5\n1/1/2025,A,7\n")
    assert [r.value for r in readers.dendrometers(spark, f"{p}/twd.csv").collect()] == [5.0]
    p = write(tmp_path, "swp.csv", "TS (CET),H1,H2\n1/1/2025 1:00,-0.5,NA\n")
    assert {r.sensor: r.value for r in readers.water_potential(spark, f"{p}/swp.csv").collect()} == {"swp_mpa_h1": -0.5, "swp_mpa_h2": None}
    j = tmp_path / "json"
    j.mkdir()
    write(j, "a.json", '{"frames": [{"timestamp": "2025-01-01 00:00:00", "predicted_mean_leaf_angle": 10}, {"timestamp": "missing", "predicted_mean_leaf_angle": 1}, {"timestamp": "2025-01-01 00:00:00", "predicted_mean_leaf_angle": 20}]}')
    write(j, "b.json", "{corrupt")
    assert [r.value for r in readers.frames(spark, f"file://{j}").collect()] == [15.0]
    s = tmp_path / "laser"
    s.mkdir()
    write(s, "a.csv", "# height: 1.5\n1,2,3,4,5,6,7,8\n1,2,x,4,5,6,7,8\n1,2\n# end = yes\n")
    assert readers.laser_shots(spark, f"file://{s}").count() == 1
    assert readers.laser_headers(spark, f"file://{s}").first().header == {"height": "1.5", "end": "yes"}
    p = write(tmp_path, "rain.csv", "From,Precipitation_Sum_mm\n2025-01-01T00:00:00Z,0.2\n")
    assert readers.precipitation(spark, f"{p}/rain.csv").first().mm == 0.2


def test_partition_sink_is_idempotent(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "cam string, day int, v double")
    readers.save(df, out, ["cam", "day"])
    readers.save(df.where("cam = 'a'").withColumn("v", F.lit(9.0)), out, ["cam", "day"])
    assert sorted((r.cam, r.v) for r in spark.read.parquet(out).collect()) == [("a", 9.0), ("b", 2.0)]
    readers.compact(spark, out, f"file://{tmp_path}/one", "cam=([^/]+)/", "v")
    assert sorted((r.group, r.v) for r in spark.read.parquet(f"file://{tmp_path}/one").collect()) == [("a", 9.0), ("b", 2.0)]


def scans_of(plan):
    """The file scans of an executed plan."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(p)
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_receivers_that_are_not_asked_for_stay_unopened(spark, tmp_path):
    for k in (1, 2, 3, 5):
        write(tmp_path, f"gnss_vod_Hartheim_GPS{k}_GPS1_2512_#x.csv", "datetime,nvod,theta,pool\n2025-07-01 00:00:00,0.4,35,a\n2025-07-01 00:30:00,0.5,10,a\n2025-07-01 01:00:00,x,30,b\n")
    path = f"file://{tmp_path}/gnss_vod_*.csv"
    df = readers.receivers(spark, path)
    got = sorted((r.receiver, str(r.ts), r.nvod, r.pool) for r in df.collect())
    assert got == sorted(x for k in (1, 3, 5) for x in ((f"gps{k}", "2025-06-30 23:00:00", 0.4, "a"), (f"gps{k}", "2025-07-01 00:00:00", None, "b")))
    one = readers.receivers(spark, path, only=("GPS2",))
    query = one._jdf.queryExecution()
    plan = query.executedPlan()
    assert plan.executeCollect().__len__() == 2
    assert [s.metrics().apply("numFiles").value() for s in scans_of(plan)] == [1]
    with pytest.raises(ValueError, match="no files"):
        readers.receivers(spark, path, only=("GPS9",))
    write(tmp_path, "gnss_vod_other.csv", "datetime,nvod,theta\n")
    with pytest.raises(ValueError, match="no receiver"):
        readers.receivers(spark, path)


def test_compaction_packs_by_size_and_lists_damaged_files(spark, tmp_path):
    scratch, out = tmp_path / "scratch", f"file://{tmp_path}/out"
    for cam in "ab":
        for day in range(12):
            d = scratch / cam
            d.mkdir(parents=True, exist_ok=True)
            pd.DataFrame({"t": np.arange(200) + 1000 * day, "v": float(day)}).to_parquet(d / f"{cam}_{day:02}.parquet")
    pd.DataFrame({"t": np.array([], dtype=np.int64), "v": np.array([], dtype=float)}).to_parquet(scratch / "a" / "a_empty.parquet")
    whole = (scratch / "a" / "a_03.parquet").read_bytes()
    (scratch / "a" / "a_03.parquet").write_bytes(whole[:40] + b"\x00" * 60 + whole[100:])  # breaks off within its pages
    (scratch / "b" / "b_05.parquet").write_bytes(b"PAR1")
    size = len(whole)
    report = readers.compact(spark, f"file://{scratch}", out, "/([ab])_[^/]*$", "t", target_bytes=4 * size).toPandas()
    bad = report[report["error"].notna()]
    assert sorted(f.rsplit("/", 1)[1] for f in bad["file"]) == ["a_03.parquet", "b_05.parquet"] and len(report) == 25
    assert report[report["error"].isna()]["n_rows"].sum() == 22 * 200
    filled = report[report["error"].isna()].groupby(["group", "bin"])["length"].sum()
    assert len(filled) < 10 and filled.max() < 4 * size + report["length"].max()
    files = sorted((tmp_path / "out").rglob("*.parquet"))
    assert len(files) == len(filled)
    rows = 0
    for f in files:
        t = pd.read_parquet(f)["t"].to_numpy()
        rows += len(t)
        assert (np.diff(t) >= 0).all()
    assert rows == 22 * 200
    with pytest.raises(ValueError, match="2 of 25"):
        readers.compact(spark, f"file://{scratch}", out, "/([ab])_[^/]*$", "t", max_bad=0.05)


def test_a_bad_scan_takes_no_other_with_it(spark, tmp_path):
    ok = "1,57.5,0,0.5,1,2,3,4\n1,58.5,0,3.5,1,2,3,4\n"
    for name, text in (("a", f"# height: 1\n{ok}# end\n"), ("b", ok + "1,2,x,4,5,6,7,8\n1,2\n"), ("c", "# nothing\n"), ("d", "\n"), ("e", ok)):
        write(tmp_path, f"{name}.txt", text)
    results, errors = readers.scan_batch(spark, f"file://{tmp_path}/*.txt", gap_range=1.0, max_bad=0.6)
    name = lambda f: f.rsplit("/", 1)[1][0]
    assert {name(r.file): (r.shots, r.gaps, r.mean_angle, r.top) for r in results.collect()} == {"a": (2, 1, 58.0, 3.5), "e": (2, 1, 58.0, 3.5)}
    assert {name(r.file): (r.reason, r.lines) for r in errors.collect()} == {"b": ("broken lines", 2), "c": ("no shots", 0), "d": ("no shots", 0)}
    with pytest.raises(ValueError, match="3 of 5"):
        readers.scan_batch(spark, f"file://{tmp_path}/*.txt")


def test_tables_are_interpolated_between_nodes(spark):
    f = lambda x, y: 2 + 3 * x - y + 0.5 * x * y  # bilinear, so cells give it back
    table = spark.createDataFrame([("k", float(x), float(y), f(x, y)) for x in (1, 2, 4) for y in (10, 30, 40)], "key string, x double, y double, value double")
    at = [(1.0, 10.0), (4.0, 40.0), (2.0, 30.0), (3.3, 11.0), (1.5, 39.9), (0.9, 20.0), (2.0, 41.0)]
    got = profiles.interpolated(spark.createDataFrame([("k", *p) for p in at] + [("other", 1.0, 10.0)], "key string, x double, y double"), profiles.table_cells(table, ["key"], "x", "y", "value"), ["key"], "x", "y", "v").collect()
    assert len(got) == len(at) + 1
    for r in got:
        inside = r.key == "k" and 1 <= r.x <= 4 and 10 <= r.y <= 40
        assert r.v == (pytest.approx(f(r.x, r.y)) if inside else None)


def test_stream_resumes_where_it_ended(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), 1, "a", float(i * 10), "{}") for i in range(10)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.where("event_id < 5").write.parquet(f"file://{src}")
    stream = lambda: jobs.lockout(jobs.events(spark, f"file://{src}", "*.parquet"), hours=3, wet=15, late="1 hour")
    assert jobs.run(stream(), f"file://{tmp_path}/out").count() == 4  # up to an hour before the last row
    df.where("event_id >= 5").write.mode("append").parquet(f"file://{src}")
    rows = {r.event_id: r.dry for r in jobs.run(stream(), f"file://{tmp_path}/out").collect()}
    assert rows == {i: i < 2 for i in range(9)}


def test_absolute_costs_are_those_of_medians():
    y = np.random.default_rng(3).normal(size=60).round(1)
    table = cp.segment_cost(y, "l1")
    for j in range(1, 61):
        i = np.arange(j)
        assert np.allclose(table(i, j), [np.abs(y[a:j] - np.median(y[a:j])).sum() for a in i])


def _onset_by_rule(y, direction, breaks, rule):
    sigma = np.diff(y).std() / np.sqrt(2) or 1.0
    edges, kept = [0, *breaks, len(y)], []
    for k in range(1, len(edges) - 1):
        jump = y[edges[k] : edges[k + 1]].mean() - y[edges[k - 1] : edges[k]].mean()
        size = -jump if direction == "decrease" else jump if direction == "increase" else abs(jump)
        if size >= sigma:
            kept.append((size, edges[k]))
    if not kept:
        return None
    return max(kept, key=lambda x: (x[0], -x[1]))[1] if rule == "acute" else min(b for _, b in kept)


def test_onsets_of_detected_breaks_follow_the_rule():
    r = np.random.default_rng(11)
    seen = 0
    for trial in range(40):
        y = np.concatenate([r.normal(m, 0.5, r.integers(8, 20)) for m in r.integers(-4, 5, 4)])
        for direction in ("decrease", "increase", "auto"):
            for rule in ("acute", "departure"):
                (onset, breaks), (none, _) = cp.series_onset(y, direction, "l2", [0.5, 1e9], rule)
                assert onset == _onset_by_rule(y, direction, breaks, rule) and none is None
                z = (y - y.mean()) / y.std()
                assert breaks == cp.penalised_breaks(z, "l2", 0.5 * np.log(len(y)), 5)
                seen += onset is not None
    assert seen > 100 and cp.series_onset(np.ones(3), "auto", "l2", [1.0]) == [(None, [])]


def test_bootstrapped_onsets_hold_a_planted_break(spark):
    r = np.random.default_rng(5)
    rows = [(k, d, float(i), float(v)) for k, d, jump in (("a", "decrease", -6), ("b", "increase", -6), ("c", "increase", 6)) for i, v in enumerate(r.normal(0, 1, 60) + jump * (np.arange(60) >= 35))]
    df = spark.createDataFrame([*rows, ("a", "decrease", 99.0, None)], "k string, direction string, d double, v double")
    got = {x.k: x for x in cp.bootstrap_onsets(df, ["k"], "d", "v", replicates=60, chunk=7).collect()}
    for k in "ac":
        assert got[k].n_obs == 60 and got[k].lo <= got[k].point <= got[k].hi and abs(got[k].onset - 35) <= 1 and 30 <= got[k].found <= 60
    assert got["b"].onset is None and got["b"].lo is None and got["b"].found == 0
    assert got["a"] == {x.k: x for x in cp.bootstrap_onsets(df.repartition(3), ["k"], "d", "v", replicates=60, chunk=60).collect()}["a"]  # on any number of tasks


def test_tails_of_f_are_those_of_t(spark):
    df = spark.createDataFrame([(0.5, 7.0), (2.3, 30.0), (4.0, 200.0)], "t double, n double").select(statistics.student_p(F.col("t"), F.col("n")).alias("a"), statistics.f_p(F.col("t") ** 2, F.lit(1.0), F.col("n")).alias("b"), statistics.f_p(F.col("t"), F.lit(2.0), F.col("n")).alias("two"), "t", "n")
    for r in df.collect():
        assert abs(r.a - r.b) < 1e-9 and abs(r.two - (1 + 2 * r.t / r.n) ** (-r.n / 2)) < 1e-9  # with 2 upper degrees the tail has a closed form


def test_intervals_of_the_median(spark):
    df = spark.createDataFrame([("p", i, float(i % 9)) for i in range(45)] + [("q", i, 3.0) for i in range(20)] + [("few", 1, 1.0)], "k string, i int, v double")
    got = {r.k: r for r in statistics.median_interval(df, ["k"], "v", ["i"], 400, least=12).collect()}
    r = np.random.default_rng(1)
    v = np.array([i % 9 for i in range(45)], dtype=float)
    want = np.quantile([np.median(r.choice(v, 45)) for _ in range(4000)], [0.025, 0.5, 0.975])
    assert set(got) == {"p", "q"} and (got["q"].lo, got["q"].hi, got["q"].n) == (3, 3, 20)
    assert abs(got["p"].lo - want[0]) <= 1 and abs(got["p"].mid - want[1]) <= 0.5 and abs(got["p"].hi - want[2]) <= 1


def test_places_in_a_global_order(spark):
    from sensorspark.operators import ordering

    rows = [(i, None if i % 50 == 0 else float(i % 3 if i % 2 else 7)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "i int, v double")
    got = [r.i for r in ordering.places(df, [F.desc_nulls_last("v"), F.asc("i")]).orderBy("place").collect()]
    assert got == [i for i, v in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    assert ordering.places(df.limit(0), [F.asc("v")]).count() == 0
    assert sorted(r.place for r in ordering.places(df, [F.asc("v"), F.asc("i")]).collect()) == list(range(1, 3_001))


def test_bootstrap_of_lags(spark):
    """A series and itself three days later: every draw finds the lag; blocks' sums give the same r as all days together."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=130)
    rows = [(d, "a", float(x[d])) for d in range(120)] + [(d + 3, "b", float(x[d])) for d in range(120)]
    t = spark.createDataFrame([(date(2001, 1, 1) + timedelta(days=d), k, v) for d, k, v in rows], "d date, variable string, value double")
    pairs = joins.lagged_pairs(t, t, range(-5, 6)).where("x < y")
    pairs = pairs.withColumn("i", F.datediff("d", F.lit("2001-01-01").cast("date")))
    got = statistics.bootstrap_best_lags(pairs, ["x", "y"], "i", 130, replicates=200).collect()
    assert [(r.replicates, r.lo, r.mid, r.hi) for r in got] == [(200, 3, 3, 3)]
    assert statistics.bootstrap_best_lags(pairs.where("i < 4"), ["x", "y"], "i", 4).first().mid is None  # too few days


def test_moving_blocks_equal_a_plain_loop(spark):
    """Each replicate's correlations from the very days that its blocks hold."""
    rng = np.random.default_rng(9)
    days, block, reps, lags = 41, 3, 60, range(-2, 3)
    x, y = rng.normal(size=60), rng.normal(size=60)
    y[5:] += 0.6 * x[:-5]
    rows = [("a", "b", i, lag, float(x[i + 5]), float(y[i + 5 + lag])) for i in range(days) for lag in lags if rng.random() > 0.1]
    got = statistics.bootstrap_best_lags(spark.createDataFrame(rows, "x string, y string, i int, lag int, vx double, vy double"), ["x", "y"], "i", days, block, reps, least=12).first()
    at = {(i, lag): (u, v) for _, _, i, lag, u, v in rows}
    best = []
    for starts in statistics.block_starts("a|b", reps, days, block):
        idx = [i for s in starts for i in range(s, s + block)][:days]
        assert len(idx) == days and max(idx) < days
        r = {}
        for lag in lags:
            p = np.array([at[i, lag] for i in idx if (i, lag) in at])
            if len(p) >= 12:
                r[lag] = abs(np.corrcoef(p[:, 0], p[:, 1])[0, 1])
        best.append(max(r, key=lambda k: (round(r[k], 9), -k)))
    assert np.allclose((got.lo, got.mid, got.hi), np.quantile(best, [0.025, 0.5, 0.975])) and got.replicates == reps


def test_season_breaks(spark):
    """Two planted breaks are found under each buffer; a gappy series, one without baseline and a short one say why they have none."""
    def rows(name, days, level=lambda d: 0.0):
        rng = np.random.default_rng(1)
        return [(name, date(2001, 3, 20) + timedelta(days=d), level(d) + 0.1 * float(rng.normal())) for d in days]

    step = lambda d: 5.0 if 100 <= d < 160 else 0.0
    data = rows("steps", range(300), step) + rows("gaps", [d for d in range(300) if d % 3], step) + rows("late", range(60, 300), step) + rows("few", [*range(12, 40), *range(290, 300)])
    t = spark.createDataFrame(data, "k string, d date, v double").withColumns({"s": F.lit("2001-05-01").cast("date"), "e": F.lit("2001-10-31").cast("date")})
    got = {r.k: r for r in cp.season_breaks(t, ["k"], "d", "v", "s", "e", [14, 21, 30]).collect()}
    assert {k: r.reason for k, r in got.items()} == {"steps": "", "gaps": "gaps", "late": "no baseline", "few": "gaps"}
    r = got["steps"]
    assert r.onset == r.onset_lo == r.onset_hi == date(2001, 3, 20) + timedelta(days=100) and r.recovery == date(2001, 3, 20) + timedelta(days=160)
    assert got["late"].onset is None and abs(got["gaps"].gap - 1 / 3) < 0.01


def test_onset_windows(spark):
    """The rule against a plain reading of it, over random breaks."""
    rng = np.random.default_rng(3)
    cut, stress, rows, want = date(2001, 4, 15), date(2001, 6, 15), [], {}
    for k in range(60):
        at = sorted({date(2001, 1, 1) + timedelta(days=int(x)) for x in rng.integers(0, 330, rng.integers(1, 7))})
        soil = k % 2 == 0
        rows += [(k, soil, d) for d in at]
        valid = at[:-1]
        if not valid:
            continue
        near = lambda some: min(some, key=lambda d: (abs((d - stress).days), d))
        if soil:
            early, before = [d for d in valid if d < cut], [d for d in valid if d <= stress]
            start = early[-1] if early else before[-1] if before else near(valid)
        else:
            start = near([d for d in valid if d >= cut] or valid)
        want[k] = (len(at), start, at[at.index(start) + 1])
    t = spark.createDataFrame(rows, "k int, soil boolean, b date")
    got = cp.onset_windows(t, ["k", "soil"], "b", F.lit(cut), F.lit(stress), F.col("soil")).collect()
    assert {r.k: (r.n_breaks, r.start, r.end) for r in got} == want


def test_absolute_penalty(spark):
    """A column's penalty counts a break, whatever the series' own cost."""
    t = spark.createDataFrame([(k, i, float(i >= 30) + 0.01 * (i % 3), p) for k, p in (("low", 2.0), ("high", 1e6)) for i in range(60)], "k string, i int, v double, penalty double")
    assert [(r.k, r.break_first, r.break_last) for r in cp.detect(t, ["k"], "i", "v", model="l2", min_size=5).collect()] == [("low", 30, 29)]


def test_quadratic_band(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 80)
    y = 3 + 2 * x - 0.4 * x * x + rng.normal(size=80)
    t = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)] + [("b", 1.0, 2.0), ("b", 2.0, 1.0)], "k string, x double, y double")
    got = sorted((r for r in statistics.quadratic_band(t, ["k"], "x", "y", points=20).collect() if r.k == "a"), key=lambda r: r.i)
    p, cov = np.polyfit(x, y, 2, cov=True)
    at = np.linspace(x.min(), x.max(), 20)
    design = np.column_stack([at**2, at, np.ones(20)])
    assert np.allclose([r.fit for r in got], np.polyval(p, at)) and np.allclose([r.half for r in got], 1.96 * np.sqrt(np.diag(design @ cov @ design.T)))
    assert all(r.half is None for r in statistics.quadratic_band(t, ["k"], "x", "y", points=3).collect() if r.k == "b")


def test_uncertainty_of_pairs_and_nodes(spark):
    """A pair whose setups agree is surer than one whose directions disagree; equal figures share their rank; satellites keep to their own pairs."""
    rows = []
    for w in (10, 20, 30):
        for m in (5, 10):
            for d in ("forward", "reverse"):
                rows += [("a", "b", w, m, d, 3), ("a", "c", w, m, d, w // 10 if d == "forward" else -m), ("b", "c", w, m, d, -w // 10)]
    su = spark.createDataFrame(rows, "x string, y string, window int, max_lag int, direction string, lag int")
    comp = {(r.x, r.y): r for r in statistics.uncertainty_components(su, replicates=50).collect()}
    assert comp["a", "b"][2:] == (0, 0, 0, 0, 0, 0, 0) and comp["a", "c"].directions > 5 and comp["a", "c"].signs == 0.5
    u = {(r.x, r.y): r.uncertainty for r in statistics.composite_uncertainty(statistics.uncertainty_components(su, replicates=50)).collect()}
    assert u["a", "b"] == 0 < u["b", "c"] < u["a", "c"] == 1
    few = spark.createDataFrame([("a", "b", 10, 5, "forward", 1)], su.schema)
    assert statistics.composite_uncertainty(statistics.uncertainty_components(few)).count() == 0
    pairs = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 1.0), ("b", "c", 0.5), ("s", "a", 0.5), ("s", "t", 0.5)], "leader string, follower string, uncertainty double")
    nodes = {r.variable: r for r in statistics.node_table(pairs).collect()}
    assert (nodes["a"].leads, nodes["a"].follows, nodes["a"].pairs) == (2, 1, 3) and nodes["s"].tendency == 1 and nodes["c"].lead_fraction == 0
    got = {r.variable: r for r in statistics.anchored(pairs, lambda k: k.isin("s", "t")).collect()}
    assert got["a"].mixed == 1 and abs(got["a"].every - 1 / 3) < 1e-12 and got["s"].internal_first == 1 and got["t"].internal == -1 and got["s"].core is None


def test_daylight_saving_as_pandas_infers_it(spark):
    """One step back a night, gaps and plain hours of several years against pandas; then what pandas refuses: ties, nulls, no step back."""
    rows = []
    for sensor, night in enumerate(("2021-10-31", "2022-10-30", "2022-03-27", "2023-03-26", "2024-07-15")):
        walls = pd.date_range(f"{night} 00:10", f"{night} 05:50", freq="20min").tolist()
        if night[5:7] == "10":
            walls = [w for w in walls if w.hour < 3] + [w for w in walls if w.hour >= 2]
        rows += [(sensor, i, w.to_pydatetime()) for i, w in enumerate(walls)]
    df = spark.createDataFrame(rows, "sensor int, i int, wall timestamp_ntz")
    got = {(r.sensor, r.i): r.utc for r in timefns.local_to_utc(df, ["sensor"], "i", "wall", "Europe/Berlin").collect()}
    p = pd.DataFrame(rows, columns=["sensor", "i", "wall"])
    for sensor, g in p.groupby("sensor"):
        want = g["wall"].dt.tz_localize("Europe/Berlin", ambiguous="infer", nonexistent="shift_forward").dt.tz_convert("UTC").dt.tz_localize(None)
        assert [got[sensor, i] for i in g["i"]] == [w.to_pydatetime() for w in want]
    at = lambda hm: pd.Timestamp(f"2021-10-31 {hm}").to_pydatetime()
    odd = [("tie", 1, at("02:10")), ("tie", 2, at("02:10")), ("tie", 3, None), ("tie", 4, at("02:05")), ("tie", 5, at("02:05")), ("up", 1, at("02:10")), ("up", 2, at("02:40"))]
    got = {(r.sensor, r.i): r.utc and f"{r.utc:%H:%M}" for r in timefns.local_to_utc(spark.createDataFrame(odd, "sensor string, i int, wall timestamp_ntz"), ["sensor"], "i", "wall", "Europe/Berlin").collect()}
    assert got == {("tie", 1): "00:10", ("tie", 2): "00:10", ("tie", 3): None, ("tie", 4): "01:05", ("tie", 5): "01:05", ("up", 1): "00:10", ("up", 2): "00:40"}


@pytest.mark.parametrize("footprint", [rasters.box(3), rasters.box(7), rasters.circle(1), rasters.circle(2.3)])
def test_focal_statistics_match_every_neighbourhood(spark, footprint):
    """Holes, nulls, negative places and tiles of four pixels."""
    r = np.random.default_rng(1)
    at = {(k, int(x), int(y)): (None if r.random() < 0.1 else float(r.normal(1e4, 1))) for k in "ab" for x in range(-7, 12) for y in range(-3, 9) if r.random() > 0.2}
    df = spark.createDataFrame([(*k, v, 1) for k, v in at.items()], "k string, x int, y int, value double, other int")
    kinds = {"mean": np.mean, "var": np.var, "min": np.min, "max": np.max, "median": np.median}
    got = rasters.focal(df, ["k"], footprint, {f"_{s}": s for s in kinds}, tile=4).collect()
    assert len(got) == len(at)
    for p in got:
        near = [at[p.k, p.x + i, p.y + j] for j, (lo, hi) in footprint.items() for i in range(lo, hi + 1) if at.get((p.k, p.x + i, p.y + j)) is not None]
        assert p.value == at[p.k, p.x, p.y]
        for s, f in kinds.items():
            assert p[f"_{s}"] == (None if not near else pytest.approx(f(near), abs=1e-6))
    assert rasters.focal(df.limit(0), ["k"], footprint, {"m": "mean"}).collect() == []


def test_the_halo_alone_grows_with_the_neighbourhood(spark):
    """Rows that are shuffled for 3 x 3 and for 7 x 7 pixels; sending each value to its neighbours would take 9 and 49 times as many."""
    df = spark.range(256 * 256).selectExpr("1 AS k", "cast(id % 256 AS int) AS x", "cast(id div 256 AS int) AS y", "cast(id AS double) AS value")
    for size, most in ((3, 1.07), (7, 1.21)):
        assert rasters.focal(df, ["k"], rasters.box(size), {"m": "mean"}).count() == 256 * 256
        reach = size // 2
        sent = df.selectExpr(f"size(sequence(floor((x - {reach}) / 64), floor((x + {reach}) / 64))) * size(sequence(floor((y - {reach}) / 64), floor((y + {reach}) / 64))) AS n").agg(F.sum("n")).first()[0]
        assert sent / 65_536 <= most


def burst(n=4000, seed=3):
    """Seconds of rows of which nine in ten fall into one hour of a year."""
    r = np.random.default_rng(seed)
    return np.sort(np.where(r.random(n) < 0.9, 2_000_000 + r.integers(0, 3600, n), r.integers(0, 31_000_000, n)))


def test_a_burst_is_spread_over_the_ranges(spark):
    df = spark.createDataFrame([(int(t) * 1000 + i,) for i, t in enumerate(burst())], "t long")
    n = joins.ranged(df, "t", joins.ranges(df, "t", 16)).groupBy("_b").count().collect()
    assert len(n) == 16 and max(r["count"] for r in n) <= 2 * 4000 / 16
    assert joins.ranges(df.limit(0), "t") == [] and joins.ranged(df.limit(0), "t", []).count() == 0


def test_asof_and_trailing_sums_in_a_burst_match_brute_force(spark):
    day = pd.Timestamp("2024-01-01")
    at = lambda s: (day + pd.Timedelta(seconds=int(s))).to_pydatetime()
    r = np.random.default_rng(1)
    times, values = burst(1500), np.round(r.random(1500) * 10, 3)
    probes = [*burst(200, 5), *times[:40]]
    left = spark.createDataFrame([(i, int(i % 3), at(s)) for i, s in enumerate(probes)] + [(900, 0, None)], "id int, k int, ts timestamp")
    right = spark.createDataFrame([(int(i % 3), at(s), float(v)) for i, (s, v) in enumerate(zip(times, values))] + [(0, None, 1.0)], "k int, ts timestamp, v double")
    got = {x.id: x for x in joins.trailing_at(left, right, "id", "ts", {"total": ("sum", "v", 600), "mean": ("avg", "v", 7200), "n": ("count", "v", 600)}).collect()}
    assert len(got) == len(probes) + 1 and (got[900].total, got[900].mean, got[900].n) == (None, None, 0)
    for i, s in enumerate(probes):
        short, long = values[(times > s - 600) & (times <= s)], values[(times > s - 7200) & (times <= s)]
        assert got[i].n == len(short) and got[i].total == (pytest.approx(short.sum()) if len(short) else None) and got[i].mean == (pytest.approx(long.mean()) if len(long) else None)
    got = {x.id: x.matched_ts for x in joins.nearest(left, right, "ts", ["v"], keys=["k"]).collect()}
    assert len(got) == len(probes) + 1 and got[900] is None
    for i, s in enumerate(probes):
        own = times[i % 3 :: 3]
        assert got[i] == at(max(own[np.abs(own - s) == np.abs(own - s).min()]))


def test_planted_exponentials_are_found_off_the_grid(spark):
    r = np.random.default_rng(2)
    planted = {"up": (2.0, 0.0437, -5.0), "down": (30.0, -0.0713, 4.0), "steep": (1e-3, 0.1313, 1.0), "flip": (-4.0, -0.0191, 10.0)}
    rows = [(k, float(x), a * np.exp(b * x) + c) for k, (a, b, c) in planted.items() for x in r.uniform(0, 60, 80)]
    rows += [("few", float(x), 2 * np.exp(0.05 * x)) for x in range(9)] + [("noisy", float(x), 3 * np.exp(0.03 * x) + 1 + r.normal(0, 0.5)) for x in r.uniform(0, 60, 200)]
    df = spark.createDataFrame([(k, x, float(y)) for k, x, y in rows], "k string, x double, y double")
    got = {g.k: g for g in statistics.exponential_fit(df, ["k"], "x", "y", statistics.rates()).collect()}
    assert set(got) == {*planted, "noisy"}
    for k, (a, b, c) in planted.items():
        assert abs(got[k].b - b) < 1e-6 and got[k].a == pytest.approx(a, rel=1e-4) and got[k].c == pytest.approx(c, abs=1e-4) and got[k].r2 > 1 - 1e-9
    # the noisy one is at the least error among near rates
    x, y = np.array([(x, y) for k, x, y in rows if k == "noisy"]).T

    def error(b):
        e = np.stack([np.exp(b * x), np.ones(len(x))], axis=1)
        return ((y - e @ np.linalg.lstsq(e, y, rcond=None)[0]) ** 2).sum()

    assert all(error(got["noisy"].b) <= error(b) + 1e-9 for b in got["noisy"].b + np.linspace(-1e-3, 1e-3, 21))
    assert statistics.exponential_fit(df.limit(0), ["k"], "x", "y", statistics.rates()).collect() == []


def test_what_jobs_write_goes_with_the_session(tmp_path):
    code = f"""
import os
from pyspark.sql import SparkSession
from sensorspark.sources.shared import written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert written(spark.range(5)).count() == 5
(folder,) = [d for d in os.listdir("{tmp_path}") if d.startswith("sensorspark-")]
assert len(os.listdir("{tmp_path}/" + folder)) == 1
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
    for _ in range(100):  # the JVM ends a little later
        if not [d for d in tmp_path.iterdir() if d.name.startswith("sensorspark-")]:
            break
        time.sleep(0.2)
    else:
        raise AssertionError(list(tmp_path.iterdir()))
