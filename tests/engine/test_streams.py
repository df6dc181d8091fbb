import pandas as pd
import pytest

from sensorspark.streaming import jobs

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def feed(spark, folder, files):
    """One file after the other, each one trigger; rows are (event_id, hour, stream, value)."""
    for rows in files:
        data = [(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime(), 1, s, float(v), "{}") for i, h, s, v in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return jobs.events(spark, folder, "*.parquet", 1)


def test_upsert_keeps_what_a_batch_lacks(spark, tmp_path):
    files = [[(i, 1, "click", 1) for i in range(6)], [(10 + i, 2, "view", 1) for i in range(3)], [(20 + i, 3, "click", 1) for i in range(4)], [(30, 40, "view", 1)]]
    df = jobs.daily(feed(spark, f"file://{tmp_path}/in", files), late="5 days").selectExpr("cast(to_date(start) as string) AS d", "stream", "n")
    jobs.upsert(df, f"file://{tmp_path}/out", ["d"], ["stream"])
    got = {(str(r.d), r.stream): r.n for r in spark.read.parquet(f"file://{tmp_path}/out/panel").collect()}
    assert got == {("2024-01-01", "click"): 10, ("2024-01-01", "view"): 3, ("2024-01-02", "view"): 1}


def test_late_rows_are_judged_in_order(spark, tmp_path):
    files = [[(1, 5, "a", 90), (2, 1, "b", 5)], [(3, 0, "a", 1), (4, 4, "a", 2)], [(5, 9, "a", 3), (6, 30, "a", 1)], [(7, 60, "a", 0)]]
    out = jobs.run(jobs.lockout(feed(spark, f"file://{tmp_path}/in", files), hours=4, wet=60, late="12 hours"), f"file://{tmp_path}/out")
    # event 3 and 4 come before the wet one though they arrive after it; b's row leaves by its timer; 7 is withheld
    assert {r.event_id: r.dry for r in out.collect()} == {3: True, 4: True, 1: False, 5: False, 6: True, 2: True}


def test_rows_older_than_the_watermark_are_dropped(spark, tmp_path):
    files = [[(1, 100, "a", 1)], [(2, 1, "a", 99)], [(3, 200, "a", 1)], [(4, 300, "a", 1)]]
    out = jobs.run(jobs.lockout(feed(spark, f"file://{tmp_path}/in", files), hours=1000, wet=60, late="1 hour"), f"file://{tmp_path}/out")
    assert {r.event_id: r.dry for r in out.collect()} == {1: True, 3: True}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_alerts_are_those_of_one_pass(spark, tmp_path, parts):
    import random

    r = random.Random(parts)
    rows = [(i, i, "a" if i % 3 else "b", r.choice([0, 10, 30, 70])) for i in range(60)]
    want = []
    for s in "ab":
        away, quiet = False, 0
        for i, _, t, v in rows:
            if t != s:
                continue
            if not away and v >= 60:
                away, quiet = True, 0
                want.append((s, i, "onset"))
            elif away:
                quiet = quiet + 1 if v <= 20 else 0
                if quiet == 2:
                    away = False
                    want.append((s, i, "recovery"))
    late = [(99, 500, s, 30) for s in "ab"]
    mixed = sorted(rows, key=lambda x: x[1] + r.random() * 8)
    files = [mixed[k * 60 // parts : (k + 1) * 60 // parts] for k in range(parts)] + [late]
    out = jobs.run(jobs.departures(feed(spark, f"file://{tmp_path}/in", files), 60, 20, late="10 hours"), f"file://{tmp_path}/out")
    assert sorted(map(tuple, out.collect())) == sorted(want)


def state(spark, path, name, **options):
    return spark.read.format("statestore").option("path", path).option("stateVarName", name).options(**options).load()


def test_idle_keys_leave_no_state(spark, tmp_path):
    """a falls silent: its lock-out is over and its row judged, so nothing of it stays; b's last row waits, and its wet time still counts."""
    files = [[(1, 0, "a", 90), (2, 0, "b", 1)], [(3, 30, "b", 99)], [(4, 31, "b", 1)], [(5, 33, "b", 1)]]
    jobs.run(jobs.lockout(feed(spark, f"file://{tmp_path}/in", files), hours=4, wet=60, late="1 hour"), f"file://{tmp_path}/out")
    where = f"file://{tmp_path}/out/state"
    assert [r.key.stream for r in state(spark, where, "memory").collect()] == ["b"]
    assert {(r.key.stream, r.list_element.event_id) for r in state(spark, where, "waiting").collect()} == {("b", 5)}


def test_silent_streams_are_forgotten(spark, tmp_path):
    """Without idle_hours the stream is still away at hour 50 and a second high value is no alert; with it the stream begins anew."""
    # a's rows 6 and 7 are judged in one go, though they lie further apart than that
    files = [[(1, 0, "a", 90)], [(2, 20, "b", 1)], [(3, 40, "b", 1)], [(4, 50, "a", 95), (6, 51, "a", 5), (7, 70, "a", 97)], [(5, 90, "b", 1)]]
    for idle, want in ((None, {1}), (12, {1, 4, 7})):
        out = jobs.run(jobs.departures(feed(spark, f"file://{tmp_path}/in{idle}", files), 60, 20, late="1 hour", idle_hours=idle), f"file://{tmp_path}/out{idle}")
        assert {r.event_id for r in out.collect()} == want
        kept = {r.key.stream for r in state(spark, f"file://{tmp_path}/out{idle}/state", "memory").collect()}
        assert kept == ({"a", "b"} if idle is None else set())  # b's last row waits, and has no memory behind it
