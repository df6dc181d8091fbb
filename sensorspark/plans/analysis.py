"""Queries on change points, lead-lag, regressions and networks (C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import changepoints as cp
from ..operators import statistics as st
from ..sources.shared import written
from .registry import query

c = F.col
R6 = lambda x: F.round(x, 6)
R4 = lambda x: F.round(x, 4)
KEY = ["variable"]
Y95 = "y AS (SELECT variable, d, value FROM panel WHERE year(d) = 1995)"
SIGMA = "sg AS (SELECT variable, CASE WHEN stddev_pop(dv) > 0 THEN stddev_pop(dv) / sqrt(2) ELSE 1 END AS sigma FROM (SELECT variable, value - lag(value) OVER (PARTITION BY variable ORDER BY d) AS dv FROM y) GROUP BY 1)"
DIRECTIONS = [("1-URGENT", "decrease"), ("2-HIGH", "increase"), ("3-MEDIUM", "auto"), ("4-NOT SPECIFIED", "increase"), ("5-LOW", "decrease")]
#: The kind of sensor behind each variable of the registry.
GROUPS = {"1-URGENT": "forcing", "2-HIGH": "physiology", "3-MEDIUM": "proximal", "4-NOT SPECIFIED": "flux", "5-LOW": "satellite"}
PEARSON = lambda x, y: f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"
CURVES = f"lc AS (SELECT a.variable AS x, b.variable AS y, CAST(l AS INT) AS lag, count(*) AS n, {PEARSON('a.value', 'b.value')} AS r FROM panel a, range(-10, 11) l(l), panel b WHERE a.variable < b.variable AND b.d = a.d + CAST(l AS INT) GROUP BY 1, 2, 3 HAVING count(*) >= 30)"
BEST = "bl AS (SELECT x, y, arg_max(lag, struct_pack(a := abs(r), b := -lag)) AS lag, arg_max(r, struct_pack(a := abs(r), b := -lag)) AS r FROM lc GROUP BY 1, 2)"


def y95(v):
    return v.panel.where(F.year("d") == 1995)


SERIES = ["variable", "yr"]


def years(v):
    return v.panel.withColumn("yr", F.year("d"))


def directions(v):
    return v.spark.createDataFrame(DIRECTIONS, "variable string, direction string")


def curves(v, max_lag: int = 10):
    return st.lag_correlations(v.panel, v.panel, max_lag).where("x < y")


@query("C01_noise", "+y AS (SELECT variable, year(d) AS yr, value - lag(value) OVER (PARTITION BY variable, year(d) ORDER BY d) AS dv FROM panel) SELECT variable, yr, round(CASE WHEN stddev_pop(dv) > 0 THEN stddev_pop(dv) / sqrt(2) ELSE 1 END, 4) AS sigma FROM y GROUP BY 1, 2", "panel")
def _(v):
    """Each year of a variable is a series."""
    return cp.noise(years(v), SERIES, "d", "value").select(*SERIES, R4("sigma").alias("sigma"))


@query(
    "C02_single_break",
    "+y AS (SELECT variable, year(d) AS yr, d, value FROM panel), p AS (SELECT variable, yr, d, count(*) OVER b AS n, sum(value) OVER b AS s, sum(value * value) OVER b AS q, count(*) OVER w AS nn, sum(value) OVER w AS ss, sum(value * value) OVER w AS qq FROM y WINDOW b AS (PARTITION BY variable, yr ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY variable, yr)), k AS (SELECT *, q - s * s / n + (qq - q) - (ss - s) ** 2 / (nn - n) AS cost FROM p WHERE n >= 3 AND nn - n >= 3) SELECT variable, yr, arg_min(d, struct_pack(a := cost, b := d)) AS \"break\", CAST(arg_min(n, struct_pack(a := cost, b := d)) AS BIGINT) AS position FROM k GROUP BY 1, 2",
    "panel",
)
def _(v):
    return cp.single_break(years(v), SERIES, "d", "value").select(*SERIES, "break", "position")


@query("C03_penalised_breaks")
def _(v):
    return cp.detect(years(v), SERIES, "d", "value", model="l2", scale=1.0)


@query("C04_fixed_breaks")
def _(v):
    return cp.detect(years(v), SERIES, "d", "value", model="rbf", count=2, min_size=5)


@query(
    "C05_onsets",
    f"+{Y95}, {SIGMA}, q AS (SELECT variable, quarter(d) AS q, avg(value) AS m, min(d) AS d FROM y GROUP BY 1, 2), j AS (SELECT variable, d AS b, m - lag(m) OVER (PARTITION BY variable ORDER BY q) AS jump FROM q), r(variable, direction) AS (VALUES {', '.join(map(str, DIRECTIONS))}), s AS (SELECT variable, b, CASE direction WHEN 'decrease' THEN -jump WHEN 'increase' THEN jump ELSE abs(jump) END AS size FROM j JOIN r USING (variable)) SELECT variable, arg_max(b, struct_pack(a := size, b := -epoch(b))) AS acute, min(b) AS first_departure FROM s JOIN sg USING (variable) WHERE size >= sigma / 20 GROUP BY 1",
    "panel",
)
def _(v):
    """Given breaks: the quarters' first days."""
    q = y95(v).groupBy("variable", F.quarter("d").alias("q")).agg(F.avg("value").alias("m"), F.min("d").alias("break_first"))
    jump = q.withColumn("jump", c("m") - F.lag("m").over(Window.partitionBy("variable").orderBy("q"))).where("jump IS NOT NULL")
    sigma = cp.noise(y95(v), KEY, "d", "value").withColumn("sigma", c("sigma") / 20)
    return cp.onsets(jump.select("variable", "break_first", "jump"), sigma, directions(v), KEY)


@query("C05_detected_onsets")
def _(v):
    """Acute event and first departure of every year of a variable, from detected breaks."""
    acute = cp.onset_grid(directed(v), SERIES, "d", "value", ["l2"], [1.0], "acute").select(*SERIES, "n_obs", c("onset").alias("acute"))
    return acute.join(cp.onset_grid(directed(v), SERIES, "d", "value", ["l2"], [1.0], "departure").select(*SERIES, c("onset").alias("first_departure")), SERIES)


def directed(v):
    return years(v).join(F.broadcast(directions(v)), "variable")  # five rows


@query("C06_bootstrap_onset")
def _(v):
    """1,000 replicates for each year of a variable."""
    return cp.bootstrap_onsets(directed(v), SERIES, "d", "value")


@query("C07_onset_run")
def _(v):
    """First departures over the registry, with each series' group and the interval's length in days, earliest first; 1,000 replicates each."""
    run = cp.bootstrap_onsets(directed(v), SERIES, "d", "value", rule="departure")
    group = F.coalesce(*[F.when(c("variable") == k, F.lit(g)) for k, g in GROUPS.items()])
    return run.select(*SERIES, group.alias("group"), "n_obs", "onset", "lo", "hi", F.datediff("hi", "lo").alias("ci_days")).orderBy(F.asc_nulls_last("onset"), *SERIES)


MODELS, SCALES = ["l2", "l1", "rbf", "normal"], [0.5, 1.0, 1.5, 2.0, 3.0, 4.0]


@query("C08_robustness_grid")
def _(v):
    """24 configurations for each year of a variable."""
    g = cp.onset_grid(directed(v), SERIES, "d", "value", MODELS, SCALES)
    return g.withColumn("onset_doy", F.dayofyear("onset"))


@query("C09_grid_stability")
def _(v):
    """Rank agreement (tau) of each configuration's onsets with their medians over the grid, by year: its mean and least."""
    g = cp.onset_grid(directed(v), SERIES, "d", "value", MODELS, SCALES).where("onset IS NOT NULL")
    g = g.select("yr", F.concat_ws("|", "yr", "model", "scale").alias("config"), c("variable").alias("item"), F.dayofyear("onset").alias("doy"))
    g = written(g)  # the fits are made once
    med = g.groupBy("yr", "item").agg(F.percentile("doy", F.lit(0.5)).alias("med"), F.count("*").alias("n_cfg"), (F.max("doy") - F.min("doy")).alias("spread"))
    tau = st.kendall(g.join(med, ["yr", "item"]), "config", "item", "doy", "med").withColumn("yr", F.split("config", r"\|")[0].cast("int"))
    taus = tau.groupBy("yr").agg(F.avg("tau").alias("mean_tau"), F.min("tau").alias("least_tau"), F.count("tau").alias("configs"))
    return med.join(taus, "yr", "left")


PEAKS = "pk AS (SELECT year(d) AS config, variable AS item, arg_max(dayofyear(d), struct_pack(a := value, b := d)) AS doy FROM panel GROUP BY 1, 2), md AS (SELECT item, quantile_cont(doy, 0.5) AS med FROM pk GROUP BY 1)"


def peaks(v):
    return v.panel.groupBy(F.year("d").alias("config"), c("variable").alias("item")).agg(F.max_by(F.dayofyear("d"), F.struct("value", "d")).alias("doy"))


@query("C09_stability", f"+{PEAKS} SELECT item, count(*) AS n, quantile_cont(doy, 0.5) AS med, max(doy) - min(doy) AS spread FROM pk GROUP BY 1", "panel")
def _(v):
    return peaks(v).groupBy("item").agg(F.count("*").alias("n"), F.percentile("doy", F.lit(0.5)).alias("med"), (F.max("doy") - F.min("doy")).alias("spread"))


@query("C09_kendall", f"+{PEAKS}, p AS (SELECT config, item, doy, med FROM pk JOIN md USING (item)), t AS (SELECT a.config, sum(sign(a.doy - b.doy) * sign(a.med - b.med)) AS s, sum(abs(sign(a.doy - b.doy))) AS u, sum(abs(sign(a.med - b.med))) AS w FROM p a JOIN p b ON a.config = b.config AND a.item < b.item GROUP BY 1) SELECT config, round(s / nullif(sqrt(u * w), 0), 6) AS tau FROM t", "panel")
def _(v):
    p = peaks(v)
    med = p.groupBy("item").agg(F.percentile("doy", F.lit(0.5)).alias("med"))
    return st.kendall(p.join(med, "item"), "config", "item", "doy", "med").select("config", R6("tau").alias("tau"))


def dense_report(v, max_gap: float):
    """Every year's season, 1 May to 31 October, of every variable."""
    season = years(v).select("variable", "d", "value")
    spans = season.select(F.year("d").alias("yr")).distinct().select("yr", F.make_date("yr", F.lit(5), F.lit(1)).alias("start"), F.make_date("yr", F.lit(10), F.lit(31)).alias("end"))
    return cp.season_breaks(season.withColumn("yr", F.year("d")).join(spans, "yr"), SERIES, "d", "value", "start", "end", [14, 21, 30], max_gap=max_gap)


@query("C10_dense_report")
def _(v):
    """Gaps up to 40 per cent: at the smallest scale factors a day often has no order of a kind."""
    return dense_report(v, 0.4)


@query("C10_dense_report_strict")
def _(v):
    """Gaps up to 10 per cent; seasons with more of them keep their row, with the reason."""
    return dense_report(v, 0.1)


WEEKLY = "wk AS (SELECT variable, CAST(date_diff('day', DATE '1970-01-01', d) // 7 AS BIGINT) AS w, avg(value) AS m FROM panel GROUP BY 1, 2), bs AS (SELECT variable, avg(m) AS mu, stddev_samp(m) AS sd FROM wk WHERE w < 1400 GROUP BY 1), z AS (SELECT variable, w, (m - mu) / sd AS z FROM wk JOIN bs USING (variable) WHERE w >= 1400)"


def weekly_z(v):
    wk = v.panel.groupBy("variable", F.floor(F.datediff("d", F.lit("1970-01-01")) / 7).alias("w")).agg(F.avg("value").alias("m"))
    base = wk.where("w < 1400").groupBy("variable").agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd"))
    return wk.where("w >= 1400").join(base, "variable").select("variable", "w", ((c("m") - c("mu")) / c("sd")).alias("z"))


@query("C11_departures", f"+{WEEKLY}, x AS (SELECT *, lag(w) OVER o AS prev, lead(z) OVER o AS nz FROM z WINDOW o AS (PARTITION BY variable ORDER BY w)), f AS (SELECT variable, min(w) AS onset, arg_min(prev, w) AS before FROM x WHERE z >= 2 GROUP BY 1) SELECT f.variable, onset, before, min(w) FILTER (w > onset AND z <= 1 AND nz <= 1) AS recovery FROM f JOIN x USING (variable) GROUP BY 1, 2, 3", "panel")
def _(v):
    return cp.departures(weekly_z(v), KEY, "w", "z")


@query("C12_response_horizon", f"+{WEEKLY}, f AS (SELECT variable, min(w) FILTER (z >= 2) AS onset, max(abs(z)) AS top FROM z GROUP BY 1) SELECT variable, onset, round(top, 4) AS top, CASE WHEN onset IS NULL THEN 'no departure' WHEN onset > 1500 THEN 'after the event' ELSE 'kept' END AS reason, onset - 1400 AS weeks FROM f", "panel")
def _(v):
    f = weekly_z(v).groupBy("variable").agg(F.min(F.when(c("z") >= 2, c("w"))).alias("onset"), R4(F.max(F.abs("z"))).alias("top"))
    reason = F.when(c("onset").isNull(), "no departure").when(c("onset") > 1500, "after the event").otherwise("kept")
    return f.select("variable", "onset", "top", reason.alias("reason"), (c("onset") - 1400).alias("weeks"))


#: First and last week of the event, and the deviation that counts.
STRESS = (1400, 1500)
HORIZON = (
    f"+{WEEKLY}, e AS (SELECT variable, CASE WHEN avg(z) < 0 THEN -1 ELSE 1 END AS dir, max(abs(z)) AS magnitude, count(*) AS n FROM z WHERE w <= {STRESS[1]} GROUP BY 1), "
    "s AS (SELECT variable, w, z * dir AS z, lead(z * dir) OVER (PARTITION BY variable ORDER BY w) AS nz FROM z JOIN e USING (variable)), o AS (SELECT variable, min(w) AS onset FROM s WHERE z >= 2 GROUP BY 1), "
    "r AS (SELECT variable, min(w) AS recovery FROM s JOIN o USING (variable) WHERE w > onset AND z <= 1 AND nz <= 1 GROUP BY 1), "
    f"k AS (SELECT variable, n, dir, magnitude, CASE WHEN n < 10 THEN 'too few observations' WHEN onset IS NULL THEN 'no departure' WHEN onset > {STRESS[1]} THEN 'after the event' ELSE '' END AS reason, onset, recovery FROM e LEFT JOIN o USING (variable) LEFT JOIN r USING (variable)) "
    f"SELECT variable, n, CASE WHEN dir < 0 THEN 'down' ELSE 'up' END AS direction, round(magnitude, 4) AS magnitude, reason, CASE WHEN reason = '' THEN 7 * (onset - {STRESS[0]}) END AS days_from_start, CASE WHEN reason = '' THEN 7 * (recovery - {STRESS[1]}) END AS days_from_end FROM k"
)


@query("C12_event_response", HORIZON, "panel")
def _(v):
    """Departures in the direction that the event's mean takes, with their size in deviations, days from the event's start and end, and why a series is dropped."""
    z = weekly_z(v)
    e = z.where(c("w") <= STRESS[1]).groupBy("variable").agg(F.when(F.avg("z") < 0, -1).otherwise(1).alias("dir"), F.max(F.abs("z")).alias("magnitude"), F.count("*").alias("n"))
    found = cp.departures(z.join(e, "variable").withColumn("z", c("z") * c("dir")), KEY, "w", "z")
    reason = F.when(c("n") < 10, "too few observations").when(c("onset").isNull(), "no departure").when(c("onset") > STRESS[1], "after the event").otherwise("")
    k = e.join(found, "variable", "left").withColumn("reason", reason)
    days = lambda week, zero: F.when(c("reason") == "", 7 * (c(week) - zero))
    return k.select("variable", "n", F.when(c("dir") < 0, "down").otherwise("up").alias("direction"), R4("magnitude").alias("magnitude"), "reason", days("onset", STRESS[0]).alias("days_from_start"), days("recovery", STRESS[1]).alias("days_from_end"))


#: Absolute penalties of variables that don't take the general one.
PENALTY, PENALTIES = 2.0, {"3-MEDIUM": 4.0}


@query("C13_batch_breaks")
def _(v):
    """Both conventions: the first day of a new segment and the last of the old; each break's number, its segment's end and its days from the event."""
    override = F.coalesce(*[F.when(c("variable") == k, F.lit(p)) for k, p in PENALTIES.items()], F.lit(PENALTY))
    found = cp.detect(v.panel.withColumn("penalty", override), KEY, "d", "value", model="l2", min_size=5)
    by = Window.partitionBy("variable").orderBy("break_first")
    ends = found.withColumn("number", F.row_number().over(by)).withColumn("period_end", F.lead("break_last").over(by))
    last = v.panel.groupBy("variable").agg(F.max("d").alias("_last"))
    ends = ends.join(last, "variable").withColumn("period_end", F.coalesce("period_end", "_last")).drop("_last")
    return ends.withColumn("days_from_event", F.datediff("break_first", F.lit(EVENT).cast("date")))


SOIL = ("4-NOT SPECIFIED", "5-LOW")


def windowed(breaks):
    """Cutoff 15 April, stress 15 June of each year; two variables behave like soil moisture."""
    day = lambda m: F.make_date("yr", F.lit(m), F.lit(15))
    w = cp.onset_windows(breaks, SERIES, "b", day(4), day(6), c("variable").isin(*SOIL))
    return w.select(*SERIES, "n_breaks", "start", "end", F.datediff("end", "start").alias("days"), "nearest_before", "nearest_after", F.datediff("start", day(6)).alias("from_stress"))


@query(
    "C14_onset_window",
    "+b AS (SELECT variable, year(d) AS yr, min(d) AS b FROM panel GROUP BY variable, year(d), quarter(d)), "
    f"n AS (SELECT *, lead(b) OVER (PARTITION BY variable, yr ORDER BY b) AS nxt, make_date(yr, 4, 15) AS cut, make_date(yr, 6, 15) AS st, variable IN {SOIL} AS soil FROM b), "
    "p AS (SELECT *, CASE WHEN soil AND b < cut THEN 0 WHEN NOT soil AND b >= cut THEN 0 WHEN soil AND b <= st THEN 1 ELSE 2 END AS pr, date_diff('day', b, st) AS di FROM n), "
    "q AS (SELECT *, CASE WHEN soil AND pr < 2 THEN di ELSE abs(di) END AS k FROM p), "
    'g AS (SELECT variable, yr, count(*) AS n_breaks, arg_min(b, struct_pack(a := pr, c := k, e := b)) FILTER (nxt IS NOT NULL) AS "start", arg_min(nxt, struct_pack(a := pr, c := k, e := b)) FILTER (nxt IS NOT NULL) AS "end", max(b) FILTER (b <= st) AS nearest_before, min(b) FILTER (b > st) AS nearest_after, any_value(st) AS st FROM q GROUP BY 1, 2) '
    'SELECT variable, yr, n_breaks, "start", "end", date_diff(\'day\', "start", "end") AS days, nearest_before, nearest_after, date_diff(\'day\', st, "start") AS from_stress FROM g WHERE "start" IS NOT NULL',
    "panel",
)
def _(v):
    """The rule over given breaks: the quarters' first days."""
    return windowed(years(v).groupBy("variable", "yr", F.quarter("d").alias("q")).agg(F.min("d").alias("b")))


@query("C14_detected_windows")
def _(v):
    """The rule over the breaks detected in each year of a variable."""
    found = cp.detect(years(v).withColumn("penalty", F.lit(PENALTY)), SERIES, "d", "value", model="l2", min_size=5)
    return windowed(found.select(*SERIES, c("break_first").alias("b")))


@query("C15_lag_curves", f"+{CURVES} SELECT x, y, lag, n, round(r, 6) AS r FROM lc WHERE n >= 30", "panel")
def _(v):
    return curves(v).select("x", "y", "lag", "n", R6("r").alias("r"))


@query("C16_pair_table", f"+{CURVES}, {BEST} SELECT x, y, lag, round(r, 6) AS r FROM bl", "panel")
def _(v):
    return st.best_lags(curves(v), ["x", "y"]).select("x", "y", "lag", R6("r").alias("r"))


#: Half-widths of C16's windows around the event.
WIDTHS = [10, 15, 20, 25, 30]


@query(
    "C16_pair_windows",
    f"+ev AS (SELECT * FROM panel WHERE d BETWEEN DATE '1995-07-01' - 45 AND DATE '1995-07-01' + 45), cv AS (SELECT a.variable AS x, b.variable AS y, w, CAST(l AS INT) AS lag, count(*) AS n, {PEARSON('a.value', 'b.value')} AS r FROM ev a, range(-10, 11) l(l), ev b, (VALUES {', '.join(f'({w})' for w in WIDTHS)}) h(w) "
    "WHERE a.variable < b.variable AND b.d = a.d + CAST(l AS INT) AND abs(date_diff('day', DATE '1995-07-01', a.d)) <= w GROUP BY 1, 2, 3, 4), "
    "bc AS (SELECT x, y, w, arg_max(lag, struct_pack(a := abs(r), b := -lag)) AS lag, round(arg_max(r, struct_pack(a := abs(r), b := -lag)), 6) AS r, arg_max(n, struct_pack(a := abs(r), b := -lag)) AS n FROM cv WHERE n >= 30 AND r IS NOT NULL GROUP BY 1, 2, 3), "
    f"al AS (SELECT a.variable AS x, b.variable AS y, w FROM (SELECT DISTINCT variable FROM panel) a, (SELECT DISTINCT variable FROM panel) b, (VALUES {', '.join(f'({w})' for w in WIDTHS)}) h(w) WHERE a.variable < b.variable), mx AS (SELECT x, y, w, max(n) AS most FROM cv GROUP BY 1, 2, 3) "
    "SELECT x, y, w AS \"window\", lag, r, n, coalesce(most, 0) AS days, CASE WHEN lag IS NULL THEN 'fewer than 30 days' ELSE 'kept' END AS reason FROM al LEFT JOIN bc USING (x, y, w) LEFT JOIN mx USING (x, y, w)",
    "panel",
)
def _(v):
    """The best lag of each pair for every half-width of the window around the event, from lags with at least 30 days; why a window has none."""
    curve = window_curves(v, WIDTHS, 10, least=1).where("x < y").select("x", "y", "window", "lag", "n", "r")
    best = st.best_lags(curve.where("n >= 30 AND r IS NOT NULL"), ["x", "y", "window"])
    names = v.panel.select("variable").distinct()  # a row a variable
    every = names.select(c("variable").alias("x")).join(names.select(c("variable").alias("y")), F.expr("x < y")).select("x", "y", F.explode(F.lit(WIDTHS)).alias("window"))
    days = curve.groupBy("x", "y", "window").agg(F.max("n").alias("days"))
    out = every.join(best, ["x", "y", "window"], "left").join(days, ["x", "y", "window"], "left")
    return out.select("x", "y", "window", "lag", R6("r").alias("r"), "n", F.coalesce("days", F.lit(0).cast("long")).alias("days"), F.when(c("lag").isNull(), "fewer than 30 days").otherwise("kept").alias("reason"))


@query("C17_lead_edges", f"+{CURVES}, {BEST} SELECT CASE WHEN lag > 0 THEN x ELSE y END AS source, CASE WHEN lag > 0 THEN y ELSE x END AS target, abs(lag) AS days, round(r, 6) AS r FROM bl WHERE abs(r) >= 0.03 AND lag <> 0", "panel")
def _(v):
    return st.lead_edges(st.best_lags(curves(v), ["x", "y"]), 0.03).withColumn("r", R6("r"))


@query("C18_plateau", f"+{CURVES}, pk AS (SELECT x, y, max(abs(r)) AS peak FROM lc GROUP BY 1, 2) SELECT x, y, min(lag) AS first, max(lag) AS last, count(*) AS width FROM lc JOIN pk USING (x, y) WHERE abs(r) >= 0.8::DOUBLE * peak GROUP BY 1, 2", "panel")
def _(v):
    return st.plateau(curves(v), ["x", "y"], 0.8)


YEARLY = f"ly AS (SELECT year(a.d) AS yr, a.variable AS x, b.variable AS y, CAST(l AS INT) AS lag, count(*) AS n, {PEARSON('a.value', 'b.value')} AS r FROM panel a, range(-5, 6) l(l), panel b WHERE a.variable < b.variable AND b.d = a.d + CAST(l AS INT) GROUP BY 1, 2, 3, 4), by_ AS (SELECT yr, x, y, arg_max(lag, struct_pack(a := abs(r), b := -lag)) AS lag, max(abs(r)) AS r FROM ly WHERE n >= 30 GROUP BY 1, 2, 3)"


def yearly_best(v):
    from ..operators.joins import lagged_pairs

    pairs = lagged_pairs(v.panel, v.panel, range(-5, 6)).where("x < y")
    g = pairs.groupBy(F.year("d").alias("yr"), "x", "y", "lag").agg(F.count("*").alias("n"), st.pearson("vx", "vy").alias("r")).where("n >= 30 AND r IS NOT NULL")
    return st.best_lags(g, ["yr", "x", "y"]).withColumn("r", F.abs("r"))


#: Half-widths of the windows around an event, largest lags, least number of days of a setup.
HALVES, MOST, LEAST = [20, 30, 40, 50, 60, 70, 80, 90, 100], [5, 10, 15], 12
EVENT = "1995-07-01"


def setups_sql(halves, most, least: int) -> str:
    """su: the best lag of each pair, window, largest lag and direction."""
    reach = max(halves) + max(most)
    return (
        f"+ev AS (SELECT * FROM panel WHERE d BETWEEN DATE '{EVENT}' - {reach} AND DATE '{EVENT}' + {reach}), "
        f"pr AS (SELECT a.variable AS a, b.variable AS b, CAST(l AS INT) AS lag, abs(date_diff('day', DATE '{EVENT}', a.d)) AS off, a.value AS va, b.value AS vb FROM ev a, range({-max(most)}, {max(most) + 1}) l(l), ev b WHERE a.variable <> b.variable AND b.d = a.d + CAST(l AS INT)), "
        f"cv AS (SELECT a, b, w, lag, count(*) AS n, {PEARSON('va', 'vb')} AS r FROM pr, (VALUES {', '.join(f'({h})' for h in halves)}) h(w) WHERE off <= w GROUP BY 1, 2, 3, 4 HAVING count(*) >= {least}), "
        "bs AS (SELECT a, b, w, m, arg_max(lag, struct_pack(k := abs(r), l := -lag)) AS lag, arg_max(r, struct_pack(k := abs(r), l := -lag)) AS r, arg_max(n, struct_pack(k := abs(r), l := -lag)) AS n "
        f"FROM cv, (VALUES {', '.join(f'({m})' for m in most)}) k(m) WHERE abs(lag) <= m AND r IS NOT NULL GROUP BY 1, 2, 3, 4), "
        "su AS (SELECT least(a, b) AS x, greatest(a, b) AS y, w, m, CASE WHEN a < b THEN 'forward' ELSE 'reverse' END AS dir, n, CASE WHEN a < b THEN lag ELSE -lag END AS lag, r FROM bs)"
    )


SETUPS = setups_sql(HALVES, MOST, LEAST)


def window_curves(v, halves, most, least: int = LEAST):
    """x, y, window, lag, n, r of both directions for every half-width around the event."""
    from ..operators.joins import lagged_pairs

    event = F.lit(EVENT).cast("date")
    ev = v.panel.where(c("d").between(F.date_sub(event, max(halves) + most), F.date_add(event, max(halves) + most)))
    pairs = lagged_pairs(ev, ev, range(-most, most + 1)).where("x <> y").withColumn("off", F.abs(F.datediff("d", F.lit(EVENT))))
    wide = pairs.withColumn("window", F.explode(F.filter(F.lit(halves), lambda h: h >= c("off"))))
    return wide.groupBy("x", "y", "window", "lag").agg(F.count("*").alias("n"), st.pearson("vx", "vy").alias("r")).where(f"n >= {least} AND (r IS NOT NULL OR {least} = 1)")


def setups(v, halves=HALVES, most=MOST, least: int = LEAST):
    """The best lag of each pair for the windows (9), 3 largest lags and 2 directions. The fixed side's window decides which days count, so the directions
    differ; a reversed lag's sign is turned. One join at the largest lag and one aggregation a window serve all 54 setups."""
    curve = window_curves(v, halves, max(most), least)
    each = curve.withColumn("max_lag", F.explode(F.filter(F.lit(most), lambda m: m >= F.abs("lag"))))
    ahead = c("x") < c("y")
    return st.best_lags(each, ["x", "y", "window", "max_lag"]).select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "window", "max_lag", F.when(ahead, "forward").otherwise("reverse").alias("direction"), "n", F.when(ahead, c("lag")).otherwise(-c("lag")).alias("lag"), "r"
    )


@query("C22_all_setups", f"{SETUPS} SELECT x, y, w AS \"window\", m AS max_lag, dir AS direction, n, lag, round(r, 6) AS r FROM su", "panel")
def _(v):
    return setups(v).select("x", "y", "window", "max_lag", "direction", "n", "lag", R6("r").alias("r"))


#: Windows, largest lag and least days of the stability study; what counts as stable.
STAB = (list(range(10, 26)), [15], 10)
STABLE_N, STABLE_IQR, STABLE_SIGNS = 3, 4, 0.8


@query(
    "C19_stability_classes",
    f"{setups_sql(*STAB)}, rw AS (SELECT x, y, dir, CASE WHEN dir = 'forward' THEN lag ELSE -lag END AS lag, r FROM su), "
    "s AS (SELECT x, y, dir, count(*) AS n, quantile_cont(lag, 0.5) AS med, quantile_cont(lag, 0.25) AS q25, quantile_cont(lag, 0.75) AS q75, greatest(coalesce(avg((lag > 0)::INT) FILTER (lag <> 0), 1), coalesce(avg((lag < 0)::INT) FILTER (lag <> 0), 1)) AS consistency, quantile_cont(abs(r), 0.5) AS r FROM rw GROUP BY 1, 2, 3), "
    "al AS (SELECT a.variable AS x, b.variable AS y, dir FROM (SELECT DISTINCT variable FROM panel) a, (SELECT DISTINCT variable FROM panel) b, (VALUES ('forward'), ('reverse')) z(dir) WHERE a.variable < b.variable) "
    f"SELECT x, y, dir AS direction, coalesce(n, 0) AS n, med, q25, q75, q75 - q25 AS iqr, round(consistency, 6) AS consistency, round(r, 6) AS r, CASE WHEN n IS NULL THEN 'insufficient-data' WHEN n >= {STABLE_N} AND q75 - q25 <= {STABLE_IQR} AND consistency >= {STABLE_SIGNS}::DOUBLE THEN 'stable' ELSE 'unstable' END AS class FROM al LEFT JOIN s USING (x, y, dir)",
    "panel",
)
def _(v):
    """Each direction of a pair over the windows, at its own sign: the fixed side's name comes first. Zero lags have no sign; lags that are all zero agree."""
    su = setups(v, *STAB).withColumn("lag", F.when(c("direction") == "forward", c("lag")).otherwise(-c("lag")))
    q = F.percentile("lag", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = F.lit(1.0)
    share = lambda sign: F.coalesce(F.avg(F.when(c("lag") != 0, (F.signum("lag") == sign).cast("double"))), one)
    s = su.groupBy("x", "y", "direction").agg(F.count("*").alias("n"), q.alias("q"), F.greatest(share(1), share(-1)).alias("consistency"), F.percentile(F.abs("r"), F.lit(0.5)).alias("r"))
    names = v.panel.select("variable").distinct()  # a row a variable
    every = names.select(c("variable").alias("x")).join(names.select(c("variable").alias("y")), F.expr("x < y")).select("x", "y", F.explode(F.lit(["forward", "reverse"])).alias("direction"))
    iqr = c("q")[2] - c("q")[0]
    kind = F.when(c("n").isNull(), "insufficient-data").when((c("n") >= STABLE_N) & (iqr <= STABLE_IQR) & (c("consistency") >= STABLE_SIGNS), "stable").otherwise("unstable")
    out = every.join(s, ["x", "y", "direction"], "left")
    return out.select("x", "y", "direction", F.coalesce("n", F.lit(0).cast("long")).alias("n"), c("q")[1].alias("med"), c("q")[0].alias("q25"), c("q")[2].alias("q75"), iqr.alias("iqr"), R6("consistency").alias("consistency"), R6("r").alias("r"), kind.alias("class"))


@query(
    "C20_consensus",
    f"{setups_sql(*STAB)}, g AS (SELECT x, y, count(*) AS n, quantile_cont(lag, 0.5) AS med FROM su GROUP BY 1, 2) SELECT x, y, n, med, round_even(med, 0) AS lag, CASE WHEN round_even(med, 0) > 0 THEN x WHEN round_even(med, 0) < 0 THEN y ELSE '' END AS leader FROM g",
    "panel",
)
def _(v):
    """The median over the windows of both directions, a reversed one's sign turned, in whole days; nobody leads at 0."""
    g = setups(v, *STAB).groupBy("x", "y").agg(F.count("*").alias("n"), F.percentile("lag", F.lit(0.5)).alias("med"))
    lag = F.rint("med")
    return g.select("x", "y", "n", "med", lag.alias("lag"), F.when(lag > 0, c("x")).when(lag < 0, c("y")).otherwise("").alias("leader"))


#: The bootstrap's half-width, largest lag, block, replicates and least days.
PRIMARY, BOOT_LAG, BLOCK, DRAWS, BOOT_LEAST = 20, 5, 3, 1000, 12
BOOT_DAYS = 2 * PRIMARY + 1
BOOT_SUMS = ["n", "sx", "sy", "xx", "yy", "xy"]


@query(
    "C21_bootstrap_lag",
    f"+pp AS (SELECT a.variable AS x, b.variable AS y, year(a.d) AS yr, date_diff('day', make_date(year(a.d), 7, 1), a.d) + {PRIMARY} AS i, CAST(l AS INT) AS lag, a.value AS vx, b.value AS vy FROM panel a, range({-BOOT_LAG}, {BOOT_LAG + 1}) l(l), panel b WHERE a.variable < b.variable AND b.d = a.d + CAST(l AS INT) AND abs(date_diff('day', make_date(year(a.d), 7, 1), a.d)) <= {PRIMARY}), "
    "mu AS (SELECT x, y, yr, avg(vx) AS mx, avg(vy) AS my FROM pp GROUP BY 1, 2, 3), ce AS (SELECT x, y, yr, i, lag, vx - mx AS u, vy - my AS v FROM pp JOIN mu USING (x, y, yr)), "
    f"dy AS (SELECT x, y, yr, lag, i, count(u) AS n, coalesce(sum(u), 0) AS sx, coalesce(sum(v), 0) AS sy, coalesce(sum(u * u), 0) AS xx, coalesce(sum(v * v), 0) AS yy, coalesce(sum(u * v), 0) AS xy FROM (SELECT DISTINCT x, y, yr, lag FROM ce) k CROSS JOIN range({BOOT_DAYS}) d(i) LEFT JOIN ce USING (x, y, yr, lag, i) GROUP BY ALL), "
    "ps AS MATERIALIZED (SELECT x, y, yr, lag, i + 1 AS i, " + ", ".join(f"sum({k}) OVER w AS {k}" for k in BOOT_SUMS) + " FROM dy WINDOW w AS (PARTITION BY x, y, yr, lag ORDER BY i) UNION ALL SELECT DISTINCT x, y, yr, lag, 0, 0, 0, 0, 0, 0, 0 FROM dy), "
    f"dr AS MATERIALIZED (SELECT x, y, yr, rep, least({BLOCK}, {BOOT_DAYS} - {BLOCK} * k) AS len, CAST('0x' || substr(md5(x || '|' || y || '|' || yr || '|' || rep || '|' || k), 1, 8) AS BIGINT) % {BOOT_DAYS - BLOCK + 1} AS s FROM (SELECT DISTINCT x, y, yr FROM ce), range({DRAWS}) r(rep), range({-(-BOOT_DAYS // BLOCK)}) b(k)), "
    "sm AS (SELECT x, y, yr, rep, lag, " + ", ".join(f"sum(e.{k} - b.{k}) AS {k}" for k in BOOT_SUMS) + " FROM dr JOIN ps e USING (x, y, yr) JOIN ps b USING (x, y, yr, lag) WHERE e.i = s + len AND b.i = s GROUP BY ALL), "
    "rr AS (SELECT x, y, yr, rep, lag, round(abs((n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy))), 9) AS r FROM sm "
    f"WHERE n >= {BOOT_LEAST} AND n * xx - sx * sx > 1e-9::DOUBLE * n * xx AND n * yy - sy * sy > 1e-9::DOUBLE * n * yy), "
    "bl AS (SELECT x, y, yr, rep, arg_max(lag, struct_pack(a := r, b := -lag)) AS lag FROM rr GROUP BY 1, 2, 3, 4) "
    "SELECT x, y, yr, count(*)::INT AS replicates, quantile_cont(lag, 0.025) AS lo, quantile_cont(lag, 0.5) AS mid, quantile_cont(lag, 0.975) AS hi FROM bl GROUP BY 1, 2, 3",
    "panel",
)
def _(v):
    """1,000 draws of moving three-day blocks from the 41 days around 1 July, for each pair and year; pairs and years without an interval are left out."""
    from ..operators.joins import lagged_pairs

    pairs = lagged_pairs(v.panel, v.panel, range(-BOOT_LAG, BOOT_LAG + 1)).where("x < y").withColumn("yr", F.year("d"))
    pairs = pairs.withColumn("i", F.datediff("d", F.make_date("yr", F.lit(7), F.lit(1))) + PRIMARY).where(c("i").between(0, BOOT_DAYS - 1))
    return st.bootstrap_best_lags(pairs, ["x", "y", "yr"], "i", BOOT_DAYS, BLOCK, DRAWS, BOOT_LEAST).where("replicates > 0")


@query(
    "C23_pair_summary",
    f"{SETUPS}, g AS (SELECT x, y, count(*) AS setups, quantile_cont(lag, 0.5) AS med, quantile_cont(lag, 0.75) - quantile_cont(lag, 0.25) AS iqr, quantile_cont(abs(r), 0.5) AS r, greatest(avg((lag > 0)::INT), avg((lag < 0)::INT), avg((lag = 0)::INT)) AS pos FROM su GROUP BY 1, 2) SELECT x, y, setups, med, iqr, CASE WHEN med > 0 THEN x WHEN med < 0 THEN y ELSE least(x, y) END AS leader, CASE WHEN med > 0 THEN y WHEN med < 0 THEN x ELSE greatest(x, y) END AS follower, round(r, 6) AS r, round(pos, 6) AS consistency FROM g WHERE setups >= 12",
    "panel",
)
def _(v):
    """Over the setups; the interval of the median is C23_median_interval's."""
    g = pair_summary(setups(v))
    leader = F.when(c("med") > 0, c("x")).when(c("med") < 0, c("y")).otherwise(F.least("x", "y"))
    follower = F.when(c("med") > 0, c("y")).when(c("med") < 0, c("x")).otherwise(F.greatest("x", "y"))
    return g.select("x", "y", "setups", "med", "iqr", leader.alias("leader"), follower.alias("follower"), R6("r").alias("r"), R6("consistency").alias("consistency"))


def pair_summary(su):
    """Pairs with at least 12 setups: number, median lag, its spread, median |r|, and the largest share of lags of one sign (none is one)."""
    q = F.percentile("lag", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = su.groupBy("x", "y").agg(F.count("*").alias("setups"), q.alias("q"), F.percentile(F.abs("r"), F.lit(0.5)).alias("r"), st.sign_consistency("lag").alias("consistency")).where("setups >= 12")
    return g.select("x", "y", "setups", c("q")[1].alias("med"), (c("q")[2] - c("q")[0]).alias("iqr"), "r", "consistency")


@query("C23_median_interval", f"{SETUPS}, {st.median_interval_sql(1000)} SELECT * FROM bi", "panel")
def _(v):
    """A 95 % interval of the median lag from 1,000 draws of the setups with replacement."""
    return st.median_interval(setups(v), ["x", "y"], "lag", ["window", "max_lag", "direction"], 1000, least=12)


@query("C24_winsorised", "+p AS (SELECT variable, d, value FROM panel UNION ALL SELECT 'flat', d, CAST(value > 0 AS INT) * 1.0 FROM panel WHERE variable = '1-URGENT'), q AS (SELECT variable, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM p GROUP BY 1), k AS (SELECT variable, d, value, (rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2) / count(*) OVER (PARTITION BY variable) AS pct FROM p) SELECT variable, d, round(CASE WHEN hi > lo THEN (greatest(lo, least(hi, value)) - lo) / (hi - lo) ELSE pct END, 6) AS scaled FROM k JOIN q USING (variable)", "panel")
def _(v):
    """A series that is constant between its 5 and 95 % quantiles takes its average percent rank; `flat` is one."""
    flat = v.panel.where("variable = '1-URGENT'").select("d", F.lit("flat").alias("variable"), (c("value") > 0).cast("int").cast("double").alias("value"))
    return st.winsorised(v.panel.unionByName(flat), ["variable"], "value").select("variable", "d", R6("scaled").alias("scaled"))


@query("C25_composite_uncertainty", f"+{YEARLY}, s AS (SELECT x, y, quantile_cont(lag, 0.75) - quantile_cont(lag, 0.25) AS iqr, 1 - quantile_cont(r, 0.5) AS weak FROM by_ GROUP BY 1, 2) SELECT x, y, round(0.6::DOUBLE * least(iqr / 10, 1) + 0.4::DOUBLE * weak, 6) AS uncertainty FROM s", "panel")
def _(v):
    q = F.percentile("lag", F.array(F.lit(0.25), F.lit(0.75)))
    s = yearly_best(v).groupBy("x", "y").agg(q.alias("q"), (1 - F.percentile("r", F.lit(0.5))).alias("weak"))
    return s.select("x", "y", R6(0.6 * F.least((c("q")[1] - c("q")[0]) / 10, F.lit(1.0)) + 0.4 * c("weak")).alias("uncertainty"))


#: The setups' components, their weighted sum, and pairs with leader and follower; draws are the same hashes.
def _scaled_sql(rows: str, key: str, value: str, out: str) -> str:
    """rows with out: value winsorised by key; the average percent rank where the quantiles are equal."""
    return (
        f"{rows}_q AS (SELECT {key}, quantile_cont({value}, 0.05) AS lo, quantile_cont({value}, 0.95) AS hi FROM {rows} GROUP BY 1), "
        f"{rows}_s AS (SELECT {rows}.*, CASE WHEN hi > lo THEN (greatest(lo, least(hi, {value})) - lo) / (hi - lo) ELSE (rank() OVER (PARTITION BY {key} ORDER BY {value}) + (count(*) OVER (PARTITION BY {key}, {value}) - 1) / 2) / count(*) OVER (PARTITION BY {key}) END AS {out} FROM {rows} JOIN {rows}_q USING ({key}))"
    )


IQR = "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)".format
UNCERTAIN = (
    f"{SETUPS}, {st.median_interval_sql(500)}, sm AS (SELECT x, y, {IQR('lag')} AS a, quantile_cont(lag, 0.5) AS med, greatest(avg((lag > 0)::INT), avg((lag < 0)::INT), avg((lag = 0)::INT)) AS pos FROM su GROUP BY 1, 2 HAVING count(*) >= 12), "
    f"uw AS (SELECT x, y, {IQR('q')} AS b FROM (SELECT x, y, w, quantile_cont(lag, 0.5) AS q FROM su GROUP BY 1, 2, 3) GROUP BY 1, 2), um AS (SELECT x, y, {IQR('q')} AS c FROM (SELECT x, y, m, quantile_cont(lag, 0.5) AS q FROM su GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "ud AS (SELECT x, y, quantile_cont(abs(f - g), 0.5) AS d FROM (SELECT x, y, w, m, max(lag) FILTER (dir = 'forward') AS f, max(lag) FILTER (dir = 'reverse') AS g FROM su GROUP BY ALL) GROUP BY 1, 2), "
    "cw AS (SELECT x, y, a AS setups, b AS windows, c AS max_lags, d AS directions, 1 - pos AS signs, iqr AS draws, hi - lo AS \"interval\" FROM sm JOIN uw USING (x, y) JOIN um USING (x, y) JOIN ud USING (x, y) JOIN bi USING (x, y)), "
    f"cl AS (SELECT x, y, unnest({list(st.COMPONENTS)}) AS k, unnest([setups::DOUBLE, windows, max_lags, directions, signs, draws, \"interval\"]) AS v, unnest({list(st.COMPONENTS.values())}) AS wt FROM cw), "
    f"cf AS (SELECT x, y, k, wt, coalesce(v, quantile_cont(v, 0.5) OVER (PARTITION BY k)) AS v FROM cl), {_scaled_sql('cf', 'k', 'v', 's')}, "
    f"un AS (SELECT 1 AS one, x, y, round(sum(wt * s), 9) AS composite FROM cf_s GROUP BY x, y), {_scaled_sql('un', 'one', 'composite', 'uncertainty')}, "
    "pq AS (SELECT CASE WHEN med >= 0 THEN x ELSE y END AS leader, CASE WHEN med >= 0 THEN y ELSE x END AS follower, uncertainty FROM un_s JOIN sm USING (x, y))"
)
#: Tendencies of the variables of a set of pairs.
TENDENCY = "SELECT variable, sum(l)::BIGINT AS leads, count(*) AS n, (2 * sum(l) - count(*)) / count(*) AS tendency, quantile_cont(uncertainty, 0.5) AS med, " + IQR("uncertainty") + " AS iqr FROM (SELECT leader AS variable, 1 AS l, uncertainty FROM {0} UNION ALL SELECT follower, 0, uncertainty FROM {0}) GROUP BY 1"


def uncertain_pairs(v):
    """x, y, leader, follower, composite, uncertainty. Pairs without a leading side take the lexically first as leader."""
    su = written(setups(v))  # a row a pair and setup
    med = pair_summary(su).select("x", "y", "med")
    u = st.composite_uncertainty(st.uncertainty_components(su)).join(med, ["x", "y"])
    ahead = c("med") >= 0
    return written(u.select("x", "y", F.when(ahead, c("x")).otherwise(c("y")).alias("leader"), F.when(ahead, c("y")).otherwise(c("x")).alias("follower"), "composite", "uncertainty"))


@query("C25_components", f"{UNCERTAIN} SELECT x, y, setups, windows, max_lags, directions, round(signs, 6) AS signs, draws, \"interval\" FROM cw", "panel")
def _(v):
    """The seven components over the 54 setups of each pair, two of them from 500 draws."""
    return st.uncertainty_components(written(setups(v))).withColumn("signs", R6("signs"))


@query("C25_pair_uncertainty", f"{UNCERTAIN} SELECT x, y, round(composite, 6) AS composite, round(uncertainty, 5) AS uncertainty FROM un_s", "panel")
def _(v):
    return uncertain_pairs(v).select("x", "y", R6("composite").alias("composite"), F.round("uncertainty", 5).alias("uncertainty"))


@query(
    "C26_node_uncertainty",
    f"{UNCERTAIN}, nt AS (SELECT 1 AS one, *, round(med + 0.6::DOUBLE * iqr, 9) AS raw FROM ({TENDENCY.format('pq')})), {_scaled_sql('nt', 'one', 'raw', 'base')} "
    "SELECT variable, leads, n - leads AS follows, n AS pairs, round(leads / n, 6) AS lead_fraction, round((n - leads) / n, 6) AS follow_fraction, round(tendency, 6) AS tendency, round(raw, 5) AS raw, "
    "round(0.65::DOUBLE * base + 0.35::DOUBLE * (rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2) / count(*) OVER (), 4) AS uncertainty FROM nt_s",
    "panel",
)
def _(v):
    n = st.node_table(uncertain_pairs(v))
    return n.select("variable", "leads", "follows", "pairs", *[R6(k).alias(k) for k in ("lead_fraction", "follow_fraction", "tendency")], F.round("raw", 5).alias("raw"), R4("uncertainty").alias("uncertainty"))


SATELLITES = ("4-NOT SPECIFIED", "5-LOW")
STITCHED = (
    f"{UNCERTAIN}, every AS ({TENDENCY.format('pq')}), pc AS (SELECT * FROM pq WHERE leader NOT IN {SATELLITES} AND follower NOT IN {SATELLITES}), core AS ({TENDENCY.format('pc')}), "
    f"ps AS (SELECT * FROM pq WHERE leader IN {SATELLITES} AND follower IN {SATELLITES}), own AS ({TENDENCY.format('ps')}), "
    f"sv AS (SELECT variable, variable IN {SATELLITES} AS satellite, core.tendency AS core, every.tendency AS every, own.tendency AS internal, every.n AS every_pairs, core.n AS core_pairs, "
    f"CASE WHEN variable IN {SATELLITES} THEN every.tendency ELSE core.tendency END AS mixed, CASE WHEN variable IN {SATELLITES} THEN coalesce(own.tendency, every.tendency) ELSE core.tendency END AS internal_first, "
    f"CASE WHEN variable IN {SATELLITES} THEN coalesce(own.med, every.med) ELSE core.med END AS uncertainty, every.tendency - core.tendency AS delta FROM every LEFT JOIN core USING (variable) LEFT JOIN own USING (variable))"
)


def stitched(v):
    return st.anchored(uncertain_pairs(v), lambda k: k.isin(*SATELLITES))


@query("C27_stitched", f"{STITCHED} SELECT variable, satellite, every_pairs, core_pairs, {', '.join(f'round({k}, 5) AS {k}' for k in ('core', 'every', 'internal', 'mixed', 'internal_first', 'uncertainty', 'delta'))} FROM sv", "panel")
def _(v):
    """Tendencies around the core: core variables from core pairs, satellites from all pairs or their own, and what the satellites' pairs change."""
    return stitched(v).select("variable", "satellite", "every_pairs", "core_pairs", *[F.round(k, 5).alias(k) for k in ("core", "every", "internal", "mixed", "internal_first", "uncertainty", "delta")])


@query(
    "C28_stitching_checks",
    f"{STITCHED}, ag AS (SELECT variable, (SELECT count(*) FROM pc WHERE leader = variable) AS l, (SELECT count(*) FROM pc WHERE follower = variable) AS f FROM sv) SELECT (SELECT max(abs(core - (l - f) / nullif(l + f, 0))) FROM sv JOIN ag USING (variable)) AS core_error, bool_and(mixed IS NOT DISTINCT FROM core) FILTER (NOT satellite) AS core_rule, bool_and(mixed IS NOT DISTINCT FROM every) FILTER (satellite) AS satellite_rule, count(internal) FILTER (satellite) AS with_internal, "
    "round(quantile_cont(abs(every - internal), 0.5) FILTER (satellite), 5) AS med_difference, round(max(abs(every - internal)) FILTER (satellite), 5) AS most_difference, min(every_pairs) AS least_degree, quantile_cont(every_pairs, 0.5) AS med_degree, count(*) AS nodes FROM sv",
    "panel",
)
def _(v):
    """Whether stitched tendencies follow the rule, and how far core tendencies counted in another way (leads and follows of each side apart) are from them."""
    pairs = uncertain_pairs(v)
    core = pairs.where(~c("leader").isin(*SATELLITES) & ~c("follower").isin(*SATELLITES))
    side = lambda k: core.groupBy(c(k).alias("variable")).agg(F.count("*").alias(k))
    leads, follows = F.coalesce("leader", F.lit(0)), F.coalesce("follower", F.lit(0))
    again = side("leader").join(side("follower"), "variable", "full").select("variable", ((leads - follows) / (leads + follows)).alias("again"))
    t = st.anchored(pairs, lambda k: k.isin(*SATELLITES)).join(again, "variable", "left")
    sat, apart = c("satellite"), F.abs(c("every") - c("internal"))
    return t.agg(
        F.max(F.abs(c("core") - c("again"))).alias("core_error"), F.bool_and(F.when(~sat, c("mixed").eqNullSafe(c("core")))).alias("core_rule"), F.bool_and(F.when(sat, c("mixed").eqNullSafe(c("every")))).alias("satellite_rule"),
        F.count(F.when(sat, c("internal"))).alias("with_internal"), F.round(F.percentile(F.when(sat, apart), F.lit(0.5)), 5).alias("med_difference"), F.round(F.max(F.when(sat, apart)), 5).alias("most_difference"),
        F.min("every_pairs").alias("least_degree"), F.percentile("every_pairs", F.lit(0.5)).alias("med_degree"), F.count("*").alias("nodes"),
    )


NODES = "nd AS (SELECT x AS node, CASE WHEN lag > 0 THEN 1 ELSE 0 END AS lead, CASE WHEN lag < 0 THEN 1 ELSE 0 END AS follow FROM bl UNION ALL SELECT y, CASE WHEN lag < 0 THEN 1 ELSE 0 END, CASE WHEN lag > 0 THEN 1 ELSE 0 END FROM bl)"


def node_rows(v):
    b = st.best_lags(curves(v), ["x", "y"])
    end = lambda k, s: F.struct(c(k).alias("node"), (s * c("lag") > 0).cast("int").alias("lead"), (s * c("lag") < 0).cast("int").alias("follow"))
    return b.select(F.explode(F.array(end("x", 1), end("y", -1))).alias("e")).select("e.*")


@query("C26_nodes", f"+{CURVES}, {BEST}, {NODES} SELECT node, sum(lead) AS leads, sum(follow) AS follows, round((sum(lead) - sum(follow)) / nullif(sum(lead) + sum(follow), 0), 6) AS tendency FROM nd GROUP BY 1", "panel")
def _(v):
    n = node_rows(v).groupBy("node").agg(F.sum("lead").alias("leads"), F.sum("follow").alias("follows"))
    return n.withColumn("tendency", R6(F.try_divide(c("leads") - c("follows"), c("leads") + c("follows"))))


@query("C27_anchored", f"+{CURVES}, {BEST}, {NODES}, core AS (SELECT * FROM bl WHERE x < '4' AND y < '4'), nc AS (SELECT x AS node, CASE WHEN lag > 0 THEN 1 WHEN lag < 0 THEN -1 ELSE 0 END AS t FROM core UNION ALL SELECT y, CASE WHEN lag > 0 THEN -1 WHEN lag < 0 THEN 1 ELSE 0 END FROM core) SELECT node, coalesce(c.t, a.t) AS tendency, c.t IS NOT NULL AS core FROM (SELECT node, sum(lead) - sum(follow) AS t FROM nd GROUP BY 1) a LEFT JOIN (SELECT node, sum(t) AS t FROM nc GROUP BY 1) c USING (node)", "panel")
def _(v):
    """Core variables are judged by core pairs only, the others by all pairs."""
    b = st.best_lags(curves(v), ["x", "y"]).where("x < '4' AND y < '4'")
    sign = F.signum("lag").cast("int")
    core = b.select(F.explode(F.array(F.struct(c("x").alias("node"), sign.alias("t")), F.struct(c("y").alias("node"), (-sign).alias("t")))).alias("e")).groupBy("e.node").agg(F.sum("e.t").alias("core_t"))
    every = node_rows(v).groupBy("node").agg(F.sum(c("lead") - c("follow")).alias("t"))
    return every.join(core, "node", "left").select("node", F.coalesce("core_t", "t").alias("tendency"), c("core_t").isNotNull().alias("core"))


@query("C28_degrees", f"+{CURVES}, {BEST}, {NODES}, g AS (SELECT node, count(*) AS degree FROM nd GROUP BY 1) SELECT min(degree) AS least, quantile_cont(degree, 0.5) AS med, count(*) AS nodes FROM g", "panel")
def _(v):
    g = node_rows(v).groupBy("node").agg(F.count("*").alias("degree"))
    return g.agg(F.min("degree").alias("least"), F.percentile("degree", F.lit(0.5)).alias("med"), F.count("*").alias("nodes"))


@query("C29_simple_regression", "+g AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_r2(y, x1) AS r2, count(*) AS n, sqrt(var_pop(y) * (1 - regr_r2(y, x1)) * count(*) / (count(*) - 2)) / avg(y) AS cv, regr_r2(y, x1) / ((1 - regr_r2(y, x1)) / (count(*) - 2)) AS f FROM drivers WHERE NOT (d BETWEEN DATE '1995-06-01' AND DATE '1995-08-31')) SELECT round(b, 6) AS slope, round(a, 6) AS intercept, round(r2, 6) AS r2, n, round(cv, 6) AS cv, round(f, 2) AS f FROM g", "drivers")
def _(v):
    """The event's summer is excluded; cv is the residuals' deviation over the mean of y, f the statistic whose tail C29_p_values gives."""
    d = v.drivers.where(~c("d").between("1995-06-01", "1995-08-31"))
    return st.simple_ols(d, [], "x1", "y").select(*[R6(k).alias(k) for k in ("slope", "intercept", "r2")], "n", R6("cv").alias("cv"), F.round("f", 2).alias("f"))


@query("C29_p_values")
def _(v):
    """The same regression by year with its p."""
    g = st.simple_ols(v.drivers.withColumn("yr", F.year("d")), ["yr"], "x1", "y")
    return g.withColumn("p", st.f_p(c("f"), F.lit(1.0), (c("n") - 2).cast("double")))


@query("C30_residuals", "+f AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM drivers) SELECT l_orderkey, l_linenumber, round(a + b * x1, 4) AS structural, round(y - a - b * x1, 4) AS signal FROM drivers, f", "drivers")
def _(v):
    f = v.drivers.agg(F.regr_slope("y", "x1").alias("b"), F.regr_intercept("y", "x1").alias("a"))  # one row
    return v.drivers.join(F.broadcast(f)).select("l_orderkey", "l_linenumber", R4(c("a") + c("b") * c("x1")).alias("structural"), R4(c("y") - c("a") - c("b") * c("x1")).alias("signal"))


@query("C31_pearson_by_regime", f"SELECT regime, count(*) AS n, round({PEARSON('y', 'x2')}, 6) AS r FROM (SELECT *, unnest(CASE WHEN x1 > 25 THEN ['all', 'high'] ELSE ['all', 'low'] END) AS regime FROM drivers) GROUP BY 1 HAVING count(*) >= 30", "drivers")
def _(v):
    regimes = F.when(c("x1") > 25, F.array(F.lit("all"), F.lit("high"))).otherwise(F.array(F.lit("all"), F.lit("low")))
    return v.drivers.withColumn("regime", F.explode(regimes)).groupBy("regime").agg(F.count("*").alias("n"), R6(st.pearson("y", "x2")).alias("r")).where("n >= 30")


@query("C31_p_values")
def _(v):
    """Pearson r with its two-sided p by year."""
    g = v.drivers.groupBy(F.year("d").alias("yr")).agg(F.count("*").alias("n"), st.pearson("x1", "x2").alias("r"))
    t = c("r") * F.sqrt(F.try_divide(c("n") - 2, 1 - c("r") * c("r")))
    return g.withColumn("p", st.student_p(t, (c("n") - 2).cast("double")))


R2 = "(a * a + b * b - 2 * a * b * c) / nullif(1 - c * c, 0)"


@query("C32_two_predictors", f"+k AS (SELECT year(d) AS yr, count(*) AS n, {PEARSON('y', 'x1')} AS a, {PEARSON('y', 'x2')} AS b, {PEARSON('x1', 'x2')} AS c FROM drivers GROUP BY 1) SELECT yr, n, round({R2}, 6) AS r2, round({R2} - a * a, 6) AS delta, round(({R2} - a * a) / ((1 - {R2}) / (n - 3)), 2) AS f FROM k", "drivers")
def _(v):
    """The larger model against the one without x2: gain and its F statistic."""
    return nested(v).select("yr", "n", R6("full").alias("r2"), R6("delta").alias("delta"), F.round("f", 2).alias("f"))


def nested(v):
    g = v.drivers.groupBy(F.year("d").alias("yr")).agg(F.count("*").alias("n"), st.two_predictor_r2("y", "x1", "x2").alias("full"), F.pow(st.pearson("y", "x1"), F.lit(2)).alias("r1"))
    return g.withColumn("delta", c("full") - c("r1")).withColumn("f", F.try_divide(c("delta"), F.try_divide(1 - c("full"), c("n") - 3)))


@query("C32_f_test")
def _(v):
    """The tail of C32's F statistic with 1 and n - 3 degrees of freedom."""
    return nested(v).withColumn("p", st.f_p(c("f"), F.lit(1.0), (c("n") - 3).cast("double")))


@query("C33_commonality", f"+k AS (SELECT year(d) AS yr, {PEARSON('y', 'x1')} AS a, {PEARSON('y', 'x2')} AS b, {PEARSON('x1', 'x2')} AS c FROM drivers GROUP BY 1), f AS (SELECT *, {R2} AS r FROM k) SELECT yr, round(r, 6) AS full_r2, round(greatest(r - b * b, 0), 6) AS unique1, round(greatest(r - a * a, 0), 6) AS unique2, round(greatest(a * a + b * b - r, 0), 6) AS shared FROM f", "drivers")
def _(v):
    return st.commonality(v.drivers.withColumn("yr", F.year("d")), ["yr"], "y", "x1", "x2").select("yr", R6("full").alias("full_r2"), *[R6(k).alias(k) for k in ("unique1", "unique2", "shared")])


@query("C34_best_form", "SELECT year(d) AS yr, round(regr_r2(y, x1), 6) AS linear, round(regr_r2(y, ln(x1)), 6) AS log FROM drivers WHERE x1 > 0 GROUP BY 1", "drivers")
def _(v):
    return v.drivers.where("x1 > 0").groupBy(F.year("d").alias("yr")).agg(R6(F.regr_r2("y", "x1")).alias("linear"), R6(F.regr_r2("y", F.log("x1"))).alias("log"))


@query("C34_quadratic", "+m AS (SELECT avg(x1) AS m FROM drivers), u AS (SELECT y, x1 - m AS u, (x1 - m) ** 2 AS w FROM drivers, m), g AS (SELECT covar_pop(u, u) AS uu, covar_pop(u, w) AS uw, covar_pop(w, w) AS ww, covar_pop(u, y) AS uy, covar_pop(w, y) AS wy, var_pop(y) AS yy FROM u), s AS (SELECT *, (uy * ww - wy * uw) / (uu * ww - uw * uw) AS b, (wy * uu - uy * uw) / (uu * ww - uw * uw) AS q FROM g) SELECT round(q, 6) AS c, round((b * uy + q * wy) / yy, 6) AS r2 FROM s", "drivers")
def _(v):
    return st.quadratic_fit(v.drivers, [], "x1", "y").select(R6("c").alias("c"), R6("r2").alias("r2"))


@query("C34_exponential")
def _(v):
    """Each year's least-squares exponential, refined from the best rate of the grid."""
    return st.exponential_fit(v.drivers.withColumn("yr", F.year("d")), ["yr"], "x1", "y", st.rates())


RATES = ", ".join(f"({b!r}::DOUBLE)" for b in st.rates())


def forms_sql(key: str, source: str) -> str:
    """The four forms' r2 by key: exponentials over the same grid of rates."""
    return (
        f"fs AS (SELECT {key} AS k, x, y FROM {source}), ct AS (SELECT k, avg(x) AS mx FROM fs GROUP BY 1), fu AS (SELECT k, y, x - mx AS u, (x - mx) ** 2 AS w FROM fs JOIN ct USING (k)), "
        "qg AS (SELECT k, covar_pop(u, u) AS uu, covar_pop(u, w) AS uw, covar_pop(w, w) AS ww, covar_pop(u, y) AS uy, covar_pop(w, y) AS wy, var_pop(y) AS yy FROM fu GROUP BY 1), "
        "ff AS (SELECT k, 'linear' AS form, regr_r2(y, x) AS r2 FROM fs GROUP BY 1 UNION ALL SELECT k, 'logarithmic', CASE WHEN min(x) > 0 THEN regr_r2(y, ln(greatest(x, 1e-300::DOUBLE))) END FROM fs GROUP BY 1 "
        "UNION ALL SELECT k, 'quadratic', ((uy * ww - wy * uw) * uy + (wy * uu - uy * uw) * wy) / nullif(uu * ww - uw * uw, 0) / nullif(yy, 0) FROM qg "
        f"UNION ALL SELECT k, 'exponential', max(r2) FROM (SELECT k, b, regr_r2(y, exp(b * x)) AS r2 FROM fs, (VALUES {RATES}) z(b) GROUP BY 1, 2) GROUP BY 1), "
        f"en AS (SELECT k FROM fs GROUP BY 1 HAVING count(x) >= {st.LEAST_FIT} AND var_pop(y) > 0), "
        "bf AS (SELECT k, arg_max(form, struct_pack(a := round(r2, 9), b := form)) AS form, max(r2) AS r2 FROM ff JOIN en USING (k) WHERE r2 IS NOT NULL GROUP BY 1)"
    )


@query("C34_exponential_grid", f"+one AS (SELECT 1) SELECT year(d) AS yr, round(b, 6) AS b, round(r2, 6) AS r2 FROM (SELECT d, b, r2 FROM (SELECT min(d) AS d, year(d) AS k, b, regr_r2(y, exp(b * x1)) AS r2 FROM drivers, (VALUES {RATES}) z(b) GROUP BY 2, 3 HAVING count(y) >= {st.LEAST_FIT}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY r2 DESC) = 1)", "drivers")
def _(v):
    """The grid's best rate of each year."""
    return st.exponential_grid(v.drivers.withColumn("yr", F.year("d")), ["yr"], "x1", "y", st.rates()).select("yr", R6("b").alias("b"), R6("r2").alias("r2"))


@query("C34_best_of_four_refined")
def _(v):
    """The best of four with the exponential's rate refined."""
    return st.best_form(v.drivers.withColumn("yr", F.year("d")), ["yr"], "x1", "y", refined=True).select("yr", "form", R6("r2").alias("r2"))


@query("C34_best_of_four", f"+{forms_sql('year(d)', '(SELECT *, x1 AS x FROM drivers)')} SELECT k AS yr, form, round(r2, 6) AS r2 FROM bf", "drivers")
def _(v):
    return st.best_form(v.drivers.withColumn("yr", F.year("d")), ["yr"], "x1", "y").select("yr", "form", R6("r2").alias("r2"))


#: First hours, last hours, rolling days and lags of the search, in every combination.
FIRST, LAST, ROLLS, LAGS = range(1, 13), range(14, 23), [1, 2, 3, 5, 7, 10, 14], range(-2, 2)
STREAMS = ["view", "purchase", "error", "signup"]
C35 = (
    f"+h AS (SELECT stream, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, hour(ts) AS h, sum(value) AS s, count(*) AS n FROM obs WHERE stream IN {tuple(STREAMS)} GROUP BY 1, 2, 3), "
    f"w AS (SELECT stream, a AS h0, b AS h1, d, sum(s) / sum(n) AS m FROM h, range({FIRST[0]}, {FIRST[-1] + 1}) x(a), range({LAST[0]}, {LAST[-1] + 1}) y(b) WHERE b - a >= 4 AND h >= a AND h < b GROUP BY 1, 2, 3, 4), "
    f"r AS ({' UNION ALL '.join(f'SELECT stream, h0, h1, d, {k} AS roll, avg(m) OVER f AS x, count(*) OVER f AS k FROM w WINDOW f AS (PARTITION BY stream, h0, h1 ORDER BY d RANGE BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING)' for k in ROLLS)}), "
    "t AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, avg(value) AS y FROM obs WHERE stream = 'click' GROUP BY 1), "
    f"z AS (SELECT stream, h0, h1, roll, lag, x, y FROM r, range({LAGS[0]}, {LAGS[-1] + 1}) l(lag), t WHERE k = roll AND t.d = r.d - lag), "
    "mm AS (SELECT stream, h0, h1, roll, lag, avg(x) AS mx FROM z GROUP BY 1, 2, 3, 4, 5), u AS (SELECT stream, h0, h1, roll, lag, y, x - mx AS u, (x - mx) ** 2 AS w FROM z JOIN mm USING (stream, h0, h1, roll, lag)), "
    "g AS (SELECT stream, h0, h1, roll, lag, covar_pop(u, u) AS uu, covar_pop(u, w) AS uw, covar_pop(w, w) AS ww, covar_pop(u, y) AS uy, covar_pop(w, y) AS wy, var_pop(y) AS yy FROM u GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 15 AND var_pop(y) > 0), "
    "q AS (SELECT *, ((uy * ww - wy * uw) * uy + (wy * uu - uy * uw) * wy) / nullif(uu * ww - uw * uw, 0) / yy AS r2 FROM g), "
    f"gr AS (SELECT h0, h1, roll, lag, avg(r2) AS mean_r2 FROM q GROUP BY 1, 2, 3, 4 HAVING count(r2) = {len(STREAMS)})"
)


def window_grid(v):
    """Mean R squared of a quadratic (never below the line's) over the streams, all of which must have 15 days, for every window, rolling mean and lag.

    A day's running sums over its hours serve every window, as the difference of two; the rolling means of a window share one sort; lags are exploded.
    """
    day = F.datediff("ts", F.lit("1970-01-01"))
    h = v.obs.where(c("stream").isin(STREAMS)).groupBy("stream", day.alias("d"), F.hour("ts").alias("h")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    w = st.hour_windows(h, ["stream", "d"], "h", "s", "n", [(a, b) for a in FIRST for b in LAST if b - a >= 4]).withColumnRenamed("mean", "m")
    by = Window.partitionBy("stream", "h0", "h1").orderBy("d")
    rolled = []
    for k in ROLLS:  # centred, of whole windows only
        f = by.rangeBetween(-(k // 2), (k - 1) // 2)
        rolled.append(F.struct(F.lit(k).alias("roll"), F.avg("m").over(f).alias("x"), F.count("m").over(f).alias("k")))
    r = w.select("stream", "h0", "h1", "d", F.array(*rolled).alias("r")).select("stream", "h0", "h1", "d", F.explode("r").alias("r")).where("r.k = r.roll")
    z = r.select("stream", "h0", "h1", "r.roll", "r.x", "d", F.explode(F.lit(list(LAGS))).alias("lag")).withColumn("d", c("d") - c("lag"))
    t = v.obs.where("stream = 'click'").groupBy(day.alias("d")).agg(F.avg("value").alias("y"))
    keys = ["stream", "h0", "h1", "roll", "lag"]
    z = z.join(t, "d")
    enough = z.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("y").alias("vy")).where("n >= 15 AND vy > 0").select(*keys)
    fit = st.quadratic_fit(z, keys, "x", "y").join(enough, keys, "left_semi")
    return fit.groupBy("h0", "h1", "roll", "lag").agg(F.avg("r2").alias("mean_r2"), F.count("r2").alias("_n")).where(f"_n = {len(STREAMS)}").drop("_n")


@query("C35_window_grid", f"{C35} SELECT h0, h1, roll, lag, round(mean_r2, 5) AS mean_r2 FROM gr", "obs")
def _(v):
    return window_grid(v).withColumn("mean_r2", F.round("mean_r2", 5))


@query("C35_optimum", f"{C35}, b AS (SELECT * FROM gr ORDER BY round(mean_r2, 9) DESC, h0, h1, roll, lag LIMIT 1), j AS (SELECT gr.*, (gr.h0 = b.h0 AND gr.h1 = b.h1)::INT + (gr.roll = b.roll)::INT + (gr.lag = b.lag)::INT AS same, gr.h0 = b.h0 AND gr.h1 = b.h1 AS w, gr.roll = b.roll AS r, gr.lag = b.lag AS l FROM gr, b) SELECT h0, h1, roll, lag, CASE WHEN w AND r AND l THEN 'optimum' WHEN r AND l THEN 'hours' WHEN w AND l THEN 'rolling' ELSE 'lag' END AS slice, round(mean_r2, 5) AS mean_r2 FROM j WHERE same >= 2", "obs")
def _(v):
    """The best combination and the slices through it: other hours, other rolling means, other lags."""
    g = window_grid(v)
    rank = F.max(F.struct(F.round("mean_r2", 9).alias("a"), *[(-c(k)).alias(k) for k in ("h0", "h1", "roll", "lag")])).alias("b")
    b = g.agg(rank).select(*[(-c(f"b.{k}")).alias(f"b_{k}") for k in ("h0", "h1", "roll", "lag")])  # one row
    j = g.join(F.broadcast(b))
    w, r, lag = (c("h0") == c("b_h0")) & (c("h1") == c("b_h1")), c("roll") == c("b_roll"), c("lag") == c("b_lag")
    kind = F.when(w & r & lag, "optimum").when(r & lag, "hours").when(w & lag, "rolling").when(w & r, "lag")
    return j.select("h0", "h1", "roll", "lag", kind.alias("slice"), F.round("mean_r2", 5).alias("mean_r2")).where("slice IS NOT NULL")


@query("C36_quadratic_by_year")
def _(v):
    return st.quadratic_fit(v.drivers.withColumn("yr", F.year("d")), ["yr"], "x1", "y")


BAND = (
    "+m AS (SELECT year(d) AS yr, avg(x1) AS mx FROM drivers GROUP BY 1), u AS (SELECT yr, y, x1, mx, x1 - mx AS u, (x1 - mx) ** 2 AS w FROM drivers JOIN m ON yr = year(d)), "
    "g AS (SELECT yr, mx, count(*) AS n, min(x1) AS lo, max(x1) AS hi, covar_pop(u, u) AS uu, covar_pop(u, w) AS uw, covar_pop(w, w) AS ww, covar_pop(u, y) AS uy, covar_pop(w, y) AS wy, var_pop(y) AS yy, avg(y) AS my, avg(w) AS mw FROM u GROUP BY 1, 2), "
    "s AS (SELECT *, uu * ww - uw * uw AS det, (uy * ww - wy * uw) / (uu * ww - uw * uw) AS b, (wy * uu - uy * uw) / (uu * ww - uw * uw) AS q FROM g), "
    "p AS (SELECT *, i::INT AS i, lo + (hi - lo) * i / 199 AS x, lo + (hi - lo) * i / 199 - mx AS pu FROM s, range(200) r(i)), k AS (SELECT *, pu * pu - mw AS pw FROM p)"
)


@query("C36_band", f"{BAND} SELECT yr, i, round(x, 4) AS x, round(my + b * pu + q * pw, 4) AS fit, round(1.96::DOUBLE * sqrt(greatest(yy - b * uy - q * wy, 0) / (n - 3) * (1 + (pu ** 2 * ww - 2 * pu * pw * uw + pw ** 2 * uu) / det)), 4) AS half FROM k", "drivers")
def _(v):
    """Each year's quadratic with its 95 % band at 200 points."""
    return st.quadratic_band(v.drivers.withColumn("yr", F.year("d")), ["yr"], "x1", "y").select("yr", "i", *[R4(k).alias(k) for k in ("x", "fit", "half")])


@query("C37_two_samples", "+g AS (SELECT year(d) AS yr, avg(y) FILTER (x1 > 25) AS m1, avg(y) FILTER (x1 <= 25) AS m0, var_samp(y) FILTER (x1 > 25) AS v1, var_samp(y) FILTER (x1 <= 25) AS v0, count(*) FILTER (x1 > 25) AS n1, count(*) FILTER (x1 <= 25) AS n0 FROM drivers GROUP BY 1) SELECT yr, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)), 6) AS t FROM g", "drivers")
def _(v):
    hi, lo = F.when(c("x1") > 25, c("y")), F.when(c("x1") <= 25, c("y"))
    g = v.drivers.groupBy(F.year("d").alias("yr")).agg(F.avg(hi).alias("m1"), F.avg(lo).alias("m0"), F.var_samp(hi).alias("v1"), F.var_samp(lo).alias("v0"), F.count(hi).alias("n1"), F.count(lo).alias("n0"))
    pooled = ((c("n1") - 1) * c("v1") + (c("n0") - 1) * c("v0")) / (c("n1") + c("n0") - 2)
    return g.select("yr", R6(F.try_divide(c("m1") - c("m0"), F.sqrt(pooled * (1 / c("n1") + 1 / c("n0"))))).alias("t"))


@query("C38_paired_difference", "+h AS (SELECT sensor, CAST(ts AS DATE) AS d, avg(value) FILTER (hour(ts) < 6) AS p, avg(value) FILTER (hour(ts) BETWEEN 12 AND 17) AS a FROM obs GROUP BY 1, 2) SELECT sensor, count(a - p) AS days, round(avg(a - p), 6) AS diff FROM h GROUP BY 1", "obs")
def _(v):
    h = F.hour("ts")
    g = v.obs.groupBy("sensor", F.to_date("ts").alias("d")).agg(F.avg(F.when(h < 6, c("value"))).alias("p"), F.avg(F.when(h.between(12, 17), c("value"))).alias("a"))
    return g.groupBy("sensor").agg(F.count(c("a") - c("p")).alias("days"), R6(F.avg(c("a") - c("p"))).alias("diff"))


@query("C39_domain_table", "+m AS (SELECT CAST(ts AS DATE) AS d, max(rh) AS rh FROM humid GROUP BY 1) SELECT rh > 99.5 AS masked, count(*) AS n, round(avg(value), 6) AS mean FROM scenes JOIN m ON d = CAST(ts AS DATE) GROUP BY 1", "scenes humid")
def _(v):
    m = v.humid.groupBy(F.to_date("ts").alias("d")).agg(F.max("rh").alias("rh"))
    return v.scenes.withColumn("d", F.to_date("ts")).join(m, "d").groupBy((c("rh") > 99.5).alias("masked")).agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean"))


C40 = "+o AS (SELECT CAST(ts AS DATE) AS d, stream, sensor, avg(value) AS y FROM obs GROUP BY 1, 2, 3), t AS (SELECT d, stream, avg(y) AS fallback FROM o GROUP BY 1, 2), a AS (SELECT s.sensor, s.d, s.y AS x, coalesce(p.y, t.fallback) AS y, p.y IS NULL AS fell FROM o s JOIN t ON t.d = s.d AND t.stream = 'view' LEFT JOIN o p ON p.d = s.d AND p.sensor = s.sensor AND p.stream = 'view' WHERE s.stream = 'click')"


def matched(v):
    """A sensor's own series where it has one, else the day's mean over sensors."""
    o = v.obs.groupBy(F.to_date("ts").alias("d"), "stream", "sensor").agg(F.avg("value").alias("y"))
    view = o.where("stream = 'view'").select("d", "sensor", c("y").alias("own"))
    fallback = view.groupBy("d").agg(F.avg("own").alias("fallback"))
    return o.where("stream = 'click'").select("d", "sensor", c("y").alias("x")).join(fallback, "d").join(view, ["d", "sensor"], "left").withColumn("y", F.coalesce("own", "fallback"))


@query("C40_matched_regressions", f"{C40} SELECT sensor, count(*) AS n, sum(CASE WHEN fell THEN 1 ELSE 0 END)::BIGINT AS fell, round(regr_slope(y, x), 6) AS slope FROM a GROUP BY 1 HAVING count(*) >= 10", "obs")
def _(v):
    return matched(v).groupBy("sensor").agg(F.count("*").alias("n"), F.count_if(c("own").isNull()).alias("fell"), R6(F.regr_slope("y", "x")).alias("slope")).where("n >= 10")


@query("C40_best_forms", f"{C40}, e AS (SELECT * FROM a WHERE sensor IN (SELECT sensor FROM a GROUP BY 1 HAVING count(*) >= 10)), {forms_sql('sensor', 'e')} SELECT k AS sensor, form, round(r2, 4) AS r2 FROM bf", "obs")
def _(v):
    """The best of the four forms for each sensor with at least 10 matched days."""
    m = matched(v)
    enough = m.groupBy("sensor").agg(F.count("*").alias("n")).where("n >= 10").select("sensor")
    return st.best_form(m.join(enough, "sensor", "left_semi"), ["sensor"], "x", "y").select("sensor", "form", R4("r2").alias("r2"))