"""Correlations, regressions, lead-lag tables and network summaries, as sums that combine before each shuffle."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.shared import written
from .joins import lagged_pairs


def pearson(x: str | Column, y: str | Column) -> Column:
    """Null where either side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """The exact quantile of a column over the whole table, interpolated as percentile does it; None without values.

    percentile merges all distinct values in one task. Here approximate quantiles give bounds on both sides of the place, a pass counts what lies below
    and between them, and only the few rows between are put in order.
    """
    x = df.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    for near in (2e-4, 2e-3, 2e-2, 1.0):  # the first is twice what bounds may be off in large tables; in small ones a row is more
        low, high = max(q - near, 0.0), min(q + near, 1.0)
        bounds = x.agg(F.percentile_approx("x", F.array(F.lit(low), F.lit(high)), 10_000).alias("b")).first().b
        if bounds is None:
            return None
        # the outermost bounds are open: an approximation may miss the ends
        above = F.lit(True) if low == 0 else F.col("x") >= bounds[0]
        within = above if high == 1 else above & (F.col("x") <= bounds[1])
        n, below, between = x.agg(F.count("*"), F.count_if(~above), F.count_if(within)).first()
        place = (n - 1) * q
        lower, upper = int(np.floor(place)), int(np.ceil(place))
        if below <= lower and upper < below + between:
            break
    counts = x.where(within).groupBy("x").count()
    upto = F.sum("count").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) + below
    a, b = counts.withColumn("_n", upto).agg(*[F.min(F.when(F.col("_n") > k, F.col("x"))) for k in (lower, upper)]).first()
    return a if a == b else (upper - place) * a + (place - lower) * b


def lag_correlations(left: DataFrame, right: DataFrame, max_lag: int, min_n: int = 30, **names) -> DataFrame:
    """x, y, lag, n, r for every pair of variables and lag, from one equi-join; positive lags mean that x leads."""
    pairs = lagged_pairs(left, right, range(-max_lag, max_lag + 1), **names)
    g = pairs.groupBy("x", "y", "lag").agg(F.count("*").alias("n"), pearson("vx", "vy").alias("r"))
    return g.where((F.col("n") >= min_n) & F.col("r").isNotNull())


def hour_windows(hourly: DataFrame, keys: list[str], hour: str, total: str, count: str, windows: list[tuple[int, int]]) -> DataFrame:
    """keys, h0, h1, mean of each window [h0, h1) of hours that holds values; keys name a day.

    One row a day carries 25 running sums and counts, so a window's mean takes two differences: a day gives a row for each window, however many hours it has.
    """
    def running(name: str) -> Column:
        """0 and the sums up to each hour."""
        by_hour = F.map_from_entries(F.collect_list(F.struct(hour, name)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.array(F.lit(0).cast("double")), lambda acc, h: F.array_append(acc, F.element_at(acc, -1) + F.coalesce(F.element_at(by_hour, h), F.lit(0)).cast("double")))

    d = hourly.groupBy(*keys).agg(running(total).alias("_s"), running(count).alias("_n"))
    each = F.transform(F.lit([list(w) for w in windows]), lambda w: F.struct(w[0].alias("h0"), w[1].alias("h1"), (F.get("_s", w[1]) - F.get("_s", w[0])).alias("s"), (F.get("_n", w[1]) - F.get("_n", w[0])).alias("n")))
    d = d.select(*keys, F.explode(F.filter(each, lambda w: w["n"] > 0)).alias("_w"))
    return d.select(*keys, "_w.h0", "_w.h1", (F.col("_w.s") / F.col("_w.n")).alias("mean"))


def best_lags(curves: DataFrame, keys: list[str]) -> DataFrame:
    """The lag with the largest |r|; of equals the smallest lag."""
    best = F.max(F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("b"), "r", "n"))
    return curves.groupBy(*keys).agg(best.alias("_m")).select(*keys, (-F.col("_m.b")).alias("lag"), "_m.r", "_m.n")


def lead_edges(best: DataFrame, least_r: float = 0.45) -> DataFrame:
    """Directed edges from leader to follower; no edge at lag 0."""
    e = best.where((F.abs("r") >= least_r) & (F.col("lag") != 0))
    ahead = F.col("lag") > 0
    return e.select(F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("source"), F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("target"), F.abs("lag").alias("days"), "r")


def plateau(curves: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """First and last lag whose |r| is at least a share of the peak."""
    peak = curves.groupBy(*keys).agg(F.max(F.abs("r")).alias("peak"))
    near = curves.join(peak, keys).where(F.abs("r") >= share * F.col("peak"))
    return near.groupBy(*keys).agg(F.min("lag").alias("first"), F.max("lag").alias("last"), F.count("*").alias("width"))


def sign_consistency(lag: str) -> Column:
    """The largest of the shares of lags above, below and equal to 0."""
    return F.greatest(*[F.avg((F.signum(lag) == s).cast("double")) for s in (1, -1, 0)])


def two_predictor_r2(y: str, x1: str, x2: str) -> Column:
    """R squared of y on two predictors, from pairwise correlations."""
    a, b, c = pearson(y, x1), pearson(y, x2), pearson(x1, x2)
    return F.try_divide(a * a + b * b - 2 * a * b * c, 1 - c * c)


def commonality(df: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Unique and shared shares of explained variance, at least 0."""
    g = df.groupBy(*keys).agg(two_predictor_r2(y, x1, x2).alias("full"), F.pow(pearson(y, x1), F.lit(2)).alias("r1"), F.pow(pearson(y, x2), F.lit(2)).alias("r2"))
    zero = F.lit(0.0)
    return g.select(*keys, "full", F.greatest(F.col("full") - F.col("r2"), zero).alias("unique1"), F.greatest(F.col("full") - F.col("r1"), zero).alias("unique2"), F.greatest(F.col("r1") + F.col("r2") - F.col("full"), zero).alias("shared"))


def kendall(df: DataFrame, group: str, item: str, x: str, y: str, least: int = 4) -> DataFrame:
    """Tau-b of x against y over the items of each group, of which there are at least so many; a group holds the streams of a configuration, so its pairs are few."""
    a = df.select(group, F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(item).alias("i1"))
    b = df.select(group, F.col(x).alias("x2"), F.col(y).alias("y2"), F.col(item).alias("i2"))
    p = a.join(b, group).where("i1 < i2").withColumn("sx", F.signum(F.col("x1") - F.col("x2"))).withColumn("sy", F.signum(F.col("y1") - F.col("y2")))
    n = df.groupBy(group).agg(F.count("*").alias("items"))
    t = p.groupBy(group).agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("a"), F.sum(F.abs("sy")).alias("b"))
    return t.join(n, group).where(F.col("items") >= least).select(group, F.try_divide("s", F.sqrt(F.col("a") * F.col("b"))).alias("tau"))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta; for summary rows."""
    x = dof / (dof + t * t)
    return pd.Series([_beta(a / 2, 0.5, float(v)) if a > 0 and v == v else None for a, v in zip(dof, x)])


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, upper: pd.Series, lower: pd.Series) -> pd.Series:
    """The tail of the F distribution beyond f; for summary rows."""
    x = lower / (lower + upper * f)
    return pd.Series([_beta(b / 2, a / 2, float(v)) if a > 0 and b > 0 and v == v else None for a, b, v in zip(upper, lower, x)])


def _beta(a: float, b: float, x: float) -> float:
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(200):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + step / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def _quadratic(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Centred moments of a quadratic fit, its coefficients _b and c in them, and the determinant: one aggregation and a 2 x 2 solve in columns."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"))
    # without keys there is one mean, which every row meets by broadcast
    d = (df.join(m, keys) if keys else df.join(F.broadcast(m))).withColumn("_u", F.col(x) - F.col("_mx")).withColumn("_w", F.col("_u") * F.col("_u"))
    moments = [F.covar_pop(p, q).alias(n) for n, p, q in (("uu", "_u", "_u"), ("uw", "_u", "_w"), ("ww", "_w", "_w"), ("uy", "_u", y), ("wy", "_w", y))]
    g = d.groupBy(*keys).agg(*moments, F.var_pop(y).alias("yy"), F.avg(y).alias("my"), F.avg("_w").alias("mw"), F.first("_mx").alias("mx"), F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    g = g.withColumn("det", F.col("uu") * F.col("ww") - F.col("uw") * F.col("uw"))
    b, c = F.try_divide(F.col("uy") * F.col("ww") - F.col("wy") * F.col("uw"), "det"), F.try_divide(F.col("wy") * F.col("uu") - F.col("uy") * F.col("uw"), "det")
    return g.withColumns({"_b": b, "c": c})


def quadratic_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, a, b, c, r2 of y = a + b x + c x^2."""
    g = _quadratic(df, keys, x, y)
    a = F.col("my") - F.col("c") * F.col("mw") - F.col("_b") * F.col("mx") + F.col("c") * F.col("mx") ** 2
    return g.select(*keys, a.alias("a"), (F.col("_b") - 2 * F.col("c") * F.col("mx")).alias("b"), "c", F.try_divide(F.col("_b") * F.col("uy") + F.col("c") * F.col("wy"), "yy").alias("r2"))


def quadratic_band(df: DataFrame, keys: list[str], x: str, y: str, points: int = 200, z: float = 1.96) -> DataFrame:
    """keys, i, x, fit, half: the fitted curve at points from the least to the largest x, and half the width of its band from the coefficients' covariance.

    Groups with fewer than four rows or two distinct x have no covariance: half is null.
    """
    p = _quadratic(df, keys, x, y).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    p = p.withColumn("_u", F.col("x") - F.col("mx")).withColumn("_w", F.col("_u") * F.col("_u") - F.col("mw"))
    spread = F.try_divide(F.col("_u") ** 2 * F.col("ww") - 2 * F.col("_u") * F.col("_w") * F.col("uw") + F.col("_w") ** 2 * F.col("uu"), "det")
    rest = F.try_divide(F.greatest(F.col("yy") - F.col("_b") * F.col("uy") - F.col("c") * F.col("wy"), F.lit(0.0)), F.greatest(F.col("n") - 3, F.lit(0)))
    return p.select(*keys, "i", "x", (F.col("my") + F.col("_b") * F.col("_u") + F.col("c") * F.col("_w")).alias("fit"), (z * F.sqrt(rest * (1 + spread))).alias("half"))


#: Fewest rows that a regression is fitted to.
LEAST_FIT = 10


def exponential_grid(df: DataFrame, keys: list[str], x: str, y: str, rates: list[float]) -> DataFrame:
    """The best of y = a exp(b x) + c over a grid of b: each rate is linear in (a, c), so one aggregation serves all. Groups of fewer than ten rows have none."""
    e = df.withColumn("b", F.explode(F.array(*[F.lit(float(b)) for b in rates]))).withColumn("_e", F.exp(F.col("b") * F.col(x)))
    g = e.groupBy(*keys, "b").agg(F.regr_slope(y, "_e").alias("a"), F.regr_intercept(y, "_e").alias("c"), F.regr_r2(y, "_e").alias("r2"), F.regr_count(y, "_e").alias("_n")).where(f"r2 IS NOT NULL AND _n >= {LEAST_FIT}")
    return g.groupBy(*keys).agg(F.max(F.struct("r2", "a", "b", "c")).alias("_m")).select(*keys, "_m.*")


def exponential_fit(df: DataFrame, keys: list[str], x: str, y: str, rates: list[float], passes: int = 15, tolerance: float = 1e-9) -> DataFrame:
    """keys, r2, a, b, c of the least-squares y = a exp(b x) + c, from the best rate of a grid on.

    Given b the fit is linear in (a, c), so only b is searched: a Gauss-Newton step is the residual's share in the part of its derivative, a x exp(b x), that
    a and c can't take up. All its sums come from one aggregation over all groups a pass; a step that doesn't lower the error is taken back and tried at
    a quarter. x is centred within groups, so exponentials stay near 1. Passes end when no group's rate moves by more than the tolerance.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    middle = rows.groupBy(*keys).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    # best: the rate so far with its error (a share of the variance); b: the rate to try, step: from best to it
    now = exponential_grid(df, keys, x, y, rates).select(*keys, F.col("b").alias("best"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("c"), "b", F.lit(0.0).alias("step"))
    now = written(now.join(middle, keys))
    for _ in range(passes):
        d = rows.join(now.select(*keys, "_mx", "_my", "b"), keys).withColumns({"_u": F.col("_x") - F.col("_mx"), "_v": F.col("_y") - F.col("_my")})
        d = d.withColumn("_e", F.exp(F.col("b") * F.col("_u"))).withColumn("_j", F.col("_u") * F.col("_e"))
        m = d.groupBy(*keys).agg(
            F.count("*").alias("_n"), F.avg("_e").alias("_me"), F.avg("_j").alias("_mj"), F.var_pop("_v").alias("_vv"), F.var_pop("_e").alias("_ee"), F.var_pop("_j").alias("_jj"),
            F.covar_pop("_e", "_v").alias("_ev"), F.covar_pop("_e", "_j").alias("_ej"), F.covar_pop("_j", "_v").alias("_jv"),
        )
        a = F.try_divide("_ev", "_ee")
        error = 1 - F.try_divide(F.col("_ev") * F.col("_ev"), F.col("_ee") * F.col("_vv"))
        # j less its projection on e; the residual is orthogonal to e and to the constant
        rest = F.col("_jj") - F.try_divide(F.col("_ej") * F.col("_ej"), F.col("_ee"))
        step = F.try_divide(F.try_divide(F.col("_jv") - F.col("_a") * F.col("_ej"), "_a"), rest)
        t = now.join(m, keys).withColumns({"_a": a, "_err": error}).withColumn("_step", F.coalesce(step, F.lit(0.0)))
        better = F.col("error").isNull() | (F.col("_err") < F.col("error"))
        back = F.col("step") / 4
        t = t.select(
            *keys, "_mx", "_my", F.when(better, F.col("b")).otherwise(F.col("best")).alias("best"), F.when(better, F.col("_err")).otherwise(F.col("error")).alias("error"), F.when(better, F.col("_a")).otherwise(F.col("a")).alias("a"),
            F.when(better, F.col("_my") - F.col("_a") * F.col("_me")).otherwise(F.col("c")).alias("c"), F.when(better, F.col("_step")).otherwise(back).alias("step"),
        )
        now = written(t.withColumn("b", F.col("best") + F.col("step")))
        moved = now.agg(F.max(F.abs("step"))).first()[0]
        if moved is None or moved <= tolerance:
            break
    # a is that of the centred x
    return now.select(*keys, (1 - F.col("error")).alias("r2"), (F.col("a") * F.exp(-F.col("best") * F.col("_mx"))).alias("a"), F.col("best").alias("b"), "c")


def best_form(df: DataFrame, keys: list[str], x: str, y: str, refined: bool = False) -> DataFrame:
    """keys, form, r2: the best of linear, logarithmic (if every x is above 0), quadratic and exponential; of forms equal to nine places the last by name.

    Exponentials are the best of a grid of rates, or fitted from there if refined. Groups of fewer than ten rows, or with a constant y, have none.
    """
    simple = df.groupBy(*keys).agg(F.regr_r2(y, x).alias("linear"), F.when(F.min(x) > 0, F.regr_r2(y, F.when(F.col(x) > 0, F.log(x)))).alias("logarithmic"))
    simple = simple.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.col(k).alias("r2")) for k in ("linear", "logarithmic")])).alias("_f")).select(*keys, "_f.*")
    exponential = (exponential_fit if refined else exponential_grid)(df, keys, x, y, rates())
    others = [f.select(*keys, F.lit(k).alias("form"), "r2") for k, f in (("quadratic", quadratic_fit(df, keys, x, y)), ("exponential", exponential))]
    every = simple.unionByName(others[0]).unionByName(others[1]).where("r2 IS NOT NULL")
    enough = df.groupBy(*keys).agg(F.regr_count(y, x).alias("_n"), F.var_pop(y).alias("_v")).where(f"_n >= {LEAST_FIT} AND _v > 0").select(*keys)
    best = F.max(F.struct(F.round("r2", 9).alias("a"), F.col("form").alias("b")))
    return every.join(enough, keys, "left_semi").groupBy(*keys).agg(best.alias("_m"), F.max("r2").alias("r2")).select(*keys, F.col("_m.b").alias("form"), "r2")


def simple_ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, slope, intercept, r2, cv (deviation of the residuals over the mean of y) and f of a line, from one aggregation."""
    g = df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("_v"), F.avg(y).alias("_m"))
    dof = F.col("n") - 2
    cv = F.try_divide(F.sqrt(F.try_divide(F.col("_v") * (1 - F.col("r2")) * F.col("n"), dof)), "_m")
    return g.select(*keys, "n", "slope", "intercept", "r2", cv.alias("cv"), F.try_divide(F.col("r2"), F.try_divide(1 - F.col("r2"), dof)).alias("f"))


def winsorised(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with scaled: value between its quantiles as 0 to 1; the average percent rank where the quantiles are equal.

    Ranks come from the counts of distinct values, so only series without spread, which have few of them, could be ranked at length.
    """
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"), F.count(value).alias("_n"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    d = df.join(q, keys)
    flat = d.where(lo == hi).groupBy(*keys, value).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = flat.select(*keys, value, ((below + (F.col("_c") + 1) / 2) / F.col("_n")).alias("_rank"))
    scaled = F.when(hi > lo, F.try_divide(F.greatest(lo, F.least(hi, F.col(value))) - lo, hi - lo)).otherwise(F.col("_rank"))
    return d.join(flat, [*keys, value], "left").withColumn("scaled", scaled).select(*df.columns, "scaled")


def median_interval(df: DataFrame, keys: list[str], value: str, names: list[str], replicates: int, least: int = 1) -> DataFrame:
    """keys, n, lo, mid, hi, iqr: quantiles of the medians of draws with replacement from each group's rows (of at least so many), and their quartiles' distance.

    A group's rows (setups: bounded by design) are held as an array in the order of their names; which one a draw takes comes from a hash of group, replicate
    and draw. Groups aren't split, but each replicate is a row of its own and needs no shuffle.
    """
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names, F.col(value).alias("_v")))).alias("_r")).withColumn("n", F.size("_r")).where(F.col("n") >= least)
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("rep").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    pick = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.get(F.col("_r"), F.pmod(drawn(i), F.col("n")).cast("int"))["_v"])
    s = F.array_sort(pick)
    reps = reps.select(*keys, "n", s.alias("_s")).select(*keys, "n", ((F.get("_s", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("_s", F.floor(F.col("n") / 2).cast("int"))) / 2).alias("_m"))
    q = F.percentile("_m", F.array(*map(F.lit, (0.025, 0.25, 0.5, 0.75, 0.975))))
    q = reps.groupBy(*keys, "n").agg(q.alias("_q"))
    return q.select(*keys, "n", F.col("_q")[0].alias("lo"), F.col("_q")[2].alias("mid"), F.col("_q")[4].alias("hi"), (F.col("_q")[3] - F.col("_q")[1]).alias("iqr"))


def median_interval_sql(replicates: int) -> str:
    """The same draws from a table su (x, y, w, m, dir, lag): bi (x, y, n, lo, mid, hi, iqr)."""
    return (
        "ob AS MATERIALIZED (SELECT x, y, row_number() OVER (PARTITION BY x, y ORDER BY w, m, dir) - 1 AS i, count(*) OVER (PARTITION BY x, y) AS n, lag FROM su), "
        f"dr AS (SELECT x, y, rep, n, unnest(range(1, n + 1)) AS k FROM (SELECT DISTINCT x, y, n FROM ob WHERE n >= 12), range(1, {replicates + 1}) r(rep)), "
        "dw AS (SELECT x, y, rep, n, CAST('0x' || substr(md5(x || '|' || y || '|' || rep || '|' || k), 1, 8) AS BIGINT) % n AS i FROM dr), "
        "bm AS (SELECT dw.x, dw.y, rep, dw.n, quantile_cont(lag, 0.5) AS m FROM dw JOIN ob USING (x, y, i) GROUP BY ALL), "
        "bi AS (SELECT x, y, n, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.5) AS mid, quantile_cont(m, 0.975) AS hi, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS iqr FROM bm GROUP BY 1, 2, 3)"
    )


#: Weights of the components of a pair's uncertainty: fixed values.
COMPONENTS = {"setups": 0.20, "windows": 0.18, "max_lags": 0.18, "directions": 0.12, "signs": 0.10, "draws": 0.12, "interval": 0.10}


def uncertainty_components(setups: DataFrame, replicates: int = 500, least: int = 12) -> DataFrame:
    """x, y and the components: spreads of the lag over setups, windows' medians and largest lags' medians; the directions' median
    disagreement; how far signs disagree; and spread and interval of the drawn medians. Pairs with too few setups are left out."""
    pair = ["x", "y"]

    def iqr(column, of):
        q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
        return of.groupBy(*pair).agg(q.alias("_q"), F.count("*").alias("_n"))

    out = iqr("lag", setups).join(setups.groupBy(*pair).agg(sign_consistency("lag").alias("_p")), pair).where(F.col("_n") >= least)
    out = out.select(*pair, (F.col("_q")[1] - F.col("_q")[0]).alias("setups"), (1 - F.col("_p")).alias("signs"))
    for name, column in (("windows", "window"), ("max_lags", "max_lag")):
        medians = setups.groupBy(*pair, column).agg(F.percentile("lag", F.lit(0.5)).alias("_m"))
        out = out.join(iqr("_m", medians).select(*pair, (F.col("_q")[1] - F.col("_q")[0]).alias(name)), pair, "left")
    both = setups.groupBy(*pair, "window", "max_lag").agg(*[F.max(F.when(F.col("direction") == d, F.col("lag"))).alias(d) for d in ("forward", "reverse")])
    out = out.join(both.groupBy(*pair).agg(F.percentile(F.abs(F.col("forward") - F.col("reverse")), F.lit(0.5)).alias("directions")), pair, "left")
    drawn = median_interval(setups, pair, "lag", ["window", "max_lag", "direction"], replicates, least)
    return out.join(drawn.select(*pair, F.col("iqr").alias("draws"), (F.col("hi") - F.col("lo")).alias("interval")), pair, "left").select(*pair, *COMPONENTS)


def ranked_or_scaled(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with scaled, as winsorised gives it, by windows in one pass: for summary tables, whose groups are numbers of variables or of pairs."""
    w, equal = Window.partitionBy(key), Window.partitionBy(key, value)
    lo, hi = (F.percentile(value, F.lit(q)).over(w) for q in (0.05, 0.95))
    rank = (F.rank().over(w.orderBy(value)) + (F.count("*").over(equal) - 1) / 2) / F.count("*").over(w)
    d = df.withColumns({"_lo": lo, "_hi": hi, "_rank": rank})
    inside = F.try_divide(F.greatest("_lo", F.least("_hi", value)) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return d.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), inside).otherwise(F.col("_rank"))).drop("_lo", "_hi")


def composite_uncertainty(components: DataFrame) -> DataFrame:
    """x, y, composite (weighted sum of the winsorised components; a missing one takes the median), uncertainty (winsorised in turn)."""
    each = F.array(*[F.struct(F.lit(k).alias("component"), F.lit(w).alias("_w"), F.col(k).cast("double").alias("_v")) for k, w in COMPONENTS.items()])
    long = components.select("x", "y", F.explode(each).alias("e")).select("x", "y", "e.*")
    filled = long.withColumn("_v", F.coalesce("_v", F.percentile("_v", F.lit(0.5)).over(Window.partitionBy("component"))))
    sums = ranked_or_scaled(filled, "component", "_v").groupBy("x", "y").agg(F.round(F.sum(F.col("_w") * F.col("scaled")), 9).alias("composite"))
    return ranked_or_scaled(sums.withColumn("_all", F.lit(1)), "_all", "composite").select("x", "y", "composite", F.col("scaled").alias("uncertainty"))


def tendencies(pairs: DataFrame) -> DataFrame:
    """variable, leads, follows, pairs, tendency, med, iqr (of the uncertainty of its pairs) from rows (leader, follower, uncertainty)."""
    ends = F.array(*[F.struct(F.col(k).alias("variable"), F.lit(v).alias("lead"), "uncertainty") for k, v in (("leader", 1), ("follower", 0))])
    q = F.percentile("uncertainty", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("variable").agg(F.sum("lead").alias("leads"), F.count("*").alias("pairs"), q.alias("_q"))
    follows = F.col("pairs") - F.col("leads")
    return g.select("variable", "leads", follows.alias("follows"), "pairs", ((F.col("leads") - follows) / F.col("pairs")).alias("tendency"), F.col("_q")[1].alias("med"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def node_table(pairs: DataFrame) -> DataFrame:
    """tendencies with fractions and a node's uncertainty: 0.65 of its winsorised median + 0.6 IQR and 0.35 of that figure's average percent rank.

    One row a variable, so the ranks over all variables stay small whatever the length of the series.
    """
    t = tendencies(pairs).withColumn("raw", F.round(F.col("med") + 0.6 * F.col("iqr"), 9)).withColumn("_all", F.lit(1))
    t = ranked_or_scaled(t, "_all", "raw")
    share = lambda k: (F.col(k) / F.col("pairs")).alias(k[:-1] + "_fraction")
    return t.select("variable", "leads", "follows", "pairs", share("leads"), share("follows"), "tendency", "raw", (0.65 * F.col("scaled") + 0.35 * F.col("_rank")).alias("uncertainty"))


def anchored(pairs: DataFrame, satellite) -> DataFrame:
    """variable, satellite, core, every, internal, mixed, internal_first, delta: tendencies stitched around the core.

    satellite(column) says whether a variable is one. Core variables take the core pairs' tendency; satellites that of all pairs (mixed), or of the
    satellites' own pairs where there are any (internal_first). delta: all pairs less core pairs.
    """
    inside = lambda name, rows: tendencies(rows).select("variable", F.col("tendency").alias(name), F.col("pairs").alias(f"{name}_pairs"), F.col("med").alias(f"{name}_uncertainty"))
    x, y = satellite(F.col("leader")), satellite(F.col("follower"))
    t = inside("every", pairs).join(inside("core", pairs.where(~x & ~y)), "variable", "left").join(inside("internal", pairs.where(x & y)), "variable", "left")
    sat = satellite(F.col("variable"))
    own = F.when(~sat, F.col("core"))
    mixed, first = F.when(sat, F.col("every")).otherwise(own), F.when(sat, F.coalesce("internal", "every")).otherwise(own)
    unc = F.when(sat, F.coalesce("internal_uncertainty", "every_uncertainty")).otherwise(F.col("core_uncertainty"))
    return t.select("variable", sat.alias("satellite"), own.alias("core"), "every", "internal", "every_pairs", "core_pairs", mixed.alias("mixed"), first.alias("internal_first"), unc.alias("uncertainty"), (F.col("every") - own).alias("delta"))


def block_starts(name: str, replicates: int, days: int, block: int) -> np.ndarray:
    """First days of each replicate's blocks, from hashes of name|replicate|block, so that a rerun and SQL draw the same."""
    blocks = -(-days // block)
    drawn = [int.from_bytes(md5(f"{name}|{rep}|{k}".encode()).digest()[:4], "big") for rep in range(replicates) for k in range(blocks)]
    return (np.array(drawn, dtype=np.int64) % max(days - block + 1, 1)).reshape(replicates, blocks)


def bootstrap_best_lags(pairs: DataFrame, keys: list[str], day: str, days: int, block: int = 3, replicates: int = 1000, least: int = 12) -> DataFrame:
    """keys, replicates, lo, mid, hi: an interval of the lag with the largest |r| (of equals the smallest), from moving blocks of days drawn with replacement.

    pairs has lag, vx, vy and a day's number below days. A block may start at any day; a draw takes as many blocks as cover the days and leaves the last
    one's surplus. Running sums over the days make a block the difference of two rows, so all draws are one product with a matrix of where blocks begin and
    end. A group is a window of days by lags. Days that lack a value add nothing; a lag with fewer than least days in a draw counts as none.
    """
    d = pairs.select(*keys, F.col(day).alias("_i"), "lag", "vx", "vy").where("vx IS NOT NULL AND vy IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, lags = pdf.iloc[0], np.unique(pdf["lag"])
        x, y = (pdf[k].to_numpy(dtype=float) - pdf[k].mean() for k in ("vx", "vy"))
        table = np.zeros((days + 1, len(lags), 6))
        np.add.at(table, (pdf["_i"].to_numpy() + 1, np.searchsorted(lags, pdf["lag"])), np.stack([np.ones(len(pdf)), x, y, x * x, y * y, x * y], axis=1))
        starts = block_starts("|".join(str(first[k]) for k in keys), replicates, days, block)
        ends = np.minimum(starts + np.minimum(block, days - block * np.arange(starts.shape[1])), days)
        weight, rows = np.zeros((replicates, days + 1)), np.arange(replicates)[:, None]
        np.add.at(weight, (rows, ends), 1.0)
        np.add.at(weight, (rows, starts), -1.0)
        sums = (weight @ table.cumsum(axis=0).reshape(days + 1, -1)).reshape(replicates, len(lags), 6)
        n, x, y, xx, yy, xy = np.moveaxis(sums, 2, 0)
        vx, vy = n * xx - x * x, n * yy - y * y
        ok = (n >= least) & (vx > 1e-9 * n * xx) & (vy > 1e-9 * n * yy)
        r = np.where(ok, np.round(np.abs(n * xy - x * y) / np.sqrt(np.where(ok, vx * vy, 1.0)), 9), -1.0)
        found = lags[r.argmax(axis=1)][r.max(axis=1) >= 0]
        q = np.quantile(found, [0.025, 0.5, 0.975]) if len(found) else [None] * 3
        return pd.DataFrame([(*[first[k] for k in keys], len(found), *q)], columns=[*keys, "replicates", "lo", "mid", "hi"])

    return d.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {t}" for k, t in d.select(*keys).dtypes) + ", replicates int, lo double, mid double, hi double")


def rates(n: int = 21, most: float = 0.1) -> list[float]:
    return [float(b) for b in np.linspace(-most, most, n) if b]
