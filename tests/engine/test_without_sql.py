"""Registered queries without an SQL twin, held against plain numpy over the same whole tables."""

from math import lgamma, log, pi

import numpy as np
import pandas as pd
import pytest

from sensorspark.plans import catalog


@pytest.fixture(scope="module")
def drivers(tiny):
    li, part = (pd.read_parquet(f"{tiny}/{t}.parquet") for t in ("lineitem", "part"))
    j = li.merge(part, left_on="l_partkey", right_on="p_partkey").astype({"l_quantity": float, "p_retailprice": float, "l_discount": float})
    y = 2 * j.l_quantity + j.p_retailprice / 10 + 100 * j.l_discount
    return pd.DataFrame({"yr": pd.to_datetime(j.l_shipdate).dt.year, "y": y, "x1": j.l_quantity, "x2": j.p_retailprice})


@pytest.fixture(scope="module")
def panel(tiny):
    o = pd.read_parquet(f"{tiny}/orders.parquet").astype({"o_totalprice": float})
    return o.groupby(["o_orderpriority", pd.to_datetime(o.o_orderdate).dt.date]).o_totalprice.mean()


def by_year(spark, tiny, name):
    return {r.yr: r for r in catalog.queries()[name](spark, tiny).collect()}


def two_sided(t, dof):
    """Student's tail by integrating the density."""
    x = np.linspace(0, abs(t), 200_001)
    d = np.exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - 0.5 * log(dof * pi) - (dof + 1) / 2 * np.log1p(x * x / dof))
    return 1 - 2 * np.trapezoid(d, x)


def left_over(y, *xs):
    """Sum of squared residuals and coefficients of a linear model with intercept."""
    a = np.column_stack([np.ones(len(y)), *xs])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    return float(((y - a @ b) ** 2).sum()), b


def test_p_values_of_a_line(spark, tiny, drivers):
    got = by_year(spark, tiny, "C29_p_values")
    assert set(got) == set(drivers.yr)
    for yr, g in drivers.groupby("yr"):
        y, n = g.y.to_numpy(), len(g)
        rest, (a, b) = left_over(y, g.x1)
        r2 = 1 - rest / ((y - y.mean()) ** 2).sum()
        assert np.allclose([got[yr].n, got[yr].intercept, got[yr].slope, got[yr].r2], [n, a, b, r2], rtol=1e-8)
        assert abs(got[yr].p - two_sided((r2 * (n - 2) / (1 - r2)) ** 0.5, n - 2)) < 1e-7


def test_p_values_of_correlations(spark, tiny, drivers):
    got = by_year(spark, tiny, "C31_p_values")
    assert set(got) == set(drivers.yr)
    for yr, g in drivers.groupby("yr"):
        r, n = np.corrcoef(g.x1, g.x2)[0, 1], len(g)
        assert got[yr].n == n and abs(got[yr].r - r) < 1e-9
        assert abs(got[yr].p - two_sided(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)) < 1e-7


def test_nested_models(spark, tiny, drivers):
    got = by_year(spark, tiny, "C32_f_test")
    assert set(got) == set(drivers.yr)
    for yr, g in drivers.groupby("yr"):
        y, n = g.y.to_numpy(), len(g)
        small, large = left_over(y, g.x1)[0], left_over(y, g.x1, g.x2)[0]
        f = (small - large) / (large / (n - 3))
        assert abs(got[yr].f - f) < 1e-6 * max(1, f) and abs(got[yr].p - two_sided(f**0.5, n - 3)) < 1e-7


def test_quadratics(spark, tiny, drivers):
    got = by_year(spark, tiny, "C36_quadratic_by_year")
    assert set(got) == set(drivers.yr)
    for yr, g in drivers.groupby("yr"):
        y = g.y.to_numpy()
        rest, (a, b, c) = left_over(y, g.x1, g.x1**2)
        assert np.allclose([got[yr].a, got[yr].b, got[yr].c, got[yr].r2], [a, b, c, 1 - rest / ((y - y.mean()) ** 2).sum()], rtol=1e-6)


def test_exponentials_leave_least_squares(spark, tiny, drivers):
    got = by_year(spark, tiny, "C34_exponential")
    assert set(got) <= set(drivers.yr) and got
    for yr, g in drivers.groupby("yr"):
        if yr not in got:
            assert len(g) < 10
            continue
        y, x, r = g.y.to_numpy(), g.x1.to_numpy(), got[yr]
        rest = lambda b: left_over(y, np.exp(b * x))[0]
        assert np.isclose(r.r2, 1 - rest(r.b) / ((y - y.mean()) ** 2).sum(), atol=1e-8)
        assert rest(r.b) <= min(rest(r.b + d) for d in (-1e-4, 1e-4)) * (1 + 1e-10)
        assert np.isclose(((y - r.a * np.exp(r.b * x) - r.c) ** 2).sum(), rest(r.b), rtol=1e-6)


def plain_breaks(y, penalty, size):
    """The least of squared deviations plus penalties, by the whole recursion."""
    n, s, q = len(y), np.append(0, y.cumsum()), np.append(0, (y * y).cumsum())
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    for j in range(size, n + 1):
        i = np.arange(0, j - size + 1)
        best[j] = (best[i] + (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (j - i) + penalty).min()
    return best[n]


def test_batch_breaks_are_the_best(spark, tiny, panel):
    found = {}
    for r in catalog.queries()["C13_batch_breaks"](spark, tiny).collect():
        found.setdefault(r.variable, []).append(r)
    for variable, s in panel.groupby(level=0):
        days, y = [d for _, d in s.index], s.to_numpy()
        z = (y - y.mean()) / y.std()
        penalty = 4.0 if variable == "3-MEDIUM" else 2.0
        rows = sorted(found.get(variable, []), key=lambda r: r.break_first)
        edges = [0, *[days.index(r.break_first) for r in rows], len(y)]
        assert [r.break_last for r in rows] == [days[e - 1] for e in edges[1:-1]] and [r.number for r in rows] == list(range(1, len(rows) + 1))
        assert all(b - a >= 5 for a, b in zip(edges, edges[1:]))
        cost = sum(((z[a:b] - z[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:])) + penalty * len(rows)
        assert cost <= plain_breaks(z, penalty, 5) + 1e-7


def test_the_strict_report_leaves_out_seasons_with_gaps(spark, tiny):
    loose, strict = ({(r.variable, r.yr): r for r in catalog.queries()[n](spark, tiny).collect()} for n in ("C10_dense_report", "C10_dense_report_strict"))
    assert loose and set(loose) == set(strict)
    for k, r in strict.items():
        assert r == loose[k] or (r.gap > 0.1 and (r.onset is None) == (r.reason != ""))


def test_the_tail_by_integration():
    assert abs(two_sided(2.228139, 10) - 0.05) < 1e-6 and abs(two_sided(1.0, 2) - (1 - 1 / 3**0.5)) < 1e-6


def test_breaks_of_each_year_are_the_best(spark, tiny, panel):
    found = {}
    for r in catalog.queries()["V04_series_program"](spark, tiny).collect():
        found.setdefault((r.variable, r.y), []).append(r)
    series = {}
    for (variable, d), x in panel.items():
        series.setdefault((variable, d.year), []).append((d, x))
    assert found and set(found) <= set(series)
    for key, s in series.items():
        days, y = [d for d, _ in s], np.array([x for _, x in s])
        rows = sorted(found.get(key, []), key=lambda r: r.break_first)
        if len(y) < 4:
            assert not rows
            continue
        penalty = max(y.var(), 1e-9) * np.log(len(y))
        edges = [0, *[days.index(r.break_first) for r in rows], len(y)]
        for r, a, b, c in zip(rows, edges, edges[1:], edges[2:]):
            assert r.break_last == days[b - 1] and np.isclose(r.jump, y[b:c].mean() - y[a:b].mean())
        cost = sum(((y[a:b] - y[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:])) + penalty * len(rows)
        assert all(b - a >= 2 for a, b in zip(edges, edges[1:])) and cost <= plain_breaks(y, penalty, 2) * (1 + 1e-9)


def test_tails_of_regimes(spark, tiny, drivers):
    got = by_year(spark, tiny, "V05_tails")
    assert set(got) == set(drivers.yr)
    for yr, g in drivers.groupby("yr"):
        a, b = g.y[g.x1 > 25], g.y[g.x1 <= 25]
        t = (a.mean() - b.mean()) / (a.var() / len(a) + b.var() / len(b)) ** 0.5
        assert abs(got[yr].t - t) < 1e-5 and abs(got[yr].p - two_sided(t, len(g) - 2)) < 1e-7
