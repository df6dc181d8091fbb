"""Change points: exact single breaks in Catalyst, penalised and fixed-number breaks by a dynamic program a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def noise(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, sigma: the deviation of first differences over the root of two; 1 where it is 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    s = F.stddev_pop("_d") / F.sqrt(F.lit(2.0))
    return d.groupBy(*keys).agg(F.when(s > 0, s).otherwise(F.lit(1.0)).alias("sigma"))


def single_break(df: DataFrame, keys: list[str], order: str, value: str, min_size: int = 3) -> DataFrame:
    """keys, break (first row of the second segment), cost, position: the split with the least squared error, from prefix sums."""
    up = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    x = F.col(value)
    p = df.withColumn("_n", F.count("*").over(up)).withColumn("_s", F.sum(x).over(up)).withColumn("_q", F.sum(x * x).over(up))
    p = p.withColumn("_n_all", F.count("*").over(whole)).withColumn("_s_all", F.sum(x).over(whole)).withColumn("_q_all", F.sum(x * x).over(whole))
    p = p.where((F.col("_n") >= min_size) & (F.col("_n_all") - F.col("_n") >= min_size))
    left = F.col("_q") - F.col("_s") ** 2 / F.col("_n")
    right = F.col("_q_all") - F.col("_q") - (F.col("_s_all") - F.col("_s")) ** 2 / (F.col("_n_all") - F.col("_n"))
    p = p.withColumn("_cost", left + right)
    best = F.min(F.struct(F.col("_cost").alias("cost"), F.col(order).alias("break"), F.col("_n").alias("position")))
    return p.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.break", "_b.cost", "_b.position")


class MedianCosts:
    """Sums of distances from the median over segments [start, end), for arrays of starts.

    A wavelet matrix: for each bit of the values' ranks, counts and sums of those without it, in the order that the bits before leave. A segment's
    k smallest values and their sum take one step a bit, so the memory is n log n and nothing is kept of a segment.
    """

    def __init__(self, y: np.ndarray) -> None:
        n = len(y)
        self.sorted = np.sort(y)
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(y, kind="stable")] = np.arange(n)
        self.total, self.levels = np.concatenate(([0.0], np.cumsum(y))), []
        for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
            low = (rank >> bit & 1) == 0
            self.levels.append((bit, np.concatenate(([0], np.cumsum(low))), np.concatenate(([0.0], np.cumsum(np.where(low, self.sorted[rank], 0.0)))), int(low.sum())))
            rank = np.concatenate((rank[low], rank[~low]))

    def __call__(self, starts: np.ndarray, end: int) -> np.ndarray:
        a = np.atleast_1d(starts)
        b, n = np.full(len(a), end), end - a
        k, below, at = n // 2, np.zeros(len(a)), np.zeros(len(a), dtype=np.int64)
        for bit, count, value, zeros in self.levels:
            ca, cb = count[a], count[b]
            high = k >= cb - ca
            below += np.where(high, value[b] - value[a], 0.0)
            k = k - np.where(high, cb - ca, 0)
            at += high.astype(np.int64) << bit
            a, b = np.where(high, zeros + a - ca, ca), np.where(high, zeros + b - cb, cb)
        # at is now the rank of the upper median, and below the sum of the values before it
        rest = self.total[end] - self.total[np.atleast_1d(starts)] - 2 * below
        return np.maximum(rest - np.where(n % 2 == 1, self.sorted[np.minimum(at, len(self.sorted) - 1)], 0.0), 0)


def median_distance(y: np.ndarray) -> float:
    """The median of the squared distances of all pairs, by counting pairs below a bound instead of making them."""
    v, n = np.sort(y), len(y)
    pairs = n * (n - 1) // 2

    def ranked(k: int) -> float:
        """The k-th smallest distance: bounds are halved until they stand next to each other."""
        lo, hi = 0.0, float(v[-1] - v[0])
        while True:
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi:
                break
            # the float order of v[i] + mid and of differences may part by a rounding; only the last digit is at stake
            if (np.searchsorted(v, v + mid, side="right") - np.arange(n) - 1).sum() > k:
                hi = mid
            else:
                lo = mid
        return hi if (np.searchsorted(v, v + lo, side="right") - np.arange(n) - 1).sum() <= k else lo

    return (ranked((pairs - 1) // 2) ** 2 + ranked(pairs // 2) ** 2) / 2 if pairs else 1.0


#: The least and the largest scaled distance that the kernel tells apart.
NEAR, FAR = 1e-2, 1e2


class KernelCosts:
    """Kernel costs of segments [start, end), for arrays of starts. Ends should grow from call to call: the sums of all starts are carried on by one
    row of the kernel, from the smallest start that was asked for; a smaller end or start begins anew."""

    def __init__(self, y: np.ndarray) -> None:
        self.y, self.unit = y, median_distance(y) or 1.0
        self._begin(0)

    def _begin(self, low: int) -> None:
        self.low, self.end, self.sums = low, low, np.zeros(len(self.y) + 1)

    def __call__(self, starts: np.ndarray, end: int) -> np.ndarray:
        i = np.atleast_1d(starts)
        if end < self.end or i[0] < self.low:
            self._begin(int(i[0]))
        self.low = int(i[0])
        for j in range(max(self.end, self.low), end):
            d = self.y[self.low : j] - self.y[j]
            row = np.exp(-np.clip(d * d / self.unit, NEAR, FAR))
            self.sums[self.low : j] += 2 * row[::-1].cumsum()[::-1]
            self.sums[self.low : j + 1] += 1
        self.end = end
        return (end - i) - self.sums[i] / np.maximum(end - i, 1)


def segment_cost(y: np.ndarray, model: str):
    """A function of (ascending starts, end): the costs of the segments [start, end) of a series. Memory is linear in the series, or n log n for l1."""
    y = y - y.mean() if len(y) else y  # no model's cost depends on the level, and small sums are exact for longer
    if model == "l1":
        return MedianCosts(y)
    if model == "rbf":
        return KernelCosts(y)
    one, two = np.concatenate(([0], np.cumsum(y))), np.concatenate(([0], np.cumsum(y * y)))

    def squares(i, j):
        return np.maximum(two[j] - two[i] - (one[j] - one[i]) ** 2 / np.maximum(j - i, 1), 0)

    if model == "l2":
        return squares
    if model == "normal":
        return lambda i, j: (j - i) * np.log(squares(i, j) / np.maximum(j - i, 1) + 1e-6)
    raise ValueError(f"no cost model {model}")


def noise_level(y: np.ndarray) -> float:
    """The deviation of first differences over the root of two; 1 where it is 0."""
    return float(np.diff(y).std() / np.sqrt(2)) or 1.0


def penalty_for(cost, n: int, scale: float) -> float:
    """scale times the whole series' cost a row times ln n. It is taken of the series as it is: under `normal` it depends on the series' unit."""
    return scale * max(abs(float(np.atleast_1d(cost(np.array([0]), n))[0])) / n, 1e-9) * np.log(n)


def penalised_breaks(y: np.ndarray, model: str, penalty: float, min_size: int = 2, cost=None) -> list[int]:
    """The optimal breaks (first rows of segments but the first) for a penalty a break, by dynamic programming with pruning."""
    return penalty_path(len(y), cost or segment_cost(np.asarray(y, dtype=float), model), [penalty], min_size, model != "normal")[0]


def penalty_path(n: int, cost, penalties: list[float], min_size: int, prune: bool = True) -> list[list[int]]:
    """The optimal breaks for each of several penalties. Ends are visited once: a segment's cost is asked for once, for all penalties."""
    best, last = np.full((len(penalties), n + 1), np.inf), np.zeros((len(penalties), n + 1), dtype=int)
    best[:, 0] = [-p for p in penalties]
    # starts that can still win, and until when: one that can't stays until its successor's first segment is long enough
    ready, until = [np.zeros(0, dtype=int) for _ in penalties], np.full(best.shape, n + 1)
    for j in range(min_size, n + 1):
        for k, starts in enumerate(ready):
            if np.isfinite(best[k, j - min_size]):
                starts = np.append(starts, j - min_size)
            ready[k] = starts[until[k, starts] > j]
        wanted = ready[0] if len(ready) == 1 else np.unique(np.concatenate(ready))
        each = cost(wanted, j)
        for k, penalty in enumerate(penalties):
            starts = ready[k]
            total = best[k, starts] + (each if len(ready) == 1 else each[np.searchsorted(wanted, starts)]) + penalty
            m = int(total.argmin())
            best[k, j], last[k, j] = total[m], starts[m]
            if prune:
                lost = starts[total - penalty > best[k, j]]
                until[k, lost] = np.minimum(until[k, lost], j + min_size)
    out = []
    for row in last:
        found, j = [], n
        while j > 0 and row[j] > 0:
            found.append(int(row[j]))
            j = row[j]
        out.append(found[::-1])
    return out


def fixed_breaks(y: np.ndarray, model: str, count: int, min_size: int = 5) -> list[int]:
    """The best segmentation with exactly count breaks; none if the series is too short. Each end's costs are asked for once, for all counts."""
    n, cost = len(y), segment_cost(np.asarray(y, dtype=float), model)
    if n < (count + 1) * min_size:
        return []
    best = np.full((count + 1, n + 1), np.inf)
    last = np.zeros((count + 1, n + 1), dtype=int)
    for j in range(min_size, n + 1):
        each = cost(np.arange(j - min_size + 1), j)
        best[0, j] = each[0]
        for k in range(1, min(count, j // min_size - 1) + 1):
            total = best[k - 1, k * min_size : j - min_size + 1] + each[k * min_size :]
            m = int(total.argmin())
            best[k, j], last[k, j] = total[m], m + k * min_size
    out, j = [], n
    for k in range(count, 0, -1):
        j = last[k, j]
        out.append(int(j))
    return out[::-1]


def detect(df: DataFrame, keys: list[str], order: str, value: str, model: str | None = None, scale: float = 2.0, count: int | None = None, min_size: int = 2) -> DataFrame:
    """keys, break_first (first row of the new segment), break_last (last of the old), jump: one grouped call a series.

    The penalty is scale times the series' cost a row times ln n; a model column takes the place of the argument if model is None, a scale column of scale.
    A penalty column holds absolute penalties (of the series scaled to deviation 1) and takes the place of both.
    """
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + f", break_first {dict(df.dtypes)[order]}, break_last {dict(df.dtypes)[order]}, jump double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(order)
        y = pdf[value].to_numpy(dtype=float)
        rows = []
        if len(y) >= 2 * min_size:
            m = model or pdf["model"].iloc[0]
            if count:
                found = fixed_breaks(y, m, count, min_size)
            elif "penalty" in pdf:
                found = penalised_breaks((y - y.mean()) / (y.std() or 1.0), m, float(pdf["penalty"].iloc[0]), min_size)
            else:
                cost = segment_cost(y, m)
                found = penalised_breaks(y, m, penalty_for(cost, len(y), float(pdf["scale"].iloc[0]) if "scale" in pdf else scale), min_size, cost)
            edges = [0, *found, len(y)]
            for a, b, c in zip(edges[:-2], edges[1:-1], edges[2:]):
                rows.append((*[pdf[k].iloc[0] for k in keys], pdf[order].iloc[b], pdf[order].iloc[b - 1], float(y[b:c].mean() - y[a:b].mean())))
        return pd.DataFrame(rows, columns=[*keys, "break_first", "break_last", "jump"])

    return df.groupBy(*keys).applyInPandas(run, schema)


def season_breaks(df: DataFrame, keys: list[str], order: str, value: str, start: str, end: str, buffers: list[int], max_gap: float = 0.1, least: int = 15) -> DataFrame:
    """keys, n_obs, gap, reason, onset, onset_lo, onset_hi, recovery, recovery_lo, recovery_hi: two breaks of a dense season under several buffers around it.

    start and end are date columns. A buffer's days are made dense and interpolated (the ends take the nearest value); z is against the mean and deviation of
    the 30th to 7th day before start. A buffer with fewer than least values or a larger share of gaps counts as none, as does a series without
    baseline; reason says why a series has no onset. Dates are the buffers' mean (floored) and range. A group is one season and its buffers, so bounded.
    """
    when = dict(df.dtypes)[order]
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + f", n_obs int, gap double, reason string, {', '.join(f'{a}{b} {when}' for a in ('onset', 'recovery') for b in ('', '_lo', '_hi'))}"
    reach = max(30, max(buffers))
    d = df.where(F.col(value).isNotNull() & F.col(order).between(F.date_sub(start, reach), F.date_add(end, max(buffers)))).select(*keys, order, value, F.col(start).alias("_start"), F.col(end).alias("_end"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        s = pdf.set_index(pd.DatetimeIndex(pd.to_datetime(pdf[order])))[value].astype(float).groupby(level=0).mean().sort_index()
        lo, hi, day = pd.Timestamp(first["_start"]), pd.Timestamp(first["_end"]), pd.Timedelta(days=1)
        base = s[lo - 30 * day : lo - 7 * day]
        gap, n, reason, onsets, recoveries = None, len(s[lo:hi]), "", [], []
        if len(base) < 2 or not base.std() > 0:
            reason = "no baseline"
        for b in () if reason else buffers:
            seg = s.reindex(pd.date_range(lo - b * day, hi + b * day))
            share = float(seg.isna().mean())
            gap = share if gap is None else max(gap, share)
            if seg.notna().sum() < least:
                reason = "too few values"
            elif share > max_gap:
                reason = "gaps"
            else:
                found = fixed_breaks(((seg.interpolate("linear").bfill().ffill() - base.mean()) / base.std()).to_numpy(), "rbf", 2, 5)
                if found:
                    onsets.append(seg.index[found[0]])
                    recoveries.append(seg.index[found[1]])
        ends = []
        for found in (onsets, recoveries):
            ends += [t.date() for t in (pd.Series(found).mean().floor("D"), min(found), max(found))] if found else [None] * 3
        return pd.DataFrame([(*[first[k] for k in keys], n, gap, "" if onsets else reason or "no breaks", *ends)], columns=[*keys, "n_obs", "gap", "reason", *[f"{a}{b}" for a in ("onset", "recovery") for b in ("", "_lo", "_hi")]])

    return d.groupBy(*keys).applyInPandas(run, schema)


def onset_windows(breaks: DataFrame, keys: list[str], at: str, cutoff: Column, stress: Column, soil: Column) -> DataFrame:
    """keys, n_breaks, start, end, nearest_before, nearest_after: the window of a response between two breaks.

    Soil-like series start at their last break before the cutoff, else at the last one up to the stress; others at the break from the cutoff on that is nearest
    to the stress; both else at the nearest of all. Only breaks with a later one can start; of equally near ones the first does.
    """
    b = breaks.withColumn("_next", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))
    last, near = F.datediff(stress, at), F.abs(F.datediff(stress, at))
    early, by_stress = soil & (F.col(at) < cutoff), soil & (F.col(at) <= stress)
    order = F.struct(F.when(early | (~soil & (F.col(at) >= cutoff)), 0).when(by_stress, 1).otherwise(2).alias("a"), F.when(early | by_stress, last).otherwise(near).alias("b"), F.col(at).alias("start"), F.col("_next").alias("end"))
    g = b.groupBy(*keys).agg(F.count("*").alias("n_breaks"), F.min(F.when(F.col("_next").isNotNull(), order)).alias("_w"), F.max(F.when(F.col(at) <= stress, F.col(at))).alias("nearest_before"), F.min(F.when(F.col(at) > stress, F.col(at))).alias("nearest_after"))
    return g.where("_w IS NOT NULL").select(*keys, "n_breaks", "_w.start", "_w.end", "nearest_before", "nearest_after")


def least_size(n: int) -> int:
    return max(2, min(5, n // 4))


def series_onset(y: np.ndarray, direction: str, model: str, scales: list[float], rule: str = "acute", min_size: int | None = None) -> list[tuple[int | None, list[int]]]:
    """For each scale of the penalty: the onset's row, or None, and all detected breaks; the cost function is made once.

    An onset is a break whose jump of segment means in the direction of stress is at least the noise: the largest (acute) or the first (departure).
    """
    y = np.asarray(y, dtype=float)
    k = min_size or least_size(len(y))
    if len(y) < 2 * k:
        return [(None, []) for _ in scales]
    cost, sigma = segment_cost(y, model), noise_level(y)
    out, unit = [], penalty_for(cost, len(y), 1.0)
    for found in penalty_path(len(y), cost, [scale * unit for scale in scales], k, model != "normal"):
        edges = [0, *found, len(y)]
        jump = np.array([y[b:c].mean() - y[a:b].mean() for a, b, c in zip(edges[:-2], edges[1:-1], edges[2:])])
        size = {"decrease": -jump, "increase": jump}.get(direction, np.abs(jump))
        ok = np.flatnonzero(size >= sigma)
        best = None if not len(ok) else found[int(ok[size[ok].argmax()] if rule == "acute" else ok[0])]
        out.append((best, found))
    return out


def replicate_onsets(series: np.ndarray, direction: str, scale: float, rule: str, min_size: int, cells: int = 1 << 21) -> np.ndarray:
    """series_onset under l2 for every row of series at once: the onset's place, or -1. All rows' prefix sums go through one dynamic program, in slices
    of at most so many numbers at a step."""
    n = series.shape[1]
    out = np.full(len(series), -1)
    if n < 2 * min_size:
        return out
    step = max(1, cells // n)
    for lo in range(0, len(series), step):
        y = series[lo : lo + step]
        y = y - y.mean(axis=1, keepdims=True)
        r = len(y)
        one, two = (np.concatenate((np.zeros((r, 1)), np.cumsum(x, axis=1)), axis=1) for x in (y, y * y))
        whole = np.maximum(two[:, -1] - one[:, -1] ** 2 / n, 0)
        penalty = scale * np.maximum(whole / n, 1e-9) * np.log(n)
        best, last = np.full((r, n + 1), np.inf), np.zeros((r, n + 1), dtype=np.int64)
        best[:, 0] = -penalty
        rows = np.arange(r)
        for j in range(min_size, n + 1):
            i = slice(0, j - min_size + 1)
            size = np.arange(j, min_size - 1, -1)
            total = best[:, i] + np.maximum(two[:, j, None] - two[:, i] - (one[:, j, None] - one[:, i]) ** 2 / size, 0)
            k = total.argmin(axis=1)
            best[:, j], last[:, j] = total[rows, k] + penalty, k
        sigma = np.diff(y, axis=1).std(axis=1) / np.sqrt(2)
        sigma[sigma == 0] = 1.0
        sign = {"decrease": -1.0, "increase": 1.0}.get(direction)
        for x in range(r):
            edges, j = [n], n
            while last[x, j] > 0:
                j = last[x, j]
                edges.append(j)
            edges = np.array([0, *edges[::-1]])
            means = np.diff(one[x, edges]) / np.diff(edges)
            jump = np.diff(means)
            size = np.abs(jump) if sign is None else sign * jump
            ok = np.flatnonzero(size >= sigma[x])
            if len(ok):
                out[lo + x] = edges[1 + (ok[size[ok].argmax()] if rule == "acute" else ok[0])]
    return out


def onset_grid(df: DataFrame, keys: list[str], order: str, value: str, models: list[str], scales: list[float], rule: str = "acute") -> DataFrame:
    """keys, model, scale, n_obs, onset for every model and scale; df has a column direction. A group is a series and a model, so the models run apart."""
    d = df.select(*keys, "direction", order, value).where(F.col(value).isNotNull()).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + f", model string, scale double, n_obs int, onset {dict(df.dtypes)[order]}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        first, at = pdf.iloc[0], pdf[order].tolist()
        found = series_onset(pdf[value].to_numpy(), first["direction"], first["model"], scales, rule)
        return pd.DataFrame([(*[first[k] for k in keys], first["model"], s, len(at), None if o is None else at[o]) for s, (o, _) in zip(scales, found, strict=True)], columns=[*keys, "model", "scale", "n_obs", "onset"])

    return d.groupBy(*keys, "model").applyInPandas(run, schema)


def bootstrap_onsets(df: DataFrame, keys: list[str], order: str, value: str, model: str = "l2", scale: float = 1.0, rule: str = "acute", replicates: int = 1000, block: int = 5, chunk: int = 50) -> DataFrame:
    """keys, n_obs, onset, point, lo, hi, found: the onset with a 95 % interval; df has a column direction.

    Residuals about the detected segments' means are drawn in blocks and the detector runs again. The point is the median of the replicates that
    have an onset; the interval is withheld where fewer than half have one; series without an onset have neither. Replicates run apart, chunk by chunk; their draws are
    seeded by series and replicate, so a rerun draws the same.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)
    when = dict(df.dtypes)[order]
    d = df.select(*keys, "direction", order, value).where(F.col(value).isNotNull())

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = pdf[value].to_numpy(dtype=float)
        onset, breaks = series_onset(y, pdf["direction"].iloc[0], model, [scale], rule)[0]
        edges = [0, *breaks, len(y)]
        means = np.concatenate([np.full(b - a, y[a:b].mean()) for a, b in zip(edges[:-1], edges[1:])])
        row = (*[pdf[k].iloc[0] for k in keys], pdf["direction"].iloc[0], len(y), -1 if onset is None else onset, pdf[order].tolist(), means.tolist(), (y - means).tolist())
        return pd.DataFrame([row], columns=[*keys, "direction", "n_obs", "i", "days", "means", "rest"])

    fits = d.groupBy(*keys).applyInPandas(fit, f"{kinds}, direction string, n_obs int, i int, days array<{when}>, means array<double>, rest array<double>")
    starts = F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(chunk))
    tasks = fits.where("i >= 0").select(*keys, "direction", "means", "rest", F.explode(starts).alias("_from"), F.xxhash64(*keys).alias("_seed")).repartition(*keys, "_from")

    def draw(batches):
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                means, rest = np.array(t.means), np.array(t.rest)
                n = len(means)
                drawn = np.empty((min(t[-2] + chunk, replicates) - t[-2], n))
                for i in range(len(drawn)):
                    rng = np.random.default_rng([t[-1] % 2**63, t[-2] + i])
                    at = (rng.integers(0, max(n - block + 1, 1), -(-n // block))[:, None] + np.arange(block)).ravel()[:n]
                    drawn[i] = means + rest[np.minimum(at, n - 1)]
                if model == "l2":
                    found = replicate_onsets(drawn, t.direction, scale, rule, least_size(n)).tolist()
                else:
                    found = [-1 if o is None else o for o in (series_onset(y, t.direction, model, [scale], rule)[0][0] for y in drawn)]
                rows += [(*t[: len(keys)], o) for o in found if o >= 0]
            yield pd.DataFrame(rows, columns=[*keys, "_o"])

    drawn = tasks.mapInPandas(draw, f"{kinds}, _o int")
    q = F.percentile("_o", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    drawn = drawn.groupBy(*keys).agg(q.alias("_q"), F.count("*").alias("found"))
    day = lambda i: F.get("days", F.rint(F.col("_q")[i]).cast("int"))
    enough = F.col("found") >= replicates / 2
    out = fits.join(drawn, keys, "left")
    return out.select(*keys, "n_obs", F.get("days", F.when(F.col("i") >= 0, F.col("i"))).alias("onset"), F.coalesce(day(1), F.get("days", F.when(F.col("i") >= 0, F.col("i")))).alias("point"), F.when(enough, day(0)).alias("lo"), F.when(enough, day(2)).alias("hi"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def onsets(breaks: DataFrame, sigma: DataFrame, directions: DataFrame, keys: list[str]) -> DataFrame:
    """Breaks whose jump in the stress direction is at least the noise: the largest (acute) and the earliest (first departure)."""
    j = breaks.join(sigma, keys).join(directions, keys)
    size = F.when(F.col("direction") == "decrease", -F.col("jump")).when(F.col("direction") == "increase", F.col("jump")).otherwise(F.abs("jump"))
    j = j.withColumn("_size", size).where(F.col("_size") >= F.col("sigma"))
    return j.groupBy(*keys).agg(F.max_by("break_first", F.struct("_size", F.expr("-datediff(break_first, DATE '1970-01-01')"))).alias("acute"), F.min("break_first").alias("first_departure"))


def bootstrap_single_break(df: DataFrame, keys: list[str], order: str, value: str, replicates: int = 200, block: int = 5, min_size: int = 3) -> DataFrame:
    """Onset with a 95 % interval: residuals about the two segment means are resampled in blocks and the break is fitted again.

    Replicates are exploded; a row's block and its offset come from a hash of (series, replicate, block), so a rerun draws the same.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    s = df.select(*keys, order, value).withColumn("_i", F.row_number().over(w) - 1)
    fit = single_break(df, keys, order, value, min_size).select(*keys, "position")
    s = s.join(fit, keys).withColumn("_side", F.col("_i") >= F.col("position"))
    means = s.groupBy(*keys, "_side").agg(F.avg(value).alias("_m"), F.count("*").alias("_c"))
    s = s.join(means, [*keys, "_side"]).withColumn("_r", F.col(value) - F.col("_m"))
    n = s.groupBy(*keys).agg(F.count("*").alias("_n"))
    s = s.join(n, keys)
    reps = s.select(*keys, "_i", "_m", "_n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    start = F.pmod(F.xxhash64(*keys, "rep", F.floor(F.col("_i") / block)), F.greatest(F.col("_n") - block + 1, F.lit(1)))
    reps = reps.withColumn("_j", F.least(start + F.col("_i") % block, F.col("_n") - 1).cast("int"))
    drawn = reps.join(s.select(*keys, F.col("_i").alias("_j"), "_r"), [*keys, "_j"]).withColumn("_y", F.col("_m") + F.col("_r"))
    again = single_break(drawn, [*keys, "rep"], "_i", "_y", min_size)
    q = F.percentile("break", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return again.groupBy(*keys).agg(q.alias("_q"), F.count("*").alias("replicates")).select(*keys, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("mid"), F.col("_q")[2].alias("hi"), "replicates")


def departures(df: DataFrame, keys: list[str], order: str, z: str, limit: float = 2.0, back: float = 1.0) -> DataFrame:
    """Sparse series: the first row at least limit out, the row before it, and the first of two in a row within back afterwards."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_prev", F.lag(order).over(w)).withColumn("_next", F.lead(z).over(w))
    first = d.where(F.col(z) >= limit).groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("onset"), F.col("_prev").alias("before"))).alias("_f")).select(*keys, "_f.onset", "_f.before")
    calm = d.join(first, keys).where((F.col(order) > F.col("onset")) & (F.col(z) <= back) & (F.col("_next") <= back)).groupBy(*keys).agg(F.min(order).alias("recovery"))
    return first.join(calm, keys, "left")
