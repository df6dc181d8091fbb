"""Projections, filters, look-ups and reductions over a family of columns or a small hierarchy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_available(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of names that exist, renamed; none at all is an error."""
    found = [F.col(k).alias(v) for k, v in names.items() if k in df.columns]
    if not found:
        raise ValueError(f"none of {sorted(names)} in {df.columns}")
    return df.select(*found)


def depth_profiles(df: DataFrame, keys: list[str], pattern: str = r"VWCSoil_([A-C])_(\d+)cm") -> DataFrame:
    """Wide depth columns in long form: keys, profile, depth_cm, value."""
    columns = [c for c in df.columns if re.fullmatch(pattern, c)]
    if not columns:
        raise ValueError(f"no column like {pattern}")
    long = df.unpivot(keys, columns, "name", "value")
    return long.select(*keys, F.regexp_extract("name", pattern, 1).alias("profile"), F.regexp_extract("name", pattern, 2).cast("int").alias("depth_cm"), "value")


def family(columns: list[str]) -> dict[str, Column]:
    """mean, std (sample) and median of a row's values that aren't null."""
    x = F.array_compact(F.array(*columns))
    n = F.size(x)
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), n)
    square = F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean))
    s = F.sort_array(x)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return {"mean": mean, "std": F.sqrt(F.try_divide(square, F.when(n > 1, n - 1))), "median": median}


def two_stage_mean(df: DataFrame, outer: str, inner: str, value: str = "value") -> DataFrame:
    """Means of the inner groups, then their mean, sample deviation and number by outer group."""
    per = df.groupBy(outer, inner).agg(F.avg(value).alias("m"))
    return per.groupBy(outer).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.count("*").alias("profiles"))


def iqr_guard(df: DataFrame, keys: list[str], value: str, factor: float = 3.0) -> DataFrame:
    """Rows within factor inter-quartile ranges of their group's median."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    near = F.abs(F.col(value) - F.col("_q")[1]) <= factor * (F.col("_q")[2] - F.col("_q")[0])
    return df.join(q, keys).where(near).drop("_q")


def between_days(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Both days whole; plain bounds on ts, so they reach the scan."""
    return df.where((F.col(ts) >= F.lit(first).cast("timestamp")) & (F.col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")))


def criteria(**bounds: tuple[float | None, float | None]) -> Column:
    """A conjunction of (least, most) by column; None switches a bound off."""
    out = F.lit(True)
    for name, (lo, hi) in bounds.items():
        out = out & (F.col(name) >= lo) if lo is not None else out
        out = out & (F.col(name) <= hi) if hi is not None else out
    return out


def fill_mean(df: DataFrame, keys: list[str], value: str, into: str = "filled") -> DataFrame:
    """Nulls become their group's mean; means are combined before the shuffle and joined back, so no group meets in one task."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return df.join(means, keys, "left").withColumn(into, F.coalesce(value, "_mean")).drop("_mean")


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by a stated order, by a combinable aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.max if last else F.min
    best = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def look_up(df: DataFrame, registry: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Labels from a small registry; unknown keys get the defaults."""
    return df.join(F.broadcast(registry), key, "left").withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def centre(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values less the middle of their group's range."""
    mid = df.groupBy(key).agg(((F.min(value) + F.max(value)) / 2).alias("_mid"))
    return df.join(mid, key).withColumn(value, F.col(value) - F.col("_mid")).drop("_mid")


def window_of(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)
