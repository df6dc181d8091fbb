"""Window operators: gaps, smoothing, runs, ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate(df: DataFrame, keys: list[str], day: str, value: str, limit: int | None = None) -> DataFrame:
    """Nulls between values filled linearly in time, the first limit of a run only; trailing ones carry the last value."""
    w = Window.partitionBy(*keys).orderBy(day)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    df = df.withColumn("_p", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    since = F.datediff(day, "_p.d")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * since / F.datediff("_n.d", "_p.d")
    filled = F.when(F.col("_n").isNull(), F.col("_p.v")).otherwise(line)
    if limit is not None:
        filled = F.when(since <= limit, filled)
    return df.withColumn(value, F.coalesce(F.col(value), filled)).drop("_p", "_n")


def rolling(keys: list[str], order: str, k: int) -> Window:
    """A centred frame of k rows; an even k leans to the left."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k // 2), (k - 1) // 2)


def rolled(value: str, how: str, w: Window, at_least: int) -> Column:
    x = F.percentile(value, F.lit(0.5)) if how == "median" else getattr(F, how)(value)
    return F.when(F.count(value).over(w) >= at_least, x.over(w))


def savgol_weights(width: int, degree: int) -> np.ndarray:
    """The hat matrix of a least-squares polynomial over width points: row i gives the fit at point i."""
    x = np.arange(width) - width // 2
    a = np.vander(x, degree + 1, increasing=True).astype(float)
    return a @ np.linalg.inv(a.T @ a) @ a.T


def savgol(df: DataFrame, keys: list[str], order: str, value: str, width: int = 7, degree: int = 2, into: str = "smooth") -> DataFrame:
    """Savitzky-Golay smoothing of series without nulls; the ends follow the polynomial of the first or last width points. Series shorter than width stay as they are."""
    hat, half = savgol_weights(width, degree), width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    dot = lambda get, row: sum((get(i) * float(row[i]) for i in range(width)), start=F.lit(0.0))
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count("*").over(whole))
    df = df.withColumn("_around", F.collect_list(value).over(w.rowsBetween(-(width - 1), width - 1)))
    # position of the row within what was collected
    at = F.least(F.col("_i"), F.lit(width)) - 1
    get = lambda shift: lambda i: F.get(F.col("_around"), (shift + i).cast("int"))
    out = dot(get(at - half), hat[half])
    for j in range(half):
        out = F.when(F.col("_i") == j + 1, dot(get(F.lit(0)), hat[j])).when(F.col("_i") == F.col("_m") - j, dot(get(F.size("_around") - width), hat[width - 1 - j])).otherwise(out)
    return df.withColumn(into, F.when(F.col("_m") >= width, out).otherwise(F.col(value))).drop("_i", "_m", "_around")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of equal flags: keys, flag, start, end, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_f", flag).withColumn("_new", F.coalesce((F.lag("_f").over(w) != F.col("_f")).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w))
    return df.groupBy(*keys, "_run", F.col("_f").alias("flag")).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).drop("_run")


def average_rank(keys: list[str], value: str) -> Column:
    """Ranks from 1, ties at their mean, over the number of rows."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(Window.partitionBy(*keys))
