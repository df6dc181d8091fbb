"""Time handling and quality-control expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Local standard time without daylight saving; POSIX zone names have the opposite sign.
FIXED_ZONE = "Etc/GMT-1"
SENTINEL, TOLERANCE = -9999.0, 1.0


def parse_mixed(text: Column, day_first: bool = False) -> Column:
    """Timestamps with or without a clock time; null where no format fits."""
    day = "d/M/yyyy" if day_first else "M/d/yyyy"
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in (f"{day} H:mm", day, "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])


def fixed_to_utc(ts: Column, zone: str = FIXED_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz")).cast("timestamp")


def local_to_utc(df: DataFrame, keys: list[str], order: str, ts: str, zone: str, into: str = "utc") -> DataFrame:
    """df with into (timestamp_ntz, UTC) for the wall clock ts of a zone with daylight saving.

    A time that the clock skips becomes the end of the gap. A time that it shows twice is taken by order: among a key's twice-shown times of a night, the first
    that is earlier than the one before it begins the second pass; without such a step back all belong to the first. Equal times are no step back; ties of order
    are taken by ts; a null ts gives null. Zones' changes are taken to lie at full hours and to be an hour or half of one. Only the few twice-shown times are
    sorted, each night apart; all other rows take one expression.
    """
    wall = F.col(ts).cast("timestamp_ntz")
    utc = lambda t: F.convert_timezone(F.lit(zone), F.lit("UTC"), t)
    shown = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    first = utc(wall)  # the earlier instant of two
    again = F.coalesce(*[F.when(shown(first + F.expr(f"INTERVAL {m} MINUTES")) == wall, first + F.expr(f"INTERVAL {m} MINUTES")) for m in (60, 30)])
    skipped = shown(first) != wall
    d = df.withColumns({"_wall": wall, "_second": again, into: F.when(skipped, utc(F.date_trunc("hour", wall))).otherwise(first)})
    by = Window.partitionBy(*keys, F.to_date("_wall")).orderBy(order, "_wall")
    twice = d.where("_second IS NOT NULL").withColumn("_back", (F.col("_wall") < F.lag("_wall").over(by)).cast("int"))
    passes = F.coalesce(F.max("_back").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    twice = twice.withColumn(into, F.when(passes > 0, F.col("_second")).otherwise(F.col(into)))
    return d.where("_second IS NULL").select(*df.columns, into).unionByName(twice.select(*df.columns, into))


def replace_sentinels(df: DataFrame, sentinel: float = SENTINEL, tolerance: float = TOLERANCE, columns: list[str] | None = None) -> DataFrame:
    """Numeric values within tolerance of the sentinel, and NaN, become null."""
    columns = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c) - sentinel) < tolerance), None).otherwise(F.col(c)) for c in columns})


def in_hours(hour: Column, start: float, end: float) -> Column:
    """hour in [start, end), which may pass midnight."""
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("autumn")


def decimal_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60


def clip(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def db_to_linear(c: Column) -> Column:
    return F.pow(F.lit(10.0), c / 10)


def linear_to_db(c: Column) -> Column:
    """Null where the power isn't positive."""
    return 10 * F.log10(F.when(c > 0, c))


def std_to_db(mean: Column, std: Column) -> Column:
    """A standard deviation of linear power, carried to dB."""
    return F.lit(10.0) / F.log(F.lit(10.0)) * F.try_divide(std, mean)
