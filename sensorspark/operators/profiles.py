"""Vertical profiles and gap fractions: interpolation at a level, layers, ring integrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(level: float, height: str, value: str) -> tuple[list[Column], Column]:
    """Aggregates of the rows around a level, and the value there from them: linear between, the end values beyond the ends."""
    pair = F.struct(F.col(height).alias("h"), F.col(value).alias("v"))
    around = [F.max(F.when(F.col(height) <= level, pair)).alias("_a"), F.min(F.when(F.col(height) >= level, pair)).alias("_b")]
    slope = F.try_divide(F.col("_b.v") - F.col("_a.v"), F.col("_b.h") - F.col("_a.h"))
    line = F.col("_a.v") + F.coalesce(slope, F.lit(0.0)) * (level - F.col("_a.h"))
    return around, F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)


def at_level(profile: DataFrame, scan: str, level: float, height: str = "height", value: str = "lin_pai", into: str = "at") -> DataFrame:
    """A profile's value at a level. One aggregation a scan."""
    around, at = _level(level, height, value)
    return profile.groupBy(scan).agg(*around).select(scan, at.alias(into))


def layer_split(profile: DataFrame, scan: str, level: float, height: str = "height", value: str = "lin_pai") -> DataFrame:
    """Leaf area below and above a level, from one aggregation a scan."""
    around, at = _level(level, height, value)
    g = profile.groupBy(scan).agg(*around, F.max(value).alias("_total")).withColumn("under", at)
    return g.select(scan, "under", F.greatest(F.col("_total") - F.col("under"), F.lit(0.0)).alias("over"))



def gap_fraction(shots: DataFrame, scan: str, width: float) -> DataFrame:
    """Shots, gaps and their share by zenith ring; ring is the ring's middle."""
    ring = F.floor(F.abs("zenith") / width) * width + width / 2
    g = shots.groupBy(scan, ring.alias("ring")).agg(F.count("*").alias("shots"), F.count_if("is_gap").alias("gaps"))
    return g.withColumn("pgap", F.col("gaps") / F.col("shots"))


def miller(rings: DataFrame, scan: str) -> DataFrame:
    """Leaf area from gap fractions over zenith: twice the trapezoid integral of -ln P cos sin."""
    a = F.radians("ring")
    f = -F.log(F.greatest(F.col("pgap"), F.lit(1e-6))) * F.cos(a) * F.sin(a)
    w = Window.partitionBy(scan).orderBy("ring")
    t = rings.withColumn("_f", f).withColumn("_a", a)
    t = t.withColumn("_t", (F.col("_f") + F.lag("_f").over(w)) / 2 * (F.col("_a") - F.lag("_a").over(w)))
    return t.groupBy(scan).agg((2 * F.coalesce(F.sum("_t"), F.lit(0.0))).alias("pai"))


def hinge(shots: DataFrame, scan: str, centre: float = 57.5, half: float = 2.0) -> DataFrame:
    """Leaf area from the gap share near the hinge angle."""
    near = shots.where(F.abs(F.abs("zenith") - centre) <= half)
    return near.groupBy(scan).agg((-F.log(F.greatest(F.avg(F.col("is_gap").cast("double")), F.lit(1e-6)))).alias("pai"))


def density(profile: DataFrame, scan: str, value: str = "lin_pai", height: str = "height") -> DataFrame:
    """Change by height: central differences, one-sided at the ends."""
    w = Window.partitionBy(scan).orderBy(height)
    lo, hi = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    a, b = F.coalesce(F.lag(height).over(w), F.col(height)), F.coalesce(F.lead(height).over(w), F.col(height))
    return profile.withColumn("density", F.try_divide(hi - lo, (b - a).cast("double")))


def table_cells(table: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """keys and the cells of a table of nodes x by y: x0, x1, y0, y1 and the values v00, v01, v10, v11 at their corners (first x, then y). Cells that lack a corner are left out."""
    after = lambda c: F.lead(c).over(Window.partitionBy(*keys).orderBy(c))
    xs = table.select(*keys, F.col(x).alias("x0")).distinct().withColumn("x1", after("x0")).where("x1 IS NOT NULL")
    ys = table.select(*keys, F.col(y).alias("y0")).distinct().withColumn("y1", after("y0")).where("y1 IS NOT NULL")
    cells = xs.join(ys, keys)
    for i in (0, 1):
        for j in (0, 1):
            corner = table.select(*keys, F.col(x).alias(f"x{i}"), F.col(y).alias(f"y{j}"), F.col(value).alias(f"v{i}{j}"))
            cells = cells.join(corner, [*keys, f"x{i}", f"y{j}"])
    return cells


def interpolated(points: DataFrame, cells: DataFrame, keys: list[str], x: str, y: str, into: str) -> DataFrame:
    """points with into: the bilinear value within the table's cell around (x, y); null outside the table. A point on a line between cells belongs to the first of them.

    A join by keys whose rows meet the few cells of their table; the cells are the table's size, given and small beside the points.
    """
    px, py = F.col(f"_p.{x}"), F.col(f"_p.{y}")
    low = lambda k: F.min(f"{k}0").over(Window.partitionBy(*keys))
    c = cells.withColumns({"_x": low("x"), "_y": low("y")}).alias("_c")
    inside = ((px > F.col("_c.x0")) | ((px == F.col("_c.x0")) & (F.col("_c.x0") == F.col("_c._x")))) & (px <= F.col("_c.x1")) & ((py > F.col("_c.y0")) | ((py == F.col("_c.y0")) & (F.col("_c.y0") == F.col("_c._y")))) & (py <= F.col("_c.y1"))
    same = [F.col(f"_p.{k}") == F.col(f"_c.{k}") for k in keys]
    u, w = (px - F.col("_c.x0")) / (F.col("_c.x1") - F.col("_c.x0")), (py - F.col("_c.y0")) / (F.col("_c.y1") - F.col("_c.y0"))
    value = F.col("_c.v00") * (1 - u) * (1 - w) + F.col("_c.v01") * (1 - u) * w + F.col("_c.v10") * u * (1 - w) + F.col("_c.v11") * u * w
    on = inside
    for k in same:
        on = on & k
    return points.alias("_p").join(c, on, "left").select("_p.*", value.alias(into))


def explained_fractions(cases: DataFrame, table: DataFrame, key: str, first: str, second: str, sweep: list[float]) -> DataFrame:
    """key, first, sim_baseline, sim_event, d_sim, d_obs, fraction, sign for each case (key, before, after, d_obs) and each value of the swept axis.

    The table has key, first (swept), second and value. What the simulated change explains of an observed one smaller than a millionth is null; so is all that lies
    outside the table.
    """
    points = cases.withColumn(first, F.explode(F.lit([float(s) for s in sweep])))
    cells = table_cells(table, [key], first, second, "value")
    for when, name in (("before", "sim_baseline"), ("after", "sim_event")):
        points = interpolated(points, cells, [key], first, when, name)
    d = points.withColumn("d_sim", F.col("sim_event") - F.col("sim_baseline"))
    fraction = F.when(F.abs("d_obs") > 1e-6, F.col("d_sim") / F.col("d_obs"))
    return d.select(key, first, "sim_baseline", "sim_event", "d_sim", "d_obs", fraction.alias("fraction"), F.when(F.col("d_sim") * F.col("d_obs") > 0, "same").otherwise("opp").alias("sign"))
