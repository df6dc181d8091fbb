"""Neighbourhood operators on pixel tables: tiles with a halo, so that a value is shuffled about once however large the neighbourhood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A neighbourhood: for each row offset the first and last column offset.
Footprint = dict[int, tuple[int, int]]
TILE = 64


def box(size: int) -> Footprint:
    half = size // 2
    return {j: (-half, half) for j in range(-half, half + 1)}


def circle(radius: float) -> Footprint:
    """The pixels whose centres lie within a radius in pixels; 1 is a cross of five."""
    r = int(radius)
    return {j: (-int((radius * radius - j * j) ** 0.5), int((radius * radius - j * j) ** 0.5)) for j in range(-r, r + 1)}


def _sums(grid: np.ndarray, rows: Footprint, reach: int) -> np.ndarray:
    """Sums over each inner pixel's neighbourhood: four corners of two-dimensional running sums for a box, else the ends of each row's."""
    h, w = grid.shape[0] - 2 * reach, grid.shape[1] - 2 * reach
    if len(set(rows.values())) == 1:
        (lo, hi), top, low = next(iter(rows.values())), reach + min(rows), reach + max(rows) + 1
        s = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1))
        s[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)
        a, b = slice(reach + lo, reach + lo + w), slice(reach + hi + 1, reach + hi + 1 + w)
        up, down = slice(top, top + h), slice(low, low + h)
        return s[down, b] - s[up, b] - s[down, a] + s[up, a]
    s = np.concatenate((np.zeros((grid.shape[0], 1)), grid.cumsum(axis=1)), axis=1)
    return sum(s[reach + j : reach + j + h, reach + hi + 1 : reach + hi + 1 + w] - s[reach + j : reach + j + h, reach + lo : reach + lo + w] for j, (lo, hi) in rows.items())


def _sliding_min(grid: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width columns, from minima running forwards and backwards in blocks of that width: the work doesn't grow with the width."""
    n = grid.shape[1]
    blocks = np.pad(grid, ((0, 0), (0, -n % width)), constant_values=np.inf).reshape(len(grid), -1, width)
    ahead = np.minimum.accumulate(blocks, axis=2).reshape(len(grid), -1)
    back = np.minimum.accumulate(blocks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(grid), -1)
    return np.minimum(back[:, : n - width + 1], ahead[:, width - 1 : n])


def _least(grid: np.ndarray, rows: Footprint, reach: int) -> np.ndarray:
    """Minima over each inner pixel's neighbourhood; infinite where it is empty. Equal rows of it share their runs."""
    h, w = grid.shape[0] - 2 * reach, grid.shape[1] - 2 * reach
    runs = {span: _sliding_min(grid, span[1] - span[0] + 1) for span in set(rows.values())}
    out = np.full((h, w), np.inf)
    for j, (lo, hi) in rows.items():
        np.minimum(out, runs[lo, hi][reach + j : reach + j + h, reach + lo : reach + lo + w], out=out)
    return out


def _median(grid: np.ndarray, rows: Footprint, reach: int) -> np.ndarray:
    h, w = grid.shape[0] - 2 * reach, grid.shape[1] - 2 * reach
    near = np.sort(np.stack([grid[reach + j : reach + j + h, reach + i : reach + i + w] for j, (lo, hi) in rows.items() for i in range(lo, hi + 1)]), axis=0)
    n = (~np.isnan(near)).sum(axis=0)  # what is missing is sorted to the end
    at = lambda k: np.take_along_axis(near, np.maximum(k, 0)[None], axis=0)[0]
    return np.where(n > 0, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)


def _tile_stats(x: np.ndarray, y: np.ndarray, value: np.ndarray, rows: Footprint, stats: dict[str, str], reach: int, core: np.ndarray) -> list[np.ndarray]:
    """The statistics at a tile's own pixels, from its rows and its halo's."""
    ox, oy = x[core].min() - reach, y[core].min() - reach
    w, h = x[core].max() + reach + 1 - ox, y[core].max() + reach + 1 - oy
    inside = (x >= ox) & (x < ox + w) & (y >= oy) & (y < oy + h) & ~np.isnan(value)
    at = (y[inside] - oy, x[inside] - ox)
    count, total = np.zeros((h, w)), np.zeros((h, w))
    level = value[inside].mean() if inside.any() else 0.0
    np.add.at(count, at, 1.0)
    np.add.at(total, at, value[inside] - level)
    with np.errstate(invalid="ignore", divide="ignore"):
        grid = total / count  # repeated pixels count as their mean
    known = count > 0
    filled = np.where(known, grid, 0.0)
    here = (y[core] - oy - reach, x[core] - ox - reach)
    n = np.rint(_sums(known.astype(float), rows, reach))
    out = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for kind in stats.values():
            if kind in ("mean", "var"):
                mean = _sums(filled, rows, reach) / n
                got = mean + level if kind == "mean" else np.maximum(_sums(filled * filled, rows, reach) / n - mean * mean, 0)
            elif kind in ("min", "max"):
                sign = 1 if kind == "min" else -1
                got = sign * _least(np.where(known, sign * grid, np.inf), rows, reach) + level
            elif kind == "median":
                got = _median(grid, rows, reach) + level
            else:
                raise ValueError(f"no statistic {kind}")
            out.append(np.where(n > 0, got, np.nan)[here])
    return out


def focal(pixels: DataFrame, keys: list[str], footprint: Footprint, stats: dict[str, str], value: str = "value", tile: int = TILE) -> DataFrame:
    """keys, x, y, value and stats (column -> mean, var, min, max or median) over each pixel's neighbourhood; what lies beyond the raster or is null is left out.

    A raster is cut into tiles of tile x tile pixels, and a pixel goes to those whose halo it is in: for a neighbourhood that is small beside the tile, hardly more
    than one. A tile is all that a task holds of a raster.
    """
    reach = max(max(abs(j), abs(lo), abs(hi)) for j, (lo, hi) in footprint.items())
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    d = pixels.select(*keys, "x", "y", value).where("x IS NOT NULL AND y IS NOT NULL").withColumn("_tx", spread("x")).withColumn("_ty", spread("y"))
    d = d.withColumn("_core", (F.floor(F.col("x") / tile) == F.col("_tx")) & (F.floor(F.col("y") / tile) == F.col("_ty"))).withColumn("_tile", F.to_json(F.struct(*keys, "_tx", "_ty"))).drop("_tx", "_ty")
    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "x", "y", value)) + "".join(f", {s} double" for s in stats)

    def tiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            names = pdf["_tile"].to_numpy()
            x, y, v, core = (pdf[k].to_numpy() for k in ("x", "y", value, "_core"))
            v = v.astype(float)
            edges = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist() + [len(names)]
            found = [np.full(len(pdf), np.nan) for _ in stats]
            for a, b in zip(edges[:-1], edges[1:]):
                own = core[a:b].astype(bool)
                if own.any():
                    for f, g in zip(found, _tile_stats(x[a:b].astype(int), y[a:b].astype(int), v[a:b], footprint, stats, reach, own), strict=True):
                        f[a:b][own] = g
            yield pdf[[*keys, "x", "y", value]].assign(**dict(zip(stats, found, strict=True)))[core.astype(bool)]

        left = None
        for pdf in parts:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            cut = int((pdf["_tile"] == pdf["_tile"].iloc[-1]).to_numpy().argmax()) if len(pdf) else 0  # the last tile may go on
            left = pdf.iloc[cut:]
            if cut:
                yield from done(pdf.iloc[:cut])
        if left is not None and len(left):
            yield from done(left)

    out = d.repartition("_tile").sortWithinPartitions("_tile").mapInPandas(tiles, schema)
    return out.withColumns({s: F.when(~F.isnan(s), F.col(s)) for s in stats})


def lee(pixels: DataFrame, keys: list[str], size: int, value: str = "value") -> DataFrame:
    """Lee's speckle filter: pixels drawn to the local mean where the local variance is small beside the scene's. Edges average what they have."""
    scene = pixels.groupBy(*keys).agg(F.var_pop(value).alias("_scene"))
    near = focal(pixels, keys, box(size), {"_m": "mean", "_v": "var"}, value).join(scene, keys)
    weight = F.coalesce(F.try_divide("_v", F.col("_v") + F.col("_scene")), F.lit(0.0))
    return near.withColumn("filtered", F.col("_m") + weight * (F.col(value) - F.col("_m"))).drop("_m", "_v", "_scene")
