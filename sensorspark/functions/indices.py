"""Per-pixel indices of optical and radar stacks: a catalogue of column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timefns import db_to_linear, linear_to_db

c = F.col


def normalised(a: str, b: str) -> Column:
    return F.try_divide(c(a) - c(b), c(a) + c(b))


def evi(n: str, r: str, b: str, scale: float = 1.0) -> Column:
    return F.try_divide(2.5 * (c(n) - c(r)), c(n) + 6 * c(r) - 7.5 * c(b) + scale)


def mcari(red_edge: str, r: str, g: str) -> Column:
    red = F.when(c(r) == 0, 1e-6).otherwise(c(r))
    return ((c(red_edge) - c(r)) - 0.2 * (c(red_edge) - c(g))) * (c(red_edge) / red)


def savi(n: str, r: str, soil: float = 0.5) -> Column:
    return F.try_divide((1 + soil) * (c(n) - c(r)), c(n) + c(r) + soil)


def kndvi(n: str, r: str) -> Column:
    return F.tanh(F.pow(normalised(n, r), F.lit(2)))


def kernel_ndvi(n: str, r: str, sigma: Column) -> Column:
    """With a radial kernel; sigma is a scalar of the stack."""
    k = F.exp(-F.try_divide(F.pow(c(n) - c(r), F.lit(2)), 2 * sigma * sigma))
    return (1 - k) / (1 + k)


def span_db(vv: str, vh: str) -> Column:
    return linear_to_db(db_to_linear(c(vv)) + db_to_linear(c(vh)))


def rvi(vv: str, vh: str) -> Column:
    a, b = db_to_linear(c(vv)), db_to_linear(c(vh))
    return F.try_divide(4 * b, a + b)


def cross_ratio_db(vv: str, vh: str) -> Column:
    return c(vh) - c(vv)


def vh_over_vv(vv: str, vh: str) -> Column:
    return F.try_divide(db_to_linear(c(vh)), db_to_linear(c(vv)))


def vv_over_vh(vv: str, vh: str) -> Column:
    return F.try_divide(db_to_linear(c(vv)), db_to_linear(c(vh)))


def angle_normalised(band: str, angle: str, reference: float = 40.0, power: float = 2.0) -> Column:
    """dB at the reference incidence angle."""
    ratio = F.cos(F.radians(F.lit(reference))) / F.cos(F.radians(c(angle)))
    return c(band) + 10 * power * F.log10(ratio)


OPTICAL: dict[str, Callable[[], Column]] = {
    "ndvi": lambda: normalised("N", "R"),
    "ndwi": lambda: normalised("N", "S1"),
    "cci": lambda: normalised("G", "RE1"),
    "evi": lambda: evi("N", "R", "B"),
    "nirv": lambda: normalised("N", "R") * c("N"),
    "savi": lambda: savi("N", "R"),
    "cire": lambda: F.try_divide(c("N"), c("RE1")) - 1,
    "mtci": lambda: F.try_divide(c("N") - c("RE1"), c("RE1") - c("R")),
    "mcari": lambda: mcari("RE1", "R", "G"),
    "kndvi": lambda: kndvi("N", "R"),
}
RADAR: dict[str, Callable[[], Column]] = {"span": lambda: span_db("VV", "VH"), "rvi": lambda: rvi("VV", "VH"), "cr_db": lambda: cross_ratio_db("VV", "VH"), "vh_vv": lambda: vh_over_vv("VV", "VH"), "vv_vh": lambda: vv_over_vh("VV", "VH")}


def attach(df: DataFrame, catalogue: dict[str, Callable[[], Column]]) -> DataFrame:
    """All indices of a catalogue, over same-named bands."""
    return df.withColumns({name: build() for name, build in catalogue.items()})
