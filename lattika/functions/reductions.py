"""Weighted reductions as aggregate columns: name -> (value, weight) -> Column.

A zero weight is a filter; negative and fractional weights are not. NaN values
propagate through extrema always. An empty group gives the accumulator's identity
(type extremes for minimum and maximum, 1 for product, 0 otherwise). Values are
taken as doubles; `strict` gives integer inputs squares of zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BIGGEST = 1.7976931348623157e308


def _on(w: Column, x: Column) -> Column:
    return F.when(w != 0, x)


def _total(w: Column, x: Column) -> Column:
    return F.coalesce(F.sum(_on(w, w * x)), F.lit(0.0))


def _mean(w: Column, x: Column) -> Column:
    n = F.sum(w)
    return F.when(n != 0, _total(w, x) / n).otherwise(F.lit(0.0))


def _extreme(w: Column, x: Column, pick: Callable[[Column], Column], identity: float) -> Column:
    nan = F.max(_on(w, F.isnan(x)))
    return F.when(nan, F.lit(float("nan"))).otherwise(F.coalesce(pick(_on(w, x)), F.lit(identity)))


def _square(x: Column, strict: bool) -> Column:
    return F.lit(0.0) if strict else x * x


REDUCTIONS: dict[str, Callable[..., Column]] = {
    "count": lambda x, w, strict=False: F.coalesce(F.sum(w), F.lit(0.0)),
    "minimum": lambda x, w, strict=False: _extreme(w, x, F.min, BIGGEST),
    "maximum": lambda x, w, strict=False: _extreme(w, x, F.max, -BIGGEST),
    "product": lambda x, w, strict=False: F.coalesce(F.product(_on(w, F.when(w == 1, x).otherwise(F.pow(x, w)))), F.lit(1.0)),
    "sum": lambda x, w, strict=False: _total(w, x),
    "sum_abs": lambda x, w, strict=False: _total(w, F.abs(x)),
    "sum_squared": lambda x, w, strict=False: _total(w, _square(x, strict)),
    "sum_abs_squared": lambda x, w, strict=False: _total(w, _square(x, strict)),
    "average": lambda x, w, strict=False: _mean(w, x),
    "norm1": lambda x, w, strict=False: _mean(w, F.abs(x)),
    "norm2": lambda x, w, strict=False: F.sqrt(_mean(w, _square(x, strict))),
    "norm_inf": lambda x, w, strict=False: _extreme(w, F.abs(x), F.max, 0.0),
}


def reduction(name: str, x: Column | str, w: Column | str | None = None, level: Column | None = None, dim: int = 3, strict: bool = False) -> Column:
    """The reduction `name`, or its point-counting form `i<name>`.

    level: refinement level of a row for a reduction over several levels; volumes
    shrink by 2**dim a level. The `i` forms count points and ignore the level.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    w = F.lit(1.0) if w is None else (F.col(w) if isinstance(w, str) else w).cast("double")
    points = name not in REDUCTIONS
    if points and name[1:] not in REDUCTIONS:
        raise KeyError(name)
    if level is not None and not points:
        w = w * F.pow(F.lit(0.5**dim), level)
    return REDUCTIONS[name[1:] if points else name](x, w, strict=strict)


def complex_reduction(name: str, re: Column, im: Column, w: Column) -> Column:
    """Struct (re, im): extrema are componentwise; sum_squared is the true square, sum_abs_squared |z|**2.

    The product is that of complex numbers, fractional weights by the principal power; a count is real.
    """
    r = lambda x: REDUCTIONS[name](x, w)
    if name == "count":
        return F.struct(r(re).alias("re"), F.lit(0.0).alias("im"))
    if name == "product":
        size = F.sqrt(re * re + im * im)
        radius = F.when(F.max(_on(w, size == 0)), F.lit(0.0)).otherwise(F.exp(F.coalesce(F.sum(_on((w != 0).cast("double") * (size != 0).cast("double"), w * F.log(size))), F.lit(0.0))))
        angle = F.coalesce(F.sum(_on(w, w * F.atan2(im, re))), F.lit(0.0))
        return F.struct((radius * F.cos(angle)).alias("re"), (radius * F.sin(angle)).alias("im"))
    if name == "sum_squared":
        return F.struct(_total(w, re * re - im * im).alias("re"), _total(w, 2 * re * im).alias("im"))
    if name in ("sum_abs_squared", "norm2"):
        square = re * re + im * im
        return F.struct((_total(w, square) if name == "sum_abs_squared" else F.sqrt(_mean(w, square))).alias("re"), F.lit(0.0).alias("im"))
    if name in ("sum_abs", "norm1", "norm_inf"):
        return F.struct(REDUCTIONS[name](F.sqrt(re * re + im * im), w).alias("re"), F.lit(0.0).alias("im"))
    return F.struct(r(re).alias("re"), r(im).alias("im"))


def strict_for(df, column: str) -> bool:
    """Whether the compatible rule for integers (squares are 0) applies to a column."""
    return dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")


def interior(is_ghost: Column, is_outer: Column) -> Column:
    """Points that take part in a reduction: no ghosts, but those on an outer boundary."""
    return ~is_ghost | is_outer


def centre_of_mass(m: Column, x: Column, mirrored: bool = False) -> Column:
    """sum(m x) / sum(m); 0 along an axis whose other half is the mirror image, or without mass."""
    return F.when(F.lit(not mirrored) & (F.sum(m) != 0), F.sum(m * x) / F.sum(m)).otherwise(F.lit(0.0))
