"""Scalar helpers: index arithmetic, the three roundings, snapping, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_down(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(float(b))).cast("long")


def mod_down(a: Column, b: int) -> Column:
    return F.pmod(a, F.lit(b))


def align_down(a: Column, b: int) -> Column:
    return a - mod_down(a, b)


def align_up(a: Column, b: int) -> Column:
    return a + mod_down(-a, b)


def index_half_up(x: Column, stride: int = 1) -> Column:
    """Nearest lattice index, halves up: used to locate points."""
    return (F.floor(x / F.lit(float(stride)) + 0.5) * stride).cast("long")


def index_slice(x: Column) -> Column:
    """Index of a slice's coordinate: values up to a quarter above an index still belong to it."""
    return F.floor(x + 0.75).cast("long")


def index_block(x: Column, origin: float, width: int) -> Column:
    """Block number of an index relative to an origin."""
    return F.floor((x - F.lit(origin)) / F.lit(float(width))).cast("long")


def snap(x: Column, base: float, eps: float = 1e-10) -> Column:
    """x, or the nearest multiple of base if it is that close."""
    near = F.round(x / F.lit(base)) * F.lit(base)
    return F.when(F.abs(x - near) < F.lit(eps * base), near).otherwise(x)


def nan_least(*xs: Column) -> Column:
    nan = None
    for x in xs:
        nan = F.isnan(x) if nan is None else nan | F.isnan(x)
    return F.when(nan, F.lit(float("nan"))).otherwise(F.least(*xs))


def nan_greatest(*xs: Column) -> Column:
    nan = None
    for x in xs:
        nan = F.isnan(x) if nan is None else nan | F.isnan(x)
    return F.when(nan, F.lit(float("nan"))).otherwise(F.greatest(*xs))


def select_variables(text: str, known: list[str]) -> dict[str, dict[str, str]]:
    """Variables that an option string names, with the options of each.

    "all", group names ("wave" of "wave::phi") and full names, apart by white space; options in braces.
    """
    import re

    out: dict[str, dict[str, str]] = {}
    for name, options in re.findall(r"([^\s{}]+)(?:\{([^}]*)\})?", text):
        own = dict(re.findall(r"(\w+)\s*=\s*('[^']*'|\"[^\"]*\"|\S+)", options))
        found = [k for k in known if name == "all" or k.lower() == name.lower() or k.split("::")[0].lower() == name.lower()]
        if not found:
            raise KeyError(name)
        out |= {k: {o: v.strip("'\"") for o, v in own.items()} for k in found}
    return out


def adler32(total: Column, weighted: Column, n: Column) -> Column:
    """Adler-32 of n bytes from the sum of bytes and the sum of (n - position) * byte, position from 0."""
    a = F.pmod(total + 1, F.lit(65521))
    b = F.pmod(weighted + n, F.lit(65521))
    return b * 65536 + a


def ones_complement16(total: Column) -> Column:
    """Folded 16-bit ones-complement sum of a total of 16-bit words."""
    once = F.shiftrightunsigned(total, 16) + total.bitwiseAND(F.lit(65535))
    twice = F.shiftrightunsigned(once, 16) + once.bitwiseAND(F.lit(65535))
    return F.lit(65535) - (F.shiftrightunsigned(twice, 16) + twice.bitwiseAND(F.lit(65535)))
