"""Level transfer by scatter: one shuffle whatever the stencil's width.

Lattices are tables of integer indices and a value. A prolonged point is returned
only if all its stencil's coarse points exist; its value is null if one of theirs is.
Values are real numbers: integers are not transferred between levels and raise.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.functions import stencils


def real(df: DataFrame, value: str) -> DataFrame:
    """df, if its values may be transferred between levels."""
    kind = dict(df.dtypes)[value]
    if kind not in ("float", "double"):
        raise TypeError(f"{value} is {kind}: only real values are transferred between levels")
    return df


def _scatter(df: DataFrame, axis: str, value: str, entries: list[tuple[int, int, float]], need: dict[int, int]) -> DataFrame:
    """entries: (parity, offset, weight): coarse point i adds weight * value to fine 2 * (i - offset) + parity."""
    others = [c for c in df.columns if c not in (axis, value)]
    parts = F.array(*[F.struct((2 * (F.col(axis) - o) + p).alias("t"), (F.col(value) * w).alias("v")) for p, o, w in entries])
    out = df.select(*others, F.explode(parts).alias("s")).groupBy(*others, F.col("s.t").alias(axis)).agg(F.sum("s.v").alias(value), F.count("s.v").alias("_c"), F.count(F.lit(1)).alias("_n"))
    want = F.when(F.pmod(F.col(axis), F.lit(2)) == 0, need[0]).otherwise(need[1])
    return out.where(F.col("_n") == want).withColumn(value, F.when(F.col("_c") == want, F.col(value))).select(*df.columns)


def prolong_vertex(df: DataFrame, axes: list[str], order: int, value: str = "v") -> DataFrame:
    """Vertex-centred Lagrange: even fine points are copies, odd ones come from order + 1 coarse points."""
    k = stencils.vertex(order)
    for a in axes:
        df = _scatter(real(df, value), a, value, [(0, 0, 1.0)] + [(1, o, w) for o, w in k], {0: 1, 1: len(k)})
    return df


def prolong_cell(df: DataFrame, axes: list[str], order: int, value: str = "v") -> DataFrame:
    """Cell-centred Lagrange of order 0 to 5."""
    for a in axes:
        e = [(p, o, w) for p in (0, 1) for o, w in stencils.cell(order, p)]
        df = _scatter(real(df, value), a, value, e, {0: order + 1, 1: order + 1})
    return df


def prolong_staggered(df: DataFrame, centred: list[str], vertex: list[str], order: int, value: str = "v") -> DataFrame:
    """Cell rules along some axes, vertex rules along the others."""
    return prolong_vertex(prolong_cell(df, centred, order, value), vertex, order if order % 2 else order - 1, value)


def restrict_sample(df: DataFrame, axes: list[str]) -> DataFrame:
    """Vertex-centred restriction: every second point."""
    keep = F.lit(True)
    for a in axes:
        keep = keep & (F.pmod(F.col(a), F.lit(2)) == 0)
    return df.where(keep).withColumns({a: F.floor(F.col(a) / 2).cast("long") for a in axes})


def restrict_mean(df: DataFrame, axes: list[str], value: str = "v", sampled: list[str] | None = None) -> DataFrame:
    """Cell-centred restriction: mean of the children; `sampled` axes take every second point instead (mixed centring)."""
    df = restrict_sample(real(df, value), sampled or [])
    rest = [c for c in df.columns if c not in (*axes, value)]
    out = df.groupBy(*rest, *[F.floor(F.col(a) / 2).cast("long").alias(a) for a in axes]).agg(F.avg(value).alias(value), F.count(value).alias("_c"), F.count(F.lit(1)).alias("_n"))
    whole = 2 ** len(axes)
    return out.where(F.col("_n") == whole).withColumn(value, F.when(F.col("_c") == whole, F.col(value))).select(*df.columns)


def restrict_cell(df: DataFrame, axes: list[str], order: int, value: str = "v") -> DataFrame:
    """Non-conservative restriction of order 3 or 5: the polynomial through the fine cells at the coarse centre."""
    k = stencils.vertex(order)  # the coarse centre lies midway between fine cells 2i and 2i + 1
    for a in axes:
        others = [c for c in df.columns if c not in (a, value)]
        t = lambda o: F.col(a) - o  # noqa: E731, B023
        parts = F.array(*[F.struct(t(o).alias("t"), (F.col(value) * w).alias("v")) for o, w in k])
        df = df.select(*others, F.explode(parts).alias("s")).where("s.t % 2 = 0").groupBy(*others, F.floor(F.col("s.t") / 2).cast("long").alias(a)).agg(F.sum("s.v").alias(value), F.count("s.v").alias("_c"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(k)).withColumn(value, F.when(F.col("_c") == len(k), F.col(value))).select(*df.columns)
    return df


def minmod(a: Column, b: Column) -> Column:
    """0 for opposite signs, else the smaller in size; null if one is null."""
    return F.when(a * b < 0, F.lit(0.0)).when(F.abs(a) < F.abs(b), a).when(F.abs(a) >= F.abs(b), b)


def prolong_tvd(df: DataFrame, axis: str, across: list[str], value: str = "v") -> DataFrame:
    """Order 1 with a minmod slope of the coarse neighbours: fine 2i + f is v_i + f / 2 of the slope; 0 at the ends."""
    n = neighbours(real(df, value), [axis], value, {"_a": (-1,), "_b": (0,), "_c": (1,)})
    slope = F.coalesce(minmod(F.col("_b") - F.col("_a"), F.col("_c") - F.col("_b")), F.lit(0.0))
    kept = n.select(axis, *across, "_b", slope.alias("_s"))
    return _children(kept, [axis], lambda f: F.col("_b") + 0.5 * f[axis] * F.col("_s"), df.columns, value)


def eno_midpoint(q1: Column, q2: Column, q3: Column, q4: Column) -> Column:
    """The smoother of two parabolas between q2 and q3, or their mean where it isn't monotone or curvatures differ."""
    left, right = q1 + q3 - 2 * q2, q2 + q4 - 2 * q3
    e = F.when(F.abs(left) < F.abs(right), (-q1 + 6 * q2 + 3 * q3) / 8).otherwise((3 * q2 + 6 * q3 - q4) / 8)
    return F.when(((e - q2) * (q3 - e) < 0) | (left * right <= 0), (q2 + q3) / 2).otherwise(e)


def _between(df: DataFrame, axis: str, across: list[str], value: str, rule) -> DataFrame:
    """Even fine points copied, odd ones by rule(q1, q2, q3, q4) where four neighbours have values."""
    n = neighbours(real(df, value), [axis], value, {"_a": (-1,), "_b": (0,), "_c": (1,), "_d": (2,)})
    q = [F.col(x) for x in ("_a", "_b", "_c", "_d")]
    whole = q[0].isNotNull() & q[1].isNotNull() & q[2].isNotNull() & q[3].isNotNull()
    kept = n.select(axis, *across, "_b", F.when(whole, rule(*q)).alias("_m"))
    return _children(kept, [axis], lambda f: F.col("_m") if f[axis] else F.col("_b"), df.columns, value)


def prolong_eno(df: DataFrame, axis: str, across: list[str], value: str = "v") -> DataFrame:
    return _between(df, axis, across, value, eno_midpoint)


def prolong_monotone(df: DataFrame, axis: str, across: list[str], value: str = "v") -> DataFrame:
    """Cubic value, replaced by the mean of the two nearest points where it leaves their range."""

    def rule(a, b, c, d):
        v = (-a + 9 * b + 9 * c - d) / 16
        return F.when(v.between(F.least(b, c), F.greatest(b, c)), v).otherwise((b + c) / 2)

    return _between(df, axis, across, value, rule)


def reflux(df: DataFrame, axis: str, across: list[str], value: str = "v") -> DataFrame:
    """Face values of a fine level on the coarse faces normal to axis: sampled along it, averaged across."""
    return restrict_mean(df, across, value, sampled=[axis])


def time_interpolate(df: DataFrame, keys: list[str], time: str, value: str, target: Column, levels: int) -> DataFrame:
    """Value at a time from the newest `levels` time levels of each key, by Lagrange weights; needs all levels.

    Targets outside the levels' range (extrapolation) and coinciding levels give null.
    """
    ranked = df.withColumn("_tl", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))).where(F.col("_tl") <= levels)
    g = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_tl", F.col(time).alias("t"), F.col(value).alias("v")))).alias("p")).where(F.size("p") == levels)
    g = g.withColumn("_at", target)
    terms = []
    for i in range(levels):
        w = F.lit(1.0)
        for j in range(levels):
            if i != j:
                gap = F.col("p")[i]["t"] - F.col("p")[j]["t"]
                w = w * F.when(gap != 0, (F.col("_at") - F.col("p")[j]["t"]) / gap)
        terms.append(w * F.col("p")[i]["v"])
    inside = F.col("_at").between(F.col("p")[levels - 1]["t"], F.col("p")[0]["t"])
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return g.select(*keys, F.when(inside, total).alias(value))


def time_interpolate_eno(p1, p2, p3, t: Column) -> Column:
    """Parabola through (time, value) pairs, newest first; linear in the surrounding pair where it leaves their range."""
    (t1, v1), (t2, v2), (t3, v3) = p1, p2, p3
    par = v1 * (t - t2) * (t - t3) / ((t1 - t2) * (t1 - t3)) + v2 * (t - t1) * (t - t3) / ((t2 - t1) * (t2 - t3)) + v3 * (t - t1) * (t - t2) / ((t3 - t1) * (t3 - t2))
    lin = F.when(t >= t2, v2 + (v1 - v2) * (t - t2) / (t1 - t2)).otherwise(v3 + (v2 - v3) * (t - t3) / (t2 - t3))
    return F.when(par.between(F.least(v1, v2, v3), F.greatest(v1, v2, v3)), par).otherwise(lin)


# --- Kernels that look at neighbours: gathered by one shuffle, without a window ---------------------


def neighbours(df: DataFrame, axes: list[str], value: str, offsets: dict[str, tuple[int, ...]]) -> DataFrame:
    """Points of df with a column for the value at each named offset; a neighbour that df lacks gives null.

    The value of a point is scattered to those that look at it.
    """
    others = [c for c in df.columns if c not in (*axes, value)]
    parts = F.array(*[F.struct(F.lit(n).alias("n"), *[(F.col(a) - o).alias(a) for a, o in zip(axes, at, strict=True)]) for n, at in offsets.items()])
    own = next(n for n, at in offsets.items() if not any(at))
    s = df.select(*others, value, F.explode(parts).alias("s")).groupBy(*others, *[F.col(f"s.{a}").alias(a) for a in axes])
    out = s.agg(F.max(F.col("s.n") == own).alias("_own"), *[F.max(F.when(F.col("s.n") == n, F.col(value))).alias(n) for n in offsets])
    return out.where("_own").drop("_own")


def _children(df: DataFrame, axes: list[str], rule: Callable[[dict[str, int]], Column], columns: list[str], value: str) -> DataFrame:
    """All fine points 2 i + f of each coarse point with a value by rule(f); null values go."""
    kids = [dict(zip(axes, f, strict=True)) for f in itertools.product((0, 1), repeat=len(axes))]
    parts = F.array(*[F.struct(*[(2 * F.col(a) + f[a]).alias(a) for a in axes], rule(f).alias(value)) for f in kids])
    rest = [c for c in columns if c not in (*axes, value)]
    return df.select(*rest, F.explode(parts).alias("s")).select(*rest, *[F.col(f"s.{a}").alias(a) for a in axes], F.col(f"s.{value}").alias(value)).where(F.col(value).isNotNull()).select(*columns)


def prolong_tvd_vertex(df: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Value of the lower corner and, along each axis with an odd fine index, half of a limited slope.

    The slope is the minmod, over the transverse edges of the coarse cell, of the minmod of the up-wind and
    the local difference. Points whose neighbours are missing are not returned.
    """
    offsets: dict[str, tuple[int, ...]] = {}
    for at in itertools.product((-1, 0, 1), repeat=len(axes)):
        if sum(o < 0 for o in at) <= 1:
            offsets["q" + "".join("m01"[o + 1] for o in at)] = at
    n = neighbours(real(df, value), axes, value, offsets)
    name = lambda at: F.col("q" + "".join("m01"[o + 1] for o in at))

    def slope(d: int) -> Column:
        out = None
        for edge in itertools.product((0, 1), repeat=len(axes) - 1):
            at = lambda o: (*edge[:d], o, *edge[d:])  # noqa: E731, B023
            one = minmod(name(at(0)) - name(at(-1)), name(at(1)) - name(at(0)))
            out = one if out is None else minmod(out, one)
        return out

    slopes = [slope(d).alias(f"_s{d}") for d in range(len(axes))]
    kept = n.select(*[c for c in n.columns if c not in offsets], name((0,) * len(axes)).alias("_q"), *slopes)

    def rule(f: dict[str, int]) -> Column:
        v = F.col("_q")
        for d, a in enumerate(axes):
            if f[a]:
                v = v + 0.5 * F.col(f"_s{d}")
        return v

    return _children(kept, axes, rule, df.columns, value)


def prolong_tvd_cell(df: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Cell-centred, order 1: the coarse value and a quarter of a minmod slope to either side, along each axis."""
    zero = (0,) * len(axes)
    step = lambda d, o: tuple(o if k == d else 0 for k in range(len(axes)))
    offsets = {"q": zero} | {f"q{d}{'mp'[o > 0]}": step(d, o) for d in range(len(axes)) for o in (-1, 1)}
    n = neighbours(real(df, value), axes, value, offsets)

    def rule(f: dict[str, int]) -> Column:
        v = F.col("q")
        for d, a in enumerate(axes):
            v = v + (0.25 if f[a] else -0.25) * minmod(F.col("q") - F.col(f"q{d}m"), F.col(f"q{d}p") - F.col("q"))
        return v

    return _children(n, axes, rule, df.columns, value)


def prolong_eno_cell(df: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Cell-centred parabolas: of the two stencils around a fine cell's side, the one with the smaller second difference; an axis at a time."""
    for a in axes:
        n = neighbours(real(df, value), [a], value, {"a": (-2,), "b": (-1,), "c": (0,), "d": (1,), "e": (2,)})
        bend = lambda x, y, z: F.abs(F.col(x) - 2 * F.col(y) + F.col(z))

        def rule(f: dict[str, int], axis: str = a) -> Column:
            low, high = ((-2, -1, 0), (-1, 0, 1)) if not f[axis] else ((-1, 0, 1), (0, 1, 2))
            value_of = lambda at: sum((w * F.col("abcde"[o + 2]) for o, w in stencils.cell_at(at, f[axis])), F.lit(0.0))
            left = bend(*("abcde"[o + 2] for o in low)) < bend(*("abcde"[o + 2] for o in high))
            return F.when(left, value_of(low)).otherwise(value_of(high))

        df = _children(n, [a], rule, df.columns, value)
    return df


def prolong_monotone5(df: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Vertex-centred order 5; a value outside the range of the 2, 4 or 8 nearest coarse points becomes their mean."""
    real(df, value)
    bounds = df
    bounds = bounds.withColumns({"_lo": F.col(value), "_hi": F.col(value), "_m": F.col(value)}).drop(value)
    rest = [c for c in bounds.columns if c not in (*axes, "_lo", "_hi", "_m")]
    for a in axes:
        others = [c for c in (*rest, *axes) if c != a]
        parts = F.array(*[F.struct((2 * F.col(a) + o).alias("t")) for o in (-1, 0, 1)])
        s = bounds.select(*others, "_lo", "_hi", "_m", F.explode(parts).alias("s")).groupBy(*others, F.col("s.t").alias(a))
        whole = F.when(F.pmod(F.col(a), F.lit(2)) == 0, 1).otherwise(2)
        bounds = s.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.avg("_m").alias("_m"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == whole).drop("_n")
    fine = prolong_vertex(df, axes, 5, value).join(bounds, [*rest, *axes])
    kept = F.when(F.col(value).between(F.col("_lo"), F.col("_hi")), F.col(value)).otherwise(F.col("_m"))
    return fine.withColumn(value, kept).select(*df.columns)


def restrict_staggered(df: DataFrame, axes: list[str], code: str, value: str = "v") -> DataFrame:
    """Means along the axes whose digit in the code ("011") is 1, every second point along the others."""
    return restrict_mean(df, [a for a, c in zip(axes, code, strict=True) if c == "1"], value, [a for a, c in zip(axes, code, strict=True) if c == "0"])


def copy_region(target: DataFrame, source: DataFrame, axes: list[str], box: dict[str, tuple[int, int]], value: str = "v") -> DataFrame:
    """target with the values of source inside a box."""
    inside = F.lit(True)
    for a, (lo, hi) in box.items():
        inside = inside & F.col(a).between(lo, hi)
    j = target.join(source.where(inside).select(*axes, F.col(value).alias("_v"), F.lit(1).alias("_in")), axes, "left")
    return j.withColumn(value, F.when(F.col("_in") == 1, F.col("_v")).otherwise(F.col(value))).select(*target.columns)


def prolong_boundary(fine: DataFrame, coarse: DataFrame, axes: list[str], order: int, is_boundary: Column, value: str = "v") -> DataFrame:
    """Boundary points of the fine level take the prolonged coarse value where there is one."""
    p = prolong_vertex(coarse, axes, order, value).select(*axes, F.col(value).alias("_p"))
    j = fine.withColumn("_b", is_boundary).join(p, axes, "left")
    return j.withColumn(value, F.when(F.col("_b"), F.coalesce("_p", value)).otherwise(F.col(value))).select(*fine.columns)


def time_derivative(df: DataFrame, keys: list[str], time: str, value: str, target: Column, levels: int, order: int) -> DataFrame:
    """First or second time derivative, at a time, of the polynomial through the newest 2 or 3 levels of each key."""
    if (order, levels) not in ((1, 2), (1, 3), (2, 3)):
        raise ValueError("needs two or three levels for the first, three for the second derivative")
    ranked = df.withColumn("_tl", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))).where(F.col("_tl") <= levels)
    g = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_tl", F.col(time).alias("t"), F.col(value).alias("v")))).alias("p")).where(F.size("p") == levels).withColumn("_at", target)
    total = F.lit(0.0)
    for i in range(levels):
        gap, rest = F.lit(1.0), F.lit(0.0)
        for j in range(levels):
            if i != j:
                gap = gap * (F.col("p")[i]["t"] - F.col("p")[j]["t"])
                rest = rest + F.col("p")[j]["t"]
        top = F.lit(1.0) if levels == 2 else 2 * F.col("_at") - rest if order == 1 else F.lit(2.0)
        total = total + F.when(gap != 0, top / gap) * F.col("p")[i]["v"]
    return g.select(*keys, total.alias(value))


def jacobi(df: DataFrame, axes: list[str], source: str, sweeps: int, value: str = "v", every: int = 8, damping: float = 1.0) -> DataFrame:
    """Sweeps of u = (sum of the neighbours - source) / (2 D) on interior points, or the damped part of the way there; others keep their value. One shuffle a sweep."""
    zero = (0,) * len(axes)
    offsets = {"_q": zero} | {f"_{d}{'mp'[o > 0]}": tuple(o if k == d else 0 for k in range(len(axes))) for d in range(len(axes)) for o in (-1, 1)}
    around = [n for n in offsets if n != "_q"]
    rhs, u = df.select(*axes, source), df.select(*axes, value)
    for k in range(1, sweeps + 1):
        n = neighbours(u, axes, value, offsets).join(rhs, axes)
        total = sum((F.col(x) for x in around), F.lit(0.0))
        u = n.select(*axes, F.coalesce(F.col("_q") + damping * ((total - F.col(source)) / (2.0 * len(axes)) - F.col("_q")), F.col("_q")).alias(value))
        if k % every == 0 and df.sparkSession.sparkContext.getCheckpointDir():
            u = u.checkpoint()
    return u.join(rhs, axes).select(*df.columns)


def residual(df: DataFrame, axes: list[str], source: str, value: str = "v") -> DataFrame:
    """source - (sum of the neighbours - 2 D u) at interior points."""
    zero = (0,) * len(axes)
    offsets = {"_q": zero} | {f"_{d}{'mp'[o > 0]}": tuple(o if k == d else 0 for k in range(len(axes))) for d in range(len(axes)) for o in (-1, 1)}
    n = neighbours(df.select(*axes, value), axes, value, offsets).join(df.select(*axes, source), axes)
    total = sum((F.col(x) for x in offsets if x != "_q"), F.lit(0.0)) - 2.0 * len(axes) * F.col("_q")
    return n.select(*axes, (F.col(source) - total).alias("residual")).where("residual IS NOT NULL")


def prolong_weno(df: DataFrame, axis: str, across: list[str], value: str = "v") -> DataFrame:
    """Order 5 by name; the engine's rule for it is that of ENO."""
    return prolong_eno(df, axis, across, value)


def two_grid(df: DataFrame, axes: list[str], source: str, smooth: int = 2, coarse: int = 8, value: str = "v") -> DataFrame:
    """One multigrid cycle for (sum of the neighbours) - 2 D u = source: smooth, restrict the residual, sweep on the
    coarse lattice, prolong the correction, smooth. Points at the rim of the lattice keep their value."""
    u = jacobi(df, axes, source, smooth, value, damping=2 / 3)
    inner = residual(u, axes, source, value)
    r = u.select(*axes).join(inner, axes, "left").withColumn("residual", F.coalesce("residual", F.lit(0.0)))
    # The coarse spacing is twice the fine one, so the undivided source is four times the sampled residual.
    c = restrict_sample(r.withColumn(source, 4.0 * F.col("residual")), axes).select(*axes, source, F.lit(0.0).alias(value))
    e = prolong_vertex(jacobi(c, axes, source, coarse, value).select(*axes, value), axes, 1, value).select(*axes, F.col(value).alias("_e"))
    j = u.join(e, axes, "left").join(inner.select(*axes, F.lit(1).alias("_in")), axes, "left")
    new = j.withColumn(value, F.when(F.col("_in") == 1, F.col(value) + F.coalesce("_e", F.lit(0.0))).otherwise(F.col(value))).select(*df.columns)
    return jacobi(new, axes, source, smooth, value, damping=2 / 3)
