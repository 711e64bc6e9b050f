"""Box and point-set algebra. Boxes are columns lo/hi per axis, both inclusive, with one stride."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def empty(lo: list[Column], hi: list[Column]) -> Column:
    out = F.lit(False)
    for a, b in zip(lo, hi, strict=True):
        out = out | (a > b)
    return out


def size(lo: list[Column], hi: list[Column], stride: int = 1) -> Column:
    out = F.lit(1).cast("long")
    for a, b in zip(lo, hi, strict=True):
        out = out * (F.floor((b - a) / F.lit(float(stride))) + 1).cast("long")
    return F.when(empty(lo, hi), F.lit(0).cast("long")).otherwise(out)


def contains(lo: list[Column], hi: list[Column], x: list[Column]) -> Column:
    """Bounds only, no alignment; an empty box holds nothing."""
    out = ~empty(lo, hi)
    for a, b, p in zip(lo, hi, x, strict=True):
        out = out & p.between(a, b)
    return out


def contained_in(lo, hi, other_lo, other_hi) -> Column:
    inside = F.lit(True)
    for a, b, c, d in zip(lo, hi, other_lo, other_hi, strict=True):
        inside = inside & (a >= c) & (b <= d)
    return empty(lo, hi) | inside


def intersects(lo, hi, other_lo, other_hi) -> Column:
    out = ~empty(lo, hi) & ~empty(other_lo, other_hi)
    for a, b, c, d in zip(lo, hi, other_lo, other_hi, strict=True):
        out = out & (a <= d) & (c <= b)
    return out


def aligned(lo: Column, other_lo: Column, stride: int, other_stride: int) -> Column:
    return (F.lit(stride) == F.lit(other_stride)) & (F.pmod(lo - other_lo, F.lit(stride)) == 0)


def intersection(lo, hi, other_lo, other_hi) -> tuple[list[Column], list[Column]]:
    return [F.greatest(a, c) for a, c in zip(lo, other_lo, strict=True)], [F.least(b, d) for b, d in zip(hi, other_hi, strict=True)]


def expand(lo, hi, low: int, high: int, stride: int = 1):
    """Grow outward by multiples of the stride; shift(v) is expand(-v, v)."""
    return [a - low * stride for a in lo], [b + high * stride for b in hi]


def shift(lo, hi, v: int, stride: int = 1):
    return expand(lo, hi, -v, v, stride)


def expanded_for(lo: Column, hi: Column, stride: int, origin: int = 0) -> tuple[Column, Column]:
    """The smallest box of another stride that holds this one; an empty box stays empty."""
    a, b = _outward(lo, hi, stride, origin)
    return F.when(lo <= hi, a).otherwise(lo), F.when(lo <= hi, b).otherwise(hi)


def _outward(lo: Column, hi: Column, stride: int, origin: int) -> tuple[Column, Column]:
    return lo - F.pmod(lo - origin, F.lit(stride)), hi + F.pmod(F.lit(stride) - F.pmod(hi - origin, F.lit(stride)), F.lit(stride))


def contracted_for(lo: Column, hi: Column, stride: int, origin: int = 0) -> tuple[Column, Column]:
    """The largest box of another stride inside this one, which may be empty; an empty box stays empty."""
    a, b = lo + F.pmod(F.lit(stride) - F.pmod(lo - origin, F.lit(stride)), F.lit(stride)), hi - F.pmod(hi - origin, F.lit(stride))
    return F.when(lo <= hi, a).otherwise(lo), F.when(lo <= hi, b).otherwise(hi)


def anti_contracted_for(lo: Column, hi: Column, stride: int, own: int = 1, origin: int = 0) -> tuple[Column, Column]:
    """Grown by a stride of its own, expanded for the other stride and shrunk by one of those."""
    a, b = _outward(lo - own, hi + own, stride, origin)
    return F.when(lo <= hi, a + stride).otherwise(lo), F.when(lo <= hi, b - stride).otherwise(hi)


def hull(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Smallest box around the boxes of each key. Empty boxes are neutral; of empty boxes alone it is 1 to 0."""
    some = ~empty([F.col(f"{a}_lo") for a in axes], [F.col(f"{a}_hi") for a in axes])
    lo = [F.coalesce(F.min(F.when(some, F.col(f"{a}_lo"))), F.lit(1)).alias(f"{a}_lo") for a in axes]
    return df.groupBy(*keys).agg(*lo, *[F.coalesce(F.max(F.when(some, F.col(f"{a}_hi"))), F.lit(0)).alias(f"{a}_hi") for a in axes])


def points(df: DataFrame, axes: list[str], stride: int = 1) -> DataFrame:
    """All lattice points of the boxes, as a set."""
    for a in axes:
        df = df.where(F.col(f"{a}_lo") <= F.col(f"{a}_hi")).withColumn(a, F.explode(F.sequence(f"{a}_lo", f"{a}_hi", F.lit(stride))))
    return df.select(*axes).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_semi")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One shuffle: points that one side alone has."""
    both = a.select("*", F.lit(1).alias("_s")).unionByName(b.select("*", F.lit(2).alias("_s")))
    return both.groupBy(*a.columns).agg(F.bit_or("_s").alias("_s")).where("_s <> 3").select(*a.columns)


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return minus(a, b).isEmpty()


def is_equal(a: DataFrame, b: DataFrame) -> bool:
    return symmetric_difference(a, b).isEmpty()


def is_proper_subset(a: DataFrame, b: DataFrame) -> bool:
    return is_subset(a, b) and not minus(b, a).isEmpty()


def meets(a: DataFrame, b: DataFrame) -> bool:
    return not intersect(a, b).isEmpty()


def has_point(a: DataFrame, point: dict[str, int]) -> bool:
    cond = F.lit(True)
    for x, i in point.items():
        cond = cond & (F.col(x) == i)
    return not a.where(cond).isEmpty()


def disjoint_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of sets that share no point; one that both have fails the query."""
    both = a.distinct().unionByName(b.distinct()).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_n"))
    sure = F.when(F.col("_n") > 1, F.raise_error(F.lit("sets are not disjoint")).cast("boolean")).otherwise(F.lit(True))
    return both.where(sure).select(*a.columns)


def shift_set(a: DataFrame, by: dict[str, int], stride: int = 1) -> DataFrame:
    return a.withColumns({x: F.col(x) + v * stride for x, v in by.items()})


def expand_set(a: DataFrame, axes: list[str], low: int, high: int, stride: int = 1) -> DataFrame:
    """Every point grown to a box of points, as a set; an axis at a time, so that copies go early."""
    for x in axes:
        a = a.withColumn(x, F.explode(F.array(*[F.col(x) + k * stride for k in range(-low, high + 1)]))).distinct()
    return a


def restride_set(a: DataFrame, axes: list[str], stride: int, how: str = "expanded") -> DataFrame:
    """Points of another stride that box the set's points in (expanded), or those of them that are in the set (contracted)."""
    if how == "contracted":
        cond = F.lit(True)
        for x in axes:
            cond = cond & (F.pmod(F.col(x), F.lit(stride)) == 0)
        return a.where(cond).distinct()
    for x in axes:
        down = F.col(x) - F.pmod(F.col(x), F.lit(stride))
        up = F.col(x) + F.pmod(-F.col(x), F.lit(stride))
        a = a.withColumn(x, F.explode(F.array_distinct(F.array(down, up)))).distinct()
    return a


def set_sizes(a: DataFrame, first: str, second: str) -> DataFrame:
    """Of a plane set: points, disjoint boxes of its canonical form, and changes between neighbouring rows (its representation)."""
    rows = runs(a, first, [second])
    edges = rows.select(second, F.explode(F.array(F.col(f"{first}_lo"), F.col(f"{first}_hi") + 1)).alias("e"))
    both = edges.unionByName(edges.withColumn(second, F.col(second) + 1))
    chi = both.groupBy(second, "e").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    one = a.distinct().agg(F.count(F.lit(1)).alias("size"))
    return one.join(normalise(a, first, second).agg(F.count(F.lit(1)).alias("setsize"))).join(chi.agg(F.count(F.lit(1)).alias("chi_size")))


def equal(lo, hi, other_lo, other_hi) -> Column:
    """Equal as sets of points: all empty boxes are equal."""
    same = F.lit(True)
    for a, b, c, d in zip(lo, hi, other_lo, other_hi, strict=True):
        same = same & (a == c) & (b == d)
    return (empty(lo, hi) & empty(other_lo, other_hi)) | same


def less(lo, hi, other_lo, other_hi) -> Column:
    """A proper subset."""
    return contained_in(lo, hi, other_lo, other_hi) & ~equal(lo, hi, other_lo, other_hi)


def linear_index(lo, hi, x, stride: int = 1) -> Column:
    """Number of a point in the box's order, first axis fastest; null outside."""
    out, step = F.lit(0).cast("long"), F.lit(1).cast("long")
    for a, b, p in zip(lo, hi, x, strict=True):
        out = out + step * F.floor((p - a) / F.lit(float(stride))).cast("long")
        step = step * (F.floor((b - a) / F.lit(float(stride))) + 1).cast("long")
    return F.when(contains(lo, hi, x), out)


def runs(df: DataFrame, axis: str, across: list[str], stride: int = 1) -> DataFrame:
    """Disjoint maximal runs along an axis for each value of the other axes (gaps and islands)."""
    w = Window.partitionBy(*across).orderBy(axis)
    island = F.col(axis) - stride * F.row_number().over(w)
    return df.withColumn("_g", island).groupBy(*across, "_g").agg(F.min(axis).alias(f"{axis}_lo"), F.max(axis).alias(f"{axis}_hi")).drop("_g")


def normalise(df: DataFrame, first: str, second: str, stride: int = 1) -> DataFrame:
    """A canonical set of disjoint boxes of a plane point set: runs along one axis, merged along the other."""
    r = runs(df, first, [second], stride)
    return runs(r, second, [f"{first}_lo", f"{first}_hi"], stride)


def range_join(pts: DataFrame, bxs: DataFrame, axes: list[str], width: int) -> DataFrame:
    """Points in boxes by buckets: an equi-join with a residual filter instead of a nested loop.

    A box is copied to each bucket of the first axis that it touches, a point has one.
    """
    a = axes[0]
    b = bxs.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{a}_lo") / F.lit(float(width))), F.floor(F.col(f"{a}_hi") / F.lit(float(width))))))
    p = pts.withColumn("_b", F.floor(F.col(a) / F.lit(float(width))))
    cond = F.lit(True)
    for x in axes:
        cond = cond & F.col(x).between(F.col(f"{x}_lo"), F.col(f"{x}_hi"))
    return p.join(b, "_b").where(cond).drop("_b")


def overlaps(a: DataFrame, b: DataFrame, axis: str, width: int) -> DataFrame:
    """Pairs of intervals that overlap, each once: kept in the bucket where the overlap begins."""
    spread = lambda d: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{axis}_lo") / F.lit(float(width))), F.floor(F.col(f"{axis}_hi") / F.lit(float(width))))))
    x, y = spread(a).alias("x"), spread(b).alias("y")
    lo, hi = F.greatest(f"x.{axis}_lo", f"y.{axis}_lo"), F.least(f"x.{axis}_hi", f"y.{axis}_hi")
    return x.join(y, F.col("x._b") == F.col("y._b")).where((lo <= hi) & (F.floor(lo / F.lit(float(width))) == F.col("x._b")))
