"""Ghosts, periodic images, refills, validity and balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sync(df: DataFrame, keys: list[str], value: str, is_ghost: Column) -> DataFrame:
    """Ghost rows take the value of the owner at the same keys (the least of several); a ghost without owner keeps its own."""
    owners = df.where(~is_ghost).groupBy(*keys).agg(F.min(value).alias("_v"))
    j = df.withColumn("_g", is_ghost).join(owners, keys, "left")
    return j.withColumn(value, F.when(F.col("_g"), F.coalesce("_v", value)).otherwise(F.col(value))).drop("_g", "_v")


def periodic(df: DataFrame, axis: str, n: int, width: int, others: list[str], value: str) -> DataFrame:
    """Image points up to `width` beyond both ends of [0, n), by an equi-join on the wrapped index."""
    ghosts = df.sparkSession.range(width).select(F.explode(F.array(-F.col("id") - 1, F.lit(n) + F.col("id"))).alias("_i"))
    inside = df.where(F.col(axis).between(0, n - 1))
    image = ghosts.withColumn("_w", F.pmod("_i", F.lit(n)))
    wrapped = inside.join(image, inside[axis] == image["_w"]).select(*others, F.col("_i").alias(axis), value)
    return inside.select(*others, axis, value).unionByName(wrapped)


def recompose(old: DataFrame, prolonged: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values on a new level: kept from the old one where it was there, else prolonged."""
    o = old.select(*keys, F.col(value).alias("_o"))
    return prolonged.join(o, keys, "left").withColumn(value, F.coalesce("_o", value)).drop("_o")


def poison_count(df: DataFrame, values: list[str], poison: float) -> DataFrame:
    return df.agg(*[F.count(F.when((F.col(v) == poison) | F.isnan(v), 1)).alias(v) for v in values])


def checksum(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """An order-free checksum for each key."""
    return df.groupBy(*keys).agg(F.bit_xor(F.xxhash64(*columns)).alias("checksum"), F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, key: str, load: Column) -> DataFrame:
    """max - mean of the load of workers."""
    per = df.groupBy(key).agg(F.sum(load).alias("load"))
    return per.agg(F.max("load").alias("busiest"), F.avg("load").alias("mean"), (F.max("load") - F.avg("load")).alias("imbalance"))


def assign_greedy(items: list[tuple[object, float]], workers: int) -> dict:
    """Largest item first, each to the least busy worker; for tables of regions."""
    import heapq

    heap, out = [(0.0, w) for w in range(workers)], {}
    for key, load in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        busy, w = heapq.heappop(heap)
        out[key] = w
        heapq.heappush(heap, (busy + load, w))
    return out


class Validity:
    """Which parts (interior, ghosts, boundary) of a variable are valid at a time level."""

    INTERIOR, GHOSTS, BOUNDARY, EVERYWHERE = 1, 2, 4, 7

    def __init__(self):
        self.bits: dict[tuple, int] = {}

    def writes(self, key: tuple, where: int) -> None:
        """Writing the interior makes ghosts and boundary stale."""
        self.bits[key] = where if where & self.INTERIOR else self.bits.get(key, 0) | where

    def syncs(self, key: tuple) -> None:
        if not self.bits.get(key, 0) & self.INTERIOR:
            raise ValueError(f"{key}: interior is not valid")
        self.bits[key] |= self.GHOSTS

    def needs(self, key: tuple, where: int) -> int:
        """Parts that a reader lacks."""
        return where & ~self.bits.get(key, 0)

    def cycles(self, name: str, n: int) -> None:
        old = {k: v for k, v in self.bits.items() if k[0] == name}
        for k in old:
            del self.bits[k]
        for (v, tl, *rest), b in old.items():
            self.bits[(v, (tl + 1) % n, *rest)] = b


def checksum_verify(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose checksums or row counts differ between two tables of `checksum`, or that one of them lacks."""
    j = before.alias("a").join(after.alias("b"), keys, "full")
    same = F.col("a.checksum").eqNullSafe(F.col("b.checksum")) & F.col("a.n").eqNullSafe(F.col("b.n"))
    return j.where(~same).select(*keys)


def boundary(df: DataFrame, axis: str, lo: int, hi: int, kind: str, value: str = "v", scalar: float = 0.0) -> DataFrame:
    """Points outside lo..hi along an axis: `flat` takes the nearest interior value, `mirror` its mirror image, `scalar` a constant; `none` leaves them."""
    outside = ~F.col(axis).between(lo, hi)
    if kind == "none":
        return df
    if kind == "scalar":
        return df.withColumn(value, F.when(outside, F.lit(scalar)).otherwise(F.col(value)))
    if kind not in ("flat", "mirror"):
        raise ValueError(f"no boundary condition {kind}")
    clamped = F.least(F.greatest(F.col(axis), F.lit(lo)), F.lit(hi))
    at = clamped if kind == "flat" else F.when(F.col(axis) < lo, 2 * lo - F.col(axis)).when(F.col(axis) > hi, 2 * hi - F.col(axis)).otherwise(F.col(axis))
    others = [c for c in df.columns if c not in (axis, value)]
    source = df.where(~outside).select(*others, F.col(axis).alias("_at"), F.col(value).alias("_v"))
    j = df.withColumn("_at", at).join(source, [*others, "_at"], "left")
    return j.withColumn(value, F.when(outside, F.coalesce("_v", value)).otherwise(F.col(value))).select(*df.columns)


def split_largest(items: list[tuple[object, float]], workers: int, least: float) -> list[tuple[object, float]]:
    """Items halved until the busiest worker of a greedy assignment has no item over `least` that is more than its mean share."""
    items = [((k,), load) for k, load in items]
    while items:
        share = sum(load for _, load in items) / workers
        key, load = max(items, key=lambda x: (x[1], str(x[0])))
        if load <= max(share, least) or load / 2 < least:
            break
        items.remove((key, load))
        items += [((*key, 0), load / 2), ((*key, 1), load / 2)]
    return items


class Requirements:
    """Checks, before a step runs, that what it reads was written since it became stale; independent of Validity."""

    def __init__(self):
        self.written: dict[tuple[str, str], int] = {}
        self.clock = 0

    def run(self, step: str, reads: list[tuple[str, str]], writes: list[tuple[str, str]]) -> None:
        lacking = [r for r in reads if r not in self.written]
        if lacking:
            raise ValueError(f"{step} reads {lacking}, which nothing has written")
        self.clock += 1
        for variable, where in writes:
            if where == "interior":  # ghosts and boundary are stale from now on
                for part in ("ghosts", "boundary"):
                    self.written.pop((variable, part), None)
            self.written[variable, where] = self.clock


class Storage:
    """Which time levels of which groups are held; numbers of levels change like a stack and never go below zero."""

    def __init__(self, groups: dict[str, list[str]]):
        self.groups, self.levels = groups, dict.fromkeys(groups, 0)

    def enable(self, group: str, levels: int) -> int:
        """Raises the number of levels to `levels`; the number before, to go back to."""
        before = self.levels[group]
        self.levels[group] = max(before, levels)
        return before

    def disable(self, group: str, levels: int) -> None:
        self.levels[group] = max(0, min(self.levels[group], levels))

    def query(self, group: str) -> int:
        return self.levels[group]

    def held(self, df: DataFrame) -> DataFrame:
        """The rows (group, tl) of a table whose levels are held."""
        keep = F.lit(False)
        for g, n in self.levels.items():
            keep = keep | ((F.col("group") == g) & (F.col("tl") < n))
        return df.where(keep)


def extents(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Lower and upper index, points and shape of each group's lattice."""
    lo = [F.min(a).alias(f"{a}_lo") for a in axes]
    hi = [F.max(a).alias(f"{a}_hi") for a in axes]
    return df.groupBy(*keys).agg(*lo, *hi, F.count(F.lit(1)).alias("n"))
