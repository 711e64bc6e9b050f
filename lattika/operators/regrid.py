"""Deciding where to refine: flags to blocks, clustering, region properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_blocks(df: DataFrame, axes: list[str], flag: Column, block: int, offset: int = 0) -> DataFrame:
    """Blocks of the lattice that hold a flagged point, as boxes."""
    b = df.where(flag).select(*[F.floor((F.col(a) - offset) / F.lit(float(block))).cast("long").alias(a) for a in axes]).distinct()
    return b.select(*[(F.col(a) * block + offset).alias(f"{a}_lo") for a in axes], *[(F.col(a) * block + offset + block - 1).alias(f"{a}_hi") for a in axes])


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def signature(df: DataFrame, axis: str, flag: Column) -> DataFrame:
    """Flagged points for each index of an axis, its second difference (ends 0) and sign-changing jump."""
    w = Window.orderBy(axis)
    s = df.groupBy(axis).agg(F.sum(flag.cast("int")).alias("s"))
    s = s.withColumn("d2", F.coalesce(F.lag("s").over(w) - 2 * F.col("s") + F.lead("s").over(w), F.lit(0)))
    nxt = F.lead("d2").over(w)
    return s.withColumn("jump", F.when(F.col("d2") * nxt < 0, F.abs(nxt - F.col("d2"))).otherwise(F.lit(0)))


def first_hole(sig: DataFrame, axis: str, min_width: int) -> DataFrame:
    """First index without flags at least min_width from both ends."""
    ends = sig.agg(F.min(axis).alias("a"), F.max(axis).alias("b"))
    return sig.join(F.broadcast(ends)).where((F.col("s") == 0) & (F.col(axis) >= F.col("a") + min_width) & (F.col(axis) <= F.col("b") - min_width)).agg(F.min(axis).alias("hole"))


def cluster(points: DataFrame, axes: list[str], density: float, min_width: int = 2, depth: int = 12) -> list[dict]:
    """Boxes that cover all points, each at least that dense or too narrow to cut (Berger-Rigoutsos).

    One aggregation a round for all open boxes: a box shrinks to its points, then
    splits at a hole, else at the largest sign change of the second difference, else
    in halves. The driver holds boxes and their marginal sums only.
    """
    spark, done = points.sparkSession, []
    ext = points.agg(*[F.min(a).alias(f"{a}_lo") for a in axes], *[F.max(a).alias(f"{a}_hi") for a in axes]).first()
    if ext is None or ext[f"{axes[0]}_lo"] is None:
        return []
    todo = [ext.asDict()]
    for round_ in range(depth + 1):
        if not todo:
            break
        cond = lambda b: " AND ".join(f"{a} BETWEEN {b[f'{a}_lo']} AND {b[f'{a}_hi']}" for a in axes)
        which = F.coalesce(*[F.when(F.expr(cond(b)), F.lit(k)) for k, b in enumerate(todo)])
        inside = points.withColumn("_k", which).where("_k IS NOT NULL")
        sums = inside.select("_k", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("long").alias("i")) for a in axes])).alias("m")).groupBy("_k", "m.axis", "m.i").count().collect()
        per: dict[int, dict[str, dict[int, int]]] = {}
        for r in sums:
            per.setdefault(r["_k"], {}).setdefault(r["axis"], {})[r["i"]] = r["count"]
        nxt = []
        for k in per:
            box, total = {}, sum(per[k][axes[0]].values())
            for a in axes:
                box[f"{a}_lo"], box[f"{a}_hi"] = min(per[k][a]), max(per[k][a])
            volume = 1
            for a in axes:
                volume *= box[f"{a}_hi"] - box[f"{a}_lo"] + 1
            cut = None if total >= density * volume or round_ == depth else _cut(box, per[k], axes, min_width)
            if cut is None:
                done.append(box)
            else:
                a, at = cut
                nxt += [{**box, f"{a}_hi": at - 1}, {**box, f"{a}_lo": at}]
        todo = nxt
    del spark
    return sorted(done, key=lambda b: tuple(b[f"{a}_lo"] for a in axes))


def _cut(box: dict, sums: dict[str, dict[int, int]], axes: list[str], width: int) -> tuple[str, int] | None:
    """Axis and first index of the upper part."""
    wide = [a for a in reversed(axes) if box[f"{a}_hi"] - box[f"{a}_lo"] + 1 >= 2 * width]
    for a in wide:  # a hole
        for i in range(box[f"{a}_lo"] + width, box[f"{a}_hi"] - width + 2):
            if i <= box[f"{a}_hi"] and not sums[a].get(i):
                return a, i
    best = None
    for a in wide:  # the largest jump of a sign-changing second difference
        lo, hi = box[f"{a}_lo"], box[f"{a}_hi"]
        s = [sums[a].get(i, 0) for i in range(lo, hi + 1)]
        d = [0] + [s[i - 1] - 2 * s[i] + s[i + 1] for i in range(1, len(s) - 1)] + [0]
        for i in range(width - 1, len(s) - width):
            jump = abs(d[i + 1] - d[i])
            if d[i] * d[i + 1] < 0 and (best is None or jump > best[0]):
                best = (jump, a, lo + i + 1)
    if best:
        return best[1], best[2]
    if not wide:
        return None
    a = max(wide, key=lambda a: box[f"{a}_hi"] - box[f"{a}_lo"])
    return a, (box[f"{a}_lo"] + box[f"{a}_hi"] + 1) // 2


def nest_properly(coarse: DataFrame, fine: DataFrame, axes: list[str], distance: int, factor: int = 2) -> DataFrame:
    """Coarse boxes joined by the fine ones, grown and coarsened, so that fine regions lie inside."""
    grown = fine.select(*[F.floor((F.col(f"{a}_lo") - distance) / F.lit(float(factor))).cast("long").alias(f"{a}_lo") for a in axes], *[F.ceil((F.col(f"{a}_hi") + distance) / F.lit(float(factor))).cast("long").alias(f"{a}_hi") for a in axes])
    return coarse.select(*grown.columns).unionByName(grown).distinct()


def add_buffers(df: DataFrame, axes: list[str], width: int) -> DataFrame:
    return df.withColumns({f"{a}_lo": F.col(f"{a}_lo") - width for a in axes} | {f"{a}_hi": F.col(f"{a}_hi") + width for a in axes})


def granulate(df: DataFrame, axes: list[str], grain: int) -> DataFrame:
    """Boxes grown outward to multiples of a granularity."""
    return df.withColumns({f"{a}_lo": F.col(f"{a}_lo") - F.pmod(F.col(f"{a}_lo"), F.lit(grain)) for a in axes} | {f"{a}_hi": F.col(f"{a}_hi") + F.pmod(F.lit(grain - 1) - F.col(f"{a}_hi"), F.lit(grain)) for a in axes})


def clip(df: DataFrame, axes: list[str], lo: int, hi: int) -> DataFrame:
    out = df.withColumns({f"{a}_lo": F.greatest(F.col(f"{a}_lo"), F.lit(lo)) for a in axes} | {f"{a}_hi": F.least(F.col(f"{a}_hi"), F.lit(hi)) for a in axes})
    for a in axes:
        out = out.where(F.col(f"{a}_lo") <= F.col(f"{a}_hi"))
    return out


def reflect(df: DataFrame, axis: str) -> DataFrame:
    """The boxes and their mirror images about 0 of an axis, as a set."""
    image = df.withColumns({f"{axis}_lo": -F.col(f"{axis}_hi"), f"{axis}_hi": -F.col(f"{axis}_lo")})
    return df.unionByName(image).distinct()


def rotate180(df: DataFrame, x: str, y: str) -> DataFrame:
    image = df.withColumns({f"{x}_lo": -F.col(f"{x}_hi"), f"{x}_hi": -F.col(f"{x}_lo"), f"{y}_lo": -F.col(f"{y}_hi"), f"{y}_hi": -F.col(f"{y}_lo")})
    return df.unionByName(image).distinct()


def rotate90(df: DataFrame, x: str, y: str) -> DataFrame:
    image = df.withColumns({f"{x}_lo": -F.col(f"{y}_hi"), f"{x}_hi": -F.col(f"{y}_lo"), f"{y}_lo": F.col(f"{x}_lo"), f"{y}_hi": F.col(f"{x}_hi")})
    return df.unionByName(image).distinct()


def combine(df: DataFrame, axes: list[str], min_fraction: float) -> DataFrame:
    """The hull in place of the boxes where they fill that fraction of it; 1 disables."""
    size = F.lit(1)
    for a in axes:
        size = size * (F.col(f"{a}_hi") - F.col(f"{a}_lo") + 1)
    h = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_v"), *[F.min(f"{a}_lo").alias(f"_{a}_lo") for a in axes], *[F.max(f"{a}_hi").alias(f"_{a}_hi") for a in axes])
    whole = F.lit(1)
    for a in axes:
        whole = whole * (F.col(f"_{a}_hi") - F.col(f"_{a}_lo") + 1)
    go = (F.col("_n") > 1) & (F.lit(min_fraction) < 1) & (F.col("_v") >= F.lit(min_fraction) * whole)
    j = df.join(F.broadcast(h))
    return j.select(*[F.when(go, F.col(f"_{a}_{e}")).otherwise(F.col(f"{a}_{e}")).alias(f"{a}_{e}") for a in axes for e in ("lo", "hi")]).distinct()


def fixpoint(df: DataFrame, steps: list, rounds: int = 10) -> DataFrame:
    """Applies the steps until the set of boxes no longer changes; an error if it doesn't settle."""
    held = None
    for _ in range(rounds):
        new = df
        for step in steps:
            new = step(new)
        new = new.distinct().persist()
        settled = new.count() == df.distinct().count() and new.join(df, new.columns, "left_anti").isEmpty()
        if held is not None:
            held.unpersist()
        if settled:
            return new
        df = held = new
    raise RuntimeError("regions did not settle")


def should_regrid(old: DataFrame, new: DataFrame, key: str, axes: list[str], threshold: float) -> DataFrame:
    """Whether any centre moved further than the threshold, changed its activity or its radius."""
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    d2 = F.lit(0.0)
    for a in axes:
        d2 = d2 + (F.col(f"o.{a}") - F.col(f"n.{a}")) ** 2
    changed = F.col(f"o.{key}").isNull() | F.col(f"n.{key}").isNull() | (F.col("o.active") != F.col("n.active")) | (d2 > threshold * threshold) | (F.col("o.radius") != F.col("n.radius"))
    return j.agg(F.coalesce(F.max(changed), F.lit(False)).alias("regrid"))


def centre_boxes(centres: DataFrame, axes: list[str], origin: float, delta: float) -> DataFrame:
    """Boxes of lattice indices around centres: a centre's position, and `radii` by level from 1; level 0 is the base grid."""
    each = centres.where("active").select("*", F.posexplode("radii").alias("_k", "radius"))
    h = F.lit(delta) / F.pow(F.lit(2.0), F.col("_k") + 1)
    lo = [F.floor((F.col(a) - F.col("radius") - origin) / h + 0.5).cast("long").alias(f"{a}_lo") for a in axes]
    hi = [F.floor((F.col(a) + F.col("radius") - origin) / h + 0.5).cast("long").alias(f"{a}_hi") for a in axes]
    return each.select((F.col("_k") + 1).alias("rl"), *lo, *hi).distinct()


def bisect(flags: DataFrame, axes: list[str], box: dict[str, tuple[int, int]], flagged: Column, min_fraction: float, min_width: int) -> DataFrame:
    """Boxes by recursive bisection of an error field: without a flagged point they go, with `min_fraction` of them
    or too narrow to halve they stay, else their longest axis (the first of equal ones) is halved.

    The halvings of a point's box don't depend on the flags, so each point lists the boxes that it may end in and
    one aggregation by box decides on all levels at once; a point takes its first box that stays.
    """
    d, order, span = flags.where(flagged).select(*axes), [], {a: box[a][1] - box[a][0] + 1 for a in axes}
    for a in axes:
        d = d.where(F.col(a).between(*box[a]))
    while True:
        a = max(axes, key=lambda x: span[x])  # all boxes of a depth have about the same extent; the first of equal axes
        if span[a] < 2 * min_width:
            break
        order.append(axes.index(a))
        span[a] = -(-span[a] // 2)
    names = [f"{a}_{e}" for a in axes for e in ("lo", "hi")]
    root = F.struct(F.lit(0).alias("depth"), F.lit(not order).alias("narrow"), *[F.lit(box[a][k]).cast("long").alias(f"{a}_{e}") for a in axes for k, e in enumerate(("lo", "hi"))])

    def halve(path: Column, axis: Column) -> Column:
        last, new = F.element_at(path, -1), []
        for k, a in enumerate(axes):
            low, high = last[f"{a}_lo"], last[f"{a}_hi"]
            mid = F.floor((low + high + 1) / 2).cast("long")
            upper = F.col(a) >= mid
            new.append(F.when((axis == k) & upper, mid).otherwise(low).alias(f"{a}_lo"))
            new.append(F.when((axis == k) & ~upper, mid - 1).otherwise(high).alias(f"{a}_hi"))
        return F.concat(path, F.array(F.struct((last["depth"] + 1).alias("depth"), (last["depth"] + 1 == len(order)).alias("narrow"), *new)))

    kind = f"array<struct<depth:int,narrow:boolean,{','.join(f'{n}:bigint' for n in names)}>>"
    paths = d.select(*axes, F.aggregate(F.array(*[F.lit(k) for k in order]).cast("array<int>"), F.array(root).cast(kind), lambda path, axis: halve(path, axis).cast(kind)).alias("path"))
    each = paths.select(*axes, F.explode("path").alias("b"))
    volume = F.lit(1).cast("long")
    for a in axes:
        volume = volume * (F.col(f"b.{a}_hi") - F.col(f"b.{a}_lo") + 1)
    stay = each.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("b.narrow") | (F.col("n") >= min_fraction * volume))
    first = each.join(stay, "b").groupBy(*axes).agg(F.min("b").alias("b"))
    return first.select("b.*").drop("narrow").distinct()


def merge_neighbours(df: DataFrame, axis: str, axes: list[str]) -> DataFrame:
    """Boxes of equal extent in the other axes that touch along an axis become one."""
    across = [f"{a}_{e}" for a in axes if a != axis for e in ("lo", "hi")]
    w = Window.partitionBy(*across).orderBy(f"{axis}_lo")
    apart = F.coalesce(F.lag(f"{axis}_hi").over(w) + 1 != F.col(f"{axis}_lo"), F.lit(True)).cast("int")
    g = df.select(*[f"{a}_{e}" for a in axes for e in ("lo", "hi")]).distinct().withColumn("_new", apart).withColumn("_g", F.sum("_new").over(w))
    return g.groupBy(*across, "_g").agg(F.min(f"{axis}_lo").alias(f"{axis}_lo"), F.max(f"{axis}_hi").alias(f"{axis}_hi")).drop("_g").select(*[f"{a}_{e}" for a in axes for e in ("lo", "hi")])


def snap_coarse(df: DataFrame, axes: list[str], factor: int = 2) -> DataFrame:
    """Boxes grown outward to indices that the coarser level has too."""
    return df.withColumns({f"{a}_lo": F.col(f"{a}_lo") - F.pmod(F.col(f"{a}_lo"), F.lit(factor)) for a in axes} | {f"{a}_hi": F.col(f"{a}_hi") + F.pmod(-F.col(f"{a}_hi"), F.lit(factor)) for a in axes})


def in_domain(df: DataFrame, axes: list[str], lo: int, hi: int) -> DataFrame:
    """Boxes that leave the domain: none, if the regions are right."""
    out = F.lit(False)
    for a in axes:
        out = out | (F.col(f"{a}_lo") < lo) | (F.col(f"{a}_hi") > hi)
    return df.where(out)


def periodic_images(df: DataFrame, axis: str, n: int) -> DataFrame:
    """Boxes with their images one period up and down that meet the domain [0, n)."""
    moved = df.withColumn("_s", F.explode(F.array(F.lit(-n), F.lit(0), F.lit(n)))).withColumns({f"{axis}_lo": F.col(f"{axis}_lo") + F.col("_s"), f"{axis}_hi": F.col(f"{axis}_hi") + F.col("_s")}).drop("_s")
    return moved.where((F.col(f"{axis}_hi") >= 0) & (F.col(f"{axis}_lo") < n)).distinct()


def track(centres: DataFrame, surfaces: DataFrame, axes: list[str]) -> DataFrame:
    """Centres moved to the centroids of their surfaces; without a valid one they stay and become inactive."""
    s = surfaces.select(F.col("surface").alias("_s"), F.col("valid").alias("_ok"), *[F.col(a).alias(f"_{a}") for a in axes])
    j = centres.join(s, F.col("surface") == F.col("_s"), "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    return j.withColumns({a: F.when(F.col("_ok"), F.col(f"_{a}")).otherwise(F.col(a)) for a in axes} | {"active": F.col("_ok")}).select(*centres.columns)


def split_even(df: DataFrame, axes: list[str], parts: Column) -> DataFrame:
    """Boxes cut into slabs of about equal extent across their longest axis (the first of equal ones), no more than it has points."""
    extent = {a: F.col(f"{a}_hi") - F.col(f"{a}_lo") + 1 for a in axes}
    longest = F.greatest(*extent.values()) if len(axes) > 1 else extent[axes[0]]
    d = df.withColumn("_n", F.least(parts.cast("long"), longest.cast("long"))).withColumn("_len", longest).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    done, out = F.lit(False), {}
    for a in axes:
        here = ~done & (extent[a] == F.col("_len"))
        at = lambda k, a=a: F.col(f"{a}_lo") + F.floor(F.col("_len") * k / F.col("_n")).cast("long")
        out[f"{a}_lo"] = F.when(here, at(F.col("part"))).otherwise(F.col(f"{a}_lo"))
        out[f"{a}_hi"] = F.when(here, at(F.col("part") + 1) - 1).otherwise(F.col(f"{a}_hi"))
        done = done | (extent[a] == F.col("_len"))
    return d.withColumns(out).drop("_n", "_len")


def costs(df: DataFrame, axes: list[str], ghosts: int, per_point: float = 1.0, per_ghost: float = 0.25) -> DataFrame:
    """df with `cost`: interior points and a share of the ghosts around them."""
    inner, outer = F.lit(1.0), F.lit(1.0)
    for a in axes:
        n = (F.col(f"{a}_hi") - F.col(f"{a}_lo") + 1).cast("double")
        inner, outer = inner * n, outer * (n + 2 * ghosts)
    return df.withColumn("cost", per_point * inner + per_ghost * (outer - inner))
