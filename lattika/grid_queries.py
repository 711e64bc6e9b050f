"""More instantiations of the lattice operators, with SQL that states the expected weights as plain numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattika.functions import scalars
from lattika.functions.reductions import complex_reduction, interior, reduction, strict_for
from lattika.operators import boxes, interp, levels, regrid, slabs, sync, transfer, weights
from lattika.queries import BOX_SQL, LATTICE_SQL, LINE_SQL, PROBE_SQL, SET_A, SET_B, _probes, _sets, lattice, line, part_boxes, read, register

# --- Reductions ------------------------------------------------------------------------------------


@register("reduce_complex", """
SELECT l_returnflag, round(sum(l_discount), 4) AS n, round(sum(l_discount*(l_quantity*l_quantity - l_tax*l_tax)), 2) AS re2, round(sum(l_discount*2*l_quantity*l_tax), 4) AS im2,
 round(sum(l_discount*(l_quantity*l_quantity + l_tax*l_tax)), 2) AS abs2, round(sqrt(sum(l_discount*(l_quantity*l_quantity + l_tax*l_tax))/sum(l_discount)), 6) AS norm2,
 round(sum(l_discount*sqrt(l_quantity*l_quantity + l_tax*l_tax))/sum(l_discount), 6) AS norm1,
 round(exp(sum(0.01*l_discount*ln(sqrt(l_quantity*l_quantity + l_tax*l_tax)/20)) FILTER (WHERE l_discount<>0)) * cos(sum(0.01*l_discount*atan2(l_tax, l_quantity))), 6) AS product_re
FROM lineitem GROUP BY 1""")
def reduce_complex(spark, sf_dir):
    re, im, w = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    c = lambda name: complex_reduction(name, re, im, w)
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(c("count").alias("n"), c("sum_squared").alias("s2"), c("sum_abs_squared").alias("a2"), c("norm2").alias("n2"), c("norm1").alias("n1"), complex_reduction("product", re / 20, im / 20, 0.01 * w).alias("p"))
    return g.select("l_returnflag", F.round("n.re", 4).alias("n"), F.round("s2.re", 2).alias("re2"), F.round("s2.im", 4).alias("im2"), F.round("a2.re", 2).alias("abs2"), F.round("n2.re", 6).alias("norm2"), F.round("n1.re", 6).alias("norm1"), F.round("p.re", 6).alias("product_re"))


@register("reduce_array_to_scalar", "SELECT label, round(sum(v), 5) AS sum, count(*)::DOUBLE AS count FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label")
def reduce_array_to_scalar(spark, sf_dir):
    d = read(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v"))
    return d.groupBy("label").agg(F.round(reduction("sum", "v"), 5).alias("sum"), reduction("count", "v").alias("count"))


@register("reduce_strict", "SELECT 0.0::DOUBLE AS squares, sum(l_linenumber)::DOUBLE AS sum, round(sqrt(avg(l_quantity*l_quantity)), 6) AS norm2 FROM lineitem")
def reduce_strict(spark, sf_dir):
    """The compatible rule follows the type: squares of integers are 0, those of real numbers aren't."""
    d = read(spark, sf_dir, "lineitem")
    return d.agg(reduction("sum_squared", "l_linenumber", strict=strict_for(d, "l_linenumber")).alias("squares"), reduction("sum", "l_linenumber").alias("sum"), F.round(reduction("norm2", "l_quantity", strict=strict_for(d, "l_quantity")), 6).alias("norm2"))


@register("reduce_without_ghosts", "SELECT l_returnflag, sum(l_quantity) AS sum, count(*)::DOUBLE AS count FROM lineitem WHERE NOT (l_linenumber = 1) OR l_linestatus = 'F' GROUP BY 1")
def reduce_without_ghosts(spark, sf_dir):
    """Line 1 plays the ghost, status F the outer boundary."""
    d = read(spark, sf_dir, "lineitem").where(interior(F.col("l_linenumber") == 1, F.col("l_linestatus") == "F"))
    return d.groupBy("l_returnflag").agg(reduction("sum", "l_quantity").alias("sum"), reduction("count", "l_quantity").alias("count"))


_LAST2 = "SELECT user_id, epoch_us(ts) AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events"


@register("reduce_at_time", f"WITH e AS ({_LAST2}), p AS (SELECT a.user_id, (a.v + b.v)/2 AS v FROM e a JOIN e b ON a.user_id = b.user_id AND a.r = 1 AND b.r = 2) SELECT count(*)::DOUBLE AS count, round(avg(v), 6) AS average, round(max(v), 6) AS maximum FROM p")
def reduce_at_time(spark, sf_dir):
    """Values are interpolated to one time of each point, midway between its newest levels, before they are reduced."""
    e = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"))
    at = transfer.time_interpolate(e, ["user_id"], "t", "v", (F.col("p")[0]["t"] + F.col("p")[1]["t"]) / 2, 2).where("v IS NOT NULL")
    return at.agg(reduction("count", "v").alias("count"), F.round(reduction("average", "v"), 6).alias("average"), F.round(reduction("maximum", "v"), 6).alias("maximum"))


# --- Masks -----------------------------------------------------------------------------------------------

_FINE_SQL = f"(SELECT DISTINCT x_lo % 13 AS x_lo, x_lo % 13 + 1 + x_hi - x_lo AS x_hi, y_lo % 11 AS y_lo, y_lo % 11 + 1 + y_hi - y_lo AS y_hi FROM {BOX_SQL} WHERE id BETWEEN 3 AND 9)"


@register("mask_refined", f"""
WITH r AS {_FINE_SQL}, c AS (SELECT DISTINCT x, y FROM r, LATERAL (SELECT unnest(range(x_lo, x_hi)) AS x), LATERAL (SELECT unnest(range(y_lo, y_hi)) AS y))
SELECT 0 AS rl, 400.0 - count(*) AS volume FROM c UNION ALL SELECT 1, count(*)::DOUBLE FROM c""")
def mask_refined(spark, sf_dir):
    """Weights of two levels: their volumes are the domain's less what is refined, and what is refined, whatever boxes overlap."""
    b = part_boxes(spark, sf_dir).where("id BETWEEN 3 AND 9")  # the regions of a small hierarchy, as a regridding would give them
    x, y = F.col("x_lo") % 13, F.col("y_lo") % 11
    r = b.select(x.alias("x_lo"), (x + 1 + F.col("x_hi") - F.col("x_lo")).alias("x_hi"), y.alias("y_lo"), (y + 1 + F.col("y_hi") - F.col("y_lo")).alias("y_hi"))
    fine = r.select(*[(2 * F.col(c)).alias(c) for c in r.columns])
    grid = spark.range(21).select(F.col("id").alias("x")).crossJoin(spark.range(21).select(F.col("id").alias("y")))
    edge = weights.boundary_mask([F.col("x"), F.col("y")], [F.lit(0), F.lit(0)], [F.lit(20), F.lit(20)])
    coarse = weights.refinement_mask(grid.withColumn("iweight", edge), r, ["x", "y"], 8, covered=True)
    inner = weights.refinement_mask(boxes.points(fine, ["x", "y"]).withColumn("iweight", F.lit(15)), fine, ["x", "y"], 8, covered=False)
    total = lambda d, rl, cell: d.agg(F.lit(rl).alias("rl"), (F.sum(weights.weight(F.col("iweight"), 2)) * cell).alias("volume"))
    return total(coarse, 0, 1.0).unionByName(total(inner, 1, 0.25))


@register("mask_classes", "SELECT CASE WHEN l_linenumber = 1 THEN -1 WHEN l_discount = 0 THEN 0 ELSE l_linenumber END AS class, count(*) AS n, sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 255 END)::BIGINT AS bits FROM lineitem GROUP BY 1")
def mask_classes(spark, sf_dir):
    c = weights.classify(F.col("l_linenumber") == 1, F.col("l_discount") != 0, F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(weights.ghost_mask(F.lit(255), F.col("l_linestatus") == "O")).alias("bits"))


@register("mask_unused", f"SELECT a.i, a.j, (b.i IS NOT NULL)::INT AS unused FROM {SET_A} a LEFT JOIN {SET_B} b ON a.i = b.i AND a.j = b.j")
def mask_unused(spark, sf_dir):
    return weights.unused_mask(*_sets(spark, sf_dir), ["i", "j"])


# --- Boxes and sets -----------------------------------------------------------------------------------------


@register("box_order", f"""
WITH b AS (SELECT id, x_lo, x_hi, y_lo, y_hi, x_lo - x_lo % 3 AS u_lo, x_hi - x_hi % 2 AS u_hi, y_lo AS w_lo, y_hi AS w_hi FROM {BOX_SQL})
SELECT id, (u_lo = x_lo AND u_hi = x_hi) AS same, (u_lo >= x_lo AND u_hi <= x_hi OR u_lo > u_hi) AS within, ((u_lo >= x_lo AND u_hi <= x_hi OR u_lo > u_hi) AND NOT (u_lo = x_lo AND u_hi = x_hi)) AS below,
 CASE WHEN 40 BETWEEN x_lo AND x_hi AND 20 BETWEEN y_lo AND y_hi THEN (40 - x_lo) + (x_hi - x_lo + 1)*(20 - y_lo) END AS place,
 (x_lo - 1) - (x_lo - 1 + 4) % 4 + 4 AS a_lo, (x_hi + 1) + (4 - (x_hi + 1) % 4) % 4 - 4 AS a_hi FROM b""")
def box_order(spark, sf_dir):
    b = part_boxes(spark, sf_dir)
    lo, hi = [F.col("x_lo"), F.col("y_lo")], [F.col("x_hi"), F.col("y_hi")]
    u_lo, u_hi = [F.col("x_lo") - F.col("x_lo") % 3, F.col("y_lo")], [F.col("x_hi") - F.col("x_hi") % 2, F.col("y_hi")]
    a = boxes.anti_contracted_for(F.col("x_lo"), F.col("x_hi"), 4)
    return b.select("id", boxes.equal(u_lo, u_hi, lo, hi).alias("same"), boxes.contained_in(u_lo, u_hi, lo, hi).alias("within"), boxes.less(u_lo, u_hi, lo, hi).alias("below"), boxes.linear_index(lo, hi, [F.lit(40), F.lit(20)]).alias("place"), a[0].alias("a_lo"), a[1].alias("a_hi"))


@register("box_hull_empty", f"SELECT id % 10 AS k, coalesce(min(x_lo) FILTER (WHERE id % 3 <> 0), 1) AS x_lo, coalesce(max(x_hi) FILTER (WHERE id % 3 <> 0), 0) AS x_hi FROM {BOX_SQL} GROUP BY 1")
def box_hull_empty(spark, sf_dir):
    """Boxes of every third id are turned into empty ones, which don't widen a hull."""
    b = part_boxes(spark, sf_dir).select((F.col("id") % 10).alias("k"), F.when(F.col("id") % 3 == 0, F.col("x_hi") + 9).otherwise(F.col("x_lo")).alias("x_lo"), "x_hi")
    return boxes.hull(b, ["k"], ["x"])


register("set_shift", f"SELECT i + 3 AS i, j - 2 AS j FROM {SET_A}")(lambda s, d: boxes.shift_set(_sets(s, d)[0], {"i": 3, "j": -2}))
register("set_expand", f"SELECT DISTINCT i + a AS i, j + b AS j FROM {SET_A}, (SELECT unnest([-1, 0, 1, 2]) AS a), (SELECT unnest([-1, 0, 1, 2]) AS b)")(lambda s, d: boxes.expand_set(_sets(s, d)[0], ["i", "j"], 1, 2))
register("set_expanded_for", f"SELECT DISTINCT unnest([i - i % 4, i + (4 - i % 4) % 4]) AS i, j FROM {SET_A}")(lambda s, d: boxes.restride_set(_sets(s, d)[0], ["i"], 4))
register("set_contracted_for", f"SELECT i, j FROM {SET_A} WHERE i % 4 = 0 AND j % 4 = 0")(lambda s, d: boxes.restride_set(_sets(s, d)[0], ["i", "j"], 4, "contracted"))
register("set_disjoint_union", f"SELECT i, j FROM {SET_A} UNION ALL SELECT i + 100, j FROM {SET_B}")(lambda s, d: boxes.disjoint_union(_sets(s, d)[0], boxes.shift_set(_sets(s, d)[1], {"i": 100})))
_BOXED = f"SELECT i_lo, i_hi, j - row_number() OVER (PARTITION BY i_lo, i_hi ORDER BY j) AS h FROM (SELECT j, min(i) AS i_lo, max(i) AS i_hi FROM (SELECT i, j, i - row_number() OVER (PARTITION BY j ORDER BY i) AS g FROM {SET_A}) GROUP BY j, g)"
register("set_sizes", f"""
WITH a AS {SET_A}, p AS (SELECT i, j, count(*) AS n FROM (SELECT i, j FROM a UNION ALL SELECT i + 1, j FROM a UNION ALL SELECT i, j + 1 FROM a UNION ALL SELECT i + 1, j + 1 FROM a) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM a) AS size, (SELECT count(*) FROM (SELECT DISTINCT i_lo, i_hi, h FROM ({_BOXED}))) AS setsize, (SELECT count(*) FROM p WHERE n % 2 = 1) AS chi_size""")(lambda s, d: boxes.set_sizes(_sets(s, d)[0], "i", "j"))


@register("set_predicates", f"SELECT (SELECT count(*) FROM (SELECT * FROM {SET_A} EXCEPT SELECT * FROM {SET_B})) = 0 AS subset, (SELECT count(*) FROM (SELECT * FROM {SET_A} INTERSECT SELECT * FROM {SET_B})) > 0 AS meets, (SELECT count(*) FROM {SET_A} WHERE i = 3 AND j = 4) > 0 AS has_point, true AS itself, true AS below")
def set_predicates(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    row = (boxes.is_subset(a, b), boxes.meets(a, b), boxes.has_point(a, {"i": 3, "j": 4}), boxes.is_equal(a, a), boxes.is_proper_subset(a, boxes.disjoint_union(a, spark.range(1).select(F.lit(-1).alias("i"), F.lit(-1).alias("j")))))
    return spark.createDataFrame([row], "subset boolean, meets boolean, has_point boolean, itself boolean, below boolean")


# --- Scalars ---------------------------------------------------------------------------------------------------


@register("nan_minmax", "SELECT l_returnflag, count(*) FILTER (WHERE l_tax = 0) AS nans, round(sum(least(l_discount, l_tax)) FILTER (WHERE l_tax <> 0), 4) AS low, round(sum(greatest(l_discount, l_tax)) FILTER (WHERE l_tax <> 0), 4) AS high FROM lineitem GROUP BY 1")
def nan_minmax(spark, sf_dir):
    t = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    lo, hi = scalars.nan_least(F.col("l_discount"), t), scalars.nan_greatest(F.col("l_discount"), t)
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.isnan(lo) & F.isnan(hi)).alias("nans"), F.round(F.sum(F.when(~F.isnan(lo), lo)), 4).alias("low"), F.round(F.sum(F.when(~F.isnan(hi), hi)), 4).alias("high"))


@register("align_indices", "SELECT l_linenumber, count(*) AS n, sum(q // 4)::BIGINT AS d, sum(((q % 4) + 4) % 4)::BIGINT AS m, sum(q - ((q % 4) + 4) % 4)::BIGINT AS down, sum(q + (4 - q % 4) % 4)::BIGINT AS up FROM (SELECT l_linenumber, l_quantity::BIGINT AS q FROM lineitem) GROUP BY 1")
def align_indices(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(scalars.div_down(q, 4)).alias("d"), F.sum(scalars.mod_down(q, 4)).alias("m"), F.sum(scalars.align_down(q, 4)).alias("down"), F.sum(scalars.align_up(q, 4)).alias("up"))


# --- Level transfer -------------------------------------------------------------------------------------------

_O5 = "(VALUES (0, 0, 1.0::DOUBLE), (1, -2, 3/256.0::DOUBLE), (1, -1, -25/256.0::DOUBLE), (1, 0, 150/256.0::DOUBLE), (1, 1, 150/256.0::DOUBLE), (1, 2, -25/256.0::DOUBLE), (1, 3, 3/256.0::DOUBLE))"
_O1 = "(VALUES (0, 0), (1, 0), (1, 1))"


@register("prolong_monotone5", f"""
WITH g AS {LATTICE_SQL}, k(p, o, w) AS {_O5}, n(p, o) AS {_O1},
f AS (SELECT 2*(i-a.o)+a.p AS i, 2*(j-b.o)+b.p AS j, sum(a.w*b.w*v) AS v FROM g, k a, k b GROUP BY 2*(i-a.o)+a.p, 2*(j-b.o)+b.p, a.p, b.p HAVING count(*) = (1+5*a.p)*(1+5*b.p)),
m AS (SELECT 2*(i-a.o)+a.p AS i, 2*(j-b.o)+b.p AS j, min(v) AS lo, max(v) AS hi, avg(v) AS mean FROM g, n a, n b GROUP BY 2*(i-a.o)+a.p, 2*(j-b.o)+b.p)
SELECT i, j, round(CASE WHEN v BETWEEN lo AND hi THEN v ELSE mean END, 5) AS v FROM f JOIN m USING (i, j)""")
def prolong_monotone5(spark, sf_dir):
    return transfer.prolong_monotone5(lattice(spark, sf_dir), ["i", "j"]).withColumn("v", F.round("v", 5))


_MM = "CASE WHEN ({0})*({1}) < 0 THEN 0.0 WHEN abs({0}) < abs({1}) THEN {0} ELSE {1} END"
_PLANE = f"""g AS {LATTICE_SQL}, n AS (SELECT a.i, a.j, a.v AS q00, b.v AS q10, c.v AS qm0, d.v AS q01, e.v AS q0m, f.v AS q11, h.v AS qm1, k.v AS q1m FROM g a
 JOIN g b ON b.i = a.i+1 AND b.j = a.j JOIN g c ON c.i = a.i-1 AND c.j = a.j JOIN g d ON d.i = a.i AND d.j = a.j+1 JOIN g e ON e.i = a.i AND e.j = a.j-1
 JOIN g f ON f.i = a.i+1 AND f.j = a.j+1 JOIN g h ON h.i = a.i-1 AND h.j = a.j+1 JOIN g k ON k.i = a.i+1 AND k.j = a.j-1)"""


@register("prolong_tvd_plane", f"""
WITH {_PLANE}, e AS (SELECT *, {_MM.format('q00-qm0', 'q10-q00')} AS x0, {_MM.format('q01-qm1', 'q11-q01')} AS x1, {_MM.format('q00-q0m', 'q01-q00')} AS y0, {_MM.format('q10-q1m', 'q11-q10')} AS y1 FROM n),
s AS (SELECT i, j, q00, {_MM.format('x0', 'x1')} AS sx, {_MM.format('y0', 'y1')} AS sy FROM e)
SELECT 2*i + f AS i, 2*j + h AS j, round(q00 + 0.5*f*sx + 0.5*h*sy, 6) AS v FROM s, (SELECT unnest([0, 1]) AS f), (SELECT unnest([0, 1]) AS h)
UNION ALL SELECT 2*i, 2*j, v FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.i = g.i AND n.j = g.j)""")
def prolong_tvd_plane(spark, sf_dir):
    return transfer.prolong_tvd_vertex(lattice(spark, sf_dir), ["i", "j"]).withColumn("v", F.round("v", 6)).where("i % 2 = 0 AND j % 2 = 0 OR i BETWEEN 2 AND 29 AND j BETWEEN 2 AND 29")


@register("prolong_tvd_cell", f"""
WITH {_PLANE}, s AS (SELECT i, j, q00, {_MM.format('q00-qm0', 'q10-q00')} AS sx, {_MM.format('q00-q0m', 'q01-q00')} AS sy FROM n)
SELECT 2*i + f AS i, 2*j + h AS j, round(q00 + (0.5*f - 0.25)*sx + (0.5*h - 0.25)*sy, 6) AS v FROM s, (SELECT unnest([0, 1]) AS f), (SELECT unnest([0, 1]) AS h)""")
def prolong_tvd_cell(spark, sf_dir):
    return transfer.prolong_tvd_cell(lattice(spark, sf_dir), ["i", "j"]).withColumn("v", F.round("v", 6))


@register("prolong_eno_cell", f"""
WITH g AS {LINE_SQL}, n AS (SELECT c.i, a.v AS a, b.v AS b, c.v AS c, d.v AS d, e.v AS e FROM g c LEFT JOIN g a ON a.i = c.i-2 LEFT JOIN g b ON b.i = c.i-1 LEFT JOIN g d ON d.i = c.i+1 LEFT JOIN g e ON e.i = c.i+2),
f AS (SELECT 2*i AS i, CASE WHEN abs(a-2*b+c) < abs(b-2*c+d) THEN (-3*a+14*b+21*c)/32 ELSE (5*b+30*c-3*d)/32 END AS v FROM n
 UNION ALL SELECT 2*i+1, CASE WHEN abs(b-2*c+d) < abs(c-2*d+e) THEN (-3*b+30*c+5*d)/32 ELSE (21*c+14*d-3*e)/32 END FROM n)
SELECT i, round(v, 6) AS v FROM f WHERE v IS NOT NULL""")
def prolong_eno_cell(spark, sf_dir):
    return transfer.prolong_eno_cell(line(spark, sf_dir), ["i"]).withColumn("v", F.round("v", 6))


@register("prolong_staggered", f"""
WITH g AS {LATTICE_SQL}, c(p, o, w) AS (VALUES (0, -1, -5/128.0::DOUBLE), (0, 0, 1.0::DOUBLE)), k(p, o, w) AS (VALUES (0, -2, -5/128.0::DOUBLE), (0, -1, 35/128.0::DOUBLE), (0, 0, 105/128.0::DOUBLE), (0, 1, -7/128.0::DOUBLE), (1, -1, -7/128.0::DOUBLE), (1, 0, 105/128.0::DOUBLE), (1, 1, 35/128.0::DOUBLE), (1, 2, -5/128.0::DOUBLE)),
u(p, o, w) AS (VALUES (0, 0, 1.0::DOUBLE), (1, -1, -1/16.0::DOUBLE), (1, 0, 9/16.0::DOUBLE), (1, 1, 9/16.0::DOUBLE), (1, 2, -1/16.0::DOUBLE))
SELECT 2*(i-a.o)+a.p AS i, 2*(j-b.o)+b.p AS j, round(sum(a.w*b.w*v), 5) AS v FROM g, k a, u b GROUP BY 2*(i-a.o)+a.p, 2*(j-b.o)+b.p, a.p, b.p HAVING count(*) = 4*(1+3*b.p)""")
def prolong_staggered(spark, sf_dir):
    return transfer.prolong_staggered(lattice(spark, sf_dir), ["i"], ["j"], 3).withColumn("v", F.round("v", 5))


register("restrict_staggered", f"SELECT i//2 AS i, j//2 AS j, round(avg(v), 6) AS v FROM {LATTICE_SQL} WHERE i%2=0 GROUP BY 1, 2 HAVING count(*) = 2")(lambda s, d: transfer.restrict_staggered(lattice(s, d), ["i", "j"], "01").withColumn("v", F.round("v", 6)))

_FOUR = "(SELECT l_partkey % 5 AS i, l_suppkey % 5 AS j, l_orderkey % 5 AS k, l_linenumber % 5 AS l, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3, 4)"


def _four(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    return d.groupBy(*[(F.col(c) % 5).alias(a) for c, a in (("l_partkey", "i"), ("l_suppkey", "j"), ("l_orderkey", "k"), ("l_linenumber", "l"))]).agg(F.sum("l_quantity").alias("v"))


@register("prolong_4d", f"""
WITH g AS {_FOUR}, n(p, o, w) AS (VALUES (0, 0, 1.0::DOUBLE), (1, 0, 0.5::DOUBLE), (1, 1, 0.5::DOUBLE))
SELECT 2*(i-a.o)+a.p AS i, 2*(j-b.o)+b.p AS j, 2*(k-c.o)+c.p AS k, 2*(l-d.o)+d.p AS l, round(sum(a.w*b.w*c.w*d.w*v), 5) AS v FROM g, n a, n b, n c, n d
GROUP BY 2*(i-a.o)+a.p, 2*(j-b.o)+b.p, 2*(k-c.o)+c.p, 2*(l-d.o)+d.p, a.p, b.p, c.p, d.p HAVING count(*) = (1+a.p)*(1+b.p)*(1+c.p)*(1+d.p)""")
def prolong_4d(spark, sf_dir):
    return transfer.prolong_vertex(_four(spark, sf_dir), ["i", "j", "k", "l"], 1).withColumn("v", F.round("v", 5))


register("restrict_4d", f"SELECT i//2 AS i, j//2 AS j, k//2 AS k, l//2 AS l, v FROM {_FOUR} WHERE i%2=0 AND j%2=0 AND k%2=0 AND l%2=0")(lambda s, d: transfer.restrict_sample(_four(s, d), ["i", "j", "k", "l"]))


@register("copy_region", f"SELECT g.i, g.j, CASE WHEN g.i BETWEEN 2 AND 9 AND g.j BETWEEN 3 AND 5 THEN -g.v ELSE g.v END AS v FROM {LATTICE_SQL} g")
def copy_region(spark, sf_dir):
    g = lattice(spark, sf_dir)
    return transfer.copy_region(g, g.withColumn("v", -F.col("v")), ["i", "j"], {"i": (2, 9), "j": (3, 5)})


@register("prolong_boundary", f"""
WITH g AS {LINE_SQL}, f AS (SELECT unnest(range(0, 127))::BIGINT AS i), p AS (SELECT 2*i AS i, v FROM g UNION ALL SELECT 2*a.i+1, (a.v+b.v)/2 FROM g a JOIN g b ON b.i = a.i+1)
SELECT f.i, CASE WHEN f.i NOT BETWEEN 4 AND 121 AND p.v IS NOT NULL THEN p.v ELSE -1.0 END AS v FROM f LEFT JOIN p ON f.i = p.i""")
def prolong_boundary(spark, sf_dir):
    fine = spark.range(127).select(F.col("id").alias("i"), F.lit(-1.0).alias("v"))
    return transfer.prolong_boundary(fine, line(spark, sf_dir), ["i"], 1, ~F.col("i").between(4, 121))


@register("time_derivative", f"WITH e AS ({_LAST2}), p AS (SELECT user_id, max(t) FILTER (WHERE r=1)/1e9 AS t1, max(t) FILTER (WHERE r=2)/1e9 AS t2, max(t) FILTER (WHERE r=3)/1e9 AS t3, max(v) FILTER (WHERE r=1) AS v1, max(v) FILTER (WHERE r=2) AS v2, max(v) FILTER (WHERE r=3) AS v3 FROM e WHERE r <= 3 GROUP BY 1 HAVING count(*) = 3) SELECT user_id, round((2*t1-t2-t3)/((t1-t2)*(t1-t3))*v1 + (t1-t3)/((t2-t1)*(t2-t3))*v2 + (t1-t2)/((t3-t1)*(t3-t2))*v3, 3) AS v FROM p")
def time_derivative(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e9).alias("t"), F.col("value").alias("v"))
    return transfer.time_derivative(e, ["user_id"], "t", "v", F.col("p")[0]["t"], 3, 1).withColumn("v", F.round("v", 3))


@register("interp_eno2", f"""
WITH p AS (SELECT point_id, x FROM {PROBE_SQL}), g AS {LINE_SQL}, n AS (SELECT b.i, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM g b LEFT JOIN g a ON a.i = b.i-1 LEFT JOIN g c ON c.i = b.i+1 LEFT JOIN g d ON d.i = b.i+2),
j AS (SELECT point_id, x - floor(x) AS f, a, b, c, d FROM p LEFT JOIN n ON n.i = floor(x)::BIGINT)
SELECT point_id, round(b + f*(c-b) + f*(f-1)/2 * CASE WHEN abs(a-2*b+c) <= abs(b-2*c+d) THEN a-2*b+c ELSE b-2*c+d END, 6) AS v FROM j""")
def interp_eno2(spark, sf_dir):
    p = _probes(spark, sf_dir).select("point_id", F.col("x").alias("i"))
    return interp.eno2(p, line(spark, sf_dir), "i").withColumn("v", F.round("v", 6))


@register("interp_null", f"""
WITH p AS {PROBE_SQL}, g AS (SELECT i, j, v, CASE WHEN (i + j) % 3 <> 0 THEN v END AS u FROM {LATTICE_SQL}), o AS (SELECT unnest([0, 1]) AS d),
s AS (SELECT point_id, floor(x)::BIGINT + a.d AS i, floor(y)::BIGINT + b.d AS j, (CASE a.d WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * (CASE b.d WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) AS w FROM p, o a, o b)
SELECT point_id, CASE WHEN count(v) = 4 THEN round(sum(w * v), 4) END AS v, CASE WHEN count(u) = 4 THEN round(sum(w * u), 4) END AS u, CASE WHEN count(v) = 4 THEN 0 ELSE -1 END AS status FROM s LEFT JOIN g USING (i, j) GROUP BY point_id""")
def interp_null(spark, sf_dir):
    """Two variables over one plan; the nulls of the second don't touch the first."""
    g = lattice(spark, sf_dir).withColumn("u", F.when((F.col("i") + F.col("j")) % 3 != 0, F.col("v")))
    p = _probes(spark, sf_dir).withColumnsRenamed({"x": "i", "y": "j"})
    out = interp.apply(interp.plan(p, ["i", "j"], 1), g, ["i", "j"], ["v", "u"], 1)
    return out.select("point_id", F.round("v", 4).alias("v"), F.round("u", 4).alias("u"), "status")


@register("jacobi_sweeps", f"""
WITH g AS (SELECT i, v AS b, 0.0::DOUBLE AS u FROM {LINE_SQL}), r AS (SELECT a.i, a.b, CASE WHEN l.i IS NULL OR h.i IS NULL THEN a.u ELSE (l.u + h.u - a.b)/2 END AS u FROM g a LEFT JOIN g l ON l.i = a.i-1 LEFT JOIN g h ON h.i = a.i+1),
s AS (SELECT a.i, a.b, CASE WHEN l.i IS NULL OR h.i IS NULL THEN a.u ELSE (l.u + h.u - a.b)/2 END AS u FROM r a LEFT JOIN r l ON l.i = a.i-1 LEFT JOIN r h ON h.i = a.i+1)
SELECT i, b, u AS v FROM s""")
def jacobi_sweeps(spark, sf_dir):
    return transfer.jacobi(line(spark, sf_dir).select("i", F.col("v").alias("b"), F.lit(0.0).alias("v")), ["i"], "b", 2)


@register("solver_residual", f"WITH g AS (SELECT i, v AS b, v/7 AS u FROM {LINE_SQL}) SELECT a.i, round(a.b - (l.u + h.u - 2*a.u), 6) AS residual FROM g a JOIN g l ON l.i = a.i-1 JOIN g h ON h.i = a.i+1")
def solver_residual(spark, sf_dir):
    return transfer.residual(line(spark, sf_dir).select("i", F.col("v").alias("b"), (F.col("v") / 7).alias("v")), ["i"], "b").withColumn("residual", F.round("residual", 6))


# --- Regridding -----------------------------------------------------------------------------------------------

_CENTRE_SQL = "(SELECT s_suppkey AS id, (s_suppkey % 37)/4.0::DOUBLE AS x, (s_suppkey % 23)/2.0::DOUBLE AS y, s_suppkey % 5 <> 0 AS active FROM supplier)"


def _centres(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), ((k % 37) / F.lit(4.0)).alias("x"), ((k % 23) / F.lit(2.0)).alias("y"), (k % 5 != 0).alias("active"), F.array(F.lit(2.0), 0.5 + (k % 3)).alias("radii"))


@register("regrid_centres", f"""
SELECT DISTINCT rl, floor((x - r + 1)/(0.5/pow(2, rl)) + 0.5)::BIGINT AS x_lo, floor((y - r + 1)/(0.5/pow(2, rl)) + 0.5)::BIGINT AS y_lo, floor((x + r + 1)/(0.5/pow(2, rl)) + 0.5)::BIGINT AS x_hi, floor((y + r + 1)/(0.5/pow(2, rl)) + 0.5)::BIGINT AS y_hi
FROM (SELECT id, x, y, 1 AS rl, 2.0::DOUBLE AS r FROM {_CENTRE_SQL} WHERE active UNION ALL SELECT id, x, y, 2, 0.5 + id % 3 FROM {_CENTRE_SQL} WHERE active)""")
def regrid_centres(spark, sf_dir):
    return regrid.centre_boxes(_centres(spark, sf_dir), ["x", "y"], -1.0, 0.5)


_FLAG_SQL = "(SELECT DISTINCT o_custkey % 64 AS i, (o_orderkey // 7) % 64 AS j FROM orders WHERE o_totalprice % 50 < 3)"


def _flags(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_totalprice % 50 < 3").select((F.col("o_custkey") % 64).alias("i"), (F.floor(F.col("o_orderkey") / 7) % 64).alias("j")).distinct()


@register("regrid_bisect", f"""
WITH f AS {_FLAG_SQL}, d AS (SELECT unnest(range(0, 9))::INT AS depth), s AS (SELECT depth, (64 >> ((depth + 1)//2))::BIGINT AS a, (64 >> (depth//2))::BIGINT AS b FROM d),
p AS (SELECT i, j, depth, i//a AS bi, j//b AS bj, a, b FROM f, s), n AS (SELECT depth, bi, bj, a, b, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT * FROM n WHERE depth = 8 OR n >= 0.3*a*b),
m AS (SELECT i, j, min(p.depth) AS depth FROM p JOIN k USING (depth, bi, bj) GROUP BY i, j)
SELECT DISTINCT m.depth, bi*a AS i_lo, bi*a + a - 1 AS i_hi, bj*b AS j_lo, bj*b + b - 1 AS j_hi FROM m JOIN p ON m.i = p.i AND m.j = p.j AND m.depth = p.depth""")
def regrid_bisect(spark, sf_dir):
    out = regrid.bisect(_flags(spark, sf_dir), ["i", "j"], {"i": (0, 63), "j": (0, 63)}, F.lit(True), 0.3, 3)
    return out.select("depth", *[F.col(f"{a}_{e}").cast("long").alias(f"{a}_{e}") for a in "ij" for e in ("lo", "hi")])


@register("regrid_recombine", f"""
WITH t AS (SELECT DISTINCT (i//8)*8 AS i, (j//8)*8 AS j FROM {_FLAG_SQL} WHERE i < 24 OR j > 30), r AS (SELECT i, j, i - 8*row_number() OVER (PARTITION BY j ORDER BY i) AS g FROM t)
SELECT min(i) AS i_lo, max(i) + 7 AS i_hi, j AS j_lo, j + 7 AS j_hi FROM r GROUP BY j, g""")
def regrid_recombine(spark, sf_dir):
    b = regrid.flag_blocks(_flags(spark, sf_dir), ["i", "j"], (F.col("i") < 24) | (F.col("j") > 30), 8)
    return regrid.merge_neighbours(b, "i", ["i", "j"])


register("regrid_snap", f"SELECT id, x_lo - x_lo % 2 AS x_lo, x_hi + x_hi % 2 AS x_hi FROM {BOX_SQL}")(lambda s, d: regrid.snap_coarse(part_boxes(s, d).select("id", "x_lo", "x_hi"), ["x"]))
register("regrid_nesting", f"SELECT x_lo, x_hi FROM {BOX_SQL} WHERE id % 2 = 0 UNION SELECT floor((x_lo - 3)/2.0)::BIGINT, ceil((x_hi + 3)/2.0)::BIGINT FROM {BOX_SQL} WHERE id % 2 = 1")(lambda s, d: regrid.nest_properly(part_boxes(s, d).where("id % 2 = 0").select("x_lo", "x_hi"), part_boxes(s, d).where("id % 2 = 1").select("x_lo", "x_hi"), ["x"], 3))
register("regrid_combine", f"WITH b AS (SELECT x_lo, x_hi FROM {BOX_SQL}), h AS (SELECT count(*) AS n, sum(x_hi-x_lo+1) AS v, min(x_lo) AS lo, max(x_hi) AS hi FROM b) SELECT DISTINCT CASE WHEN n > 1 AND v >= 0.5*(hi-lo+1) THEN lo ELSE x_lo END AS x_lo, CASE WHEN n > 1 AND v >= 0.5*(hi-lo+1) THEN hi ELSE x_hi END AS x_hi FROM b, h")(lambda s, d: regrid.combine(part_boxes(s, d).select("x_lo", "x_hi"), ["x"], 0.5))
register("regrid_rotate", f"SELECT x_lo, x_hi, y_lo, y_hi FROM {BOX_SQL} UNION SELECT -x_hi, -x_lo, -y_hi, -y_lo FROM {BOX_SQL}")(lambda s, d: regrid.rotate180(part_boxes(s, d).drop("id"), "x", "y"))
register("regrid_rotate90", f"SELECT x_lo, x_hi, y_lo, y_hi FROM {BOX_SQL} UNION SELECT -y_hi, -y_lo, x_lo, x_hi FROM {BOX_SQL}")(lambda s, d: regrid.rotate90(part_boxes(s, d).drop("id"), "x", "y"))
register("regrid_periodic", f"SELECT DISTINCT x_lo + s AS x_lo, x_hi + s AS x_hi FROM {BOX_SQL}, (SELECT unnest([-97, 0, 97]) AS s) WHERE x_hi + s >= 0 AND x_lo + s < 97")(lambda s, d: regrid.periodic_images(part_boxes(s, d).select("x_lo", "x_hi"), "x", 97))
register("regrid_outside", f"SELECT id, x_lo, x_hi FROM {BOX_SQL} WHERE x_lo < 0 OR x_hi > 96")(lambda s, d: regrid.in_domain(part_boxes(s, d).select("id", "x_lo", "x_hi"), ["x"], 0, 96))


@register("track_centres", f"SELECT id, CASE WHEN id % 7 = 0 THEN x + 1 ELSE x END AS x, CASE WHEN id % 7 = 0 THEN y / 2 ELSE y END AS y, id % 7 = 0 AS active FROM {_CENTRE_SQL}")
def track_centres(spark, sf_dir):
    c = _centres(spark, sf_dir).withColumn("surface", F.col("id")).drop("radii")
    s = c.select("surface", (F.col("id") % 7 == 0).alias("valid"), (F.col("x") + 1).alias("x"), (F.col("y") / 2).alias("y")).where("surface % 3 <> 1 OR valid")
    return regrid.track(c, s, ["x", "y"]).select("id", "x", "y", "active")


@register("should_regrid", f"SELECT count(*) FILTER (WHERE active <> (id % 10 <> 0) OR id % 11 = 3) > 0 AS regrid FROM {_CENTRE_SQL}")
def should_regrid(spark, sf_dir):
    c = _centres(spark, sf_dir).withColumn("radius", F.lit(1.0)).select("id", "x", "y", "active", "radius")
    new = c.withColumn("active", F.col("id") % 10 != 0).withColumn("x", F.when(F.col("id") % 11 == 3, F.col("x") + 2).otherwise(F.col("x")))
    return regrid.should_regrid(c, new, "id", ["x", "y"], 1.0)


@register("split_regions", f"""
WITH b AS (SELECT id, x_lo, x_hi, y_lo, y_hi, x_hi-x_lo+1 AS nx, y_hi-y_lo+1 AS ny FROM {BOX_SQL}), c AS (SELECT *, least(3, greatest(nx, ny)) AS n FROM b), p AS (SELECT *, unnest(range(0, n)) AS part FROM c)
SELECT id, part, CASE WHEN nx >= ny THEN x_lo + floor(nx*part/n::DOUBLE)::BIGINT ELSE x_lo END AS x_lo, CASE WHEN nx >= ny THEN x_lo + floor(nx*(part+1)/n::DOUBLE)::BIGINT - 1 ELSE x_hi END AS x_hi,
 CASE WHEN nx < ny THEN y_lo + floor(ny*part/n::DOUBLE)::BIGINT ELSE y_lo END AS y_lo, CASE WHEN nx < ny THEN y_lo + floor(ny*(part+1)/n::DOUBLE)::BIGINT - 1 ELSE y_hi END AS y_hi FROM p""")
def split_regions(spark, sf_dir):
    return regrid.split_even(part_boxes(spark, sf_dir), ["x", "y"], F.lit(3))


register("region_costs", f"SELECT id, (x_hi-x_lo+1)*(y_hi-y_lo+1) + 0.25*((x_hi-x_lo+7)*(y_hi-y_lo+7) - (x_hi-x_lo+1)*(y_hi-y_lo+1))::DOUBLE AS cost FROM {BOX_SQL}")(lambda s, d: regrid.costs(part_boxes(s, d), ["x", "y"], 3).select("id", "cost"))

# --- Movement, slabs, time levels ---------------------------------------------------------------------------------

register("boundary_flat", f"SELECT g.i, n.v FROM {LINE_SQL} g JOIN {LINE_SQL} n ON n.i = least(greatest(g.i, 5), 58)")(lambda s, d: sync.boundary(line(s, d), "i", 5, 58, "flat"))
register("boundary_mirror", f"SELECT g.i, n.v FROM {LINE_SQL} g JOIN {LINE_SQL} n ON n.i = CASE WHEN g.i < 5 THEN 10 - g.i WHEN g.i > 58 THEN 116 - g.i ELSE g.i END")(lambda s, d: sync.boundary(line(s, d), "i", 5, 58, "mirror"))
register("checksum_verify", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_linestatus = 'O' AND l_quantity = 7")(
    lambda s, d: sync.checksum_verify(sync.checksum(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_quantity"]), sync.checksum(read(s, d, "lineitem").withColumn("l_quantity", F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") == 7), 0.5).otherwise(F.col("l_quantity"))), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_quantity"]), ["l_returnflag", "l_linestatus"])
)
register("group_extents", "SELECT l_returnflag, min(l_linenumber) AS l_linenumber_lo, max(l_linenumber) AS l_linenumber_hi, count(*) AS n FROM lineitem GROUP BY 1")(lambda s, d: sync.extents(read(s, d, "lineitem"), ["l_returnflag"], ["l_linenumber"]))
register("slab_line", f"WITH k AS (SELECT unnest(range(0, 5))::INT AS s0) SELECT s0, coalesce(v, 0.0) AS v FROM k LEFT JOIN {LATTICE_SQL} g ON g.i = 1 + 3*s0 AND g.j = 2")(lambda s, d: slabs.line_slab(lattice(s, d), ["i", "j"], (1, 2), (1, 0), 14, 3))
register("slab_classes", "SELECT l_shipmode, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'ghost' WHEN 2 THEN 'boundary' WHEN 3 THEN 'symmetry' ELSE 'interior' END AS l_shipmode FROM lineitem) WHERE l_shipmode NOT IN ('ghost', 'symmetry') GROUP BY 1")(
    lambda s, d: slabs.by_class(read(s, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, "ghost").when(F.col("l_linenumber") == 2, "boundary").when(F.col("l_linenumber") == 3, "symmetry").otherwise("interior").alias("l_shipmode")), "l_shipmode", ghosts=False, symmetry=False).groupBy("l_shipmode").agg(F.count(F.lit(1)).alias("n"))
)
register("first_poison", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20")(lambda s, d: slabs.first_places(read(s, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P", ["o_orderkey"], 20).select("o_orderkey"))
_TIMES = "(SELECT c_custkey AS id, unnest([0, 1, 2]) AS tl, c_acctbal - 10*unnest([0, 1, 2]) AS time FROM customer)"
_times = lambda s, d: read(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("tl")).select("id", "tl", (F.col("c_acctbal") - 10 * F.col("tl")).alias("time"))
register("times_advance", f"SELECT id, tl, round(time + 10, 6) AS time FROM {_TIMES}")(lambda s, d: levels.advance(_times(s, d), 10.0, 3).withColumn("time", F.round("time", 6)))
register("times_retreat", f"SELECT id, tl, round(time - 10, 6) AS time FROM {_TIMES}")(lambda s, d: levels.retreat(_times(s, d), 10.0, 3).withColumn("time", F.round("time", 6)))
