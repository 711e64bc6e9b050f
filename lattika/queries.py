"""Instantiations of the lattice operators on the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.functions import scalars, stencils
from lattika.functions.reductions import REDUCTIONS, centre_of_mass, reduction
from lattika.operators import boxes, interp, levels, locate, regrid, slabs, sync, transfer, weights
from lattika.plans import scope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Reductions --------------------------------------------------------------------------------

X, W = "l_extendedprice", "l_discount"
LEVEL_SQL = "(l_linenumber % 3)"

_TOTAL = "coalesce(sum({w}*{x}) FILTER (WHERE {w}<>0), 0)"
REDUCTION_SQL = {
    "count": "round(sum({w}), 4)",
    "minimum": "round(min({x}) FILTER (WHERE {w}<>0), 4)",
    "maximum": "round(max({x}) FILTER (WHERE {w}<>0), 4)",
    "product": "round(sum({w}*ln({x})) FILTER (WHERE {w}<>0), 6)",
    "sum": f"round({_TOTAL}, 2)",
    "sum_abs": "round(coalesce(sum({w}*abs({x})) FILTER (WHERE {w}<>0), 0), 2)",
    "sum_squared": "round(coalesce(sum({w}*{x}*{x}) FILTER (WHERE {w}<>0), 0)/1e6, 2)",
    "sum_abs_squared": "round(coalesce(sum({w}*{x}*{x}) FILTER (WHERE {w}<>0), 0)/1e6, 2)",
    "average": f"round({_TOTAL}/sum({{w}}), 4)",
    "norm1": "round(coalesce(sum({w}*abs({x})) FILTER (WHERE {w}<>0), 0)/sum({w}), 4)",
    "norm2": "round(sqrt(sum({w}*{x}*{x}) FILTER (WHERE {w}<>0)/sum({w})), 4)",
    "norm_inf": "round(max(abs({x})) FILTER (WHERE {w}<>0), 4)",
}
ROUND = {"sum": 2, "sum_abs": 2, "product": 6}


def _reduce(name: str):
    base = name if name in REDUCTIONS else name[1:]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = read(spark, sf_dir, "lineitem")
        x = 1 + F.col("l_tax") / 100 if base == "product" else F.col(X)
        r = reduction(name, x, W, level=F.col("l_linenumber") % 3)
        r = F.log(r) if base == "product" else r / 1e6 if base.endswith("squared") else r
        return d.groupBy("l_returnflag").agg(F.round(r, 2 if base.endswith("squared") else ROUND.get(base, 4)).alias("value"))

    return run


for _name in REDUCTIONS:
    for _prefix in ("", "i"):
        _x = "(1 + l_tax/100)" if _name == "product" else "l_extendedprice"
        _w = "l_discount" if _prefix else f"(l_discount*pow(0.125, {LEVEL_SQL}))"
        register(f"reduce_{_prefix}{_name}", f"SELECT l_returnflag, {REDUCTION_SQL[_name].format(x=_x, w=_w)} AS value FROM lineitem GROUP BY l_returnflag")(_reduce(_prefix + _name))


@register("reduce_levels", f"""
SELECT 'level' AS scope, {LEVEL_SQL} AS rl, round(sum(l_discount*l_quantity)/sum(l_discount), 6) AS average, round(sum(l_discount), 4) AS count FROM lineitem GROUP BY 2
UNION ALL SELECT 'global', -1, round(sum(l_discount*pow(0.125,{LEVEL_SQL})*l_quantity)/sum(l_discount*pow(0.125,{LEVEL_SQL})), 6), round(sum(l_discount*pow(0.125,{LEVEL_SQL})), 4) FROM lineitem""")
def reduce_levels(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("rl", F.col("l_linenumber") % 3)
    names = ["average", "count"]
    a = scope.reduce_scope(d, "level", names, "l_quantity", "l_discount").withColumn("scope", F.lit("level"))
    b = scope.reduce_scope(d, "global", names, "l_quantity", "l_discount").withColumn("scope", F.lit("global")).withColumn("rl", F.lit(-1))
    return a.unionByName(b).select("scope", "rl", F.round("average", 6).alias("average"), F.round("count", 4).alias("count"))


@register("reduce_map", f"SELECT {LEVEL_SQL} AS rl, l_returnflag AS map, sum(l_quantity) AS sum, count(*)::DOUBLE AS count FROM lineitem GROUP BY 1, 2")
def reduce_map(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("rl", F.col("l_linenumber") % 3).withColumn("map", F.col("l_returnflag"))
    return scope.reduce_scope(d, "map", ["sum", "count"], "l_quantity", "l_discount")


@register("reduce_arrays", "SELECT k::INT AS k, round(sum(v), 5) AS sum, max(v) AS maximum FROM (SELECT unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings) GROUP BY k")
def reduce_arrays(spark, sf_dir):
    """Array to array: each element reduced over all rows."""
    d = read(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("k", "v"))
    return d.groupBy("k").agg(F.round(reduction("sum", F.col("v")), 5).alias("sum"), reduction("maximum", F.col("v")).cast(dict(d.dtypes)["v"]).alias("maximum"))


@register("reduce_nan_empty", "SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 'NaN' ELSE printf('%.2f', min(l_extendedprice)) END AS minimum, '1.7976931348623157E308' AS nothing, 1.0::DOUBLE AS one FROM lineitem GROUP BY l_returnflag")
def reduce_nan_empty(spark, sf_dir):
    """NaN propagates through the minimum; a group whose weights are all zero has the identities."""
    x = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), F.lit(float("nan"))).otherwise(F.col(X))
    m = reduction("minimum", x)
    shown = F.when(F.isnan(m), "NaN").otherwise(F.format_string("%.2f", m))
    zero = F.lit(0.0) * F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(shown.alias("minimum"), reduction("minimum", F.col(X), zero).cast("string").alias("nothing"), reduction("product", F.col(X), zero).alias("one"))


@register("centre_of_mass", "SELECT l_returnflag, round(sum(l_quantity*l_discount)/sum(l_quantity), 8) AS x, round(sum(l_quantity*l_tax)/sum(l_quantity), 8) AS y FROM lineitem GROUP BY 1")
def centre(spark, sf_dir):
    m = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(centre_of_mass(m, F.col("l_discount")), 8).alias("x"), F.round(centre_of_mass(m, F.col("l_tax")), 8).alias("y"))


# --- Lattices made from the tables ---------------------------------------------------------------

LATTICE_SQL = "(SELECT l_partkey % 16 AS i, l_suppkey % 16 AS j, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"
LINE_SQL = "(SELECT o_custkey % 64 AS i, count(*)::DOUBLE AS v FROM orders GROUP BY 1)"


def lattice(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("i"), (F.col("l_suppkey") % 16).alias("j")).agg(F.sum("l_quantity").alias("v"))


def line(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 64).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def _sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("i"), (F.col("o_orderkey") % 40).alias("j"), "o_orderpriority", "o_orderstatus")
    return o.where("o_orderpriority LIKE '1%'").select("i", "j").distinct(), o.where("o_orderstatus = 'F'").select("i", "j").distinct()


SET_A = "(SELECT DISTINCT o_custkey % 40 AS i, o_orderkey % 40 AS j FROM orders WHERE o_orderpriority LIKE '1%')"
SET_B = "(SELECT DISTINCT o_custkey % 40 AS i, o_orderkey % 40 AS j FROM orders WHERE o_orderstatus = 'F')"

register("box_intersect", f"SELECT * FROM {SET_A} INTERSECT SELECT * FROM {SET_B}")(lambda s, d: boxes.intersect(*_sets(s, d)))
register("box_union", f"SELECT * FROM {SET_A} UNION SELECT * FROM {SET_B}")(lambda s, d: boxes.union(*_sets(s, d)))
register("box_minus", f"SELECT * FROM {SET_A} EXCEPT SELECT * FROM {SET_B}")(lambda s, d: boxes.minus(*_sets(s, d)))
register("box_xor", f"(SELECT * FROM {SET_A} EXCEPT SELECT * FROM {SET_B}) UNION (SELECT * FROM {SET_B} EXCEPT SELECT * FROM {SET_A})")(lambda s, d: boxes.symmetric_difference(*_sets(s, d)))


@register("box_runs", f"SELECT j, min(i) AS i_lo, max(i) AS i_hi FROM (SELECT i, j, i - row_number() OVER (PARTITION BY j ORDER BY i) AS g FROM {SET_A}) GROUP BY j, g")
def box_runs(spark, sf_dir):
    return boxes.runs(_sets(spark, sf_dir)[0], "i", ["j"])


@register("box_normalise", f"SELECT i_lo, i_hi, min(j) AS j_lo, max(j) AS j_hi FROM (SELECT *, j - row_number() OVER (PARTITION BY i_lo, i_hi ORDER BY j) AS h FROM (SELECT j, min(i) AS i_lo, max(i) AS i_hi FROM (SELECT i, j, i - row_number() OVER (PARTITION BY j ORDER BY i) AS g FROM {SET_A}) GROUP BY j, g)) GROUP BY i_lo, i_hi, h")
def box_normalise(spark, sf_dir):
    return boxes.normalise(_sets(spark, sf_dir)[0], "i", "j")


BOX_SQL = "(SELECT p_partkey AS id, p_partkey % 97 AS x_lo, p_partkey % 97 + p_size % 7 AS x_hi, p_partkey % 53 AS y_lo, p_partkey % 53 + p_size % 5 AS y_hi FROM part)"


def part_boxes(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(k.alias("id"), (k % 97).alias("x_lo"), (k % 97 + s % 7).alias("x_hi"), (k % 53).alias("y_lo"), (k % 53 + s % 5).alias("y_hi"))


@register("box_sizes", f"SELECT id, ((x_hi-x_lo)//2+1)*((y_hi-y_lo)//2+1) AS n2, (x_hi-x_lo+1)*(y_hi-y_lo+1) AS n, (50 BETWEEN x_lo AND x_hi AND 20 BETWEEN y_lo AND y_hi) AS inside, (x_lo<=60 AND x_hi>=40 AND y_lo<=30 AND y_hi>=10) AS meets, (x_lo>=40 AND x_hi<=60 AND y_lo>=10 AND y_hi<=30) AS within FROM {BOX_SQL}")
def box_sizes(spark, sf_dir):
    lo, hi = [F.col("x_lo"), F.col("y_lo")], [F.col("x_hi"), F.col("y_hi")]
    a, b = [F.lit(40), F.lit(10)], [F.lit(60), F.lit(30)]
    return part_boxes(spark, sf_dir).select("id", boxes.size(lo, hi, 2).alias("n2"), boxes.size(lo, hi).alias("n"), boxes.contains(lo, hi, [F.lit(50), F.lit(20)]).alias("inside"), boxes.intersects(lo, hi, a, b).alias("meets"), boxes.contained_in(lo, hi, a, b).alias("within"))


@register("box_restride", f"SELECT id, x_lo - x_lo % 4 AS e_lo, x_hi + (4 - x_hi % 4) % 4 AS e_hi, x_lo + (4 - x_lo % 4) % 4 AS c_lo, x_hi - x_hi % 4 AS c_hi, x_lo - 2 AS g_lo, x_hi + 6 AS g_hi, x_lo + 3 AS s_lo, x_hi + 3 AS s_hi FROM {BOX_SQL}")
def box_restride(spark, sf_dir):
    lo, hi = F.col("x_lo"), F.col("x_hi")
    e, c = boxes.expanded_for(lo, hi, 4), boxes.contracted_for(lo, hi, 4)
    g, s = boxes.expand([lo], [hi], 1, 3, 2), boxes.shift([lo], [hi], 3)
    return part_boxes(spark, sf_dir).select("id", e[0].alias("e_lo"), e[1].alias("e_hi"), c[0].alias("c_lo"), c[1].alias("c_hi"), g[0][0].alias("g_lo"), g[1][0].alias("g_hi"), s[0][0].alias("s_lo"), s[1][0].alias("s_hi"))


@register("box_hull", f"SELECT id % 10 AS k, min(x_lo) AS x_lo, min(y_lo) AS y_lo, max(x_hi) AS x_hi, max(y_hi) AS y_hi FROM {BOX_SQL} GROUP BY 1")
def box_hull(spark, sf_dir):
    return boxes.hull(part_boxes(spark, sf_dir).withColumn("k", F.col("id") % 10), ["k"], ["x", "y"])


@register("box_points", f"SELECT DISTINCT x, y FROM {BOX_SQL}, LATERAL (SELECT unnest(range(x_lo, x_hi+1)) AS x), LATERAL (SELECT unnest(range(y_lo, y_hi+1)) AS y)")
def box_points(spark, sf_dir):
    return boxes.points(part_boxes(spark, sf_dir), ["x", "y"])



BAND_SQL = "(SELECT s_suppkey AS id, (floor(s_acctbal)::BIGINT) AS x_lo, (floor(s_acctbal)::BIGINT) + 40 + s_suppkey % 60 AS x_hi FROM supplier)"


@register("box_overlap_join", f"SELECT a.id AS a, b.id AS b, greatest(a.x_lo, b.x_lo) AS lo, least(a.x_hi, b.x_hi) AS hi FROM {BAND_SQL} a JOIN {BAND_SQL} b ON a.id < b.id AND a.x_lo <= b.x_hi AND b.x_lo <= a.x_hi")
def box_overlap_join(spark, sf_dir):
    k = F.col("s_suppkey")
    lo = F.floor("s_acctbal").cast("long")
    band = read(spark, sf_dir, "supplier").select(k.alias("id"), lo.alias("x_lo"), (lo + 40 + k % 60).alias("x_hi"))
    j = boxes.overlaps(band, band, "x", 128).where("x.id < y.id")
    return j.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.greatest("x.x_lo", "y.x_lo").alias("lo"), F.least("x.x_hi", "y.x_hi").alias("hi"))


# --- Location and interpolation --------------------------------------------------------------------

REGION_SQL = """(SELECT label AS c, rl, avg(x) - 0.6/pow(2, rl) AS x_lo, avg(x) + 0.6/pow(2, rl) AS x_hi, avg(y) - 0.6/pow(2, rl) AS y_lo, avg(y) + 0.6/pow(2, rl) AS y_hi
 FROM (SELECT label, round(embedding[1]::DOUBLE, 3) AS x, round(embedding[2]::DOUBLE, 3) AS y FROM embeddings), (SELECT unnest([0, 1, 2]) AS rl) GROUP BY label, rl)"""


def _points(spark, sf_dir) -> DataFrame:
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.round(F.get(e, 0).cast("double"), 3).alias("x"), F.round(F.get(e, 1).cast("double"), 3).alias("y"))


def _regions(spark, sf_dir) -> DataFrame:
    r = _points(spark, sf_dir).groupBy(F.col("label").alias("c")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("rl", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    h = F.lit(0.6) / F.pow(F.lit(2.0), F.col("rl"))
    return r.select("c", "rl", *[(F.col(a) - h).alias(f"{a}_lo") for a in "xy"], *[(F.col(a) + h).alias(f"{a}_hi") for a in "xy"])


LOCATE_SQL = f"SELECT p.vec_id AS point_id, max(rl) AS rl FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 3) AS x, round(embedding[2]::DOUBLE, 3) AS y FROM embeddings) p LEFT JOIN {REGION_SQL} r ON x BETWEEN x_lo AND x_hi AND y BETWEEN y_lo AND y_hi GROUP BY p.vec_id"


@register("locate_finest", f"SELECT point_id, rl, CASE WHEN rl IS NULL THEN -1 ELSE 0 END AS status FROM ({LOCATE_SQL})")
def locate_finest(spark, sf_dir):
    return locate.locate_finest(_points(spark, sf_dir), _regions(spark, sf_dir), ["x", "y"], 0.5).select("point_id", "rl", "status")


@register("locate_linear", LOCATE_SQL)
def locate_linear(spark, sf_dir):
    return locate.locate_linear(_points(spark, sf_dir), _regions(spark, sf_dir), ["x", "y"], 1.0).select("point_id", "rl")


PROBE_SQL = "(SELECT o_orderkey AS point_id, (o_custkey % 1200) / 100.0::DOUBLE + 1.25 AS x, (o_orderkey % 1100) / 100.0::DOUBLE + 1.5 AS y FROM orders)"


def _probes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), ((F.col("o_custkey") % 1200) / 100.0 + 1.25).alias("x"), ((F.col("o_orderkey") % 1100) / 100.0 + 1.5).alias("y"))


@register("interp_points", f"""
WITH p AS {PROBE_SQL}, g AS {LATTICE_SQL}, o AS (SELECT unnest([0, 1]) AS d),
s AS (SELECT point_id, floor(x)::BIGINT + a.d AS i, floor(y)::BIGINT + b.d AS j, (CASE a.d WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * (CASE b.d WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) AS w FROM p, o a, o b)
SELECT point_id, CASE WHEN count(v) = 4 THEN round(sum(w * v), 4) END AS v, CASE WHEN count(v) = 4 THEN 0 ELSE -1 END AS status FROM s LEFT JOIN g USING (i, j) GROUP BY point_id""")
def interp_points(spark, sf_dir):
    p = _probes(spark, sf_dir).withColumnsRenamed({"x": "i", "y": "j"})
    out = interp.apply(interp.plan(p, ["i", "j"], 1), lattice(spark, sf_dir), ["i", "j"], ["v"], 1)
    return out.select("point_id", F.round("v", 4).alias("v"), "status")


@register("interp_order3", f"""
WITH p AS {PROBE_SQL}, g AS (SELECT i, v FROM {LINE_SQL}), o AS (SELECT unnest([-1, 0, 1, 2]) AS k),
s AS (SELECT point_id, floor(x)::BIGINT + k AS i, x - floor(x) AS f, k FROM p, o),
w AS (SELECT point_id, i, CASE k WHEN -1 THEN -f*(f-1)*(f-2)/6 WHEN 0 THEN (f+1)*(f-1)*(f-2)/2 WHEN 1 THEN -(f+1)*f*(f-2)/2 ELSE (f+1)*f*(f-1)/6 END AS w FROM s)
SELECT point_id, CASE WHEN count(v) = 4 THEN round(sum(w * v), 4) END AS v FROM w LEFT JOIN g USING (i) GROUP BY point_id""")
def interp_order3(spark, sf_dir):
    p = _probes(spark, sf_dir).select("point_id", F.col("x").alias("i"))
    out = interp.apply(interp.plan(p, ["i"], 3), line(spark, sf_dir), ["i"], ["v"], 3)
    return out.select("point_id", F.round("v", 4).alias("v"))


# --- Level transfer --------------------------------------------------------------------------------

register("restrict_mean", f"SELECT i//2 AS i, j//2 AS j, round(avg(v), 6) AS v FROM {LATTICE_SQL} GROUP BY 1, 2 HAVING count(*) = 4")(lambda s, d: transfer.restrict_mean(lattice(s, d), ["i", "j"]).withColumn("v", F.round("v", 6)))
register("restrict_sample", f"SELECT i//2 AS i, j//2 AS j, v FROM {LATTICE_SQL} WHERE i%2=0 AND j%2=0")(lambda s, d: transfer.restrict_sample(lattice(s, d), ["i", "j"]))
register("restrict_mixed", f"SELECT i//2 AS i, j//2 AS j, round(avg(v), 6) AS v FROM {LATTICE_SQL} WHERE j%2=0 GROUP BY 1, 2 HAVING count(*) = 2")(lambda s, d: transfer.restrict_mean(lattice(s, d), ["i"], sampled=["j"]).withColumn("v", F.round("v", 6)))
register("reflux_faces", f"SELECT i//2 AS i, j//2 AS j, round(avg(v), 6) AS v FROM {LATTICE_SQL} WHERE i%2=0 GROUP BY 1, 2 HAVING count(*) = 2")(lambda s, d: transfer.reflux(lattice(s, d), "i", ["j"]).withColumn("v", F.round("v", 6)))


def _gather_sql(source: str, entries: list[tuple[int, int, float]], need: tuple[int, int], digits: int) -> str:
    """Fine points by gathering coarse ones: the opposite of how the engine does it."""
    rows = ", ".join(f"({p}, {o}, {w!r}::DOUBLE)" for p, o, w in entries)
    return f"WITH g AS {source}, k(p, o, w) AS (VALUES {rows}) SELECT 2*(i-o)+p AS i, round(sum(w*v), {digits}) AS v FROM g, k GROUP BY 2*(i-o)+p, p HAVING count(*) = CASE p WHEN 0 THEN {need[0]} ELSE {need[1]} END"


for _order in (1, 3, 5, 7, 9, 11):
    _k = stencils.vertex(_order)
    register(f"prolong_o{_order}", _gather_sql(LINE_SQL, [(0, 0, 1.0)] + [(1, o, w) for o, w in _k], (1, _order + 1), 6))(lambda s, d, n=_order: transfer.prolong_vertex(line(s, d), ["i"], n).withColumn("v", F.round("v", 6)))
for _order in range(6):
    _e = [(p, o, w) for p in (0, 1) for o, w in stencils.cell(_order, p)]
    register(f"prolong_cell_o{_order}", _gather_sql(LINE_SQL, _e, (_order + 1, _order + 1), 6))(lambda s, d, n=_order: transfer.prolong_cell(line(s, d), ["i"], n).withColumn("v", F.round("v", 6)))
for _order in (3, 5):
    _rows = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in stencils.vertex(_order))
    register(f"restrict_cell_o{_order}", f"WITH g AS {LINE_SQL}, k(o, w) AS (VALUES {_rows}) SELECT (i-o)//2 AS i, round(sum(w*v), 6) AS v FROM g, k WHERE (i-o) % 2 = 0 AND i - o >= 0 GROUP BY 1 HAVING count(*) = {_order + 1}")(lambda s, d, n=_order: transfer.restrict_cell(line(s, d), ["i"], n).where("i >= 0").withColumn("v", F.round("v", 6)))


@register("prolong_plane_o1", f"""
WITH g AS {LATTICE_SQL}, k(p, o, w) AS (VALUES (0, 0, 1.0::DOUBLE), (1, 0, 0.5::DOUBLE), (1, 1, 0.5::DOUBLE))
SELECT 2*(i-a.o)+a.p AS i, 2*(j-b.o)+b.p AS j, round(sum(a.w*b.w*v), 6) AS v FROM g, k a, k b GROUP BY 2*(i-a.o)+a.p, 2*(j-b.o)+b.p, a.p, b.p HAVING count(*) = (1+a.p)*(1+b.p)""")
def prolong_plane(spark, sf_dir):
    return transfer.prolong_vertex(lattice(spark, sf_dir), ["i", "j"], 1).withColumn("v", F.round("v", 6))


_NEAR = f"SELECT i, v, lag(v) OVER w AS a, lead(v) OVER w AS c, lead(v, 2) OVER w AS d, lag(i) OVER w AS pi, lead(i) OVER w AS ni, lead(i, 2) OVER w AS mi FROM {LINE_SQL} WINDOW w AS (ORDER BY i)"


@register("prolong_tvd", f"""
WITH n AS ({_NEAR}), s AS (SELECT i, v, CASE WHEN pi = i-1 AND ni = i+1 THEN (CASE WHEN (v-a)*(c-v) < 0 THEN 0.0 WHEN abs(v-a) < abs(c-v) THEN v-a ELSE c-v END) ELSE 0.0 END AS s FROM n)
SELECT 2*i+f AS i, round(v + 0.5*f*s, 6) AS v FROM s, (SELECT unnest([0, 1]) AS f)""")
def prolong_tvd(spark, sf_dir):
    return transfer.prolong_tvd(line(spark, sf_dir), "i", []).select("i", F.round("v", 6).alias("v"))


_ENO = "CASE WHEN abs(l) < abs(r) THEN (-a+6*v+3*c)/8 ELSE (3*v+6*c-d)/8 END"


@register("prolong_eno", f"""
WITH n AS ({_NEAR}), s AS (SELECT *, a+c-2*v AS l, v+d-2*c AS r FROM n), e AS (SELECT *, {_ENO} AS e FROM s)
SELECT 2*i AS i, round(v, 6) AS v FROM n UNION ALL
SELECT 2*i+1, round(CASE WHEN (e-v)*(c-e) < 0 OR l*r <= 0 THEN (v+c)/2 ELSE e END, 6) FROM e WHERE pi = i-1 AND mi = i+2""")
def prolong_eno(spark, sf_dir):
    return transfer.prolong_eno(line(spark, sf_dir), "i", []).select("i", F.round("v", 6).alias("v"))


@register("prolong_monotone", f"""
WITH n AS ({_NEAR}), e AS (SELECT *, (-a+9*v+9*c-d)/16 AS e FROM n)
SELECT 2*i AS i, round(v, 6) AS v FROM n UNION ALL
SELECT 2*i+1, round(CASE WHEN e BETWEEN least(v, c) AND greatest(v, c) THEN e ELSE (v+c)/2 END, 6) FROM e WHERE pi = i-1 AND mi = i+2""")
def prolong_monotone(spark, sf_dir):
    return transfer.prolong_monotone(line(spark, sf_dir), "i", []).select("i", F.round("v", 6).alias("v"))


# --- Time levels -------------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")


def _time_sql(n: int) -> str:
    terms = []
    for i in range(n):
        ws = "*".join(f"((q - t{j})/(t{i} - t{j}))" for j in range(n) if j != i)
        terms.append(f"({ws})*v{i}")
    cols = ", ".join(f"max(t) FILTER (WHERE tl={k}) AS t{k}, max(value) FILTER (WHERE tl={k}) AS v{k}" for k in range(n))
    return f"""WITH e AS (SELECT user_id, epoch_us(ts)/1e9 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS tl FROM events),
p AS (SELECT user_id, {cols} FROM e WHERE tl < {n} GROUP BY user_id HAVING count(*) = {n}), q AS (SELECT *, t0 - 0.25*(t0 - t1) AS q FROM p)
SELECT user_id, round({" + ".join(terms)}, 3) AS value FROM q"""


def _time(n: int):
    def run(spark, sf_dir):
        d = _events(spark, sf_dir).withColumn("t", F.col("us") / 1e9)
        at = F.col("p")[0]["t"] - 0.25 * (F.col("p")[0]["t"] - F.col("p")[1]["t"])
        return transfer.time_interpolate(d, ["user_id"], "t", "value", at, n).withColumn("value", F.round("value", 3))

    return run


for _n in (2, 3, 4):
    register(f"time_interp_{_n}", _time_sql(_n))(_time(_n))

_LEVELS_SQL = "(SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS tl FROM events)"


def _rotated(rule: Callable[[Column, int], Column]):
    return lambda s, d: levels.newest(read(s, d, "events").select("user_id", "ts", "value"), ["user_id"], "ts", 3).select("user_id", "value", rule(F.col("tl"), 3).cast("long").alias("tl"))


register("cycle_levels", f"SELECT user_id, value, ((tl+1)%3)::BIGINT AS tl FROM {_LEVELS_SQL} WHERE tl < 3")(_rotated(levels.cycle))
register("uncycle_levels", f"SELECT user_id, value, ((tl+2)%3)::BIGINT AS tl FROM {_LEVELS_SQL} WHERE tl < 3")(_rotated(levels.uncycle))
register("flip_levels", f"SELECT user_id, value, (CASE WHEN tl = 0 THEN 0 ELSE 3-tl END)::BIGINT AS tl FROM {_LEVELS_SQL} WHERE tl < 3")(_rotated(levels.flip))
register("fill_levels", f"SELECT user_id, value, k::BIGINT AS tl FROM {_LEVELS_SQL}, (SELECT unnest([0, 1, 2]) AS k) WHERE tl = 0")(lambda s, d: levels.fill(levels.newest(read(s, d, "events").select("user_id", "ts", "value"), ["user_id"], "ts", 3), 3).select("user_id", "value", F.col("tl").cast("long").alias("tl")))
register("cadence_divisor", "SELECT event_id, user_id FROM events WHERE event_id % 7 = 0")(lambda s, d: read(s, d, "events").where(levels.cadence_divisor(F.col("event_id"), 7)).select("event_id", "user_id"))
register("level_due", "SELECT o_orderkey % 8 AS it, (o_orderkey % 8 - 1) % 4 = 0 AS l0, (o_orderkey % 8 - 1) % 2 = 0 AS l1, true AS l2, count(*) AS n FROM orders WHERE o_orderkey % 8 > 0 GROUP BY ALL")(
    lambda s, d: read(s, d, "orders").withColumn("it", F.col("o_orderkey") % 8).where("it > 0").groupBy("it", *[levels.due(F.col("it"), F.lit(k), 2).alias(f"l{k}") for k in range(3)]).agg(F.count(F.lit(1)).alias("n"))
)


@register("cadence_time", """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), o(user_id, t) AS (
  SELECT user_id, min(t) FROM e GROUP BY user_id UNION ALL
  SELECT user_id, t FROM (SELECT o.user_id, min(e.t) AS t FROM o JOIN e ON e.user_id = o.user_id AND e.t >= o.t + 864000000000 GROUP BY o.user_id, o.t))
SELECT user_id, t FROM o""")
def cadence_time(spark, sf_dir):
    out = levels.cadence_greedy(_events(spark, sf_dir), ["user_id"], "us", 864e9)
    return out.select("user_id", F.col("us").cast("long").alias("t"))


# --- Masks and weights ---------------------------------------------------------------------------------

register("mask_popcount", "SELECT l_orderkey % 256 AS mask, bit_count((l_orderkey % 256)::INT)/8.0::DOUBLE AS weight, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, d: read(s, d, "lineitem").groupBy((F.col("l_orderkey") % 256).alias("mask")).agg(F.count(F.lit(1)).alias("n")).select("mask", weights.weight(F.col("mask")).alias("weight"), "n")
)


@register("mask_volume", f"SELECT sum(CASE WHEN i IN (2, 13) THEN 0.5 WHEN i BETWEEN 3 AND 12 THEN 1.0 ELSE 0.0 END * CASE WHEN j IN (1, 14) THEN 0.5 WHEN j BETWEEN 2 AND 13 THEN 1.0 ELSE 0.0 END)::DOUBLE AS volume, count(*) AS n FROM {LATTICE_SQL}")
def mask_volume(spark, sf_dir):
    """Weights of the boundary mask add up to the volume between the outer faces."""
    m = weights.boundary_mask([F.col("i"), F.col("j")], [F.lit(2), F.lit(1)], [F.lit(13), F.lit(14)])
    return lattice(spark, sf_dir).agg(F.sum(weights.weight(m, 2)).alias("volume"), F.count(F.lit(1)).alias("n"))


@register("excise_sphere", "SELECT label, count(*) FILTER (WHERE pow(round(embedding[1]::DOUBLE, 3), 2) + pow(round(embedding[2]::DOUBLE, 3), 2) > 0.01) AS kept, count(*) AS n FROM embeddings GROUP BY label")
def excise_sphere(spark, sf_dir):
    """Points without a place have no weight."""
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    d = weights.excise_spheres(_points(spark, sf_dir).withColumn("w", F.when(placed, 1.0).otherwise(0.0)), ["x", "y"], [([0.0, 0.0], 0.01)], "w", squared=True)
    return d.groupBy("label").agg(F.sum("w").cast("long").alias("kept"), F.count(F.lit(1)).alias("n"))


@register("evolution_mask", f"WITH f AS {SET_A}, p AS (SELECT i//2 AS i, j//2 AS j FROM f GROUP BY 1, 2 HAVING count(*) = 4) SELECT c.i, c.j, CASE WHEN p.i IS NULL THEN 1 ELSE 0 END AS mask FROM (SELECT DISTINCT i//2 AS i, j//2 AS j FROM {SET_B}) c LEFT JOIN p ON c.i = p.i AND c.j = p.j")
def evolution_mask(spark, sf_dir):
    fine, other = _sets(spark, sf_dir)
    half = lambda a: F.floor(F.col(a) / 2).cast("long").alias(a)
    return weights.evolution_mask(other.select(half("i"), half("j")).distinct(), fine, ["i", "j"])


# --- Slabs ------------------------------------------------------------------------------------------------


@register("slab_stride", f"SELECT a AS s0, b AS s1, coalesce(v, 0)::DOUBLE AS v FROM (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(0, 5)) AS b) LEFT JOIN {LATTICE_SQL} ON i = 1 + 2*a AND j = 3*b")
def slab_stride(spark, sf_dir):
    return slabs.hyperslab(lattice(spark, sf_dir), ["i", "j"], slabs.Slab((1, 0), ((1, 0), (0, 1)), (2, 3), (6, 5))).select(F.col("s0").cast("long").alias("s0"), F.col("s1").cast("long").alias("s1"), "v")


register("slice_plane", f"SELECT i, j, v FROM {LATTICE_SQL} WHERE j = 3")(lambda s, d: slabs.plane(lattice(s, d), {"j": 3}))
register("slice_diagonal", f"SELECT i, j, v FROM {LATTICE_SQL} WHERE i = j")(lambda s, d: slabs.diagonal(lattice(s, d), ["i", "j"]))


# --- Regridding ---------------------------------------------------------------------------------------------


@register("block_flagging", f"SELECT (i//4)*4 AS i_lo, (j//4)*4 AS j_lo, (i//4)*4+3 AS i_hi, (j//4)*4+3 AS j_hi FROM {LATTICE_SQL} WHERE v > (SELECT avg(v) * 1.1 FROM {LATTICE_SQL}) GROUP BY i//4, j//4")
def block_flagging(spark, sf_dir):
    g = lattice(spark, sf_dir)
    g = g.join(F.broadcast(g.agg((F.avg("v") * 1.1).alias("m"))))  # one row
    return regrid.flag_blocks(g, ["i", "j"], regrid.finite(F.col("v")) & (F.col("v") > F.col("m")), 4)


@register("signature_1d", f"""
WITH s AS (SELECT i, sum((j % 3 = 0)::INT)::BIGINT AS s FROM {SET_A} GROUP BY i),
d AS (SELECT i, s, coalesce(lag(s) OVER w - 2*s + lead(s) OVER w, 0) AS d2 FROM s WINDOW w AS (ORDER BY i))
SELECT i, s, d2, CASE WHEN d2 * lead(d2) OVER (ORDER BY i) < 0 THEN abs(lead(d2) OVER (ORDER BY i) - d2) ELSE 0 END AS jump FROM d""")
def signature_1d(spark, sf_dir):
    return regrid.signature(_sets(spark, sf_dir)[0], "i", F.col("j") % 3 == 0)


@register("cluster_holes", f"WITH s AS (SELECT i, sum((j < 1)::INT)::BIGINT AS s FROM {SET_A} GROUP BY i) SELECT min(i) AS hole FROM s WHERE s = 0 AND i >= (SELECT min(i) FROM s) + 2 AND i <= (SELECT max(i) FROM s) - 2")
def cluster_holes(spark, sf_dir):
    return regrid.first_hole(regrid.signature(_sets(spark, sf_dir)[0], "i", F.col("j") < 1), "i", 2)


@register("regrid_boxes", f"SELECT DISTINCT greatest(x_lo - 2 - (x_lo - 2 + 400) % 4, 0) AS x_lo, least(x_hi + 2 + (3 - (x_hi + 2)) % 4 + CASE WHEN (3 - (x_hi + 2)) % 4 < 0 THEN 4 ELSE 0 END, 95) AS x_hi FROM {BOX_SQL}")
def regrid_boxes(spark, sf_dir):
    """Buffers, granularity, clipping."""
    b = part_boxes(spark, sf_dir).select("x_lo", "x_hi")
    return regrid.clip(regrid.granulate(regrid.add_buffers(b, ["x"], 2), ["x"], 4), ["x"], 0, 95).distinct()


@register("regrid_symmetry", f"SELECT x_lo, x_hi FROM {BOX_SQL} UNION SELECT -x_hi, -x_lo FROM {BOX_SQL}")
def regrid_symmetry(spark, sf_dir):
    return regrid.reflect(part_boxes(spark, sf_dir).select("x_lo", "x_hi"), "x")




# --- Movement and checks ------------------------------------------------------------------------------------


@register("periodic_wrap", f"SELECT i, j, v FROM {LATTICE_SQL} UNION ALL SELECT g.i, l.j, l.v FROM {LATTICE_SQL} l JOIN (SELECT unnest([-3, -2, -1, 16, 17, 18]) AS i) g ON ((g.i % 16) + 16) % 16 = l.i")
def periodic_wrap(spark, sf_dir):
    return sync.periodic(lattice(spark, sf_dir), "i", 16, 3, ["j"], "v").select("i", "j", "v")


@register("sync_ghosts", f"SELECT i, j, CASE WHEN k = 0 THEN v ELSE coalesce(o, -1) END AS v, k FROM (SELECT l.i, l.j, l.v, k.k, m.v AS o FROM {LATTICE_SQL} l, (SELECT unnest([0, 1]) AS k) k LEFT JOIN {LATTICE_SQL} m ON l.i = m.i AND l.j = m.j)")
def sync_ghosts(spark, sf_dir):
    g = lattice(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.when(F.col("k") == 1, F.lit(-1.0)).otherwise(F.col("v")))
    return sync.sync(g, ["i", "j"], "v", F.col("k") == 1).select("i", "j", "v", "k")


@register("recompose_fill", f"WITH c AS (SELECT i//2 AS i, avg(v) AS v FROM {LINE_SQL} GROUP BY 1), p AS (SELECT 2*i+f AS i, v FROM c, (SELECT unnest([0, 1]) AS f)) SELECT p.i, round(coalesce(o.v, p.v), 6) AS v FROM p LEFT JOIN (SELECT * FROM {LINE_SQL} WHERE i < 20) o ON p.i = o.i")
def recompose_fill(spark, sf_dir):
    g = line(spark, sf_dir)
    coarse = g.groupBy(F.floor(F.col("i") / 2).cast("long").alias("i")).agg(F.avg("v").alias("v"))
    return sync.recompose(g.where("i < 20"), transfer.prolong_cell(coarse, ["i"], 0), ["i"], "v").select("i", F.round("v", 6).alias("v"))


register("poison_count", "SELECT count(*) FILTER (WHERE l_discount = 0.05) AS l_discount, count(*) FILTER (WHERE l_tax = 0.05) AS l_tax FROM lineitem")(lambda s, d: sync.poison_count(read(s, d, "lineitem"), ["l_discount", "l_tax"], 0.05))
register("load_balance", "WITH p AS (SELECT l_suppkey % 8 AS k, sum(l_quantity) AS load FROM lineitem GROUP BY 1) SELECT max(load) AS busiest, round(avg(load), 4) AS mean, round(max(load) - avg(load), 4) AS imbalance FROM p")(
    lambda s, d: sync.imbalance(read(s, d, "lineitem").withColumn("k", F.col("l_suppkey") % 8), "k", F.col("l_quantity")).select("busiest", F.round("mean", 4).alias("mean"), F.round("imbalance", 4).alias("imbalance"))
)
register("validity", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity IS NULL OR l_quantity < 0) AS bad, count(*) AS n, count(*) FILTER (WHERE l_discount <> 0) AS weighted FROM lineitem GROUP BY 1")(
    lambda s, d: read(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity").isNull() | (F.col("l_quantity") < 0)).alias("bad"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") != 0).alias("weighted"))
)


@register("checksum16", "WITH s AS (SELECT user_id, sum(event_id % 65536)::BIGINT AS t FROM events GROUP BY 1), f AS (SELECT user_id, (t >> 16) + (t & 65535) AS t FROM s), g AS (SELECT user_id, (t >> 16) + (t & 65535) AS t FROM f) SELECT user_id, 65535 - ((t >> 16) + (t & 65535)) AS c FROM g")
def checksum16(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("event_id") % 65536).alias("t")).select("user_id", scalars.ones_complement16(F.col("t")).alias("c"))


@register("index_rounding", "SELECT l_partkey, l_suppkey, l_linenumber, floor(l_quantity/4 + 0.5)::BIGINT AS half_up, floor(l_quantity/4 + 0.75)::BIGINT AS slice, floor((l_quantity - 1)/8)::BIGINT AS block FROM lineitem")
def index_rounding(spark, sf_dir):
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", scalars.index_half_up(q / 4).alias("half_up"), scalars.index_slice(q / 4).alias("slice"), scalars.index_block(q, 1.0, 8).alias("block"))
