import glob

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.functions import stencils
from lattika.functions.reductions import REDUCTIONS, reduction
from lattika.operators import boxes, regrid, sync, transfer
from lattika.queries import ORACLES, QUERIES
from lattika.sources import datasets, text

DATA = "/root/testdata/sf0.001"
SAMPLE = ["reduce_average", "reduce_inorm2", "reduce_levels", "box_xor", "box_overlap_join", "locate_finest", "interp_points", "prolong_o3", "prolong_eno", "restrict_cell_o3", "time_interp_3", "cadence_time", "slab_stride", "periodic_wrap", "block_flagging"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(cols).collect())
    want = sorted(str(r) for r in duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
    assert got == want


def test_reduction_edges(spark):
    d = spark.createDataFrame([("a", 1.0, 0.0), ("b", float("nan"), 1.0), ("b", 2.0, 1.0), ("c", -3.0, -1.0), ("c", 2.0, 0.5)], "k string, x double, w double")
    r = {x.k: x for x in d.groupBy("k").agg(*[reduction(n, "x", "w").alias(n) for n in REDUCTIONS]).collect()}
    assert r["a"]["minimum"] > 1e308 and r["a"]["maximum"] < -1e308 and r["a"]["product"] == 1 and r["a"]["average"] == 0
    assert np.isnan(r["b"]["minimum"]) and np.isnan(r["b"]["maximum"])
    assert r["c"]["sum"] == 4 and r["c"]["count"] == -0.5 and r["c"]["norm_inf"] == 3


@pytest.mark.parametrize("order", [1, 3, 5])
def test_prolongation_is_exact_for_polynomials(spark, order):
    rows = [(i, float(i**order - 2 * i)) for i in range(-12, 13)]
    out = transfer.prolong_vertex(spark.createDataFrame(rows, "i long, v double"), ["i"], order).collect()
    assert out and all(abs(r.v - ((r.i / 2) ** order - r.i)) < 1e-6 * max(1, abs(r.v)) for r in out)


def test_stencils_reproduce_monomials():
    for order in range(6):
        for parity in (0, 1):
            for n in range(order + 1):
                assert sum(w * (o + 0.5) ** n for o, w in stencils.cell(order, parity)) == pytest.approx((0.25 + parity / 2) ** n)
    assert stencils.derivative_weights([2.0, 1.0, 0.0], 1.0, 2) == [1.0, -2.0, 1.0]
    with pytest.raises(ValueError):
        stencils.time_weights([1.0, 1.0], 1.0)


def test_set_identities(spark):
    a = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if (i * j) % 3], "i long, j long")
    b = spark.createDataFrame([(i, j) for i in range(3, 9) for j in range(4)], "i long, j long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(boxes.union(boxes.minus(a, b), boxes.intersect(a, b))) == rows(a)
    assert rows(boxes.symmetric_difference(a, b)) == rows(boxes.minus(boxes.union(a, b), boxes.intersect(a, b)))
    n = boxes.normalise(a, "i", "j").agg(F.sum((F.col("i_hi") - F.col("i_lo") + 1) * (F.col("j_hi") - F.col("j_lo") + 1))).first()[0]
    assert n == a.count()


def test_clustering_covers(spark):
    pts = [(i, j) for i in range(4) for j in range(4)] + [(i, j) for i in range(10, 14) for j in range(9, 15)]
    got = regrid.cluster(spark.createDataFrame(pts, "i long, j long"), ["i", "j"], 0.9)
    assert all(any(b["i_lo"] <= i <= b["i_hi"] and b["j_lo"] <= j <= b["j_hi"] for b in got) for i, j in pts) and len(got) == 2


def test_validity_and_balance():
    v = sync.Validity()
    v.writes(("u", 0), sync.Validity.INTERIOR)
    assert v.needs(("u", 0), 7) == 6
    v.syncs(("u", 0))
    assert v.needs(("u", 0), 3) == 0
    assert sorted(sync.assign_greedy([("a", 5), ("b", 3), ("c", 2)], 2).values()) == [0, 1, 1]


def test_sources_round_trip(spark, tmp_path):
    rows = [(0, 0, 0, 0, 0, i, 0, 0, 0.5, i / 2, 0.0, 0.0, i * 1.25) for i in range(4)]
    d = spark.createDataFrame(rows, "it int, tl int, rl int, c int, ml int, ix int, iy int, iz int, time double, x double, y double, z double, u double")
    text.write_slices(d, f"{tmp_path}/s", ["u"])
    assert sorted(map(tuple, text.read_slices(spark, f"{tmp_path}/s", ["u"]).collect())) == rows
    name = datasets.DatasetName("wave::phi", 4, 0, None, None, 1, 2)
    assert datasets.DatasetName.parse(str(name)) == name
    datasets.write_checkpoint(spark, f"{tmp_path}/c", 8, {"grid": d}, {"dx": 0.5})
    it, parameters, tables = datasets.recover(spark, f"{tmp_path}/c")
    assert (it, parameters, tables["grid"].count()) == (8, {"dx": 0.5}, 4)
