"""Operators on small tables: nulls, empty boxes, kernels, masks, regions, metadata classes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattika.functions import scalars
from lattika.functions.reductions import complex_reduction
from lattika.operators import boxes, interp, levels, regrid, slabs, sync, transfer, weights
from lattika.plans import scope
from lattika.plans.timers import Statistics, Timers
from lattika.sources import datasets, text


def line(spark, values, start=0):
    return spark.createDataFrame([(start + i, v) for i, v in enumerate(values)], "i long, v double")


def as_dict(df):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r[-1] for r in df.collect()}


def test_nulls_stay_null_in_transfer(spark):
    d = line(spark, [10.0, None, 30.0])
    assert as_dict(transfer.prolong_vertex(d, ["i"], 1)) == {0: 10.0, 1: None, 2: None, 3: None, 4: 30.0}
    assert as_dict(transfer.restrict_mean(line(spark, [10.0, None, 1.0, 3.0]), ["i"])) == {0: None, 1: 2.0}
    with pytest.raises(TypeError):
        transfer.prolong_vertex(spark.createDataFrame([(0, 1)], "i long, v long"), ["i"], 1)


def test_nulls_in_one_variable(spark):
    grid = spark.createDataFrame([(0, 1.0, None), (1, 3.0, 5.0)], "i long, v double, u double")
    pts = spark.createDataFrame([(1, 0.5), (2, 0.75), (3, 4.0)], "point_id long, i double")
    got = {r.point_id: (r.v, r.u, r.status) for r in interp.apply(interp.plan(pts, ["i"], 1), grid, ["i"], ["v", "u"], 1).collect()}
    assert got == {1: (2.0, None, 0), 2: (2.5, None, 0), 3: (None, None, -1)}


def test_complex_reductions(spark):
    d = spark.createDataFrame([("a", 0.0, 1.0, 1.0), ("a", 0.0, 1.0, 1.0), ("b", 3.0, 4.0, 0.0), ("c", 0.0, 0.0, 1.0)], "k string, re double, im double, w double")
    c = lambda n: complex_reduction(n, F.col("re"), F.col("im"), F.col("w")).alias(n)
    got = {r.k: r for r in d.groupBy("k").agg(c("product"), c("count"), c("norm2"), c("sum_squared")).collect()}
    assert got["a"]["product"].re == pytest.approx(-1) and got["a"]["product"].im == pytest.approx(0)
    assert tuple(got["a"]["count"]) == (2.0, 0.0) and tuple(got["a"].sum_squared) == (-2.0, 0.0)
    assert tuple(got["b"].norm2) == (0.0, 0.0) and tuple(got["b"]["product"]) == (1.0, 0.0) and got["c"]["product"].re == 0


def test_hull_and_restride_of_empty_boxes(spark):
    d = spark.createDataFrame([(1, 0, 3), (1, 10, 5), (2, 9, 2)], "k int, x_lo int, x_hi int")
    assert {r.k: (r.x_lo, r.x_hi) for r in boxes.hull(d, ["k"], ["x"]).collect()} == {1: (0, 3), 2: (1, 0)}
    for f in (boxes.expanded_for, boxes.contracted_for, boxes.anti_contracted_for):
        lo, hi = f(F.col("x_lo"), F.col("x_hi"), 4)
        assert all(r.x_lo == r.lo and r.x_hi == r.hi for r in d.where("x_lo > x_hi").select("*", lo.alias("lo"), hi.alias("hi")).collect())


def test_set_operators(spark):
    a = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "i int, j int")
    b = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (5, 5)], "i int, j int")
    assert boxes.is_proper_subset(a, b) and not boxes.is_proper_subset(b, b) and boxes.is_equal(a, a.union(a)) and not boxes.is_equal(a, b)
    assert boxes.meets(a, b) and boxes.has_point(b, {"i": 5, "j": 5}) and not boxes.has_point(a, {"i": 5, "j": 5})
    with pytest.raises(Exception, match="not disjoint"):
        boxes.disjoint_union(a, b).collect()


def test_kernels_are_exact_for_polynomials(spark):
    rows = [(i, j, 2.0 * i - 3.0 * j) for i in range(-6, 7) for j in range(-6, 7)]
    plane = spark.createDataFrame(rows, "i long, j long, v double")
    for fine, shift in ((transfer.prolong_tvd_vertex(plane, ["i", "j"]), 0.0), (transfer.prolong_tvd_cell(plane, ["i", "j"]), 0.25), (transfer.prolong_monotone5(plane, ["i", "j"]), 0.0), (transfer.prolong_eno_cell(plane, ["i", "j"]), 0.25)):
        got = fine.collect()
        assert len(got) > 100 and all(abs(r.v - (2 * (r.i / 2 - shift) - 3 * (r.j / 2 - shift))) < 1e-9 for r in got)
    square = line(spark, [float(i * i) for i in range(-9, 10)], -9)
    mean = lambda c: c * c + 1 / 12 * 0
    got = transfer.prolong_eno_cell(square.withColumn("v", (F.col("i") + 0.5) * (F.col("i") + 0.5)), ["i"]).collect()
    assert got and all(abs(r.v - mean((r.i + 0.5) / 2)) < 1e-9 for r in got)
    jump = line(spark, [0.0] * 8 + [1.0] * 8)
    assert all(0 <= r.v <= 1 for r in transfer.prolong_monotone5(jump, ["i"]).collect())
    assert any(not 0 <= r.v <= 1 for r in transfer.prolong_vertex(jump, ["i"], 5).collect())


def test_time_interpolation_eno(spark):
    d = spark.createDataFrame([(0.5,), (1.5,)], "t double")
    p = [(F.lit(2.0), F.lit(4.0)), (F.lit(1.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0))]
    got = [r[0] for r in d.select(transfer.time_interpolate_eno(*p, F.col("t"))).collect()]
    assert got == pytest.approx([0.25, 2.25])


def test_refinement_mask_in_three_dimensions(spark):
    n = 6
    grid = spark.createDataFrame([(x, y, z) for x in range(n + 1) for y in range(n + 1) for z in range(n + 1)], "x long, y long, z long")
    axes, lo, hi = ["x", "y", "z"], [F.lit(0)] * 3, [F.lit(n)] * 3
    r = spark.createDataFrame([(1, 4, 2, 4, 1, 3), (3, 5, 3, 5, 2, 5)], "x_lo int, x_hi int, y_lo int, y_hi int, z_lo int, z_hi int")
    inside = {(x, y, z) for b in r.collect() for x in range(b[0], b[1]) for y in range(b[2], b[3]) for z in range(b[4], b[5])}
    c = weights.refinement_mask(grid.withColumn("iweight", weights.boundary_mask([F.col(a) for a in axes], lo, hi)), r, axes, 2, covered=True)
    assert c.agg(F.sum(weights.weight(F.col("iweight")))).first()[0] == n**3 - len(inside)
    f = r.select(*[(2 * F.col(k)).alias(k) for k in r.columns])
    p = weights.refinement_mask(boxes.points(f, axes).withColumn("iweight", F.lit(255)), f, axes, 3, covered=False)
    assert p.agg(F.sum(weights.weight(F.col("iweight")) / 8)).first()[0] == len(inside)


def test_bisection_against_recursion(spark):
    rng = random.Random(2)
    pts = {(rng.randrange(20), rng.randrange(10)) for _ in range(40)} | {(i, j) for i in range(4, 9) for j in range(5)}

    def cut(lo, hi):
        inside = [p for p in pts if all(a <= x <= b for x, a, b in zip(p, lo, hi, strict=True))]
        size = [b - a + 1 for a, b in zip(lo, hi, strict=True)]
        if not inside:
            return set()
        if len(inside) >= 0.5 * size[0] * size[1]:
            return {(*lo, *hi)}
        a = max((0, 1), key=lambda x: size[x])
        if size[a] < 4:
            return {(*lo, *hi)}
        mid = (lo[a] + hi[a] + 1) // 2
        up, down = list(lo), list(hi)
        up[a], down[a] = mid, mid - 1
        return cut(lo, down) | cut(up, hi)

    got = regrid.bisect(spark.createDataFrame(sorted(pts), "i int, j int"), ["i", "j"], {"i": (0, 15), "j": (0, 7)}, F.lit(True), 0.5, 2)
    pts = {p for p in pts if p[0] < 16 and p[1] < 8}
    assert {(r.i_lo, r.j_lo, r.i_hi, r.j_hi) for r in got.collect()} == cut([0, 0], [15, 7])


def test_cluster_and_fixpoint(spark):
    flags = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)] + [(i, j) for i in range(10, 13) for j in range(2)], "i int, j int")
    got = regrid.cluster(flags, ["i", "j"], 0.9, 1)
    assert {tuple(sorted(b.items())) for b in got} == {tuple(sorted(b.items())) for b in ({"i_lo": 0, "i_hi": 3, "j_lo": 0, "j_hi": 3}, {"i_lo": 10, "i_hi": 12, "j_lo": 0, "j_hi": 1})}
    b = spark.createDataFrame([(1, 3)], "x_lo int, x_hi int")
    grow = [lambda d: regrid.reflect(d, "x"), lambda d: regrid.granulate(d, ["x"], 4)]
    out = regrid.fixpoint(b, [*grow, lambda d: regrid.clip(d, ["x"], -8, 7)])
    found = {(r.x_lo, r.x_hi) for r in out.collect()}
    assert (0, 3) in found and (-8, 7) in found and all(lo % 4 == 0 and hi % 4 == 3 for lo, hi in found)
    with pytest.raises(RuntimeError):
        regrid.fixpoint(b, grow, rounds=4)


def test_excise_surface(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 0.0, 0.0, 2.0), (3, 0.0, 0.0, 0.0)], "id int, x double, y double, z double").withColumn("w", F.lit(1.0))
    table = spark.createDataFrame([(a, b, 1.0) for a in range(4) for b in range(8)], "a int, b int, radius double")
    assert {r.id: r.w for r in weights.excise_surface(pts, table, "x", "y", "z", 4, 8, 1.0, "w").collect()} == {1: 0.0, 2: 1.0, 3: 0.0}


def test_metadata_classes(spark):
    v = sync.Validity()
    v.writes(("u", 0), sync.Validity.INTERIOR)
    assert v.needs(("u", 0), sync.Validity.EVERYWHERE) == 6
    v.syncs(("u", 0))
    v.cycles("u", 3)
    assert v.needs(("u", 1), 3) == 0 and v.needs(("u", 0), 1) == 1
    with pytest.raises(ValueError):
        v.syncs(("u", 0))
    r = sync.Requirements()
    r.run("init", [], [("u", "interior"), ("u", "ghosts")])
    r.run("use", [("u", "ghosts")], [("u", "interior")])
    with pytest.raises(ValueError, match="ghosts"):
        r.run("again", [("u", "ghosts")], [])
    s = sync.Storage({"wave": ["phi"], "mask": ["w"]})
    assert s.enable("wave", 3) == 0 and s.enable("wave", 2) == 3 and s.query("wave") == 3
    s.disable("wave", 2)
    held = s.held(spark.createDataFrame([("wave", 0), ("wave", 2), ("mask", 0)], "group string, tl int"))
    assert [tuple(x) for x in held.collect()] == [("wave", 0)]
    parts = sync.split_largest([("a", 10.0), ("b", 1.0), ("c", 1.0)], 4, 1.0)
    assert sum(x for _, x in parts) == 12 and max(x for _, x in parts) <= 3
    load = {}
    for k, w in sync.assign_greedy(parts, 4).items():
        load[w] = load.get(w, 0) + dict(parts)[k]
    assert max(load.values()) - min(load.values()) <= 2.5


def test_variables_timers_and_statistics():
    known = ["wave::phi", "wave::phit", "mask::w"]
    assert set(scalars.select_variables("wave::phi{out_every=4} mask", known)) == {"wave::phi", "mask::w"}
    assert scalars.select_variables("wave{a='x y' b=2}", known)["wave::phit"] == {"a": "x y", "b": "2"} and len(scalars.select_variables("all", known)) == 3
    with pytest.raises(KeyError):
        scalars.select_variables("nothing", known)
    now = iter(range(100))
    t = Timers(lambda: next(now))
    with t.timed("evolve"), t.timed("sync"):
        pass
    assert t.table() == [("evolve", 1, 3, 2), ("evolve/sync", 1, 1, 1)]
    s = Statistics()
    for x in (4.0, 6.0):
        s.add("rows", x)
        s.add("seconds", 2.0)
    assert s.rate("rows", "seconds") == 2.5 and s.rows["rows"] == [2, 10.0, 4.0, 6.0] and s.rate("rows", "none") == 0


def test_sources_fail_on_odd_input(spark, tmp_path):
    (tmp_path / "a.asc").write_text("# it time v\n1 0.5 2.0\n\n2 1.0 3.0\n")
    assert [tuple(r) for r in text.read_scalars(spark, str(tmp_path / "a.asc"), ["v"]).collect()] == [(1, 0.5, 2.0), (2, 1.0, 3.0)]
    (tmp_path / "b.asc").write_text("1 0.5\n")
    with pytest.raises(Exception, match="not 3 columns"):
        text.read_scalars(spark, str(tmp_path / "b.asc"), ["v"]).collect()
    d = spark.createDataFrame([(0, 0, 1.0)], "rl int, i int, v double")
    for var in ("phi", "phit"):
        datasets.write_grid(d, str(tmp_path / "grid"), var, 1)
    assert datasets.read_grid(spark, str(tmp_path / "grid"), "phi").count() == 1
    assert datasets.recover(spark, str(tmp_path / "none")) is None
    at = datasets.write_checkpoint(spark, str(tmp_path / "cp"), 4, {"u": d}, {"dt": 0.5})
    it, params, tables = datasets.recover(spark, str(tmp_path / "cp"))
    assert at.endswith("it=4") and it == 4 and params == {"dt": 0.5} and tables["u"].count() == 1
    runs = [spark.createDataFrame([(it, x) for it in its], "it int, x int") for x, its in ((1, [0, 1, 2, 3]), (2, [2, 3, 4, 4]))]
    assert sorted((r.it, r.x) for r in text.merge_restarts(*runs, keys=[]).collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)]
    screen = text.screen_table(spark.createDataFrame([(1, 1e-9), (2, 0.5)], "it int, v double"), ["it", "v"]).collect()
    assert "1.000000e-09" in screen[0].line and "0.500000" in screen[1].line


def test_evolution_recipe(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    state = spark.createDataFrame([(0, 0.0), (1, 0.0)], "rl int, v double")
    out = scope.evolve(state, lambda rows, it: rows.withColumn("v", F.col("v") + 1), 4, 2)
    assert {r.rl: r.v for r in out.collect()} == {0: 2.0, 1: 4.0}
    due = spark.range(1, 5).select(levels.due(F.col("id"), F.lit(0), 1).alias("d")).collect()
    assert [r.d for r in due] == [True, False, True, False]
    assert slabs.slice_offset(global_coord=0.5, global_index=3, delta=0.25) == 2 and math.isclose(slabs.slice_offset(local_index=7, global_coord=1.0), 7)


def test_regrid_modes(spark):
    from lattika.operators import modes

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(modes.base_level(spark, ["x"])) == []
    assert rows(modes.centre(spark, {"x": (0, 16), "y": (0, 8)}, 3)) == [(1, 8, 24, 4, 12), (2, 24, 40, 12, 20)]
    assert rows(modes.gridpoint_list(spark, ["x"], [[{"x": (1, 5)}, {"x": (8, 9)}], [{"x": (4, 6)}]])) == [(1, 1, 5), (1, 8, 9), (2, 4, 6)]
    assert rows(modes.coordinate_list(spark, ["x"], [[{"x": (-0.5, 0.5)}]], -1.0, 0.1)) == [(1, 10, 30)]
    assert rows(modes.moving(spark, ["x"], [0.0], [1.0], [0.5, 0.25], 0.5, -1.0, 0.5)) == [(1, 4, 8), (2, 10, 14)]
    d = spark.createDataFrame([(0, 2.0), (5, float("nan")), (9, float("inf")), (13, 0.1)], "x long, e double")
    assert rows(modes.automatic(d, ["x"], "e", 1.0, 4)) == [(1, 0, 7)]
    assert modes.same_on_maps(d, 3).count() == 12
    got = modes.gaussian_flags(spark.createDataFrame([(0.0,), (2.0,)], "x double"), ["x"], 1.0, 3.0).collect()
    assert [r.level_mask for r in got] == [3, 0]


def test_hooks(spark):
    from lattika.functions.reductions import reduction
    from lattika.plans.hooks import Schedule, register_reduction, unregister_reduction

    d = spark.createDataFrame([(2.0, 1.0), (5.0, 0.0), (7.0, 2.0)], "x double, w double")
    register_reduction("spread", lambda x, w, strict=False: F.max(F.when(w != 0, x)) - F.min(F.when(w != 0, x)))
    assert d.agg(reduction("spread", "x", "w").alias("a"), reduction("ispread", "x", "w").alias("b")).first() == (5.0, 5.0)
    with pytest.raises(ValueError):
        register_reduction("sum", lambda x, w, strict=False: F.sum(x))
    unregister_reduction("spread")
    s = Schedule()
    s.add("evol", "b", lambda t: {"u": t["u"].withColumn("x", F.col("x") * 2)}, after=("a",))
    s.add("evol", "a", lambda t: {"u": t["u"].withColumn("x", F.col("x") + 1)})
    s.add("evol", "c", lambda t: {}, before=("a",))
    assert s.order("evol") == ["c", "a", "b"] and [r.x for r in s.run("evol", {"u": d})["u"].collect()] == [6.0, 12.0, 16.0]
    s.add("evol", "c", lambda t: {}, after=("b",))
    with pytest.raises(ValueError):
        s.order("evol")


def test_tools(spark):
    from lattika.sources import tools

    d = spark.createDataFrame([(0, 1, 2, 1.0), (1, 1, 2, 5.0), (0, 3, 2, 2.0), (0, 3, 4, 9.0)], "rl int, i int, j int, v double")
    assert sorted(map(tuple, tools.slicer(d, ["i"], {"j": 2}).collect())) == [(1, 1, 5.0), (3, 0, 2.0)]
    chunks = spark.createDataFrame([(1, 0, 1.0), (0, 0, 2.0), (1, 1, 3.0)], "c int, i int, v double")
    assert sorted(map(tuple, tools.recombine(chunks, ["i"]).collect())) == [(0, 2.0), (1, 3.0)]
    text_ = "[ [ ([0,0]:[40,40]:[4,4]) ], [ ([2,4]:[10,12]:[2,2]), ([20,20]:[30,30]:[2,2]) ] ]"
    r = tools.parse_regions(spark, text_, ["x", "y"])
    assert sorted(map(tuple, r.collect()))[1] == (1, 0, 2, 10, 4, 12, 2)
    assert sorted(x.region for x in tools.dump_regions(r, ["x", "y"]).collect()) == sorted(["([0,0]:[40,40]:[4,4])", "([2,4]:[10,12]:[2,2])", "([20,20]:[30,30]:[2,2])"])
    with pytest.raises(ValueError):
        tools.parse_regions(spark, "[ [ ([0]:[4]:[1]) ]", ["x"])
    assert tools.output_options(9, True)["compression"] == "zstd" and tools.output_options(0)["compression"] == "uncompressed"


def test_multigrid_cycle_and_interpolation_of_maps(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = spark.createDataFrame([(i, 1.0, 0.0) for i in range(17)], "i long, b double, v double")
    size = lambda df: transfer.residual(df, ["i"], "b").agg(F.sqrt(F.sum(F.col("residual") ** 2))).first()[0]
    assert size(transfer.two_grid(d, ["i"], "b", coarse=30)) < 0.6 * size(transfer.jacobi(d, ["i"], "b", 12))
    grids = {m: line(spark, [m + 1.0 * i for i in range(4)]).withColumn("u", -F.col("v")) for m in (0, 10)}
    pts = spark.createDataFrame([(1, 0.5, 0), (2, 1.5, 10)], "point_id long, i double, map int")
    got = {r.point_id: (r.out0, r.out1, r.status) for r in interp.interpolate(pts, grids, ["i"], ["v", "u"], operands=[1, 0]).collect()}
    assert got == {1: (-0.5, 0.5, 0), 2: (-11.5, 11.5, 0)}
    assert {r.point_id: r.out0 for r in interp.interpolate(pts, grids, ["i"], ["v"], source_map=0).collect()} == {1: 0.5, 2: 1.5}
