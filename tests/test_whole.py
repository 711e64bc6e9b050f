"""Queries over whole tables against brute force."""

import math
from collections import Counter

import duckdb
import pytest

from lattika.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.collect()))


def part_boxes(spark):
    out = []
    for r in spark.read.parquet(f"{DATA}/part.parquet").collect():
        k, s = r.p_partkey, r.p_size
        out.append((k % 97, k % 97 + s % 7, k % 53, k % 53 + s % 5))
    return out


def test_box_points_whole(spark):
    want = {(x, y) for a, b, c, d in part_boxes(spark) for x in range(a, b + 1) for y in range(c, d + 1)}
    assert rows(QUERIES["box_points"](spark, DATA).select("x", "y")) == Counter(want)


def test_regrid_whole(spark):
    found = {(max((a - 2) // 4 * 4, 0), min((b + 2) // 4 * 4 + 3, 95)) for a, b, _, _ in part_boxes(spark)}
    assert rows(QUERIES["regrid_boxes"](spark, DATA).select("x_lo", "x_hi")) == Counter(found)
    both = {p for a, b, _, _ in part_boxes(spark) for p in ((a, b), (-b, -a))}
    assert rows(QUERIES["regrid_symmetry"](spark, DATA).select("x_lo", "x_hi")) == Counter(both)


def test_index_rounding_whole(spark):
    want = Counter()
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect():
        q = r.l_quantity
        want[r.l_partkey, r.l_suppkey, r.l_linenumber, math.floor(q / 4 + 0.5), math.floor(q / 4 + 0.75), math.floor((q - 1) / 8)] += 1
    assert rows(QUERIES["index_rounding"](spark, DATA).select("l_partkey", "l_suppkey", "l_linenumber", "half_up", "slice", "block")) == want


EDGE = [([s * x, t * y], 0) for x, y in ((0.0, 0.1), (0.1, 0.0), (0.06, 0.08), (0.096, 0.028)) for s in (1, -1) for t in (1, -1)]
EXCISED = {
    "edge": (EDGE + [([0.099, 0.0], 1), ([0.101, 0.0], 1), ([math.nan, 0.0], 1), ([math.inf, 0.0], 1)], [(0, 8, 16), (1, 3, 4)]),
    "null": ([(None, 2), ([None, 0.5], 2), ([0.5, None], 3), ([0.5, 0.5], 3), ([0.5, 0.5], None)], [(2, 0, 2), (3, 1, 2), (None, 1, 1)]),
    "short": ([([], 4), ([0.5], 4), ([0.5, 0.5], 4)], [(4, 1, 3)]),
}


@pytest.mark.parametrize("kind", EXCISED)
def test_excise_sphere_matches_sql_on_odd_points(spark, tmp_path, kind):
    points, want = EXCISED[kind]
    points = [(k, e, label) for k, (e, label) in enumerate(points)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert Counter(duck.execute(ORACLES["excise_sphere"]).fetchall()) == Counter(want)
    assert rows(QUERIES["excise_sphere"](spark, str(tmp_path)).select("label", "kept", "n")) == Counter(want)
