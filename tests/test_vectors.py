"""The vector index against brute force: cells, codes, pruning, odd vectors, copies, empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.sources.store import new_path

DIM = 8


def rows(n, seed=1, clusters=12):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 1) for _ in range(DIM)] for _ in range(clusters)]
    out = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.35) for x in mid[i % clusters]]
        size = math.sqrt(sum(x * x for x in v))
        out.append((i, [x / size for x in v]))
    return out


def brute(data, queries, k):
    out = {}
    for q, u in queries:
        s = sorted(((-round(sum(a * b for a, b in zip(u, v)), 6), i) for i, v in data if i != q))[:k]
        out[q] = [(i, -x) for x, i in s]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.fixture(scope="module")
def built(spark):
    data = rows(1500)
    data += [(2000 + i, data[3][1]) for i in range(700)]  # one group of copies
    df = spark.createDataFrame(data, "vec_id long, e array<double>").repartition(5)
    path = new_path(spark, "test-vectors")
    vectors.build(df, path, "vec_id", "e", DIM, n_cells=20)
    return path, data, df


def test_all_cells_give_the_exact_result(spark, built):
    path, data, df = built
    queries = [r for r in data if r[0] % 100 == 0]
    q = df.where("vec_id % 100 = 0")
    want = brute(data, queries, 20)
    assert got(vectors.search(spark, path, q, "vec_id", "e", DIM, 20, None)) == want
    assert got(vectors.search_coded(spark, path, q, "vec_id", "e", DIM, 20, None)) == want


def test_few_cells_recall_and_read_little(spark, built):
    path, data, df = built
    q = df.where("vec_id % 100 = 0 and vec_id < 1500")
    few, every = (vectors.search(spark, path, q, "vec_id", "e", DIM, 20, n) for n in (6, None))
    found = vectors.recall(few, every).collect()
    assert sum(r.hits for r in found) >= 0.9 * sum(r.expected for r in found)
    one = df.where("vec_id = 1")
    asked = vectors.probes(spark, path, one, "vec_id", "e", DIM, 2)
    met = vectors._met(spark, path, asked, ["ids"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "vectors" not in plan.split("ReadSchema")[1][:200]
    assert 0 < met.select("cell").distinct().count() <= 2
    same = got(vectors.search_coded(spark, path, q, "vec_id", "e", DIM, 20, 6))
    assert same == got(few)


def test_codes_leave_few_rows_of_distinct_vectors(spark):
    data = rows(1500, seed=3)
    df = spark.createDataFrame(data, "vec_id long, e array<double>")
    path = vectors.temporary(df, "vec_id", "e", DIM, n_cells=4)
    asked = vectors.probes(spark, path, df.where("vec_id % 100 = 0"), "vec_id", "e", DIM, None)
    share = [r.share for r in vectors.rescored(vectors.candidates(spark, path, asked, 10), 1500).collect()]
    assert len(share) == 15 and max(share) < 0.05


def test_odd_vectors_take_no_part_and_repeated_rows_do(spark):
    nan, inf = float("nan"), float("inf")
    e = [1.0] + [0.0] * 7
    data = [(1, e), (1, e), (2, [0.5] + [0.0] * 7), (3, None), (4, [nan] * 8), (5, [inf] + e[1:]), (6, [1.0]), (7, [None] * 8), (8, [-1.0] + e[1:])]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "vec_id long, e array<double>, cell string, ids int")
    path = vectors.temporary(df, "vec_id", "e", DIM)
    for find in (vectors.search, vectors.search_coded):
        assert got(find(spark, path, df.where("vec_id in (2, 3, 8)"), "vec_id", "e", DIM, 5, None)) == {2: [(1, 0.5), (1, 0.5), (8, -0.5)], 8: [(2, -0.5), (1, -1.0), (1, -1.0)]}


def test_an_empty_table_has_an_empty_index(spark):
    df = spark.createDataFrame([], "vec_id long, e array<double>")
    path = vectors.temporary(df, "vec_id", "e", DIM)
    one = spark.createDataFrame([(1, [1.0] * 8)], "vec_id long, e array<double>")
    assert vectors.search(spark, path, one, "vec_id", "e", DIM, 5, None).count() == 0
    assert vectors.search_coded(spark, path, one, "vec_id", "e", DIM, 5, None).count() == 0


def test_a_sample_is_drawn_from_few_rows_and_is_the_same(spark):
    moved = lambda df: [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "xxhash64" in x]
    for n, ids, few in ((6000, "id", True), (6000, "id * 0", False), (90, "id", False)):
        v = spark.range(n).selectExpr(f"{ids} AS id", "array(double(id)) AS v")
        got = vectors.draw(v, n, 100)
        assert bool(moved(got)) == few
        assert [r.id for r in got.collect()] == [r.id for r in v.selectExpr("id", "v").sort("id").orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert vectors.draw(spark.range(6000).selectExpr("id", "array(double(id)) AS v"), 6000, 100).count() == 100
