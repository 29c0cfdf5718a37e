"""Searches over all cells: what moves is bounded by k rows a query and group, and nothing is broadcast."""

from pyspark.sql import functions as F
from test_vectors import DIM, brute, got, rows

from tessera.operators import vectors


def test_groups_of_rows_and_queries_give_the_exact_rows_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_ROWS", 200)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", 4)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    data = rows(900) + [(2000 + i, rows(900)[3][1]) for i in range(150)]
    df = spark.createDataFrame(data, "vec_id long, e array<double>").repartition(3)
    q = df.where("vec_id % 100 = 0")
    found = vectors.nearest(q, df, "vec_id", "e", DIM, 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = brute(data, [r for r in data if r[0] % 100 == 0], 5)
    assert got(found) == want
    path = vectors.temporary(df, "vec_id", "e", DIM, n_cells=12)
    assert got(vectors.search(spark, path, q, "vec_id", "e", DIM, 5, None)) == got(vectors.search_coded(spark, path, q, "vec_id", "e", DIM, 5, None)) == want
    # a group gives five rows a query, not five a cell; with a floor, the codes of a group give fewer than five a cell
    valid = vectors._valid(q.where("vec_id < 2000"), "vec_id", "e", DIM)
    assert vectors._searched(spark, path, valid, 5, True).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 * 6
    floor = spark.createDataFrame([(i, v[4][1]) for i, v in want.items()], "id long, least double")
    assert vectors._may_reach(spark, path, valid.join(floor, "id"), 5, True).count() < 5 * 12 * valid.count() / 2
