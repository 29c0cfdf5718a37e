"""Queries over the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors
from ..plans.base import query
from ..sources.tables import table

DIM, K = 64, 20
_EXACT = """
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] e FROM embeddings),
s AS (SELECT q.vec_id query_id, c.vec_id id, round(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]), 6) score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM s) WHERE rank <= 20"""


def _index(spark, d, **more):
    v = table(spark, d, "embeddings")
    return vectors.temporary(v, "vec_id", "embedding", DIM, **more), v.where("vec_id % 100 = 0")


@query(_EXACT)
def vector_index_topk(spark, d):
    path, q = _index(spark, d)
    return vectors.search(spark, path, q, "vec_id", "embedding", DIM, K, None)


@query(_EXACT)
def vector_index_coded_topk(spark, d):
    path, q = _index(spark, d)
    return vectors.search_coded(spark, path, q, "vec_id", "embedding", DIM, K, None)


@query()
def vector_index_recall(spark, d):
    """Of the exact twenty best, how many the default number of cells finds; ``tests`` ask for 0.9."""
    path, q = _index(spark, d)
    ask = lambda n: vectors.search(spark, path, q, "vec_id", "embedding", DIM, K, n)
    return vectors.recall(ask(16), ask(None))


@query()
def vector_codes_share(spark, d):
    """How many rows the codes leave to be scored by their components."""
    path, q = _index(spark, d)
    asked = vectors.probes(spark, path, q, "vec_id", "embedding", DIM, None)
    return vectors.rescored(vectors.candidates(spark, path, asked, K), table(spark, d, "embeddings").count())


@query("SELECT 1 AS cells_match, count(*) AS rows FROM embeddings")
def vector_index_rows(spark, d):
    """Every row stands in one block, in the cell of its partition."""
    path, _ = _index(spark, d)
    b = vectors.blocks(spark, path)
    cells = spark.read.parquet(f"{path}/cells").select("cell")
    n = b.select("cell", F.explode("ids").alias("id")).join(F.broadcast(cells), "cell", "left_semi")
    return n.agg((F.count("*") == F.count_distinct("id")).cast("int").alias("cells_match"), F.count("*").alias("rows"))
