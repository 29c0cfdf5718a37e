"""Queries over the stored inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inverted
from ..plans.base import ORACLE_SQL, query
from ..sources.store import new_path
from ..sources.tables import table


def _index(spark, d):
    """An index of all documents, in two batches; the second is written twice, which changes nothing."""
    path, docs = new_path(spark, "inverted"), table(spark, d, "documents")
    odd = F.pmod("doc_id", F.lit(2)) == 1
    inverted.add(docs.where(~odd), path, 0, "doc_id", "text")
    for _ in range(2):
        inverted.add(docs.where(odd), path, 1, "doc_id", "text")
    return path


@query(ORACLE_SQL["bm25_topk"])
def stored_bm25_topk(spark, d):
    return inverted.search(spark, _index(spark, d), table(spark, d, "benchmark"), "item_id", "text", 10)


@query("""SELECT term, count(*) AS df, sum(tf)::BIGINT AS words, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1""")
def stored_postings(spark, d):
    """What the index holds of each term."""
    p = inverted.postings(spark, _index(spark, d))
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.sum(total).alias("words"), F.max("max_tf").cast("long").alias("max_tf"))


@query()
def stored_blocks_skipped(spark, d):
    """Blocks that hold an asked term, and those of them that a search for the ten best scores."""
    path, q = _index(spark, d), table(spark, d, "benchmark")
    post, weighted, limits = inverted.plan(spark, path, q, "item_id", "text")
    first = limits.withColumn("r", F.row_number().over(_by_bound())).where(f"r <= {inverted.FIRST}").drop("r")
    rest = inverted.survivors(limits, first, inverted.score(post, weighted, first, 1), 10)
    n = lambda df, c: df.groupBy("query_id").agg(F.count("*").alias(c))
    return n(limits, "blocks").join(n(first.unionAll(rest), "scored"), "query_id")


def _by_bound():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("most"), "batch", "block")
