"""BM25 without an index: tokens cut in tasks, few rows that move, brute force."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from test_inverted import QUERIES, brute, close, got, texts

from tessera.functions.text import cut_tokens, token_text, tokens
from tessera.operators import lexical

ODD = ["", None, "Ab1_c d-e", "été ete Ünder_score x", "İK  the—cat", "ends here", "here starts", "  ", "ΑΒΓ abc١", "a\x00b \U0001d400z z\U0001f600y"]


def test_tokens_cut_in_tasks_are_those_of_the_column(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").coalesce(1)
    for stop in (False, True):
        rows = df.select("i", F.coalesce(tokens(F.col("t"), stop), F.array().cast("array<string>")).alias("want"), token_text(F.col("t"), stop).alias("low")).orderBy("i").collect()
        low = pa.array(["left out", *(r.low for r in rows)])
        found, row = cut_tokens(low.slice(1), stop)
        have = [[] for _ in rows]
        for t, i in zip(found.to_pylist(), row):
            have[i].append(t)
        assert have == [r.want for r in rows]


def test_search_equals_brute_force_and_moves_k_rows_a_task(spark, monkeypatch):
    monkeypatch.setattr(lexical, "HELD", 20)
    monkeypatch.setattr(lexical, "DOCS", 7)
    data = [*texts(300), (300, None), (301, "")]
    random.Random(3).shuffle(data)
    d, q = spark.createDataFrame(data, "k long, body string").repartition(3), spark.createDataFrame(QUERIES, "q long, t string")
    found = lexical.search(q, d, "q", "t", "k", "body", 4)
    # neither postings nor pairs are joined: the plan that is left has one scan of the texts and one exchange, by query
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    close(got(found), brute(data, QUERIES, 4))


def test_parts_of_the_queries_and_other_types_of_ids(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 2)
    data, asked = texts(50), [(str(i), t) for i, t in QUERIES]
    d, q = spark.createDataFrame(data, "k int, body string"), spark.createDataFrame(asked, "q string, t string")
    close(got(lexical.search(q, d, "q", "t", "k", "body", 4)), {str(i): v for i, v in brute(data, QUERIES, 4).items()})
    assert lexical.search(q, d.limit(0), "q", "t", "k", "body", 4).count() == 0
    assert lexical.search(q.limit(0), d, "q", "t", "k", "body", 4).count() == 0


def test_stop_words_and_parts_of_words_do_not_count(spark):
    d = spark.createDataFrame([(1, "the cat"), (2, "über_cat the the"), (3, "dog"), (4, "bird"), (5, "fish")], "k long, body string")
    q = spark.createDataFrame([(1, "the cat")], "q long, t string")
    assert [(r.query_id, r.doc_id) for r in lexical.search(q, d, "q", "t", "k", "body", 4, stop_words=True).collect()] == [(1, 1)]


def test_a_block_gives_no_more_than_its_k_best(spark):
    from tessera.operators import inverted
    from tessera.sources.store import new_path

    d = spark.createDataFrame([(i, "w " * (i + 1) + "x " * 3) for i in range(40)] + [(i, "y") for i in range(40, 100)], "k long, body string").coalesce(1)
    path, q = new_path(spark, "test-inverted"), spark.createDataFrame([(1, "w"), (2, "w x")], "q long, t string")
    inverted.add(d, path, 0, "k", "body")
    post, weighted, limits = inverted.plan(spark, path, q, "q", "t")
    found = inverted.score(post, weighted, limits, 1, 5).groupBy("query_id").count().collect()
    assert sorted((r[0], r[1]) for r in found) == [(1, 5), (2, 5)]
    assert inverted.score(post, weighted, limits, 1).count() == 80
