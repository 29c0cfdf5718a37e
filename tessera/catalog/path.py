"""Queries over the whole way from a question to the gate, and over thresholds and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded, tokens
from ..operators import evaluation, path, ranking, vectors
from ..plans.base import ORACLE_SQL, query
from ..sources.store import written
from ..sources.tables import table
from .asking import ASSESSED, CONFIDENCE, REASON

DIM = 64
_PASSAGES = """p AS (SELECT doc_id AS chunk_id, CASE doc_id % 4 WHEN 0 THEN 'SUPREME COURT OF INDIA' WHEN 1 THEN 'DELHI HIGH COURT' WHEN 2 THEN 'BOMBAY HIGH COURT' ELSE 'DISTRICT COURT, PUNE' END AS court,
CASE doc_id % 2 WHEN 0 THEN 'IPC' ELSE 'BNS' END AS law, CAST(300 + doc_id % 5 AS VARCHAR) AS section FROM documents)"""
_CHOICES = "c AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'IPC' WHEN 1 THEN 'BNS' END AS law, CASE item_id % 4 WHEN 0 THEN '302' END AS section FROM benchmark)"
_NEAR = """v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM (SELECT q.item_id AS query_id, b.vec_id AS chunk_id,
round(list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]), 6) AS score FROM benchmark q JOIN v a ON a.vec_id = q.item_id JOIN v b ON b.vec_id <> a.vec_id)) WHERE r <= 20)"""
_HITS = "h AS (SELECT query_id, chunk_id, score, law, section FROM near JOIN p USING (chunk_id))"
_BM25 = ORACLE_SQL["bm25_topk"].split("SELECT query_id, CAST(rank")[0].replace("r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank", "lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) r")
_COURT = "CASE " + " ".join(f"WHEN contains(upper(court), '{n}') THEN {v}" for n, v in ranking.COURT_MULTIPLIERS) + " ELSE 1.0 END"


def _inputs(spark, d):
    """Passages are the documents; those with a vector are in the index. A benchmark item asks, with the vector of its number."""
    docs = table(spark, d, "documents")
    court = F.when(F.col("doc_id") % 4 == 0, "SUPREME COURT OF INDIA").when(F.col("doc_id") % 4 == 1, "DELHI HIGH COURT").when(F.col("doc_id") % 4 == 2, "BOMBAY HIGH COURT").otherwise("DISTRICT COURT, PUNE")
    law = F.when(F.col("doc_id") % 2 == 0, "IPC").otherwise("BNS")
    p = docs.select(F.col("doc_id").alias("chunk_id"), "text", court.alias("court"), law.alias("law"), (300 + F.col("doc_id") % 5).cast("string").alias("section"))
    # the index reads it four times, the questions once
    v = written(table(spark, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", F.col("embedding").alias("vector")), "indexed")
    items = table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    choices = items.select("query_id", F.when(F.col("query_id") % 3 == 0, "IPC").when(F.col("query_id") % 3 == 1, "BNS").alias("law"), F.when(F.col("query_id") % 4 == 0, "302").alias("section"))
    return p, vectors.temporary(v, "vec_id", "vector", DIM), items.join(v.withColumnRenamed("vec_id", "query_id"), "query_id", "left"), choices


@query(_BM25 + f""", {_PASSAGES}, {_CHOICES}, {_NEAR}, {_HITS}, u AS (SELECT query_id, chunk_id, 0.6 / (60 + r) AS w FROM near UNION ALL SELECT query_id, doc_id, 0.4 / (60 + r) FROM lex WHERE r <= 20 AND score > 0),
f AS (SELECT query_id, chunk_id, round(round(sum(w), 9) * CAST({_COURT} AS DOUBLE), 9) AS score FROM u JOIN p USING (chunk_id) GROUP BY query_id, chunk_id, court), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5), {ASSESSED}
SELECT b.query_id, CAST(rank AS INTEGER) AS rank, chunk_id, g.score, {CONFIDENCE} AS confidence, {REASON} = 'sufficient' AS allowed, {REASON} AS reason FROM b LEFT JOIN g ON g.query_id = b.query_id""")
def answered_questions(spark, d):
    """Dense and lexical search of every question over all documents, fused and boosted, with the gate's decision."""
    p, index, q, choices = _inputs(spark, d)
    return path.answer(q, p, choices, index, DIM, 5, None)


@query(f"WITH {_PASSAGES}, c0 AS (SELECT * FROM ({_CHOICES[6:-1]})), c AS (SELECT * FROM c0 WHERE law IS NOT NULL), {_NEAR}, h AS (SELECT query_id, score, p.law, p.section FROM near JOIN p USING (chunk_id) JOIN c USING (query_id) WHERE p.law <> c.law), {ASSESSED} SELECT query_id, {REASON} = 'sufficient' AS allowed, {REASON} AS reason FROM b")
def evidence_removed(spark, d):
    """Questions that name a law, with that law's passages gone."""
    p, index, q, choices = _inputs(spark, d)
    return path.without_law(path.dense(q, index, DIM, 20, None), p, choices)


@query(f"""WITH {_PASSAGES}, c0 AS (SELECT * FROM ({_CHOICES[6:-1]})), {_NEAR}, top AS (SELECT near.*, law, section FROM near JOIN p USING (chunk_id) WHERE r <= 6),
l AS (SELECT a.query_id || ':' || g.chunk_id AS query_id, a.score, a.law, a.section, row_number() OVER (PARTITION BY a.query_id, g.chunk_id ORDER BY a.r) AS n FROM top a JOIN top g ON a.query_id = g.query_id AND g.r <= 5 AND a.r <> g.r), h AS (SELECT * FROM l WHERE n <= 5),
c AS (SELECT c0.query_id || ':' || g.chunk_id AS query_id, c0.law, c0.section FROM c0 JOIN top g ON g.query_id = c0.query_id AND g.r <= 5), {ASSESSED}
SELECT CAST(string_split(query_id, ':')[1] AS BIGINT) AS query_id, CAST(string_split(query_id, ':')[2] AS BIGINT) AS removed, {REASON} = 'sufficient' AS allowed, {REASON} AS reason FROM b""")
def evidence_left_out(spark, d):
    """The gate without each of a question's five best passages."""
    p, index, q, choices = _inputs(spark, d)
    return path.without_each(path.dense(q, index, DIM, 6, None), p, choices, 5)


_VARIETY = "round(len(list_distinct(ts)) / len(ts), 4)"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), s AS (SELECT {_VARIETY} AS s, quality = 1 AS p FROM t JOIN labels USING (doc_id) WHERE len(ts) > 0),
n AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE p) AS p FROM s GROUP BY 1), w AS (SELECT s AS threshold, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n - p) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS ps, sum(n - p) OVER () AS ns FROM n)
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (ps - tp)::BIGINT AS fn, (ns - fp)::BIGINT AS tn, round((tp + ns - fp) / (ps + ns), 6) AS accuracy FROM w""")
def threshold_sweep(spark, d):
    """Every threshold on a text's share of different words, against its quality."""
    ts = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    s = ts.select("doc_id", rounded(F.size(F.array_distinct("ts")) / F.size("ts"), 4).alias("s")).join(table(spark, d, "labels"), "doc_id")
    return evaluation.sweep(s, "s", F.col("quality") == 1)


_GRID = {"section": [0.0, 0.25, 0.5, 0.75], "crossed": [0.0, 0.25, 0.5], "law": [0.0, 0.15]}
_POINTS = ", ".join(f"({i}, {p['section']}, {p['crossed']}, {p['law']})" for i, p in enumerate(evaluation.grid(_GRID)))


@query(f"""WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), g AS (SELECT * FROM (VALUES {_POINTS}) t(trial, section, crossed, law)),
a AS (SELECT q.vec_id AS q, c.vec_id AS id, c.vec_id % 97 AS case_no, round(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]), 6) AS sem, c.label = q.label AS same, c.vec_id % 7 = q.vec_id // 100 % 7 AS crossed, c.vec_id % 2 = q.vec_id // 100 % 2 AS law FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sem DESC, id) AS r FROM a) WHERE r <= 60), gold AS (SELECT DISTINCT q, case_no FROM k WHERE same AND id % 3 = 0),
s AS (SELECT trial, q, case_no, id, round(sem + same::INT * g.section + k.crossed::INT * g.crossed + k.law::INT * g.law, 4)::DOUBLE AS s FROM k, g), o AS (SELECT *, row_number() OVER (PARTITION BY trial, q, case_no ORDER BY s DESC, id) AS n FROM s WHERE s >= 0.30),
r AS (SELECT *, row_number() OVER (PARTITION BY trial, q ORDER BY s DESC, id) AS rank FROM o WHERE n = 1), m AS (SELECT trial, r.q, rank, gold.q IS NOT NULL AS hit FROM r LEFT JOIN gold ON gold.q = r.q AND gold.case_no = r.case_no WHERE rank <= 5),
e AS (SELECT trial, q, sum(1 / log2(rank + 1.0)) FILTER (WHERE hit) AS dcg, min(rank) FILTER (WHERE hit) AS best, count(*) FILTER (WHERE hit) AS hits FROM m GROUP BY 1, 2), n AS (SELECT q, count(*) AS n FROM gold GROUP BY 1),
x AS (SELECT g.trial, n.q, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least(n, 5) + 1)]), 6) AS ndcg, round(coalesce(1.0 / best, 0), 6) AS rr, round(coalesce(hits, 0) / n, 6) AS recall FROM g CROSS JOIN n LEFT JOIN e ON e.trial = g.trial AND e.q = n.q)
SELECT trial, g.section::DOUBLE AS section, g.crossed::DOUBLE AS crossed, g.law::DOUBLE AS law, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr, round(avg(recall), 6) AS recall FROM x JOIN g USING (trial) GROUP BY 1, 2, 3, 4""")
def weights_tuned(spark, d):
    """Twenty-four weightings of the sixty nearest vectors of each query, by nDCG."""
    v = table(spark, d, "embeddings")
    near = vectors.search(spark, vectors.temporary(v, "vec_id", "embedding", DIM), v.where("vec_id % 100 = 0"), "vec_id", "embedding", DIM, 60, None)
    label = lambda n, k: v.select(F.col("vec_id").alias(k), F.col("label").alias(n))
    c = near.join(label("ql", "query_id"), "query_id").join(label("cl", "id"), "id").withColumns({"case_no": F.col("id") % 97, "section": F.col("ql") == F.col("cl")})
    turn = F.floor(F.col("query_id") / 100)
    c = c.withColumns({"crossed": F.col("id") % 7 == turn % 7, "law": F.col("id") % 2 == turn % 2})
    gold = c.where("section and id % 3 = 0").select("query_id", "case_no").distinct()
    return evaluation.tune(c, gold, evaluation.grid(_GRID), "query_id", "case_no", "id", "score")
