"""Queries that measure retrieval and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import lexical
from ..plans.base import query
from ..sources.store import new_path
from ..sources.tables import store_by, stored_by, table

_RUN = """WITH run AS (SELECT p_size AS query_id, p_partkey % 20 AS doc_id, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
gold AS (SELECT DISTINCT p_size AS query_id, p_partkey % 20 AS doc_id FROM part WHERE p_brand = 'Brand#2' OR p_name LIKE 'red%'),
f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM run GROUP BY 1, 2),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
per AS (SELECT f.query_id, k, count(*) AS n, count(*) FILTER (WHERE rank <= k AND g.doc_id IS NOT NULL) AS hits, min(rank) FILTER (WHERE g.doc_id IS NOT NULL) AS best, coalesce(sum(1 / log2(rank + 1.0)) FILTER (WHERE rank <= k AND g.doc_id IS NOT NULL), 0.0) AS dcg FROM f CROSS JOIN ks LEFT JOIN gold g ON f.query_id = g.query_id AND f.doc_id = g.doc_id GROUP BY 1, 2),
m AS (SELECT ng.query_id, k, round(hits / least(k, n), 6) AS precision, round(hits / n_gold, 6) AS recall, CAST(hits > 0 AS INTEGER) AS hit, round(coalesce(1.0 / best, 0.0), 6) AS rr, round(dcg / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least(n_gold, k) + 1)]), 6) AS ndcg FROM ng JOIN per USING (query_id))
"""


def _run(spark, d):
    p = table(spark, d, "part")
    w = Window.partitionBy("p_size").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    run = p.select(F.col("p_size").alias("query_id"), (F.col("p_partkey") % 20).alias("doc_id"), F.row_number().over(w).alias("rank"))
    gold = p.where("p_brand = 'Brand#2' or p_name like 'red%'").select(F.col("p_size").alias("query_id"), (F.col("p_partkey") % 20).alias("doc_id"))
    return run, gold


@query(_RUN + "SELECT * FROM m")
def ir_metrics_with_duplicates(spark, d):
    run, gold = _run(spark, d)
    return ev.metrics_at(run, gold, [1, 3, 5, 10])


@query(_RUN + "SELECT k, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY 1")
def ir_macro_averages(spark, d):
    run, gold = _run(spark, d)
    return ev.macro_average(ev.metrics_at(run, gold, [1, 3, 5, 10]), ["k"], ["precision", "recall", "hit", "rr", "ndcg"])


@query(_RUN + "SELECT k, round(avg(least(n_gold, k) / k), 6) AS ceiling FROM ng CROSS JOIN ks GROUP BY 1")
def precision_ceilings(spark, d):
    return ev.precision_ceilings(_run(spark, d)[1], [1, 3, 5, 10])


@query(_RUN + "SELECT query_id, doc_id, rank FROM f")
def closed_up_run(spark, d):
    return ev.closed_up(_run(spark, d)[0])


@query("""WITH r AS (SELECT p_size AS query_id, lower(trim(p_name)) AS name, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
e AS (SELECT DISTINCT p_size AS query_id, lower(substr(p_name, 1, 6)) AS name FROM part WHERE p_brand = 'Brand#3'), b AS (SELECT e.query_id, min(rank) FILTER (WHERE contains(r.name, e.name) OR contains(e.name, r.name)) AS best FROM e LEFT JOIN r ON e.query_id = r.query_id GROUP BY 1)
SELECT query_id, CAST(coalesce(best <= 5, false) AS INTEGER) AS hit, round(coalesce(1.0 / best, 0.0), 6) AS rr FROM b""")
def name_matches(spark, d):
    p = table(spark, d, "part")
    w = Window.partitionBy("p_size").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    run = p.select(F.col("p_size").alias("query_id"), F.col("p_name").alias("name"), F.row_number().over(w).alias("rank"))
    return ev.name_metrics(run, p.where("p_brand = 'Brand#3'").select(F.col("p_size").alias("query_id"), F.substring("p_name", 1, 6).alias("name")), 5)


_KEYS = ["the", "and", "der", "para", "zzz"]


@query("SELECT doc_id, round((" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INTEGER)" for k in _KEYS) + f") / {len(_KEYS)}, 6) AS coverage FROM documents")
def keyword_coverage(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(ev.keyword_coverage(F.col("text"), _KEYS), 6).alias("coverage"))


@query("""WITH x AS (SELECT lang, n_chars / 1000.0 AS s, quality = 1 AS inside FROM documents JOIN labels USING (doc_id)),
a AS (SELECT lang, min(s) FILTER (WHERE inside) AS in_min, avg(s) FILTER (WHERE inside) AS in_mean, median(s) FILTER (WHERE inside) AS in_median, max(s) FILTER (WHERE inside) AS in_max, min(s) FILTER (WHERE NOT inside) AS out_min, avg(s) FILTER (WHERE NOT inside) AS out_mean, median(s) FILTER (WHERE NOT inside) AS out_median, max(s) FILTER (WHERE NOT inside) AS out_max FROM x GROUP BY 1)
SELECT lang, round(in_min, 4) AS in_min, round(in_mean, 4) AS in_mean, round(in_median, 4) AS in_median, round(in_max, 4) AS in_max, round(out_min, 4) AS out_min, round(out_mean, 4) AS out_mean, round(out_median, 4) AS out_median, round(out_max, 4) AS out_max, coalesce(in_min > out_max, false) AS separable, round(in_min - out_max, 4) AS margin, CASE WHEN in_min > out_max THEN round((in_min + out_max) / 2, 4) END AS threshold FROM a""")
def threshold_separation(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("s", F.col("n_chars") / 1000.0)
    return ev.separation(x, ["lang"], "s", F.col("quality") == 1)


@query("SELECT source, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 HAVING count(l.doc_id) >= 3")
def labelled_splits(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return x.groupBy("source").agg(n(F.col("toxic") == 1).alias("toxic"), n(F.col("quality") == 1).alias("good"), n(F.col("has").isNull()).alias("unlabelled"), F.count("has").alias("k")).where("k >= 3").drop("k")


@query("SELECT l.doc_id, l.quality FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE n_chars > 100) d ON l.doc_id = d.doc_id")
def gold_absent(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where("n_chars > 100").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality")


@query("SELECT lang, count(*) FILTER (WHERE source < 'src1') AS a, count(*) FILTER (WHERE source >= 'src1') AS b FROM documents GROUP BY 1")
def results_pivot(spark, d):
    x = table(spark, d, "documents").select("lang", F.when(F.col("source") < "src1", "a").otherwise("b").alias("config"))
    return x.groupBy("lang").pivot("config", ["a", "b"]).agg(F.count("lang")).na.fill(0)


_BM = r"""WITH d AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') IF regexp_matches(x, '^[a-z0-9]+$') AND x NOT IN (STOP)] AS ts FROM documents),
st AS (SELECT count(*) n, avg(coalesce(len(ts), 0)) avgdl FROM d),
tf AS (SELECT doc_id, term, count(*) tf, any_value(dl) dl FROM (SELECT doc_id, len(ts) dl, unnest(ts) term FROM d) GROUP BY 1, 2),
raw AS (SELECT term, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) raw FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END idf FROM raw),
q AS (SELECT item_id query_id, term, count(*) times FROM (SELECT item_id, unnest([x FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') IF regexp_matches(x, '^[a-z0-9]+$') AND x NOT IN (STOP)]) term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st))))), 6) score FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM s WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) rank, doc_id, score FROM r WHERE rank <= 10""".replace("STOP", ", ".join(f"'{w}'" for w in lexical.STOP_WORDS))


@query(_BM)
def bm25_stop_topk(spark, d):
    """The production index: whole-word tokens without stop words."""
    return lexical.search(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text", 10, stop_words=True).select("query_id", "rank", "doc_id", "score")


@query("""WITH o AS (SELECT *, year(o_orderdate)::INT AS yr FROM orders), w AS (SELECT yr FROM o GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > count(*) / 4)
SELECT yr, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o WHERE yr IN (SELECT yr FROM w) GROUP BY 1""")
def yearly_partitions(spark, d):
    """Orders stored by year; only the years that a filter over them leaves are read again."""
    o = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    path = new_path(spark, "by-year")
    store_by(o, path, "yr")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema.fields)
    wanted = o.groupBy("yr").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")).where("f > n / 4")
    return stored_by(spark, path, schema, "yr", wanted).groupBy("yr").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
