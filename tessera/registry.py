"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import chunking, citations, evaluation, graph, lexical, ordering, ranking, state, vectors
from .plans.base import ORACLE_SQL, QUERIES, query
from .plans.base import fixture as _sql
from .plans.fixtures import CHUNKS, EDGES, LEGAL
from .sources.tables import table

TOKENS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
_BM25 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') ts FROM documents),
st AS (SELECT count(*) n, avg(coalesce(len(ts), 0)) avgdl FROM d),
tf AS (SELECT doc_id, term, count(*) tf, any_value(dl) dl FROM (SELECT doc_id, len(ts) dl, unnest(ts) term FROM d) GROUP BY 1, 2),
raw AS (SELECT term, count(*) df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) raw FROM tf GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END idf FROM raw)
"""


@query(_BM25 + """, q AS (SELECT item_id query_id, term, count(*) times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st))))), 6) score FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM s WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) rank, doc_id, score FROM r WHERE rank <= 10""")
def bm25_topk(spark, d):
    return lexical.search(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text", 10).select("query_id", "rank", "doc_id", "score")


@query(_BM25 + "SELECT term, df, round(idf, 6) idf FROM idf")
def bm25_idf_table(spark, d):
    docs = table(spark, d, "documents")
    return lexical.inverse_frequencies(lexical.postings(docs, "doc_id", "text"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest([x FOR x IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') IF regexp_matches(x, '^[a-z0-9]+$')]) term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY 1")
def term_statistics(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"), True)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    return t.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


_COS = """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] e FROM embeddings),
s AS (SELECT q.vec_id query_id, c.vec_id, q.label ql, c.label cl, round(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) / (sqrt(list_sum([x * x FOR x IN q.e])) * sqrt(list_sum([x * x FOR x IN c.e]))), 6) score
FROM v q JOIN v c ON q.vec_id <> c.vec_id {cond})
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 5"""


def _cosine_top(spark, d, part=None):
    """Every hundredth vector asks."""
    v = table(spark, d, "embeddings")
    return vectors.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 64, 5, part).withColumnRenamed("id", "vec_id")


@query(_COS.format(cond="WHERE q.vec_id % 100 = 0"))
def cosine_topk(spark, d):
    return _cosine_top(spark, d)


@query(_COS.format(cond="AND q.label = c.label WHERE q.vec_id % 100 = 0"))
def cosine_topk_label_filter(spark, d):
    return _cosine_top(spark, d, "label")


@query("""WITH v AS (SELECT label, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) x, unnest(range(1, len(embedding) + 1)) dim FROM embeddings),
m AS (SELECT dim, min(x) lo, max(x) hi FROM v GROUP BY 1)
SELECT dim, round(lo, 6) lo, round(hi, 6) hi, round(max(abs(x - (lo + round((x - lo) / (hi - lo) * 255) / 255 * (hi - lo)))), 6) worst FROM v JOIN m USING (dim) GROUP BY dim, lo, hi""")
def scalar_quantizer_error(spark, d):
    v = table(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x")).withColumn("dim", F.col("dim").cast("long") + 1)
    m = v.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.col("hi") - F.col("lo")
    back = F.col("lo") + F.round((F.col("x") - F.col("lo")) / span * 255) / 255 * span
    return v.join(F.broadcast(m), "dim").groupBy("dim", "lo", "hi").agg(F.round(F.max(F.abs(F.col("x") - back)), 6).alias("worst")).select("dim", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "worst")


def _runs(spark, d):
    p = table(spark, d, "part")
    one = lambda name, score: p.select(F.col("p_size").alias("query_id"), F.lit(name).alias("source"), F.col("p_partkey").alias("doc_id"), score.alias("score"))
    return one("price", F.col("p_retailprice")).unionByName(one("key", -F.col("p_partkey").cast("double"))).unionByName(one("name", F.length("p_name").cast("double")))


_RUNS = """WITH u AS (SELECT p_size query_id, 'price' source, p_partkey doc_id, p_retailprice score FROM part UNION ALL SELECT p_size, 'key', p_partkey, -CAST(p_partkey AS DOUBLE) FROM part UNION ALL SELECT p_size, 'name', p_partkey, CAST(length(p_name) AS DOUBLE) FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) r FROM u)
"""


@query(_RUNS + "SELECT query_id, doc_id, round(sum(CASE source WHEN 'price' THEN 0.5 WHEN 'key' THEN 0.3 ELSE 0.2 END / (60 + r)), 9) fused, count(*) n_sources FROM r GROUP BY 1, 2")
def rrf_weighted(spark, d):
    return ranking.fuse(_runs(spark, d), ["query_id"], "source", "score", "doc_id", {"price": 0.5, "key": 0.3, "name": 0.2})


@query(_RUNS + "SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 9) fused, count(*) n_sources FROM r GROUP BY 1, 2")
def rrf_unweighted(spark, d):
    return ranking.fuse(_runs(spark, d), ["query_id"], "source", "score", "doc_id")


_MULT = "CASE " + " ".join(f"WHEN contains(upper(court), '{n}') THEN {v}" for n, v in ranking.COURT_MULTIPLIERS) + " ELSE 1.0 END"


@query(f"WITH c AS ({CHUNKS}), s AS (SELECT chunk_id, case_no, court, round(score * CAST({_MULT} AS DOUBLE), 9) boosted FROM c) SELECT case_no, chunk_id, court, boosted, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY boosted DESC, chunk_id) rank FROM s) WHERE rank <= 5")
def court_boost_top5(spark, d):
    s = _sql(spark, d, CHUNKS).withColumn("boosted", F.round(F.col("score") * ranking.court_multiplier(F.col("court")), 9))
    return ranking.top_k(s, 5, ["case_no"], "boosted", "chunk_id").select("case_no", "chunk_id", "court", "boosted", "rank")


@query(f"WITH c AS ({CHUNKS}), r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY score DESC, chunk_id) rank FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY yr, case_no ORDER BY rank, chunk_id) k FROM r) SELECT yr, case_no, chunk_id, CAST(row_number() OVER (PARTITION BY yr ORDER BY rank, chunk_id) AS INTEGER) new_rank FROM o WHERE k = 1")
def parent_expand(spark, d):
    c = _sql(spark, d, CHUNKS).withColumn("rank", F.row_number().over(Window.partitionBy("yr").orderBy(F.col("score").desc(), "chunk_id"))).withColumn("parent", F.col("case_no").cast("string"))
    return ranking.expand_to_parents(c, "yr", "parent", "rank", "chunk_id").select("yr", "case_no", "chunk_id", "new_rank")


@query(f"WITH c AS ({CHUNKS}), r AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY score DESC, chunk_id) rank FROM c) SELECT case_no, chunk_id, CAST(row_number() OVER (PARTITION BY case_no ORDER BY (section_type = 'ratio') DESC, rank, chunk_id) AS INTEGER) new_rank FROM r")
def promote_ratio(spark, d):
    c = _sql(spark, d, CHUNKS).withColumn("rank", F.row_number().over(Window.partitionBy("case_no").orderBy(F.col("score").desc(), "chunk_id")))
    return ranking.promote(c, "case_no", F.col("section_type") == "ratio", "rank", "chunk_id").select("case_no", "chunk_id", "new_rank")


@query("""WITH run AS (SELECT p_size query_id, p_partkey doc_id, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) rank FROM part),
gold AS (SELECT DISTINCT p_size query_id, p_partkey doc_id FROM part WHERE p_brand = 'Brand#2' OR p_name LIKE 'red%'),
ng AS (SELECT query_id, count(*) n_gold FROM gold GROUP BY 1),
per AS (SELECT run.query_id, count(*) n, count(*) FILTER (WHERE rank <= 5 AND g.doc_id IS NOT NULL) hits, min(rank) FILTER (WHERE g.doc_id IS NOT NULL) best, coalesce(sum(1 / log2(rank + 1.0)) FILTER (WHERE rank <= 5 AND g.doc_id IS NOT NULL), 0.0) dcg FROM run LEFT JOIN gold g ON run.query_id = g.query_id AND run.doc_id = g.doc_id GROUP BY 1)
SELECT ng.query_id, round(hits / least(5, n), 6) AS precision, round(hits / n_gold, 6) recall, CAST(hits > 0 AS INTEGER) hit, round(coalesce(1.0 / best, 0.0), 6) rr, round(dcg / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least(n_gold, 5) + 1)]), 6) ndcg FROM ng JOIN per USING (query_id)""")
def ir_metrics_at_5(spark, d):
    p = table(spark, d, "part")
    run = p.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("doc_id"), F.row_number().over(Window.partitionBy("p_size").orderBy(F.col("p_retailprice").desc(), "p_partkey")).alias("rank"))
    gold = p.where("p_brand = 'Brand#2' or p_name like 'red%'").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("doc_id"))
    return evaluation.metrics_at(run, gold, 5)


@query("SELECT event_type, count(*) n, round(avg(value), 2) mean, round(quantile_disc(value, 0.5), 2) p50, round(quantile_disc(value, 0.95), 2) p95, round(min(value), 2) low, round(max(value), 2) high FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return evaluation.latency_summary(table(spark, d, "events"), ["event_type"], "value")


@query("""WITH x AS (SELECT source, quality = 1 truth, n_chars > 500 decided FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) n, count(*) FILTER (WHERE truth AND decided) tp, count(*) FILTER (WHERE NOT truth AND decided) fp, count(*) FILTER (WHERE truth AND NOT decided) fn, count(*) FILTER (WHERE NOT truth AND NOT decided) tn,
round(count(*) FILTER (WHERE truth AND decided) / nullif(count(*) FILTER (WHERE truth), 0), 6) tpr, round(count(*) FILTER (WHERE NOT truth AND decided) / nullif(count(*) FILTER (WHERE NOT truth), 0), 6) fpr FROM x GROUP BY 1""")
def confusion_rates(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return evaluation.rates(x, ["source"], F.col("quality") == 1, F.col("n_chars") > 500)


@query(r"""WITH g AS (SELECT a, b, c FROM (SELECT unnest([0.1, 0.2, 0.3]) a), (SELECT unnest([0.0, 0.5]) b), (SELECT unnest([1.0, 2.0]) c)),
s AS (SELECT a, b, c, round(avg(a * value + b * length(event_type) + c), 6) score FROM events, g GROUP BY ALL)
SELECT a, b, c, score FROM s ORDER BY score DESC, a, b, c LIMIT 1""")
def grid_search_argmax(spark, d):
    values = [("a", [0.1, 0.2, 0.3]), ("b", [0.0, 0.5]), ("c", [1.0, 2.0])]
    e = table(spark, d, "events")
    for name, v in values:  # the grid is a literal of twelve points
        e = e.withColumn(name, F.explode(F.array(*[F.lit(x) for x in v])))
    s = e.groupBy("a", "b", "c").agg(F.round(F.avg(F.col("a") * F.col("value") + F.col("b") * F.length("event_type") + F.col("c")), 6).alias("score"))
    return s.orderBy(F.col("score").desc(), "a", "b", "c").limit(1)


@query(r"SELECT doc_id, array_to_string([x FOR x IN [trim(regexp_replace(y, '[ \t\r]+', ' ', 'g')) FOR y IN string_split(text, chr(10))] IF x <> ''], chr(10)) AS clean FROM documents")
def normalize_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tidy_lines(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")
def normalize_plain(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalized(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, array_to_string([x FOR x IN string_split(text, chr(10)) IF NOT regexp_matches(x, '(?i)" + "|".join(f"(?:{p})" for p in tx.FURNITURE) + "')], chr(10)) AS body FROM documents")
def strip_furniture(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.without_furniture(F.col("text")).alias("body"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '([.,;:])([A-Za-z])', '\1 \2', 'g') AS spaced FROM documents")
def unglue_words(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.unglued(F.col("text")).alias("spaced"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z\\[\\\\\\]^_`]', '', 'g')) AS latin, length(text) AS total FROM documents")
def script_share(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.script_counts(F.col("text"))["en"].cast("long").alias("latin"), F.length("text").cast("long").alias("total"))


@query("WITH c AS (" + CHUNKS + ") SELECT chunk_id, CASE WHEN regexp_matches(court, '(?i)SUPREME\\s+COURT\\s+OF\\s+INDIA') THEN 'SUPREME_COURT' WHEN regexp_matches(court, '(?i)HIGH\\s+COURT') THEN 'HIGH_COURT' WHEN regexp_matches(court, '(?i)DISTRICT\\s+(?:COURT|JUDGE|SESSIONS)') THEN 'DISTRICT_COURT' ELSE 'UNKNOWN' END AS kind FROM c")
def document_types(spark, d):
    return _sql(spark, d, CHUNKS).select("chunk_id", tx.document_type(F.col("court")).alias("kind"))


@query(r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '[ \t\n\r]+') IF x <> ''] w FROM documents),
x AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 220, 0) / 170.0) AS BIGINT) + 1)) i FROM w WHERE len(w) > 0)
SELECT doc_id AS id, CAST(i AS INTEGER) AS chunk_index, CAST(len(list_slice(w, i * 170 + 1, i * 170 + 220)) AS INTEGER) AS n_words, md5(array_to_string(list_slice(w, i * 170 + 1, i * 170 + 220), ' ')) AS digest FROM x""")
def fixed_window_chunks(spark, d):
    return chunking.fixed_windows(table(spark, d, "documents"), "doc_id", "text").select("id", "chunk_index", "n_words", F.md5("text").alias("digest"))


@query(r"""WITH w AS (SELECT lang, len([x FOR x IN regexp_split_to_array(text, '[ \t\n\r]+') IF x <> '']) n_words FROM documents)
SELECT lang, count(*) chunks, min(n_words) low, list_sort(list(n_words))[count(*) // 2 + 1] upper_median, max(n_words) high FROM w GROUP BY 1""")
def length_statistics(spark, d):
    n = table(spark, d, "documents").select("lang", F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))
    return chunking.length_stats(n, ["lang"])


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS question FROM conversations")
def carry_forward(spark, d):
    c = table(spark, d, "conversations").withColumn("asked", F.when(F.col("role") == "user", F.col("turn")))
    return chunking.carry_forward(c, "conv_id", "turn", "asked", "question").select("conv_id", "turn", F.coalesce("question", F.lit(-1).cast("long")).alias("question"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) k FROM conversations) WHERE k <= 6")
def history_last6(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return table(spark, d, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 6").drop("k")


@query("SELECT doc_id, CASE WHEN a > 1 THEN 'text' WHEN b > 1 THEN 'size' END AS reason FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) a, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) b FROM documents)")
def duplicate_reasons(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("s"))
    return state.duplicate_reason(x, "doc_id", [("text", "h"), ("size", "s")]).select("doc_id", "reason")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def sha_duplicates(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 3 = 0 THEN 'output missing' ELSE 'skip' END AS decision FROM documents")
def manifest_decision(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    m = x.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("h")).alias("h"))
    return state.skip_decision(x, m, x.where("doc_id % 3 <> 0"), "doc_id", "h")


@query("SELECT CAST(floor(doc_id / 256.0) AS BIGINT) AS slice, count(*) AS rows, bool_and(doc_id % 97 <> 0) AS done FROM documents GROUP BY 1")
def slice_completion(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return state.slice_completion(x, x.where("doc_id % 97 <> 0"), "doc_id", "doc_id", "h", 256)


@query("SELECT source, count(*) AS n, CAST(sum(CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE n_chars END) AS BIGINT) AS chars FROM documents GROUP BY 1")
def upsert_by_source(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    new = x.where(F.col("source").isin("src0", "src1")).withColumn("n_chars", F.lit(0).cast("long"))
    return state.upsert(x, new, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH l AS ({LEGAL}) SELECT id, array_to_string(list_sort(list_distinct([upper(x) FOR x IN regexp_extract_all(txt, '\\(\\d{{4}}\\)\\s*\\d+\\s*SCC\\s*\\d+')])), ';') AS cites, array_to_string(regexp_extract_all(txt, '(?i)section\\s+(\\d+[A-Z]?)', 1), ',') AS sections FROM l")
def citation_extract(spark, d):
    return _sql(spark, d, LEGAL).select("id", F.array_join(citations.legal.citations(F.col("txt")), ";").alias("cites"), F.array_join(citations.sections(F.col("txt")), ",").alias("sections"))


@query(f"WITH l AS ({LEGAL}), x AS (SELECT DISTINCT case_no, unnest(regexp_extract_all(txt, '(?i)section\\s+(\\d+[A-Z]?)', 1)) section FROM l) SELECT section, count(*) AS n_cases, min(case_no) AS first_case FROM x GROUP BY 1")
def cross_references(spark, d):
    x = _sql(spark, d, LEGAL).select("case_no", F.explode(citations.sections(F.col("txt"))).alias("section")).distinct()
    return x.groupBy("section").agg(F.count("*").alias("n_cases"), F.min("case_no").alias("first_case"))


@query(f"WITH c AS ({CHUNKS}), f AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY chunk_id) k FROM c) SELECT case_no, chunk_id, court, yr, CAST(row_number() OVER (ORDER BY yr, case_no) AS INTEGER) AS place FROM f WHERE k = 1")
def timeline(spark, d):
    f = ranking.first_per_key(_sql(spark, d, CHUNKS), ["case_no"], [F.col("chunk_id")])
    return ordering.numbered(f, ["yr", "case_no"]).select("case_no", "chunk_id", "court", "yr", F.col("place").cast("int").alias("place"))


@query(f"WITH RECURSIVE e AS ({EDGES}), b(seed, node, hops) AS (SELECT DISTINCT src, src, 0 FROM e WHERE src % 20 = 0 UNION SELECT b.seed, e.dst, b.hops + 1 FROM b JOIN e ON b.node = e.src WHERE b.hops < 2) SELECT seed, node, min(hops) AS hops FROM b GROUP BY 1, 2")
def bfs_depth2(spark, d):
    e = _sql(spark, d, EDGES)
    return graph.neighbours_within(e, e.where("src % 20 = 0").select(F.col("src").alias("id")).distinct(), 2).select("seed", "node", "hops")


@query(f"WITH e AS ({EDGES}), o AS (SELECT src node, count(*) n FROM e GROUP BY 1), i AS (SELECT dst node, count(*) n FROM e GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i USING (node)")
def graph_degrees(spark, d):
    return graph.degrees(_sql(spark, d, EDGES))


@query(f"WITH c AS ({CHUNKS}) SELECT court, section_type, count(*) AS n, count(DISTINCT case_no) AS cases FROM c GROUP BY 1, 2")
def graph_histogram(spark, d):
    return _sql(spark, d, CHUNKS).groupBy("court", "section_type").agg(F.count("*").alias("n"), F.countDistinct("case_no").alias("cases"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) w FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def token_overlap(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ", -1)).alias("w"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")), 6).alias("overlap"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events) WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) >= 3600000000")
def debounce(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return table(spark, d, "events").withColumn("p", F.lag("ts").over(w)).where(F.col("p").isNull() | (us("ts") - us("p") >= 3_600_000_000)).select("user_id", "event_id")


@query("SELECT source, count(*) AS n, round(avg(n_chars), 2) AS mean_chars, count(DISTINCT text) AS texts, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY 1")
def corpus_report(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.countDistinct(F.md5("text")).alias("texts"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("""WITH h AS (SELECT source, least(count(*), 60) target, count(*) // 2 held FROM documents GROUP BY 1), o AS (SELECT source, greatest(0, target - held) outstanding FROM h)
SELECT source, outstanding, CAST(CASE WHEN sum(outstanding) OVER () > 200 THEN floor(outstanding * (200.0 / sum(outstanding) OVER ())) ELSE outstanding END AS BIGINT) planned FROM o""")
def plan_strata(spark, d):
    h = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    o = h.select("source", F.greatest(F.lit(0), F.least("n", F.lit(60)) - F.floor(F.col("n") / 2)).cast("long").alias("outstanding"))
    total = o.agg(F.sum("outstanding").alias("total"))
    share = F.when(F.col("total") > 200, F.floor(F.col("outstanding") * (200.0 / F.col("total")))).otherwise(F.col("outstanding"))
    return o.join(F.broadcast(total)).select("source", "outstanding", share.cast("long").alias("planned"))


# the themes register their own queries
from .catalog import answering, asking, corpus, documents, evidence, headers, inverted, joins, measures, path, streams  # noqa: E402, F401
from .catalog import vectors as _vectors  # noqa: E402, F401
