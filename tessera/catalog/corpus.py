"""Queries on choosing a corpus, its state, its index and its graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import legal
from ..operators import citations, graph, selection, state
from ..operators.ranking import first_per_key, top_k
from ..plans.base import fixture, query
from ..plans.fixtures import CHUNKS, JUDGMENTS
from ..sources.store import new_path
from ..sources.tables import table

_J = f"WITH j AS ({JUDGMENTS})"
_HAS = lambda p: f"regexp_matches(txt, '(?i){p}')"
_STAT = "[x FOR x IN [" + ", ".join(f"CASE WHEN {_HAS(p)} THEN '{n}' END" for n, p in legal.STATUTES.items()) + "] IF x IS NOT NULL]"
_TOPICS = "[x FOR x IN [" + ", ".join(f"CASE WHEN {_HAS(p)} THEN '{n}' END" for n, p in legal.TOPICS.items()) + "] IF x IS NOT NULL]"
_SCORE = "CAST(" + " + ".join(f"CASE WHEN {_HAS(p)} THEN {4 if n in legal.CORE_STATUTES else 2} ELSE 0 END" for n, p in legal.STATUTES.items()) + f" + least(len(regexp_extract_all(txt, '(?i){legal.CRIMINAL_TERMS}')), 30) // 3 AS INTEGER)"
_S = f"{_J}, s AS (SELECT *, {_STAT} AS statutes, {_TOPICS} AS topics, {_SCORE} AS score FROM j)"
TARGET = 1500


def _scored(spark, d):
    t = F.col("txt")
    return fixture(spark, d, JUDGMENTS).withColumns({"statutes": legal.statutes_in(t), "topics": legal.topics_in(t)}).withColumn("score", legal.criminal_score(t, F.col("statutes")))


@query(_S + " SELECT id, score, array_to_string(statutes, ',') AS statutes, CASE WHEN list_contains(statutes, 'BNS') THEN 'BNS' WHEN list_contains(statutes, 'IPC') THEN 'IPC' ELSE coalesce(statutes[1], 'other') END AS law, array_to_string(topics, ',') AS topics FROM s")
def criminal_relevance(spark, d):
    return _scored(spark, d).select("id", "score", F.array_join("statutes", ",").alias("statutes"), legal.primary_law(F.col("statutes")).alias("law"), F.array_join("topics", ",").alias("topics"))


_NAMES = sorted({*selection.FLOORS, *selection.SHARES})
_QUOTA = ", ".join(f"('{t}', {selection.FLOORS.get(t, 'NULL')}, {round(selection.SHARES[t] * TARGET) if t in selection.SHARES else 'NULL'})" for t in _NAMES)
_STATE = f", n AS (SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM s WHERE id % 2 = 0) GROUP BY 1), q AS (SELECT * FROM (VALUES {_QUOTA}) v(topic, floor, ceiling)), st AS (SELECT q.topic, coalesce(n, 0) AS n, coalesce(coalesce(n, 0) < floor, false) AS short, coalesce(coalesce(n, 0) >= ceiling, false) AS full_ FROM q LEFT JOIN n ON q.topic = n.topic)"


@query(_S + " SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM s) GROUP BY 1")
def topic_counts(spark, d):
    return selection.topic_counts(_scored(spark, d))


@query(_S + _STATE + " SELECT topic, n, short, full_ AS full FROM st")
def quota_state(spark, d):
    return selection.quota_state(selection.topic_counts(_scored(spark, d).where("id % 2 = 0")), TARGET)


@query(_S + _STATE + """, o AS (SELECT list(topic) FILTER (WHERE full_) AS f, coalesce(list(topic) FILTER (WHERE short), []) AS sh FROM st),
r AS (SELECT id, CASE WHEN len(topics) > 0 AND len([x FOR x IN topics IF NOT list_contains(coalesce(f, []), x)]) = 0 THEN 'topic_ceiling' WHEN score >= 10 THEN 'general_fill' WHEN len(list_intersect(topics, sh)) > 0 THEN 'quota:' || list_min(list_intersect(topics, sh)) ELSE 'below_general_fill_score' END AS reason FROM s, o WHERE id % 2 = 1)
SELECT id, reason LIKE 'quota%' OR reason = 'general_fill' AS accepted, reason FROM r""")
def quota_admission(spark, d):
    s = _scored(spark, d)
    q = selection.quota_state(selection.topic_counts(s.where("id % 2 = 0")), TARGET)
    return selection.admit(s.where("id % 2 = 1"), q).select("id", "accepted", "reason")


@query(_S + """, x AS (SELECT *, row_number() OVER (PARTITION BY md5(txt) ORDER BY id) AS copy FROM s)
SELECT id, CASE WHEN id % 11 = 0 THEN 'ledger' WHEN trim(dated) = '' THEN 'missing_metadata' WHEN length(txt) < 150 THEN 'too_short' WHEN score < 6 THEN 'not_criminal' WHEN copy > 1 THEN 'duplicate_text' END AS reason FROM x""")
def candidate_gate(spark, d):
    s = _scored(spark, d).withColumn("copy", F.row_number().over(Window.partitionBy(F.md5("txt")).orderBy("id")))
    c = F.col
    checks = [("ledger", c("id") % 11 == 0), ("missing_metadata", F.size(selection.missing_fields(["dated"])) > 0), ("too_short", F.length("txt") < 150), ("not_criminal", c("score") < selection.LEAST_SCORE), ("duplicate_text", c("copy") > 1)]
    return selection.gate_reasons(s, checks).select("id", "reason")


@query(_J + " SELECT id, array_to_string([x FOR x IN [CASE WHEN trim(dated) = '' THEN 'dated' END, CASE WHEN trim(court) = '' THEN 'court' END, CASE WHEN trim(title) = '' THEN 'title' END] IF x IS NOT NULL], ',') AS missing FROM j")
def missing_metadata(spark, d):
    return fixture(spark, d, JUDGMENTS).select("id", F.array_join(selection.missing_fields(["dated", "court", "title"]), ",").alias("missing"))


@query(_J + " SELECT id, CASE WHEN row_number() OVER (PARTITION BY court, yr ORDER BY id DESC) <= 40 THEN 1 ELSE 2 END AS turn FROM j")
def yearly_cap(spark, d):
    return selection.capped_by_year(fixture(spark, d, JUDGMENTS), "court", "yr", [F.col("id").desc()], 40).select("id", "turn")


@query(_J + """, m AS (SELECT id, section IN ('KEY_POINTS', 'ORDER') AS m FROM j), r AS (SELECT id, m, row_number() OVER (PARTITION BY m ORDER BY CASE WHEN m THEN '' ELSE md5('7:' || id) END, id) AS r FROM m)
SELECT id, row_number() OVER (ORDER BY CASE WHEN m THEN r + (r - 1) // 2 ELSE 3 * r END, m) AS place FROM r""")
def candidate_order(spark, d):
    return selection.interleave(fixture(spark, d, JUDGMENTS), F.col("section").isin("KEY_POINTS", "ORDER"), "id").select("id", "place")


_CEILINGS = {"murder": 200, "bail": 150}
_LIMITS = sorted({*selection.FLOORS, *_CEILINGS})
_FULL = "[x FOR x IN [" + ", ".join(f"CASE WHEN counts[{_LIMITS.index(t) + 1}] >= {c} THEN '{t}' END" for t, c in _CEILINGS.items()) + "] IF x IS NOT NULL]"
_SHORT = "[x FOR x IN [" + ", ".join(f"CASE WHEN counts[{_LIMITS.index(t) + 1}] < {f} THEN '{t}' END" for t, f in selection.FLOORS.items()) + "] IF x IS NOT NULL]"
_COUNTED = "[" + ", ".join(f"counts[{i + 1}] + (took AND list_contains(topics, '{t}'))::INT" for i, t in enumerate(_LIMITS)) + "]"


@query(_S.replace("WITH", "WITH RECURSIVE", 1) + f""", c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('h' || id), id) AS place, id, score, topics FROM s),
walk AS (SELECT 0::BIGINT AS place, NULL::BIGINT AS id, CAST(NULL AS VARCHAR) AS reason, [{', '.join('0' for _ in _LIMITS)}] AS counts, 0 AS have
UNION ALL SELECT place, id, reason, {_COUNTED} AS counts, have + took::INT FROM (SELECT *, reason LIKE 'quota%' OR reason = 'general_fill' AS took FROM (SELECT c.*, counts, have,
CASE WHEN have >= {TARGET} THEN 'target_reached' WHEN len(topics) > 0 AND len([x FOR x IN topics IF NOT list_contains({_FULL}, x)]) = 0 THEN 'topic_ceiling' WHEN score >= 10 THEN 'general_fill'
WHEN len(list_intersect(topics, {_SHORT})) > 0 THEN 'quota:' || list_min(list_intersect(topics, {_SHORT})) ELSE 'below_general_fill_score' END AS reason FROM walk JOIN c ON c.place = walk.place + 1)))
SELECT id, reason LIKE 'quota%' OR reason = 'general_fill' AS accepted, reason FROM walk WHERE place > 0""")
def harvest(spark, d):
    """Candidates in a drawn order, each against the counts that the ones before have left."""
    s = _scored(spark, d).withColumn("drawn", F.md5(F.concat(F.lit("h"), F.col("id").cast("string")).cast("binary")))
    return selection.harvest(s.select("id", "drawn", "score", "topics"), TARGET, ["drawn", "id"], ceilings=_CEILINGS).select("id", "accepted", "reason")


@query(_J + """, p AS (SELECT id, 'missing dated' AS problem FROM j WHERE trim(dated) = '' UNION ALL SELECT id, 'duplicate txt' FROM (SELECT id, row_number() OVER (PARTITION BY txt ORDER BY id) AS k FROM j) WHERE k > 1
UNION ALL SELECT id, 'court' FROM j WHERE NOT contains(upper(court), 'COURT OF') UNION ALL SELECT id, 'year' FROM j WHERE NOT yr BETWEEN 1993 AND 1997) SELECT id, problem FROM p""")
def corpus_violations(spark, d):
    rules = {"court": F.upper("court").contains("COURT OF"), "year": F.col("yr").between(1993, 1997)}
    return selection.violations(fixture(spark, d, JUDGMENTS), "id", ["dated"], ["txt"], rules)


@query(_J + " SELECT count(*) FILTER (WHERE trim(dated) <> '') AS kept, count(*) FILTER (WHERE trim(dated) = '') AS pruned, round(avg(length(txt)), 2) AS mean_chars, median(length(txt))::DOUBLE AS median_chars, count(DISTINCT case_no) AS cases, count(DISTINCT md5(txt)) AS texts FROM j")
def prune_report(spark, d):
    ok = F.size(selection.missing_fields(["dated"])) == 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return fixture(spark, d, JUDGMENTS).agg(n(ok).alias("kept"), n(~ok).alias("pruned"), F.round(F.avg(F.length("txt")), 2).alias("mean_chars"), F.median(F.length("txt")).alias("median_chars"), F.countDistinct("case_no").alias("cases"), F.countDistinct(F.md5("txt")).alias("texts"))


@query(_J + ", a AS (SELECT id, title FROM j), b AS (SELECT id, CASE WHEN id % 50 = 0 THEN 'changed' ELSE title END AS title FROM j WHERE id % 77 <> 0) SELECT 'only left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def table_difference(spark, d):
    a = fixture(spark, d, JUDGMENTS).select("id", "title")
    b = a.where("id % 77 <> 0").withColumn("title", F.when(F.col("id") % 50 == 0, "changed").otherwise(F.col("title")))
    return selection.differs(a, b)


@query("SELECT page_id, array_to_string(string_split(url, '/')[-3:], '/') AS path_key, CASE WHEN trim(url) <> '' THEN 'https://store/' || (page_id % 30 + 1990) || '/' || url END AS object_url, concat_ws('/', CAST(page_id % 30 + 1990 AS VARCHAR), url) AS candidate FROM pages")
def candidate_keys(spark, d):
    p = table(spark, d, "pages").withColumn("year", (F.col("page_id") % 30 + 1990).cast("string"))
    return p.select("page_id", state.path_key(F.col("url")).alias("path_key"), state.object_url("https://store", F.col("year"), F.col("url")).alias("object_url"), F.concat_ws("/", "year", "url").alias("candidate"))


_SEEN = ", seen AS (SELECT * FROM j WHERE id % 3 = 0), c AS (SELECT * FROM j WHERE id % 3 <> 0)"


@query(_J + _SEEN + " SELECT id, CASE WHEN EXISTS (SELECT 1 FROM seen s WHERE s.txt = c.txt) THEN 'text' WHEN EXISTS (SELECT 1 FROM seen s WHERE s.title = c.title AND s.dated = c.dated AND s.dated <> '') THEN 'title' END AS reason FROM c")
def seen_before(spark, d):
    j = fixture(spark, d, JUDGMENTS).withColumns({"sha": F.sha2("txt", 256), "named": F.when(F.col("dated") != "", F.concat_ws("/", "title", "dated"))})
    return state.seen_reason(j.where("id % 3 <> 0"), j.where("id % 3 = 0"), [("text", "sha"), ("title", "named")]).select("id", "reason")


@query("WITH m AS (SELECT doc_id AS k, md5(text) AS h FROM documents), n AS (SELECT doc_id AS k, md5(lang) AS h FROM documents WHERE doc_id % 5 = 0), u AS (SELECT * FROM m WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n) SELECT k, h FROM u WHERE k IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)")
def manifest_update(spark, d):
    x = table(spark, d, "documents")
    m, n = x.select(F.col("doc_id").alias("k"), F.md5("text").alias("h")), x.where("doc_id % 5 = 0").select(F.col("doc_id").alias("k"), F.md5("lang").alias("h"))
    return state.pruned(state.upsert(m, n, "k"), x.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("k")), "k")


@query("SELECT event_type AS prefix, count(*) FILTER (WHERE value > 20) AS hits, count(*) FILTER (WHERE NOT coalesce(value > 20, false)) AS misses, count(DISTINCT user_id) FILTER (WHERE epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-29 00:00:00')) AS items FROM events GROUP BY 1")
def cache_statistics(spark, d):
    return state.cache_stats(table(spark, d, "events"), "event_type", F.col("value") > 20, "user_id", F.col("ts").cast("timestamp") > F.lit("2024-01-29 00:00:00").cast("timestamp_ntz").cast("timestamp"))


@query(_J + """, c AS (SELECT DISTINCT case_no, unnest([upper(trim(regexp_replace(x, '\\s+', ' ', 'g'))) FOR x IN regexp_extract_all(txt, '\\(\\d{4}\\)\\s*\\d+\\s*SCC\\s*\\d+')]) AS cite, min(id) OVER () AS z FROM j), f AS (SELECT DISTINCT case_no, cite FROM c)
SELECT case_no, count(*) AS cites FROM f GROUP BY 1""")
def citations_per_case(spark, d):
    c = fixture(spark, d, JUDGMENTS).select("id", "case_no", F.explode(F.transform(legal.found(F.col("txt"), legal.CITATION_FORMATS[0]), lambda x: F.upper(legal.one_line(x)))).alias("cite"))
    return first_per_key(c, ["case_no", "cite"], [F.col("id")]).groupBy("case_no").agg(F.count("*").alias("cites"))


_G = f"""WITH c AS ({CHUNKS}), j AS ({JUDGMENTS}),
e AS (SELECT 'Case::' || lower(trim(title)) AS src, 'Court::' || lower(trim(court)) AS dst, 'decided_by' AS relation, 1 AS o FROM j
UNION ALL SELECT 'Case::' || lower(trim(title)), 'Citation::' || lower(x), 'cites', 2 FROM (SELECT title, unnest(regexp_extract_all(txt, '\\(\\d{{4}}\\)\\s*\\d+\\s*SCC\\s*\\d+')) AS x FROM j)
UNION ALL SELECT 'Case::' || lower(trim(title)), 'Section::section ' || s || ' of indian penal code', 'interprets', 3 FROM (SELECT title, unnest(regexp_extract_all(txt, '(?i)Section\\s+(\\d+)\\s+of\\s+the\\s+Indian\\s+Penal\\s+Code', 1)) AS s FROM j))
"""


def _edges(spark, d):
    return graph.case_graph(fixture(spark, d, JUDGMENTS), "title", "court", "txt", r"\(\d{4}\)\s*\d+\s*SCC\s*\d+", r"(?i)Section\s+(\d+)\s+of\s+the\s+(Indian\s+Penal\s+Code)")


@query(_G + "SELECT src, dst, arg_min(relation, o) AS relation FROM e GROUP BY 1, 2")
def case_graph_edges(spark, d):
    return _edges(spark, d)


@query(_G + ", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT string_split(id, '::')[1] AS kind, count(*) AS n FROM n GROUP BY 1")
def case_graph_nodes(spark, d):
    return graph.nodes(_edges(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(_G + ", t AS (SELECT DISTINCT dst, src FROM e WHERE relation = 'interprets' AND contains(dst, 'section 30')) SELECT dst AS section, count(*) AS cases FROM t GROUP BY 1")
def cases_by_statute(spark, d):
    return graph.cases_by_statute(_edges(spark, d), "section 30")


@query(_G + ", w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), k AS (SELECT DISTINCT item_id, w FROM w WHERE length(w) > 3), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), s AS (SELECT DISTINCT item_id, id FROM k JOIN n ON contains(string_split(id, '::')[2], w) WHERE id LIKE 'Case::%' OR id LIKE 'Section::%') SELECT item_id, count(*) AS seeds FROM s GROUP BY 1")
def related_nodes(spark, d):
    return graph.seeds(_edges(spark, d), table(spark, d, "benchmark"), "item_id", "text").groupBy("item_id").agg(F.count("*").alias("seeds"))


@query(_G + "SELECT src, dst, arg_min(relation, o) AS relation FROM e GROUP BY 1, 2")
def merged_graph_edges(spark, d):
    """The graph of three parts, the second first, stored one after the other; one part comes twice."""
    j, path = fixture(spark, d, JUDGMENTS), new_path(spark, "graph")
    for k in (1, 0, 2, 1):
        part = j.where(F.pmod("case_no", F.lit(3)) == k)
        graph.merge(graph.related(part, "title", "court", "txt", r"\(\d{4}\)\s*\d+\s*SCC\s*\d+", r"(?i)Section\s+(\d+)\s+of\s+the\s+(Indian\s+Penal\s+Code)"), path)
    return graph.stored(spark, path).select("src", "dst", "relation")


_SEEDS = """, w AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
s AS (SELECT DISTINCT item_id, id FROM w JOIN n ON length(w) > 3 AND contains(string_split(id, '::')[2], w) WHERE id LIKE 'Case::%' OR id LIKE 'Section::%')"""


@query(_G + _SEEDS + """, k AS (SELECT item_id, id AS node FROM s WHERE id LIKE 'Case::%' UNION SELECT item_id, dst FROM s JOIN e ON e.src = s.id WHERE dst LIKE 'Case::%' UNION SELECT item_id, src FROM s JOIN e ON e.dst = s.id WHERE relation = 'interprets')
SELECT item_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT item_id, j.id, row_number() OVER (PARTITION BY item_id ORDER BY j.id) AS rank FROM k JOIN j ON k.node = 'Case::' || lower(trim(j.title))) WHERE rank <= 5""")
def related_chunks(spark, d):
    j = fixture(spark, d, JUDGMENTS)
    return graph.related_chunks(_edges(spark, d), j, table(spark, d, "benchmark"), "item_id", "text", "title", "id", 5)


_ASKED = "select distinct o_custkey % 97 as q, case o_custkey % 97 % 3 when 0 then concat('Case ', cast(o_custkey % 97 as string), ' v. State') when 1 then concat('the CASE of ', cast(100 + o_custkey % 97 as string), ' State') else 'nobody at all' end as title from orders"


@query(_G + f""", a AS ({_ASKED}), cs AS (SELECT DISTINCT src AS id FROM e), t AS (SELECT id, unnest(list_distinct([x FOR x IN regexp_extract_all(string_split(id, '::')[2], '[a-z0-9]+') IF length(x) > 2])) AS t FROM cs),
x AS (SELECT q, 'Case::' || lower(trim(title)) AS id FROM a WHERE 'Case::' || lower(trim(title)) IN (SELECT id FROM cs)), r AS (SELECT q, unnest(list_distinct([x FOR x IN regexp_extract_all(lower(title), '[a-z0-9]+') IF length(x) > 2])) AS t FROM a WHERE q NOT IN (SELECT q FROM x)),
n AS (SELECT q, id, count(*) AS n FROM r JOIN t USING (t) GROUP BY 1, 2), s AS (SELECT * FROM x UNION ALL SELECT q, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, id) AS k FROM n) WHERE k = 1),
f AS (SELECT src, dst, arg_min(relation, o) AS relation FROM e GROUP BY 1, 2) SELECT q, id AS node, string_split(id, '::')[2] AS label, 0 AS hops, NULL AS parent, NULL AS relation FROM s
UNION ALL SELECT q, dst, string_split(dst, '::')[2], 1, src, relation FROM s JOIN f ON f.src = s.id""")
def citation_chain(spark, d):
    """From a case's title, exact or by its words, to what it cites and what that cites."""
    return graph.citation_chain(_edges(spark, d), fixture(spark, d, _ASKED), "q", "title", 2)


@query("SELECT label, count(*) AS rows, count(DISTINCT vec_id) AS ids, min(len(embedding)) AS low, max(len(embedding)) AS high, bool_and(len(embedding) = 64) AS ok FROM embeddings GROUP BY 1")
def index_verification(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), F.countDistinct("vec_id").alias("ids"), F.min(F.size("embedding")).cast("long").alias("low"), F.max(F.size("embedding")).cast("long").alias("high"), F.bool_and(F.size("embedding") == 64).alias("ok"))


@query(f"WITH c AS ({CHUNKS}), f AS (SELECT * FROM c WHERE (contains(lower(court), 'high court') OR contains(lower(court), 'supreme')) AND yr >= 1994 AND yr <= 1997), r AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY score DESC, chunk_id) AS rank FROM f) SELECT case_no, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def filtered_top5(spark, d):
    c = fixture(spark, d, CHUNKS).where(selection.court_filter(["High Court", "Supreme"], "court") & F.col("yr").between(1994, 1997))
    return top_k(c, 5, ["case_no"], "score", "chunk_id").select("case_no", "chunk_id", "rank")


@query(_J + f""", c AS (SELECT j.*, id % 1000 / 1000.0 AS sem, [x FOR x IN regexp_extract_all(txt, '{citations.SECTION}', 1) IF x IN ('300', '302', '304')] AS hit FROM j),
s AS (SELECT case_no, id, round(sem + CASE WHEN len(hit) > 0 THEN 0.25 ELSE 0 END + CASE WHEN yr = 1995 THEN 0.25 ELSE 0 END, 6) AS score FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY score DESC, id) AS k FROM s WHERE score >= 0.30)
SELECT case_no, id, score FROM (SELECT * FROM b WHERE k = 1) ORDER BY score DESC, case_no LIMIT 5""")
def best_judgments(spark, d):
    j = fixture(spark, d, JUDGMENTS)
    named = F.arrays_overlap(citations.sections(F.col("txt")), F.array(*map(F.lit, ("300", "302", "304"))))
    score = F.round(F.col("id") % 1000 / 1000.0 + F.when(named, 0.25).otherwise(0.0) + F.when(F.col("yr") == 1995, 0.25).otherwise(0.0), 6)
    s = j.withColumn("score", score).where("score >= 0.30")
    return first_per_key(s, ["case_no"], [F.col("score").desc(), F.col("id")]).orderBy(F.col("score").desc(), "case_no").limit(5).select("case_no", "id", "score")
