"""Queries on judgments scored for questions, the writer's passages, and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal
from ..operators import answering, state
from ..plans.base import fixture, query
from ..sources.tables import table

_CAND = """select o_custkey as query_id, o_orderkey as id, o_orderkey % 13 as case_no, cast((o_orderkey * 37) % 1000 as double) / 1000 as semantic, case o_orderkey % 2 when 0 then 'IPC' else 'BNS' end as law, concat(cast(300 + o_orderkey % 5 as string), ',', cast(o_orderkey % 40 as string)) as cites from orders"""
_NAMED = "select distinct o_custkey as query_id, case o_custkey % 2 when 0 then 'IPC' else 'CrPC' end as statute, cast(300 + o_custkey % 7 as string) as section from orders where o_custkey % 3 <> 0"
_CROSSED = "select o_custkey as query_id, o_custkey % 13 as case_no from orders"
_SCORES = f"""c AS ({_CAND}), n AS (SELECT query_id, list(DISTINCT section) AS sections FROM ({_NAMED}) GROUP BY 1), x AS (SELECT DISTINCT query_id, case_no, true AS crossed FROM ({_CROSSED})),
b AS (SELECT c.*, coalesce(crossed, false) AS crossed, list_sort(coalesce(list_intersect(sections, string_split(cites, ',')), [])) AS hits FROM c LEFT JOIN n USING (query_id) LEFT JOIN x USING (query_id, case_no)),
s AS (SELECT query_id, id, case_no, round(semantic + CASE WHEN len(hits) > 0 THEN 0.25 ELSE 0 END + CASE WHEN crossed THEN 0.25 ELSE 0 END, 4)::DOUBLE AS score, CASE WHEN len(hits) = 0 AND NOT crossed THEN 'matched the question semantically'
ELSE array_to_string([r FOR r IN [CASE WHEN len(hits) > 0 THEN 'cites section ' || array_to_string(hits, ', ') || ', which the question names' END, CASE WHEN crossed THEN 'cross-referenced to the retrieved provision' END] IF r IS NOT NULL], '; ') END AS reasons FROM b)"""


def _scored(spark, d):
    c = fixture(spark, d, _CAND).withColumn("cited", F.split("cites", ","))
    return answering.scored(c, fixture(spark, d, _NAMED), fixture(spark, d, _CROSSED), "query_id", "case_no").withColumn("reasons", F.array_join("reasons", "; "))


@query(f"WITH {_SCORES} SELECT * FROM s")
def judgment_scores(spark, d):
    return _scored(spark, d).select("query_id", "id", "case_no", "score", "reasons")


@query(f"""WITH {_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, case_no ORDER BY score DESC, id) AS k FROM s WHERE score >= 0.30),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k WHERE k = 1) SELECT query_id, id, case_no, score, reasons, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def judgments_for_questions(spark, d):
    return answering.judgments(_scored(spark, d), "query_id", "case_no", "id").select("query_id", "id", "case_no", "score", "reasons", "rank")


_RUNS = """select o_custkey as query_id, cast(o_orderkey % 3 as int) as run, o_orderkey as rank, o_orderkey % 60 as chunk_id, case o_orderkey % 7 when 0 then '' else cast(o_orderkey % 20 as string) end as parent, case o_orderkey % 4 when 0 then 'SUPREME COURT OF INDIA' when 1 then 'HIGH COURT OF DELHI' when 2 then 'HIGH COURT OF BOMBAY' else 'DISTRICT COURT' end as court, case o_orderkey % 5 when 0 then null else cast(year(o_orderdate) as int) end as yr, case o_orderkey % 3 when 0 then 'ratio' when 1 then 'obiter' else '' end as section_type, concat('Case ', cast(o_orderkey % 9 as string)) as title, concat('in CASE ', cast(o_orderkey % 8 as string), case o_orderkey % 4 when 0 then ' it was overruled' when 1 then ' bail was refused' when 2 then ' as distinguished there; bail' else '' end) as text, o_totalprice as score from orders"""
_TREATED = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in legal.TREATMENTS.items()) + " END"


@query(f"""WITH u AS ({_RUNS}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY run, rank) AS k FROM u),
d AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY query_id ORDER BY run, rank, chunk_id) AS o FROM f WHERE k = 1 AND (contains(lower(court), 'high court') OR contains(lower(court), 'supreme')) AND coalesce(yr >= 1993, true) AND coalesce(yr <= 1997, true)
AND (contains(lower(text), 'bail') OR contains(lower(title), 'bail') OR contains(lower(text), 'case') OR contains(lower(title), 'case')) AND (section_type IN ('', 'ratio', 'overruled') OR contains(lower(text), 'ratio') OR contains(lower(text), 'overruled'))),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(nullif(parent, ''), 'orphan:' || chunk_id) ORDER BY o) AS k FROM d),
s AS (SELECT query_id, chunk_id, title, round(score * CASE section_type WHEN 'ratio' THEN 1.15 WHEN 'obiter' THEN 0.90 ELSE 1.0 END::DOUBLE, 6) AS score FROM p WHERE k = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s), b AS (SELECT * FROM t WHERE rank <= 5), l AS (SELECT *, lower(text) AS low FROM d), e AS (SELECT *, {_TREATED} AS st FROM l),
m AS (SELECT b.query_id, b.chunk_id, st, row_number() OVER (PARTITION BY b.query_id, b.chunk_id ORDER BY (st IS NULL), coalesce(yr, 0) DESC, e.chunk_id) AS k FROM b JOIN e ON b.query_id = e.query_id AND contains(low, lower(b.title)) AND lower(e.title) <> lower(b.title))
SELECT b.query_id, b.chunk_id, b.title, b.score, CAST(b.rank AS INTEGER) AS rank, CASE WHEN k IS NULL THEN 'good_law' ELSE coalesce(st, 'followed') END AS status, CASE WHEN k IS NULL THEN 1.0 WHEN st IS NULL THEN 0.60 ELSE 0.95 END::DOUBLE AS confidence
FROM b LEFT JOIN m ON b.query_id = m.query_id AND b.chunk_id = m.chunk_id AND k = 1""")
def writers_context(spark, d):
    filters = answering.admitted(["High Court", "Supreme"], 1993, 1997, ["bail", "Case"], ["ratio", "overruled"])
    return answering.context(fixture(spark, d, _RUNS), "query_id", 5, filters)


@query("""WITH r AS (SELECT doc_id, md5(text) AS h FROM documents), f AS (SELECT CASE WHEN doc_id % 37 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 29 = 0 THEN md5(text || 'x') ELSE md5(text) END AS h FROM documents)
SELECT doc_id, CASE WHEN r.doc_id IS NULL THEN 'unrecorded' WHEN f.doc_id IS NULL THEN 'missing' WHEN r.h = f.h THEN 'ok' ELSE 'changed' END AS status FROM r FULL JOIN f USING (doc_id)""")
def provenance_check(spark, d):
    """All documents on record, against the same files of which some were changed and others renamed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    now = F.md5(F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    found = docs.select(F.when(F.col("doc_id") % 37 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), now.alias("h"))
    return state.provenance_status(docs.select("doc_id", F.md5("text").alias("h")), found, "doc_id", "h")
