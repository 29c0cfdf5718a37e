"""Queries on understanding questions, abstention and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import asking
from ..operators import gate
from ..plans.base import fixture, query
from ..plans.fixtures import ASK, CHOICES, HELD, HITS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SECTION = f"upper(coalesce(nullif(regexp_extract(txt, '{asking.SECTION}', 1), ''), nullif(regexp_extract(txt, '{asking.BARE_SECTION}', 1), '')))"
_CASE = f"""CASE WHEN upper(trim(override)) IN ('IPC', 'BNS') THEN 'chosen' WHEN upper(trim(override)) IN ('BOTH', 'ALL', 'ANY') THEN 'both'
WHEN regexp_matches(txt, '{asking.IPC}') AND NOT regexp_matches(txt, '{asking.BNS}') THEN 'IPC' WHEN regexp_matches(txt, '{asking.BNS}') AND NOT regexp_matches(txt, '{asking.IPC}') THEN 'BNS'
WHEN regexp_matches(txt, '{asking.IPC}') AND regexp_matches(txt, '{asking.BNS}') THEN 'named' ELSE 'open' END"""
_REASON = "CASE c " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in asking.REASONS.items()) + " END"
_CHOICE = f"WITH a AS ({ASK}), b AS (SELECT *, {_CASE} AS c FROM a), r AS (SELECT id, txt, CASE WHEN c = 'chosen' THEN upper(trim(override)) WHEN c IN ('IPC', 'BNS') THEN c END AS law, c <> 'open' AS explicit, {_REASON} AS reason, {_SECTION} AS section FROM b)"


def _choices(spark, d):
    a = fixture(spark, d, ASK)
    return a.select("id", "txt", asking.corpus_choice(F.col("txt"), F.col("override")).alias("c")).select("id", "txt", "c.*")


@query(_CHOICE + " SELECT id, law, explicit, reason, section FROM r")
def corpus_choice(spark, d):
    return _choices(spark, d).drop("txt")


@query(_CHOICE + " SELECT id, CASE law WHEN 'IPC' THEN " + _q(asking.DISCLOSURES["IPC"]) + " WHEN 'BNS' THEN " + _q(asking.DISCLOSURES["BNS"]) + " ELSE " + _q(asking.DISCLOSURES[""]) + " END AS line FROM r")
def law_disclosure(spark, d):
    return _choices(spark, d).select("id", asking.disclosure(F.col("law")).alias("line"))


@query(_CHOICE + f", h AS ({HELD}) SELECT r.law AS choice, h.statute, count(*) AS allowed FROM r JOIN h ON r.law IS NULL OR r.law = h.statute GROUP BY 1, 2")
def law_filter(spark, d):
    # the filter is of a choice's law only: choices and sections are counted before they meet
    c = _choices(spark, d).groupBy(F.col("law").alias("choice")).agg(F.count("*").alias("n"))
    h = fixture(spark, d, HELD).groupBy("statute").agg(F.count("*").alias("m"))
    return c.join(F.broadcast(h), asking.law_allows(F.col("choice"), F.col("statute"))).select("choice", "statute", (F.col("n") * F.col("m")).alias("allowed"))


_KEY = "CASE WHEN k IN ('IPC', 'BNS') THEN k WHEN k LIKE 'CRPC%' THEN 'CRPC' WHEN k LIKE 'BNSS%' THEN 'BNSS' WHEN k LIKE 'EVIDENCE%' THEN 'EVIDENCE' " + " ".join(f"WHEN k LIKE '{x}%' THEN '{x}'" for x in asking.ABSENT) + " ELSE k END"
_REFS = f"""WITH a AS ({ASK}), h AS ({HELD}),
u AS (SELECT id, unnest(regexp_extract_all(txt, '{asking.BEFORE}', 1)) AS t, unnest(regexp_extract_all(txt, '{asking.BEFORE}', 2)) AS n FROM a
 UNION ALL SELECT id, unnest(regexp_extract_all(txt, '{asking.AFTER}', 2)), unnest(regexp_extract_all(txt, '{asking.AFTER}', 1)) FROM a),
k AS (SELECT id, upper(regexp_replace(t, '[.\\s]', '', 'g')) AS k, upper(n) AS section FROM u),
refs AS (SELECT DISTINCT id, {_KEY} AS statute, section FROM k),
j AS (SELECT r.*, h.section IS NOT NULL AS found FROM refs r LEFT JOIN h ON r.statute = h.statute AND r.section = h.section),
g AS (SELECT id, count(*) AS n_refs,
 coalesce(list_sort(list(DISTINCT statute || ':' || section) FILTER (WHERE statute IN ('IPC', 'BNS') AND found)), []) AS named,
 coalesce(list_sort(list(DISTINCT statute || ':' || section) FILTER (WHERE statute IN ('IPC', 'BNS') AND NOT found)), []) AS missing,
 coalesce(list_sort(list(DISTINCT statute) FILTER (WHERE statute NOT IN ('IPC', 'BNS'))), []) AS absent FROM j GROUP BY 1),
p AS (SELECT a.id, a.txt, coalesce(n_refs, 0) AS n_refs, coalesce(named, []) AS named, coalesce(missing, []) AS missing,
 CASE WHEN n_refs IS NULL THEN list_sort([x FOR x IN [{', '.join(f"CASE WHEN regexp_matches(lower(txt), '{p}') THEN '{k}' END" for k, (_, p) in asking.ABSENT.items())}] IF x IS NOT NULL]) ELSE absent END AS absent FROM a LEFT JOIN g ON a.id = g.id)
"""


def _premises(spark, d):
    return asking.check_premises(fixture(spark, d, ASK), fixture(spark, d, HELD))


@query(_REFS + "SELECT id, len(missing) = 0 AND len(absent) = 0 AS ok, n_refs, array_to_string(named, ';') AS named, array_to_string(missing, ';') AS missing, array_to_string(absent, ';') AS absent FROM p")
def premise_check(spark, d):
    j = lambda c: F.array_join(c, ";").alias(c)
    return _premises(spark, d).select("id", "ok", F.col("n_refs").cast("long").alias("n_refs"), j("named"), j("missing"), j("absent"))


_KIND = f"CASE WHEN NOT (len(missing) = 0 AND len(absent) = 0) THEN 'unsupported' WHEN regexp_matches(txt, '{asking.CASE_LAW}') THEN 'case_law' WHEN regexp_matches(txt, '{asking.APPLICATION}') THEN 'application' WHEN len(named) > 0 OR regexp_matches(txt, '{asking.MENTION}') THEN 'direct_section' ELSE 'natural_language' END"
_W = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {w[i]}" for k, w in asking.KINDS.items()) + " END"


@query(_REFS + f", c AS (SELECT id, {_KIND} AS kind FROM p) SELECT id, kind, CAST({_W(0)} AS DOUBLE) AS statute_weight, CAST({_W(1)} AS DOUBLE) AS judgment_weight, kind <> 'unsupported' AS should_retrieve FROM c")
def question_kind(spark, d):
    x = _premises(spark, d).select("id", "ok", F.size("named").alias("n")).join(fixture(spark, d, ASK), "id")
    x = x.select("id", asking.kind_of(F.col("txt"), F.col("ok"), F.col("n")).alias("kind"))
    w = asking.kind_weights(F.col("kind"))
    return x.select("id", "kind", w["statute"].alias("statute_weight"), w["judgment"].alias("judgment_weight"), (F.col("kind") != "unsupported").alias("should_retrieve"))


#: What is known of each query of ``c`` from its hits ``h``.
ASSESSED = """t AS (SELECT c.query_id, c.law AS wl, c.section AS ws, h.score, h.law, h.section, row_number() OVER (PARTITION BY c.query_id ORDER BY h.score DESC) AS place FROM c LEFT JOIN h ON c.query_id = h.query_id),
a AS (SELECT query_id, wl, ws, count(score) AS n, round(max(score), 4) AS peak, round(max(score) - CASE WHEN count(score) > 1 THEN min(score) FILTER (WHERE place <= 3) ELSE 0 END, 4) AS margin,
 count(*) FILTER (WHERE score >= 0.486) AS n_support, wl IS NULL OR coalesce(bool_or(law = wl), false) AS corpus_match, CASE WHEN ws IS NOT NULL THEN coalesce(bool_or(section = ws), false) END AS section_found FROM t GROUP BY 1, 2, 3),
b AS (SELECT *, n = 0 OR peak < 0.40 OR NOT corpus_match OR (NOT coalesce(section_found, false) AND (n_support = 0 OR peak < 0.486)) AS abstain FROM a)
"""
_ASSESS = f"WITH h AS ({HITS}), c AS ({CHOICES}),\n{ASSESSED}"


def _assessed(spark, d):
    return gate.assess(fixture(spark, d, HITS), fixture(spark, d, CHOICES))


@query(_ASSESS + """SELECT query_id, n, peak, margin, n_support, corpus_match, coalesce(CAST(section_found AS INTEGER), -1) AS section_found, margin < 0.02 AND peak < 0.486 AS indistinct, abstain,
CASE WHEN abstain THEN 'none' WHEN NOT section_found THEN 'low' WHEN section_found THEN 'high' WHEN peak < 0.486 OR n_support < 1 THEN 'low' WHEN peak >= 0.60 THEN 'high' ELSE 'medium' END AS confidence FROM b""")
def abstain_assess(spark, d):
    return _assessed(spark, d)


REASON = "CASE WHEN n = 0 THEN 'no evidence' WHEN peak < 0.40 THEN 'below the floor' WHEN abstain THEN 'abstention advised' ELSE 'sufficient' END"
CONFIDENCE = "CASE WHEN abstain THEN 'none' WHEN NOT section_found THEN 'low' WHEN section_found THEN 'high' WHEN peak < 0.486 OR n_support < 1 THEN 'low' WHEN peak >= 0.60 THEN 'high' ELSE 'medium' END"
_REASONED = "SELECT query_id, CASE WHEN n = 0 THEN 'no evidence' WHEN n < 4 THEN 'too few sources' WHEN peak < 0.40 THEN 'below the floor' WHEN abstain THEN 'abstention advised' ELSE 'sufficient' END AS reason FROM b"


@query(_ASSESS + f", g AS ({_REASONED}) SELECT query_id, reason = 'sufficient' AS allowed, reason FROM g")
def evidence_gate(spark, d):
    return gate.gate(_assessed(spark, d), min_sources=4)


@query(_ASSESS + f", g AS ({_REASONED}) SELECT coalesce(c.law, 'open') AS grp, count(*) AS n, round(avg(CAST(reason = 'sufficient' AS INTEGER)), 6) AS allow_rate, round(avg(CAST((reason = 'sufficient') = (c.section IS NOT NULL) AS INTEGER)), 6) AS accuracy FROM g JOIN c USING (query_id) GROUP BY 1")
def gate_accuracy(spark, d):
    g = gate.gate(_assessed(spark, d), min_sources=4).join(fixture(spark, d, CHOICES), "query_id")
    right = F.col("allowed") == F.col("section").isNotNull()
    return g.groupBy(F.coalesce("law", F.lit("open")).alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("allowed").cast("int")), 6).alias("allow_rate"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))
