"""Queries on headers of judgments, titles, maxims, sections over pages, and resumed runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers as h
from ..functions import legal, maxims
from ..operators import citations, splitting, state
from ..plans.base import counted_terms, counted_terms_sql, fixture, located_sql, query
from ..plans.fixtures import HEADERS, LEGAL, PAGES, TITLES
from ..sources.tables import table

_q = lambda s: s.replace("'", "''")
_strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_ex = lambda c, p, g=1: f"regexp_extract({c}, '(?i){_q(p)}', {g})"
_plain = lambda c: f"regexp_replace({c}, '\\s+', '', 'g')"


def _first(text: str, patterns: list[str], ok: str, tidy=_strip) -> str:
    return f"[x FOR x IN [{', '.join(tidy(_ex(text, p)) for p in patterns)}] IF {ok}][1]"


_COURT_OK = "length(x) BETWEEN 6 AND 99 AND (contains(upper(x), 'COURT') OR contains(upper(x), 'TRIBUNAL')) AND NOT regexp_matches(x, '\\. [a-z]')" + "".join(
    f" AND NOT contains(upper(x), '{w}')" for w in legal.NOT_A_COURT)
_DIGIT = "regexp_matches(x, '\\d')"
_DATE_OK = f"length(x) BETWEEN 7 AND 29 AND {_DIGIT}"
_TITLE_OK = lambda x: f"length({x}) BETWEEN 6 AND 199 AND NOT regexp_matches(trim(regexp_replace({x}, '(?i)\\s+(?:v\\.?|vs\\.?|VERSUS)\\s+(?:.|\\n)*$', '')), '{legal.NOT_A_PARTY}')"
_city = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(upper({c}), '\\b{n}\\b') THEN '{n}'" for n in sorted(legal.CITIES, key=len, reverse=True)) + " END"
_TIER, _TRAIL = _ex("header", h.DISTRICT), _ex("header", h.DISTRICT, 2)
_COURT = f"coalesce({_first('header', h.COURTS, _COURT_OK)}, CASE WHEN contains(header, 'PETITIONER') AND contains(header, 'RESPONDENT') THEN 'SUPREME COURT OF INDIA' END, CASE WHEN {_TIER} <> '' THEN upper({_TIER}) || ' COURT' || coalesce(', ' || coalesce({_city(_TRAIL)}, {_city('header')}), '') END)"
_FULL = "header || chr(10) || body"
_OUT = f"[upper(w[1]) || lower(w[2:]) FOR w IN string_split(nullif({_ex(_FULL, h.OUTCOME)}, ''), ' ')]"
_BENCH = f"[{_strip('x')} FOR x IN list_sort(list_distinct(regexp_extract_all(header, '{_q(h.JUDGE)}', 1)))]"


@query(f"""WITH h AS ({HEADERS}) SELECT id, {_COURT} AS court, {_first('header', h.NUMBERS, f'length(x) BETWEEN 4 AND 79 AND {_DIGIT}')} AS case_number,
coalesce({_first('header', h.DATES, _DATE_OK, _plain)}, {_first(_FULL, h.DATES, _DATE_OK, _plain)}) AS date, array_to_string({_OUT}, ' ') AS decision, array_to_string({_BENCH}, ';') AS bench FROM h""")
def header_metadata(spark, d):
    m = fixture(spark, d, HEADERS).select("id", h.metadata_of(F.col("header"), F.concat_ws("\n", "header", "body")).alias("m"))
    return m.select("id", "m.court", "m.case_number", "m.date", "m.decision", F.array_join("m.bench", ";").alias("bench"))


def _party(x: str) -> str:
    cut = f"regexp_replace({_strip(x)}, '(?i){h.THROUGH}', '')"
    lead = _ex(x, h.BEFORE_THROUGH)
    kept = f"CASE WHEN {lead} <> '' THEN {_strip(lead)} ELSE {_strip(f'''regexp_replace({x}, '(?i)Through\\s+.*', '', 'g')''')} END"
    p = f"CASE WHEN {_strip(cut)} = '' THEN {kept} ELSE {cut} END"
    for noise in h.PARTY_NOISE:
        p = f"regexp_replace({p}, '(?i){noise}', '', 'g')"
    return f"trim(regexp_replace({p}, '\\s+', ' ', 'g'))"


def _cleaned(rows: str) -> str:
    """Common tables over (id, title) that end in z (id, flat, cleaned)."""
    return f"""t AS ({rows}), f AS (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS flat FROM t),
p AS (SELECT *, CASE WHEN regexp_matches(flat, '{h.SIDES}') THEN [regexp_extract(flat, '^(.*?){h.SIDES}(.*)$', 1), regexp_extract(flat, '^(.*?){h.SIDES}(.*)$', 2)] END AS parts FROM f),
c AS (SELECT *, [{_party('x')} FOR x IN parts] AS c FROM p), z AS (SELECT id, flat, CASE WHEN length(c[1]) >= 3 AND length(c[2]) >= 3 THEN c[1] || ' v. ' || c[2] ELSE flat END AS cleaned FROM c)"""


@query(f"WITH {_cleaned(TITLES)} SELECT id, cleaned AS title FROM z")
def clean_titles(spark, d):
    return fixture(spark, d, TITLES).select("id", h.clean_title(F.col("title")).alias("title"))


_pair = lambda p, end: f"{_strip(_ex('header', p + '(?:' + end + ')'))} || ' v. ' || {_strip(_ex('header', p + '(?:' + end + ')', 2))}"
_has = lambda p, end: f"regexp_matches(header, '(?i){_q(p)}(?:{end})')"
_JUNK = " OR ".join(f"contains(lower(title), '{w.lower()}')" for w in h.NOT_IN_A_TITLE)
_BY = ", ".join(f"CASE WHEN {_has(p, e)} THEN {_pair(p, e)} END AS v{i}" for i, (p, e) in enumerate([(h.LABELLED, h.LABELLED_END), *h.VERSUS]))


@query(f"""WITH s AS ({HEADERS}), r AS (SELECT id, {_BY} FROM s),
u AS (SELECT id * 3 AS id, v0 AS title FROM r WHERE {_TITLE_OK('v0')} UNION ALL SELECT * FROM (SELECT id * 3 + 1 AS id, v1 AS title FROM r UNION ALL SELECT id * 3 + 2, v2 FROM r) WHERE NOT ({_JUNK})),
{_cleaned('SELECT * FROM u')}, ok AS (SELECT id // 3 AS id, id % 3 AS k, cleaned FROM z WHERE id % 3 = 0 OR ({_TITLE_OK('cleaned')} AND length(cleaned) < 120))
SELECT s.id, min_by(cleaned, k) AS title FROM s LEFT JOIN ok ON s.id = ok.id GROUP BY 1""")
def header_titles(spark, d):
    return fixture(spark, d, HEADERS).select("id", h.title_of(F.col("header")).alias("title"))


_ANSWER = """select o_orderkey as id, concat('The rule of ', case o_orderkey % 6 when 0 then 'Audi Alteram Partem' when 1 then 'non compos mentis' when 2 then 'compos mentis, ex post facto' when 3 then 'IN REM and in remedy' when 4 then 'ad hocs' else 'mens rea' end, case o_orderkey % 4 when 0 then ' binds; mens rea' when 1 then '' else ' decides de facto.' end) as answer from orders"""
_MEANING = "MAP {" + ", ".join(f"'{t}': '{_q(m)}'" for t, m in maxims.MAXIMS.items()) + "}"


@query(f"""WITH a AS ({_ANSWER}), m AS (SELECT id, string_split_regex(answer, '{maxims.ANY_MAXIM}') AS p, regexp_extract_all(answer, '{maxims.ANY_MAXIM}') AS t FROM a)
SELECT id, array_to_string([p[i] || CASE WHEN i <= len(t) THEN '[[' || t[i] || '||' || map_extract({_MEANING}, lower(t[i]))[1] || ']]' ELSE '' END FOR i IN range(1, len(p) + 1)], '') AS answer FROM m""")
def marked_maxims(spark, d):
    return fixture(spark, d, _ANSWER).select("id", maxims.marked(F.col("answer")).alias("answer"))


_MAXIMS = list(maxims.MAXIMS.items())


@query(counted_terms_sql(_ANSWER, "answer", ["term", "definition"], _MAXIMS))
def maxims_table(spark, d):
    """Maxims and meanings, and how many answers hold each."""
    return counted_terms(fixture(spark, d, _ANSWER), "answer", ["term", "definition"], _MAXIMS)


_NAMES = "MAP {" + ", ".join(f"'{a}': '{s}'" for a, s in splitting.SECTION_OF.items()) + "}"
_SECTIONS = f"""g AS ({PAGES}), x AS (SELECT doc, page, string_split_regex(txt, '{splitting.HEADING_LINE}') AS p, regexp_extract_all(txt, '{splitting.HEADING_LINE}', 1) AS n FROM g),
y AS (SELECT doc, page, unnest(range(1, len(p) + 1)) AS i, p, n FROM x), v AS (SELECT doc, page, i, {_strip('p[i]')} AS text, CASE WHEN i > 1 THEN map_extract({_NAMES}, upper(n[i - 1]))[1] END AS own FROM y),
w AS (SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY i) - 1 AS INTEGER) AS idx, text, last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, i) AS section FROM v WHERE text <> ''),
k AS (SELECT doc, page, idx, coalesce(section, 'PREAMBLE') AS section, text FROM w)"""


def _pages(spark, d):
    return splitting.split_sections(fixture(spark, d, PAGES), "doc", "page", "txt")


@query(f"WITH {_SECTIONS} SELECT * FROM k")
def page_sections(spark, d):
    return _pages(spark, d)


@query(f"WITH {_SECTIONS} SELECT doc, page, section, string_agg(text, ' ' ORDER BY idx) AS text, min(idx) AS idx FROM k GROUP BY 1, 2, 3")
def page_sections_merged(spark, d):
    return splitting.merge_in_order(_pages(spark, d), ["doc", "page"])


@query()
def parents_and_children(spark, d):
    """One sentence is carried on; SQL has no fold over sentences, so plain loops test it."""
    docs = table(spark, d, "documents").withColumns({"page": F.lit(1), "section": F.lit("FACTS")})
    return splitting.parents_and_children(docs, F.col("doc_id").cast("string"), "page", "section", "text", ["doc_id"], carry=1)


@query()
def judgment_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(splitting.judgment_chunks(F.col("text"))).alias("idx", "text"))


_FORMATS = ", ".join(located_sql(f"f{k}", "j", p, 0) for k, p in enumerate(legal.CITATION_FORMATS))
_CITED = " UNION ALL ".join(f"SELECT id, {k} AS f, start_, trim(regexp_replace(hit, '\\s+', ' ', 'g')) AS cite FROM f{k}" for k in range(len(legal.CITATION_FORMATS)))
_SHORT = " UNION ALL ".join(f"SELECT id, {k} AS f, '{n}' AS label, unnest(regexp_extract_all(txt, '(?i){p}')) AS cite FROM j" for k, (n, p) in enumerate(citations.SHORT_FORMS.items()))


@query(rf"""WITH RECURSIVE j AS ({LEGAL}), {_FORMATS}, {located_sql("p", "j", legal.PARTIES, 0)}, c AS ({_CITED}), s AS ({_SHORT}),
near AS (SELECT c.id, f, c.start_, cite, arg_max(p.start_, p.start_) AS at_, arg_max(trim(regexp_replace(p.hit, '\s+', ' ', 'g')), p.start_) AS party FROM c LEFT JOIN p ON p.id = c.id AND p.start_ <= c.start_ GROUP BY ALL),
o AS (SELECT id, cite, CAST(NULL AS VARCHAR) AS label, CASE WHEN start_ - at_ < {citations.NAME_REACH} THEN party END AS party, row_number() OVER (PARTITION BY id ORDER BY f, start_) AS n FROM near
UNION ALL SELECT id, cite, label, CAST(NULL AS VARCHAR), 1000 + row_number() OVER (PARTITION BY id ORDER BY f) FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM o), l AS (SELECT case_no, id, (SELECT arg_max(trim(regexp_replace(hit, '\s+', ' ', 'g')), i) FROM p WHERE p.id = j.id) AS own FROM j),
b AS (SELECT case_no, id, last_value(own IGNORE NULLS) OVER (PARTITION BY case_no ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
walk AS (SELECT id, 0::BIGINT AS k, before AS name, CAST([] AS VARCHAR[]) AS keys, CAST(NULL AS VARCHAR) AS citation, CAST(NULL AS VARCHAR) AS case_name, CAST(NULL AS VARCHAR) AS resolved_from, false AS new FROM b
UNION ALL SELECT id, k, CASE WHEN new THEN coalesce(case_, name) ELSE name END, CASE WHEN new THEN keys || [key] ELSE keys END, upper(cite), case_, label, new FROM (SELECT *, (label IS NULL OR name IS NOT NULL) AND NOT list_contains(keys, key) AS new FROM (
SELECT q.*, walk.name, walk.keys, coalesce(party, walk.name) AS case_, coalesce(party, walk.name, '') || chr(1) || upper(cite) AS key FROM walk JOIN q ON q.id = walk.id AND q.k = walk.k + 1)))
SELECT case_no, walk.id, citation, case_name, resolved_from FROM walk JOIN b ON b.id = walk.id WHERE new""")
def linked_citations(spark, d):
    return citations.case_citations(fixture(spark, d, LEGAL), "case_no", "id", "txt")


_BUILT = "b AS (SELECT doc_id, md5(text) AS h FROM documents), s AS (SELECT doc_id, CASE WHEN doc_id % 700 = 3 THEN 'other' ELSE md5(text) END AS o FROM documents WHERE doc_id % 1100 <> 5)"


@query(f"""WITH {_BUILT}, j AS (SELECT doc_id // 256 AS slice, count(*) AS n, bool_and(coalesce(o = h, false)) AS done FROM b LEFT JOIN s USING (doc_id) GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE done), 0) AS BIGINT) AS reused, CAST(coalesce(sum(n) FILTER (WHERE NOT done), 0) AS BIGINT) AS to_do, min(slice) FILTER (WHERE NOT done) * 256 AS first_to_do,
count(*) FILTER (WHERE NOT done) AS slices_to_do, CAST(round_even(coalesce(sum(n) FILTER (WHERE NOT done), 0) / 4.0, 0) AS BIGINT) AS seconds, CAST(round_even(coalesce(sum(n) FILTER (WHERE done), 0) / 4.0, 0) AS BIGINT) AS seconds_spared FROM j""")
def resume_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    # a store that lacks some rows and holds others with another text
    stored = docs.where("doc_id % 1100 <> 5").select("doc_id", F.when(F.col("doc_id") % 700 == 3, "other").otherwise(F.col("h")).alias("h"))
    return state.resume_plan(docs, stored, "doc_id", "doc_id", "h", 256)
