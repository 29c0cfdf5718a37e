"""Queries on cleaning texts, metadata, citations, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as tx
from ..operators import chunking, citations, statutes
from ..plans.base import fixture, located_sql, query
from ..plans.fixtures import ACTS, JUDGMENTS, LAWS
from ..sources.tables import table

_J = f"WITH j AS ({JUDGMENTS})"
_FIX = "text"
for _p, _r in tx.MISREADINGS:
    _FIX = f"regexp_replace({_FIX}, '(?i){_p}', '{_r}', 'g')"
_UNGLUE = lambda c: f"regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([.,;:])([A-Za-z])', '\\1 \\2', 'g')"
_SYMBOLS = lambda c: f"regexp_replace({c}, '(?m)^[\\s:,.\\-;]+', '', 'g')"
_TIDY = lambda c: f"array_to_string([x FOR x IN [trim(regexp_replace(y, '[ \\t\\r]+', ' ', 'g')) FOR y IN string_split({c}, chr(10))] IF x <> ''], chr(10))"
_FURN = lambda c: f"array_to_string([x FOR x IN string_split({c}, chr(10)) IF NOT regexp_matches(x, '(?i){'|'.join(f'(?:{p})' for p in tx.FURNITURE)}')], chr(10))"
_DEHY = lambda c: f"regexp_replace({c}, '([A-Za-z0-9_])-\\s*\\n\\s*([A-Za-z0-9_])', '\\1\\2', 'g')"


@query(f"SELECT doc_id, {_FIX} AS fixed FROM documents")
def misreadings_mended(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.corrected(F.col("text")).alias("fixed"))


@query(f"SELECT doc_id, {_SYMBOLS('text')} AS plain FROM documents")
def leading_symbols(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.without_leading_symbols(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {_DEHY('text')} AS joined FROM documents")
def dehyphenate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.dehyphenated(F.col("text")).alias("joined"))


@query(f"WITH s AS (SELECT doc_id, {_FURN(_DEHY('text'))} AS text FROM documents) SELECT doc_id, md5({_TIDY(_SYMBOLS(_UNGLUE(_FIX)))}) AS digest FROM s")
def clean_texts(spark, d):
    """The chain of cleaning steps but Unicode composition, which SQL lacks (see ``composed_texts``)."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.cleaned(F.col("text"), unicode=False)).alias("digest"))


@query("SELECT doc_id, md5(array_to_string([x FOR x IN [trim(y) FOR y IN string_split(replace(replace(text, chr(173), ''), chr(160), ' '), chr(10))] IF x <> ''], chr(10))) AS digest FROM documents")
def source_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.source_text(F.col("text"))).alias("digest"))


_SCRIPT = ["en", *[x for x in tx.SCRIPTS if x != "en"]]
_COUNTS = ", ".join(f"length(regexp_replace(text, '[^\\x{{{tx.SCRIPTS[x][0]:x}}}-\\x{{{tx.SCRIPTS[x][1]:x}}}]', '', 'g'))" for x in _SCRIPT)


@query(f"WITH c AS (SELECT doc_id, [{_COUNTS}] AS n FROM documents), m AS (SELECT *, {_SCRIPT!r}[list_position(n, list_max(n))] AS first FROM c) SELECT doc_id, first AS main, array_to_string([x FOR x, i IN {_SCRIPT!r} IF x <> first AND n[i] / greatest(list_sum(n), 1) > 0.05], ',') AS others FROM m")
def language_of(spark, d):
    x = table(spark, d, "documents").select("doc_id", tx.languages(F.col("text")).alias("l"))
    return x.select("doc_id", F.col("l.primary").alias("main"), F.array_join("l.secondary", ",").alias("others"))


@query("""WITH p AS (SELECT doc_id, source, string_split(trim(text), chr(10)) AS l FROM documents), n AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
e AS (SELECT source, 'first' AS place, substr(trim(l[1]), 1, 80) AS line FROM p UNION ALL SELECT source, 'last', substr(trim(l[-1]), 1, 80) FROM p WHERE len(l) > 1)
SELECT source, place, line, count(*) AS pages FROM e JOIN n USING (source) WHERE pages >= 4 GROUP BY source, place, line, n.pages HAVING count(*) / n.pages >= 0.02 AND length(line) > 5""")
def running_headers(spark, d):
    return chunking.running_lines(table(spark, d, "documents"), "source", "text", 0.02)


def _sorted_all(patterns, group=0):
    return " || ".join(f"regexp_extract_all(txt, '{p}', {group})" for p in patterns)


_LINE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(_J + f" SELECT id, array_to_string(list_sort(list_distinct([upper({_LINE.format(x='x')}) FOR x IN {_sorted_all(legal.CITATION_FORMATS)}])), ';') AS cites FROM j")
def citation_formats(spark, d):
    return fixture(spark, d, JUDGMENTS).select("id", F.array_join(legal.citations(F.col("txt")), ";").alias("cites"))


@query(_J + f" SELECT id, array_to_string(list_sort(list_distinct([{_LINE.format(x='x')} FOR x IN {_sorted_all(legal.PROVISIONS)} IF length(trim(x)) > 5])), ';') AS provisions FROM j")
def provisions(spark, d):
    return fixture(spark, d, JUDGMENTS).select("id", F.array_join(legal.provisions(F.col("txt")), ";").alias("provisions"))


_CASES = f"[regexp_replace({_LINE.format(x='x')}, '(?i)^(?:In|See|Re|Also|The)\\s+', '') FOR x IN regexp_extract_all(txt, '{legal.PARTIES}')]"


@query(_J + f", c AS (SELECT id, {_CASES} AS c FROM j) SELECT id, array_to_string(list_sort(list_distinct([x FOR x IN c IF (contains(x, ' v.') OR contains(x, ' v ') OR contains(x, ' V.')) AND len([y FOR y IN regexp_split_to_array(x, '(?i)\\s+v\\.?\\s+') IF trim(y) <> '' AND (length(trim(y)) <= 5 OR length(trim(y)) >= 60)]) = 0])), ';') AS cases FROM c")
def case_names(spark, d):
    return fixture(spark, d, JUDGMENTS).select("id", F.array_join(legal.case_names(F.col("txt")), ";").alias("cases"))


@query(_J + f" SELECT id, array_to_string(list_sort(list_distinct([CAST(x AS INTEGER) FOR x IN {_sorted_all(legal.PARAGRAPHS, 1)}])), ',') AS paras FROM j")
def paragraph_numbers(spark, d):
    return fixture(spark, d, JUDGMENTS).select("id", F.array_join(legal.paragraph_numbers(F.col("txt")).cast("array<string>"), ",").alias("paras"))


_KIND = f"CASE WHEN upper(section) IN ('KEY_POINTS', 'RATIO', 'CONCLUSION') THEN 'ratio' WHEN upper(section) = 'REASONING' THEN CASE WHEN {' OR '.join(f'contains(lower(txt), {p!r})' for p in legal.HOLDING)} THEN 'ratio' WHEN {' OR '.join(f'contains(lower(txt), {p!r})' for p in legal.PASSING)} THEN 'obiter' ELSE 'reasoning' END WHEN upper(section) IN ('ORDER', 'DECISION') THEN 'order' WHEN upper(section) IN ('FACTS', 'BACKGROUND', 'PREAMBLE') THEN 'facts' ELSE 'other' END"
_CITY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(upper(court), '\\b{c}\\b') THEN '{c}' END" for c in sorted(legal.CITIES, key=len, reverse=True)) + ")"
_COURT = f"length(court) > 5 AND length(court) < 100 AND (contains(upper(court), 'COURT') OR contains(upper(court), 'TRIBUNAL')) AND NOT regexp_matches(court, '\\. [a-z]') AND NOT ({' OR '.join(f'contains(upper(court), {w!r})' for w in legal.NOT_A_COURT)})"


@query(_J + f""" SELECT id, {_KIND} AS kind, {_CITY} AS city, {_COURT} AS court_ok, length(dated) > 6 AND length(dated) < 30 AND regexp_matches(dated, '\\d') AS date_ok, length(dated) > 3 AND length(dated) < 80 AND regexp_matches(dated, '\\d') AS number_ok,
 length(title) > 5 AND length(title) < 200 AND NOT regexp_matches(trim(regexp_split_to_array(title, '(?i)\\s+(?:v\\.?|vs\\.?|VERSUS)\\s+')[1]), '{legal.NOT_A_PARTY}') AS title_ok,
 coalesce(TRY_CAST(nullif(regexp_extract(dated, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), '') AS INTEGER), 0) AS year, nullif(regexp_extract(txt, '(?i)\\((\\d{{4}})\\)\\s*\\d+\\s*SCC\\s*(\\d+).*?p(?:age)?[\\.:]?\\s*(\\d+)', 3), '') AS page FROM j""")
def passage_metadata(spark, d):
    c = F.col
    return fixture(spark, d, JUDGMENTS).select(
        "id", legal.passage_kind(c("section"), c("txt")).alias("kind"), legal.court_city(c("court")).alias("city"), legal.court_ok(c("court")).alias("court_ok"), legal.date_ok(c("dated")).alias("date_ok"),
        legal.case_number_ok(c("dated")).alias("number_ok"), legal.title_ok(c("title")).alias("title_ok"), legal.year_of(c("dated")).alias("year"), legal.pinpoint_page(c("txt")).alias("page"))


@query(_J + ", k AS (SELECT id, list_sort(list_distinct(string_split(lower(regexp_replace(txt, '[^A-Za-z ]', ' ', 'g')), '  '))) AS k FROM j) SELECT id, array_to_string([x FOR x IN [" + ", ".join(
    f"CASE WHEN len([w FOR w IN k IF lower(w) = '{n.lower()}' OR " + " OR ".join(f"contains(lower(w), '{t}') OR contains('{t}', lower(w))" for t in ts) + f"]) > 0 THEN '{n}' END" for n, ts in legal.CONCEPTS.items()) + "] IF x IS NOT NULL], ';') AS concepts FROM k")
def concepts(spark, d):
    k = F.split(F.lower(F.regexp_replace("txt", "[^A-Za-z ]", " ")), "  ")
    return fixture(spark, d, JUDGMENTS).select("id", F.array_join(legal.concepts_of(k), ";").alias("concepts"))


@query(_J + ", g AS (SELECT id, txt, [x FOR x IN [" + ", ".join(f"CASE WHEN contains(lower(txt), '{t}') THEN '{v}' END" for t, v in legal.GLOSSES.items()) + "] IF x IS NOT NULL] AS g FROM j) SELECT id, md5(CASE WHEN len(g) > 0 THEN txt || chr(10) || chr(10) || '[Semantics: ' || array_to_string(g, ', ') || ']' ELSE txt END) AS digest FROM g")
def glossed_texts(spark, d):
    return fixture(spark, d, JUDGMENTS).select("id", F.md5(legal.with_glosses(F.col("txt"))).alias("digest"))


@query(_J + ", c AS (SELECT DISTINCT unnest(regexp_extract_all(txt, '\\(\\d{4}\\)\\s*\\d+\\s*SCC\\s*\\d+|AIR\\s*\\d+\\s*SC\\s*\\d+')) AS cite FROM j), m AS (SELECT cite, lower(trim(regexp_replace(cite, '\\s+', ' ', 'g'))) AS k FROM c) SELECT cite, CASE " + " ".join(
    f"WHEN k = '{a}' THEN '{b}'" for a, b in legal.CANONICAL.items()) + " " + " ".join(f"WHEN regexp_replace(k, '[().]', '', 'g') = '{a}' THEN '{b}'" for a, b in legal.CANONICAL.items()) + " ELSE k END AS name FROM m")
def canonical_citations(spark, d):
    c = fixture(spark, d, JUDGMENTS).select(F.explode(legal.found(F.col("txt"), citations.FULL_CITE)).alias("cite")).distinct()
    return c.select("cite", legal.canonical(F.col("cite")).alias("name"))


_L = f"WITH l AS ({LAWS}), t AS (SELECT *, trim(txt) AS body, document || ' Section ' || section || '. ' || title || '.' AS head FROM l WHERE trim(txt) <> '')"


@query(_L + " SELECT document || '-s' || section || '-0' AS chunk_id, ord, md5(head || ' ' || body) AS digest, CAST(0 AS INTEGER) AS chunk_index, CAST(1 AS INTEGER) AS chunk_count FROM t")
def section_whole_chunks(spark, d):
    c = chunking.section_whole(fixture(spark, d, LAWS), ["ord"])
    return c.select("chunk_id", "ord", F.md5("text").alias("digest"), "chunk_index", "chunk_count")


@query(_L + r""", w AS (SELECT ord, document, section, row_number() OVER () AS u, regexp_extract_all(head || ' ' || body, '\S+') AS ws FROM t), a AS (SELECT *, sum(len(ws)) OVER (ORDER BY ord) - len(ws) AS before, sum(len(ws)) OVER () AS total FROM w),
x AS (SELECT ord, section, before + i AS pos, total, ws[i + 1] AS word FROM (SELECT *, unnest(range(len(ws))) AS i FROM a)), k AS (SELECT unnest(range(0, (SELECT ceil(greatest(max(total) - 220, 0) / 170.0)::BIGINT FROM x) + 1)) AS chunk_index)
SELECT 'win-' || chunk_index AS chunk_id, arg_min(ord, pos) AS ord, arg_min(section, pos) AS section, count(*) AS n_words, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM k JOIN x ON pos BETWEEN chunk_index * 170 AND chunk_index * 170 + 219 GROUP BY chunk_index""")
def section_windows(spark, d):
    """Windows run on over all sections; a window is the section's that its first word is from."""
    c = chunking.build("fixed_window", fixture(spark, d, LAWS), ["ord", "section"])
    return c.select("chunk_id", "ord", "section", "n_words", F.md5("text").alias("digest"))


@query(_L + ", s AS (SELECT ord, regexp_split_to_array(regexp_replace(body, '([.;:])\\s+([A-Z(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM t) SELECT ord, len(s) AS n, s[1] AS first, s[-1] AS last FROM s")
def sentences(spark, d):
    s = fixture(spark, d, LAWS).where("trim(txt) <> ''").select("ord", chunking.sentences(F.trim("txt")).alias("s"))
    return s.select("ord", F.size("s").cast("long").alias("n"), F.get("s", 0).alias("first"), F.element_at("s", -1).alias("last"))


@query(_L + ", k AS (SELECT document, section, ord, CAST(regexp_extract(section, '^(\\d+)', 1) AS INTEGER) AS n, regexp_extract(section, '^\\d+([A-Z]*)$', 1) AS sx FROM l), m AS (SELECT *, max(n * 100 + length(sx)) OVER (PARTITION BY document ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM k) SELECT document, ord, section FROM m WHERE top IS NULL OR n * 100 + length(sx) > top")
def monotone_sections(spark, d):
    return statutes.monotone(fixture(spark, d, LAWS), "document", "ord", "section").select("document", "ord", "section")


@query(_L + " SELECT ord, regexp_matches(body, '(?i)^\\s*\\[?.*?\\]?\\s*Rep(?:ealed)?\\.?\\s+by\\b') AS repealed, coalesce(CAST(nullif(regexp_extract(section, '^(\\d+)', 1), '') AS INTEGER), 1000000) AS n, regexp_extract(section, '^\\d+([A-Z]*)$', 1) AS suffix FROM t")
def section_records(spark, d):
    k = legal.section_key(F.col("section"))
    return fixture(spark, d, LAWS).where("trim(txt) <> ''").select("ord", F.trim("txt").rlike(statutes.REPEALED).alias("repealed"), k["n"].alias("n"), k["suffix"].alias("suffix"))


@query(_J + " SELECT id, md5(title || '::' || court || '::' || substr(txt, 1, 160)) AS chunk_id FROM j")
def stable_ids(spark, d):
    return fixture(spark, d, JUDGMENTS).select("id", legal.stable_id(F.col("title"), F.col("court"), F.substring("txt", 1, 160)).alias("chunk_id"))


@query(_J + """, w AS (SELECT id, case_no, CASE WHEN upper(section) = 'ISSUES' AND length(txt) > 180 THEN 'REASONING' ELSE upper(section) END AS section, txt FROM j WHERE len([x FOR x IN regexp_split_to_array(txt, '[ \\t\\n\\r]+') IF x <> '']) >= 5)
SELECT case_no, section, md5(string_agg(txt, ' ' ORDER BY id)) AS digest, count(*) AS parts FROM w GROUP BY 1, 2""")
def merged_sections(spark, d):
    g = chunking.guarded(fixture(spark, d, JUDGMENTS).withColumn("section", F.upper("section")), "section", "txt", "ISSUES", 180)
    return chunking.merged(g, ["case_no", "section"], "id", "txt").select("case_no", "section", F.md5("txt").alias("digest"), "parts")


# RE2 knows no look-behind: a break's sign is not after a lone s or v, nor after No
_BREAK = r"(?:^|[^sov]|\w[sv]|(?:^|[^N])o|\wNo)[.;]\s+[A-Z(\[]"
_NAMED = ", ".join(located_sql(f"n{k}", "j", f"(?i){p}", 0) for k, p in enumerate(legal.STATUTES.values()))
_NAMES = " UNION ALL ".join(f"SELECT id, start_, end_, '{n}' AS name FROM n{k}" for k, n in enumerate(legal.STATUTES))


@query(_J + rf""", {_NAMED}, named AS ({_NAMES}), {located_sql("l", "j", f"(?i){citations.SECTION_LISTS}")},
near AS (SELECT l.id, l.i, greatest(l.start_ - n.end_, n.start_ - l.end_, 0) AS far, n.start_ AS at_, name, substr(txt, least(n.end_, l.end_) + 1, greatest(n.start_, l.start_) - least(n.end_, l.end_)) AS gap FROM l JOIN named n USING (id) JOIN j USING (id)),
own AS (SELECT id, i, arg_min(name, (far, at_, name)) AS name FROM near WHERE far <= {citations.REACH} AND NOT regexp_matches(gap, '{_BREAK}') GROUP BY 1, 2),
x AS (SELECT l.id, l.i, name, upper(trim(v)) AS v, k FROM (SELECT id, i, unnest(regexp_split_to_array(g1, '(?i)\s*(?:,|and|&|/)\s*')) AS v, unnest(range(100)) AS k FROM l) l LEFT JOIN own USING (id, i) WHERE v IS NOT NULL),
q AS (SELECT id, name || ' ' || v AS s, min((i, k)) AS o FROM x WHERE name IS NOT NULL GROUP BY 1, 2), u AS (SELECT id, v AS s, min((i, k)) AS o FROM x WHERE name IS NULL GROUP BY 1, 2)
SELECT j.id, coalesce((SELECT string_agg(s, ';' ORDER BY o) FROM q WHERE q.id = j.id), '') AS qualified, coalesce((SELECT string_agg(s, ';' ORDER BY o) FROM u WHERE u.id = j.id), '') AS unqualified FROM j""")
def attributed_sections(spark, d):
    x = fixture(spark, d, JUDGMENTS).select("id", citations.attributed_sections(F.col("txt")).alias("s"))
    return x.select("id", F.array_join("s.qualified", ";").alias("qualified"), F.array_join("s.unqualified", ";").alias("unqualified"))


_NEAR = f"""{located_sql("l", "j", f"(?i){citations.NEAR_SECTIONS}")}, w AS (SELECT l.id, case_no, upper(g1) AS section, substr(txt, greatest(start_ - {citations.NEAR}, 0) + 1, end_ + {citations.NEAR} - greatest(start_ - {citations.NEAR}, 0)) AS around FROM l JOIN j USING (id)),
s AS ({" UNION ALL ".join(f"SELECT id, case_no, '{n}' AS statute, section FROM w WHERE regexp_matches(around, '(?i){p}')" for n, p in citations.NEAR_STATUTES.items())})"""


@query(_J + f", {_NEAR} SELECT statute || ':' || section AS section, count(DISTINCT case_no) AS cases FROM s GROUP BY 1")
def sections_near_statutes(spark, d):
    x = fixture(spark, d, JUDGMENTS).select("case_no", F.explode(citations.sections_by_proximity(F.col("txt"))).alias("section")).distinct()
    return x.groupBy("section").agg(F.count("*").alias("cases"))


_HELD_SECTIONS = "select case p_partkey % 2 when 0 then 'IPC' else 'BNS' end as document, cast(p_partkey % 512 as string) as section, p_name as title from part"


@query(_J + f", h AS (SELECT DISTINCT document AS statute, section FROM ({_HELD_SECTIONS})), {_NEAR}, k AS (SELECT DISTINCT id, case_no, statute, section FROM s JOIN h USING (statute, section)) SELECT statute, section, count(*) AS judgments, count(DISTINCT case_no) AS cases, min(id) AS first_id FROM k GROUP BY 1, 2")
def held_cross_references(spark, d):
    """Judgments of each section that the corpus holds, by the statute named near it."""
    x = citations.cross_references(fixture(spark, d, JUDGMENTS), fixture(spark, d, _HELD_SECTIONS), ["id", "case_no"], "txt")
    return x.groupBy("statute", "section").agg(F.count("*").alias("judgments"), F.countDistinct("case_no").alias("cases"), F.min("id").alias("first_id"))


@query(_J + f""", h AS (SELECT DISTINCT document AS statute, section FROM ({_HELD_SECTIONS})), {_NEAR}, k AS (SELECT DISTINCT id, statute, section FROM s JOIN h USING (statute, section)),
b AS (SELECT DISTINCT id, upper(x) AS section FROM (SELECT id, unnest(regexp_extract_all(txt, '{citations.SECTION}', 1)) AS x FROM j)) SELECT (SELECT count(*) FROM j) AS judgments, (SELECT count(DISTINCT (statute, section)) FROM k) AS sections, (SELECT count(*) FROM k) AS links,
(SELECT count(*) FROM b JOIN h ON h.statute = 'IPC' AND h.section = b.section) AS bare_links""")
def cross_reference_totals(spark, d):
    """How many links there are, and how many numbers alone would give."""
    j, held = fixture(spark, d, JUDGMENTS), fixture(spark, d, _HELD_SECTIONS)
    x = citations.cross_references(j, held, ["id"], "txt").agg(F.countDistinct("statute", "section").alias("sections"), F.count("*").alias("links"))
    bare = j.select("id", F.explode(F.array_distinct(F.transform(citations.sections(F.col("txt")), F.upper))).alias("section"))
    bare = bare.join(held.where("document = 'IPC'").select("section").distinct(), "section").agg(F.count("*").alias("bare_links"))
    return j.agg(F.count("*").alias("judgments")).crossJoin(x).crossJoin(bare)  # one row each


_HEADING = "length(x) BETWEEN 1 AND 90 AND NOT contains('.;:,', right(x, 1)) AND (starts_with(x, 'Of ') OR (upper(x) = x AND lower(x) <> x))"
_RE2 = lambda p: p.replace("(?dms)", "(?ms)").replace("(?dm)", "(?m)")


@query(rf"""WITH j AS (SELECT ord AS id, txt FROM ({ACTS})), {located_sql("m", "j", _RE2(statutes.SECTION), 2)}, {located_sql("c", "j", _RE2(statutes.CHAPTER))},
k AS (SELECT *, trim(regexp_replace(g2, '\s+', ' ', 'g')) AS title, lpad(regexp_extract(g1, '^\d+'), 4, '0') || regexp_extract(g1, '[A-Z]*$') AS key FROM m),
f AS (SELECT *, max(CASE WHEN NOT regexp_matches(title, '{statutes.FOOTNOTE}') THEN key END) OVER (PARTITION BY id ORDER BY start_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM k),
o AS (SELECT *, NOT regexp_matches(title, '{statutes.FOOTNOTE}') AND (top IS NULL OR key > top) AS own FROM f), p AS (SELECT *, sum(own::INT) OVER (PARTITION BY id ORDER BY start_) - 1 AS position FROM o),
g AS (SELECT id, position, min(start_) AS start_, arg_min(g1, start_) AS section, arg_min(title, start_) AS title, regexp_replace(string_agg(CASE WHEN own THEN after ELSE hit || after END, '' ORDER BY start_), '^\s+|\s+$', '', 'g') AS body FROM p WHERE position >= 0 GROUP BY 1, 2),
l AS (SELECT *, string_split(body, chr(10)) AS x, list_min([n FOR n IN range(1, 7) IF regexp_matches(string_split(body, chr(10))[-n], '{statutes.MARGIN}')]) AS n FROM g),
t AS (SELECT *, x[1:len(x) - coalesce(n, 0)] AS y FROM l), b AS (SELECT *, y[1:coalesce(list_max([z FOR z IN range(1, len(y) + 1) IF NOT ({_HEADING.replace("x", "trim(y[z])")})]), 0)] AS z FROM t),
h AS (SELECT b.id, position, arg_max('CHAPTER ' || c.g1, c.start_) AS chapter, arg_max(trim(string_split(ltrim(substr(txt, c.end_ + 1, 200), chr(10)), chr(10))[1]), c.start_) AS chapter_title FROM b JOIN c ON c.id = b.id AND c.start_ <= b.start_ JOIN j ON j.id = b.id GROUP BY 1, 2)
SELECT b.id AS ord, position::BIGINT AS position, section, title, trim(regexp_replace(array_to_string(z, chr(10)), '\s+', ' ', 'g')) AS text, coalesce(chapter, '') AS chapter, coalesce(chapter_title, '') AS chapter_title,
regexp_matches(trim(array_to_string(z, chr(10))), '{statutes.REPEALED}') AS repealed FROM b LEFT JOIN h USING (id, position)""")
def parsed_sections(spark, d):
    """Sections of whole acts, with their chapters, margins and repeals."""
    return statutes.parse(fixture(spark, d, ACTS), "ord", "txt")


@query()
def composed_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.cleaned(F.col("text"))).alias("digest"))


@query(_L.replace("WITH", "WITH RECURSIVE", 1) + r""", s AS (SELECT ord, document, section, head, body, [x FOR x IN [trim(y) FOR y IN regexp_split_to_array(regexp_replace(body, '([.;:])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))] IF x <> ''] AS s FROM t),
walk AS (SELECT ord, 0 AS i, CAST([] AS VARCHAR[]) AS now, 0 AS n, CAST([] AS VARCHAR[]) AS done FROM s UNION ALL SELECT ord, i + 1, CASE WHEN over_ THEN [now[-1], one] ELSE now || [one] END, CASE WHEN over_ THEN len(regexp_extract_all(now[-1], '\S+')) ELSE n END + w,
CASE WHEN over_ THEN done || [array_to_string(now, ' ')] ELSE done END FROM (SELECT *, len(now) > 0 AND n + w > 12 AS over_ FROM (SELECT walk.*, s[i + 1] AS one, len(regexp_extract_all(s[i + 1], '\S+')) AS w FROM walk JOIN s USING (ord) WHERE i < len(s)))),
p AS (SELECT s.*, CASE WHEN len(regexp_extract_all(body, '\S+')) <= 12 THEN [body] ELSE done || [array_to_string(now, ' ')] END AS pieces FROM s JOIN walk USING (ord) WHERE i = len(s.s)), x AS (SELECT *, unnest(range(len(pieces))) AS k FROM p)
SELECT document || '-s' || section || '-' || k AS chunk_id, ord, k::INT AS chunk_index, len(pieces)::INT AS chunk_count, md5(head || ' ' || pieces[k + 1]) AS digest FROM x""")
def packed_sentences(spark, d):
    """Greedy packing of sentences with one carried over."""
    return chunking.section_split(fixture(spark, d, LAWS), ["ord"], 12).select("chunk_id", "ord", "chunk_index", "chunk_count", F.md5("text").alias("digest"))


_CANONICAL = "CASE " + " ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in legal.CANONICAL.items()) + " " + " ".join(f"WHEN regexp_replace(k, '[().]', '', 'g') = '{a}' THEN '{b}'" for a, b in legal.CANONICAL.items()) + " ELSE k END"


@query(_J + rf""", t AS (SELECT case_no, id, txt || CASE id % 3 WHEN 0 THEN ' Ibid. applies.' WHEN 1 THEN ' See supra and ante.' ELSE ' As in id. before.' END AS txt FROM j),
f AS (SELECT case_no, id, regexp_extract_all(txt, '(?i){citations.FULL_CITE}') AS c, regexp_extract_all(txt, '(?i){citations.SHORT_CITE}') AS short FROM t),
e AS (SELECT case_no, id, pos, {_CANONICAL} AS name FROM (SELECT case_no, id, unnest(range(1, len(c) + 1)) AS pos, lower(trim(regexp_replace(unnest(c), '\s+', ' ', 'g'))) AS k FROM f)),
w AS (SELECT case_no, id, pos, list(name) OVER (PARTITION BY case_no ORDER BY id, pos ROWS BETWEEN {citations.WINDOW - 1} PRECEDING AND CURRENT ROW) AS recent FROM e), l AS (SELECT case_no, id, arg_max(recent, pos) AS recent FROM w GROUP BY 1, 2),
o AS (SELECT case_no, id, list(name ORDER BY pos) AS own FROM e GROUP BY 1, 2), r AS (SELECT f.case_no, f.id, f.short, own, last_value(recent IGNORE NULLS) OVER (PARTITION BY f.case_no ORDER BY f.id ROWS UNBOUNDED PRECEDING) AS recent FROM f LEFT JOIN l USING (case_no, id) LEFT JOIN o USING (case_no, id)),
s AS (SELECT case_no, id, own, recent, unnest(short) AS label FROM r), x AS (SELECT case_no, id, label, CASE lower(replace(label, '.', '')) WHEN 'ibid' THEN coalesce(own[-1], recent[-1]) WHEN 'id' THEN recent[-1] WHEN 'supra' THEN coalesce(recent[-2], recent[-1]) WHEN 'ante' THEN recent[1] END AS resolved FROM s)
SELECT DISTINCT * FROM x WHERE resolved IS NOT NULL""")
def resolved_short_citations(spark, d):
    t = F.concat("txt", F.when(F.col("id") % 3 == 0, " Ibid. applies.").when(F.col("id") % 3 == 1, " See supra and ante.").otherwise(" As in id. before."))
    return citations.resolve_chunks(fixture(spark, d, JUDGMENTS).withColumn("txt", t), "case_no", "id", "txt")


@query(_J + ", x AS (SELECT case_no, id, section, coalesce(last_value(CASE WHEN id % 4 = 0 THEN upper(section) END IGNORE NULLS) OVER (PARTITION BY case_no ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'PREAMBLE') AS active FROM j) SELECT id, active FROM x")
def active_section(spark, d):
    j = fixture(spark, d, JUDGMENTS).withColumn("named", F.when(F.col("id") % 4 == 0, F.upper("section")))
    return chunking.carry_forward(j, "case_no", "id", "named", "active").select("id", F.coalesce("active", F.lit("PREAMBLE")).alias("active"))


@query(_J + " SELECT id, coalesce(nullif(dated, ''), nullif(section, ''), 'Unknown') AS label, row_number() OVER (PARTITION BY case_no ORDER BY id) - 1 AS chunk_index FROM j")
def chunk_labels(spark, d):
    label = F.coalesce(F.nullif(F.col("dated"), F.lit("")), F.nullif(F.col("section"), F.lit("")), F.lit("Unknown"))
    return fixture(spark, d, JUDGMENTS).select("id", label.alias("label"), (F.row_number().over(Window.partitionBy("case_no").orderBy("id")) - 1).cast("long").alias("chunk_index"))
