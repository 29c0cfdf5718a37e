import math
import os
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import legal
from tessera.functions import text as tx
from tessera.operators import chunking, citations, evaluation, gate, graph, joins, ranking, selection, state, statutes
from tessera.sources import nested, tables
from tessera.streaming import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(frame, cols):
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else "" if v is None or v is pd.NA else str(v)
    return sorted([text(v) for v in r] for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(got, cols) == plain(want, cols)


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_duplicates_close_up(spark):
    run = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B")], "query_id int, rank int, doc_id string")
    r = evaluation.metrics_at(run, spark.createDataFrame([(1, "B")], "query_id int, doc_id string"), 2).first()
    assert (r.precision, r.hit, r.rr, r.ndcg) == (0.5, 1, 0.5, round(1 / math.log2(3), 6))


def test_a_source_without_a_weight_weighs_one(spark):
    df = spark.createDataFrame([(1, "a", 7, 0.5), (1, "b", 7, 0.1)], "q int, source string, id int, score double")
    assert ranking.fuse(df, ["q"], "source", "score", "id", {"a": 0.5}).first().fused == round(1.5 / 61, 9)


def test_statute_sections_of_a_text(spark):
    text = "CHAPTER II\nOf things\n1. Title one.--Body one.\n2.\nNext title\n2. Next title.--Body two, see s. 1.\nOf other things\n1. Subs. by Act 27 of 1870.--x\n3. Rep. by Act 4.--y\n1*[4. Acts done.--[Old words.] Rep. by Act 3."
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "No section here."), (5, "9. Only one.--\n")], "law int, txt string")
    got = [r for r in statutes.parse(d, "law", "txt").orderBy("law", "position").collect()]
    assert [(r.section, r.title, r.chapter, r.chapter_title) for r in got[:3]] == [
        ("1", "Title one", "CHAPTER II", "Of things"), ("2", "Next title", "CHAPTER II", "Of things"), ("4", "Acts done", "CHAPTER II", "Of things")]
    assert got[0].text == "Body one." and got[2].repealed and not got[0].repealed
    assert [(r.law, r.section, r.text, r.chapter) for r in got[3:]] == [(5, "9", "", "")]


@pytest.mark.parametrize("text, want", [
    ("body\n421.\nDishonest removal of property", "body"), ("body line.\nOf fraudulent deeds", "body line."), ("a b.\nOF THEFT\nOf robbery", "a b."), ("keep 12.\nthis", "keep 12.\nthis"), ("OF ALL", ""), ("one", "one"), ("", "")])
def test_margins_at_the_end_of_a_section(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(statutes.without_margin(F.col("t")).alias("t")).first().t == want


def test_matches_have_their_places(spark):
    import re

    from tessera.functions.places import located

    texts = ["", "abc", "x12y3", "12", "é1 \U0001f600 22\n333", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in d.select("i", located(F.col("t"), r"([0-9])([0-9]*)", 1, 2).alias("m")).collect():
        want = [(m.start(), m.end(), m[0], m[1], m[2]) for m in re.finditer(r"([0-9])([0-9]*)", texts[r.i] or "")]
        assert [tuple(m) for m in r.m] == want


def test_sections_belong_to_the_nearest_statute(spark):
    texts = [
        "Under Sections 302, 34 and 120B of the Indian Penal Code. Clause 3 of the notification and section 5 of that circular. Section 27 of the Evidence Act; s. 27 again.",
        "Section 4 of the Act. The Indian Penal Code is old.", "IPC u/s 420", "section 7 " + "x" * 130 + " IPC", "", None, "IPC section 1; BNS section 2, section 3 IPC"]
    want = [(["IPC 302", "IPC 34", "IPC 120B", "Evidence 27"], ["5"]), ([], ["4"]), (["IPC 420"], []), ([], ["7"]), ([], []), ([], []), (["IPC 1", "BNS 2", "IPC 3"], [])]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", citations.attributed_sections(F.col("t")).alias("s"), citations.sections_by_proximity(F.col("t")).alias("n"))
    rows = sorted(d.collect(), key=lambda r: r.i)
    assert [((r.s.qualified or []), (r.s.unqualified or [])) if r.s else ([], []) for r in rows] == want
    assert rows[0].n == ["IPC:302", "IPC:5"] and rows[2].n == ["IPC:420"]


def test_short_citations_take_the_window(spark):
    df = spark.createDataFrame([(1, 1, "(2017) 10 SCC 1 and AIR 1999 SC 5"), (1, 2, "see ibid.4 and supra"), (1, 3, "ante"), (2, 1, "id. alone")], "doc int, n int, t string")
    got = sorted((r.doc, r.n, r.label, r.resolved) for r in citations.resolve_chunks(df, "doc", "n", "t").collect())
    assert got == [(1, 2, "ibid.", "air 1999 sc 5"), (1, 2, "supra", "puttaswamy_2017"), (1, 3, "ante", "puttaswamy_2017")]


def test_two_matched_for_one_other(spark):
    df = spark.range(9).withColumn("m", F.col("id") < 6)
    got = [r.m for r in selection.interleave(df, F.col("m"), "id").orderBy("place").collect()]
    assert got == [True, True, False] * 3


def test_packing_carries_a_sentence(spark):
    df = spark.createDataFrame([(["a b c", "d e", "f g h", "i"],)], "s array<string>")
    assert df.select(chunking.packed(F.col("s"), 5)).first()[0] == ["a b c d e", "d e f g h", "f g h i"]


def test_chapter_in_force_and_running_lines(spark):
    s = spark.createDataFrame([("x", 5, "1"), ("x", 25, "2")], "doc string, at int, section string")
    c = spark.createDataFrame([("x", 10, "CHAPTER I"), ("x", 20, "CHAPTER II")], "doc string, at int, chapter string")
    assert sorted((r.section, r.chapter) for r in statutes.chapters_in_force(s, c, "doc", "at", "chapter").collect()) == [("1", ""), ("2", "CHAPTER II")]
    pages = spark.createDataFrame([("d", f"Running head\nbody {i}") for i in range(4)], "doc string, t string")
    assert [(r.place, r.line) for r in chunking.running_lines(pages, "doc", "t").collect()] == [("first", "Running head")]
    assert pages.select(chunking.without_lines(F.col("t"), F.array(F.lit("Running head")))).first()[0] == "\nbody 0"


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"id": 1, "t": "u"}')
    (tmp_path / "a" / "y.json").write_text("{broken")
    got = tables.json_documents(spark, str(tmp_path / "a"), "id int, t string").collect()
    assert sorted((r.id is None, r._corrupt is None) for r in got) == [(False, True), (True, False)]
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "q.pdf").write_bytes(b"<html>")
    assert sorted(r.is_pdf for r in tables.binaries(spark, str(tmp_path)).collect()) == [False, True]
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    seen = []
    files.ingest(spark, str(tmp_path / "in"), "k int, v string", "k", str(tmp_path / "ck"), lambda df, n: seen.extend(r.k for r in df.collect())).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_passages_carry_forty_words(spark):
    df = spark.createDataFrame([(["a " * 30, "b " * 30, "c " * 15, "d " * 30],)], "s array<string>").select(F.transform("s", lambda x: F.trim(x)).alias("s"))
    got = df.select(chunking.packed_passages(F.col("s"), 80, 40)).first()[0]
    assert [[x[0] for x in p.split(" ")][::15] for p in got] == [["a", "a", "b", "b", "c"], ["b", "b", "c", "d", "d"]]


def test_nearest_looks_both_ways(spark):
    left = spark.createDataFrame([("k", 5, "p"), ("k", 12, "q"), ("k", 90, "r"), ("z", 1, "s")], "k string, at long, id string")
    right = spark.createDataFrame([("k", 0, "A"), ("k", 10, "B")], "k string, at long, v string")
    got = {r.id: r.v for r in joins.nearest(left, right, ["k"], "at", "v", 20).collect()}
    assert got == {"p": "A", "q": "B", "r": None, "s": None}


def test_nested_tables(spark, tmp_path):
    assert nested.existing(spark, str(tmp_path / "no"), "a int").count() == 0
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, p string")
    nested.save(df, str(tmp_path / "t"), ["p"])
    nested.save(spark.createDataFrame([(9, "y")], "a int, p string"), str(tmp_path / "t"), ["p"])
    assert sorted((r.a, r.p) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "x"), (9, "y")]
    (tmp_path / "h.jsonl").write_text('{"a": 1}\nnope\n{"a": 2}\n')
    assert sorted(r.a for r in nested.history(spark, str(tmp_path / "h.jsonl"), "a int").collect()) == [1, 2]
    bad = spark.createDataFrame([(1, None, [])], "id int, metadata struct<title: string>, pages array<struct<page_number: int, chunks: array<struct<text: string>>>>")
    assert nested.flatten(bad).count() == 0


def test_ndcg_by_hand(spark):
    run = spark.createDataFrame([(1, 1, "C"), (1, 2, "A")], "query_id int, rank int, doc_id string")
    gold = spark.createDataFrame([(1, "A"), (2, "B")], "query_id int, doc_id string")
    rows = {r.query_id: r for r in evaluation.metrics_at(run, gold, 5).collect()}
    assert rows[1].ndcg == round(1 / math.log2(3), 6) and rows[1].precision == 0.5 and rows[1].rr == 0.5
    assert rows[2].hit == 0 and rows[2].ndcg == 0


def test_percentiles_are_nearest_rank(spark):
    df = spark.range(1, 101).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("v"))
    r = evaluation.latency_summary(df, ["k"], "v").first()
    assert (r.p50, r.p95, r.low, r.high) == (50, 95, 1, 100)


def test_phrase_needs_whole_words(spark):
    r = spark.sql("select 'extend the term' as t").select(tx.has_phrase(F.lit("ten"), F.col("t")).alias("a"), tx.has_phrase(F.lit("the term"), F.col("t")).alias("b")).first()
    assert not r.a and r.b


def test_windows_cover_and_stop(spark):
    df = spark.createDataFrame([(1, " ".join(["a"] * 221)), (2, ""), (3, "b c")], "id int, t string")
    got = sorted((r.id, r.chunk_index, r.n_words) for r in chunking.fixed_windows(df, "id", "t").collect())
    assert got == [(1, 0, 220), (1, 1, 51), (3, 0, 2)]


def test_abstention_thresholds(spark):
    hits = spark.createDataFrame([(1, 0.46, "IPC", "1"), (1, 0.458, "IPC", "2"), (1, 0.457, "BNS", "3"), (2, 0.8, "IPC", "1"), (2, 0.7, "IPC", "2"), (2, 0.65, "IPC", "3"), (3, 0.42, "IPC", "420"), (4, 0.9, "BNS", "5"), (5, 0.55, "IPC", "9")], "query_id int, score double, law string, section string")
    asked = spark.createDataFrame([(1, None, None), (2, None, None), (3, "IPC", "420"), (4, "IPC", None), (5, "IPC", "10"), (6, None, None)], "query_id int, law string, section string")
    got = {r.query_id: r for r in gate.assess(hits, asked).collect()}
    assert {k: (r.abstain, r.confidence) for k, r in got.items()} == {1: (True, "none"), 2: (False, "high"), 3: (False, "high"), 4: (True, "none"), 5: (False, "low"), 6: (True, "none")}
    assert got[2].margin == 0.15 and got[1].indistinct and got[5].margin == 0.55
    allowed = {r.query_id: r.reason for r in gate.gate(gate.assess(hits, asked)).collect()}
    assert allowed == {1: "abstention advised", 2: "sufficient", 3: "sufficient", 4: "abstention advised", 5: "sufficient", 6: "no evidence"}


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([("s", 1), ("t", 2)], "source string, v int")
    new = spark.createDataFrame([("s", 5)], "source string, v int")
    once = state.upsert(a, new, "source")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, state.upsert(once, new, "source").collect())) == [("s", 5), ("t", 2)]


def test_bfs_has_least_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    got = {(r.node, r.hops, r.parent) for r in graph.neighbours_within(e, spark.createDataFrame([(1,)], "id long"), 2).collect()}
    assert got == {(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 3)}


def test_court_multiplier_takes_first_substring(spark):
    df = spark.createDataFrame([("Supreme Court of India",), ("Delhi High Court",), ("Tribunal",)], "c string")
    assert [r[0] for r in df.select(ranking.court_multiplier(F.col("c"))).collect()] == [1.25, 1.05, 1.0]


def test_languages_of_a_long_text_cost_one_scan_a_script(spark):
    text = "plain words, " * 80_000 + "अआ" * 40_000
    rows = spark.createDataFrame([(1, text), (2, "ab அஆ"), (3, ""), (4, None), (5, "à 1")], "id long, t string")
    t = time.time()
    got = {r["id"]: (r["l"]["primary"], r["l"]["secondary"]) for r in rows.select("id", tx.languages(F.col("t")).alias("l")).collect()}
    assert time.time() - t < 20
    assert got[1] == ("en", ["hi"]) and got[2] == ("en", ["ta"]) and got[3] == ("en", []) and got[4][0] == "en" and got[5] == ("en", [])


def test_thresholds_round_halves_as_sql_does(spark, duck):
    rows = [(57, 800), (69, 800), (3, 160), (1, 32), (799, 800)]
    got = spark.createDataFrame(rows, "k long, n long").select(tx.rounded(F.col("k") / F.col("n"), 4).alias("s"), F.lit(True).alias("p"))
    want = [r[0] for r in duck.execute("select round(k / n, 4) from (values (57, 800), (69, 800), (3, 160), (1, 32), (799, 800)) t(k, n)").fetchall()]
    assert sorted(r["threshold"] for r in evaluation.sweep(got, "s", F.col("p")).collect()) == sorted(map(float, want))
    n = evaluation.sweep(spark.range(800).selectExpr("cast(1 as double) as s", "id < 57 as p"), "s", F.col("p")).first()
    assert n["accuracy"] == 57 / 800


@pytest.mark.parametrize("patterns", [legal.STATUTES, legal.TOPICS])
def test_searches_behind_a_literal_find_all_that_the_patterns_find(spark, patterns):
    samples = [
        "under Section 302 of", "U/S 304", "CULPABLE HOMICIDE", "498A", "dowry death", "511 of the Penal", "attempt to murder", "section34", "149 IPC", "unlawful assembly", "120B", "306 ipc", "420 of penal", "409 IPC",
        "dacoity", "Robbery", "395 penal", "rape", "outraging her modesty", "pocso", "protection of  children from sexual offences", "Narcotic drugs and psychotropic", "n.d.P.S.", "438 Cr.P.C", "BAIL",
        "482 code", "inherent power to quash", "rarest of rare", "life imprisonment", "Dying Declaration", "section 27 of the Evidence", "extrajudicial confession", "disclosure statement", "chain of circumstances",
        "bharatiya sakshya", "B.N.S.S.", "bns", "i.p.C", "I.P.C.", "ip.c", "Indian  Penal Code", "JJ Act", "child in conflict with law", "PMLA", "money-laundering", "prevention of money laundering", "TADA", "uapa",
        "unlawful activities (prevention)", "prevention of corruption act", "PC Act", "Arms Act", "cr pc", "code of criminal  procedure", "evidence act", "nagarik bharatiya nagarik suraksha sanhita", "", None, "plain",
    ]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(samples)], "i int, t string")
    plain_ = F.array_compact(F.array(*[F.when(F.col("t").rlike("(?i)" + p), n) for n, p in patterns.items()]))
    rows = t.select("t", legal._matching(F.col("t"), patterns).alias("got"), plain_.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and {x for r in rows for x in r["want"]} == set(patterns)


def test_topics_of_many_judgments_are_found_soon(spark):
    text = F.concat(F.lit("In Ram Kumar v. State at p. 7. The accused was convicted under Section 305 of the Code; see Para 9 and others. " * 3), F.col("id").cast("string"))
    found = spark.range(60_000).repartition(4).select(F.size(legal.topics_in(text)).alias("n"))
    found.limit(1).collect()
    t = time.time()
    assert found.agg(F.count("n")).first()[0] == 60_000
    assert time.time() - t < 8


def test_packing_many_sentences_takes_time_by_their_number(spark):
    n = 40_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("some words of sentence number "), i.cast("string"))).alias("s"))
    t = time.time()
    got = df.select(F.size(chunking.packed_passages(F.col("s"), 60, 12)).alias("p"), F.size(chunking.packed(F.col("s"), 60, 2)).alias("q")).first()
    assert time.time() - t < 20
    # ten sentences of six words fill a piece; each later one begins with two of the one before
    assert got["p"] == got["q"] == 1 + -(-(n - 10) // 8)
