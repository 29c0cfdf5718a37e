"""Fixed lists against rows written out by hand, so that a wrong pattern cannot be right on both sides."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import asking, legal, maxims
from tessera.functions import text as tx
from tessera.operators import evaluation, ranking, selection, state
from tessera.sources import nested


def each(spark, f, rows):
    """What a column expression makes of texts, in their order."""
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.x for r in sorted(d.select("i", f(F.col("t")).alias("x")).collect())]


def test_document_types_by_hand(spark):
    texts = ["IN THE SUPREME COURT OF INDIA", "high  court at X", "Before the District Judge", "Appellate Tribunal", "consumer forum, Delhi", "NATIONAL GREEN bench", "a letter", ""]
    assert each(spark, tx.document_type, texts) == ["SUPREME_COURT", "HIGH_COURT", "DISTRICT_COURT", "TRIBUNAL", "CONSUMER_FORUM", "TRIBUNAL", "UNKNOWN", "UNKNOWN"]


def test_citation_formats_by_hand(spark):
    text = "(2010) 4 SCC 350; AIR 1973 SC 1461; (1999) 2 SCR 7; 1988 CriLJ 12; (2001) 3 SCALE 9; [1990] 2 All ER 5; [1932] 1 AC 562; [1964] 1 WLR 8; MANU/SC/0123/2004; (2003) 1 ILR 4; 12 of 1999"
    want = ["(1999) 2 SCR 7", "(2001) 3 SCALE 9", "(2003) 1 ILR 4", "(2010) 4 SCC 350", "1988 CRILJ 12", "AIR 1973 SC 1461", "MANU/SC/0123/2004", "[1932] 1 AC 562", "[1964] 1 WLR 8", "[1990] 2 ALL ER 5"]
    assert sorted(x.upper() for x in each(spark, legal.citations, [text])[0]) == want


def test_statutes_scores_and_topics_by_hand(spark):
    texts = ["Under the Indian Penal Code and the Evidence Act", "BNSS and POCSO", "Cr.P.C. bail murder sentence", "nothing", "culpable homicide under section 302"]
    assert each(spark, legal.statutes_in, texts) == [["IPC", "Evidence"], ["BNSS", "POCSO"], ["CrPC"], [], []]
    assert each(spark, legal.criminal_score, texts) == [6, 6, 5, 0, 0]
    assert each(spark, lambda t: legal.primary_law(legal.statutes_in(t)), texts) == ["IPC", "BNSS", "CrPC", "other", "other"]
    assert "murder" in each(spark, legal.topics_in, texts)[4]


@pytest.mark.parametrize("text, want", [
    ("it stands overruled", "overruled"), ("the order is set aside", "reversed"), ("the facts are different", "distinguished"), ("decided without noticing it", "per_incuriam"),
    ("consistent with that", "followed"), ("followed but later overruled", "overruled"), ("mentioned", None)])
def test_treatments_by_hand(spark, text, want):
    assert each(spark, legal.treatment, [text]) == [want]


def test_sections_are_ordered_by_number_and_then_letters(spark):
    names = ["305", "304", "304B", "304A", "1000", "9", "x"]
    d = spark.createDataFrame([(n,) for n in names], "n string").orderBy(legal.section_key(F.col("n")))
    assert [r.n for r in d.collect()] == ["9", "304", "304A", "304B", "305", "1000", "x"]


def test_court_multipliers_by_hand(spark):
    texts = ["Supreme Court of India", "HIGH COURT OF DELHI", "a Constitutional Bench", "full bench", "Division Bench", "District Court", ""]
    assert each(spark, ranking.court_multiplier, texts) == [1.25, 1.05, 1.20, 1.15, 1.10, 1.0, 1.0]
    assert each(spark, ranking.passage_boost, ["ratio", "obiter", "facts"]) == [1.15, 0.90, 1.0]


def test_reciprocal_ranks_by_hand(spark):
    d = spark.createDataFrame([(1, "a", 7, 0.9), (1, "a", 8, 0.5), (1, "b", 8, 3.0)], "q int, source string, id int, score double")
    got = {r.id: r.fused for r in ranking.fuse(d, ["q"], "source", "score", "id").collect()}
    assert got == {7: 0.016393443, 8: 0.032522475}


def test_questions_by_hand(spark):
    texts = ["What is u/s 34 IPC?", "section 420 of the BNS", "Compare IPC and BNS section 5", "passport"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("none", F.lit(None).cast("string"))
    rows = [r.c for r in sorted(d.select("i", asking.corpus_choice(F.col("t"), F.col("none")).alias("c")).collect())]
    assert [(r.law, r.section) for r in rows] == [("IPC", "34"), ("BNS", "420"), (None, "5"), (None, None)]


def test_floors_and_shares_by_hand():
    assert selection.FLOORS["pocso"] == 60 and selection.FLOORS["uapa"] == 30 and len(selection.FLOORS) == 21
    assert selection.SHARES == {"murder": 0.5, "bail": 0.5} and (selection.LEAST_SCORE, selection.FILL_SCORE, selection.LEAST_CHARS) == (6, 10, 3000)


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 1, "C"), (1, 2, "A")], "query_id int, rank int, doc_id string")
    r = evaluation.metrics_at(run, spark.createDataFrame([(1, "A")], "query_id int, doc_id string"), 5).first()
    assert (r.precision, r.recall, r.hit, r.rr, r.ndcg) == (0.5, 1.0, 1, 0.5, 0.63093)
    t = spark.createDataFrame([("x", float(v)) for v in range(1, 101)], "k string, v double")
    s = evaluation.latency_summary(t, ["k"], "v").first()
    assert (s.mean, s.p50, s.p95, s.low, s.high) == (50.5, 50.0, 95.0, 1.0, 100.0)


def test_maxims_and_markers_by_hand(spark):
    assert each(spark, maxims.marked, ["It was Ipso Facto void"]) == ["It was [[Ipso Facto||By that very fact or act.]] void"]
    assert each(spark, legal.marked_citations, ["[IPC s.420] and [ipc s.420], [BNS s. 5A]"]) == [["IPC S.420", "BNS S. 5A"]]


def test_names_keys_and_deletions(spark):
    assert nested.collection_name("laws", "section_whole", "m") == "exp_laws_section_whole_m"
    d = spark.createDataFrame([(1, "q"), (2, "r")], "id int, v string")
    assert state.deleted(d, spark.createDataFrame([(2,), (2,), (9,)], "id int"), "id").collect() == [(1, "q")]
    keys = d.select(state.cache_key("answer", v=F.col("v"), k=F.col("id")).alias("k"), state.cache_key("answer", k=F.col("id"), v=F.col("v")).alias("same")).collect()
    assert all(r.k == r.same and r.k.startswith("answer:") and len(r.k) == 39 for r in keys) and keys[0].k != keys[1].k
