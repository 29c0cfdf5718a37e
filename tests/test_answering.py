"""Judgments scored for questions, the writer's passages and provenance, on plain cases."""

from pyspark.sql import functions as F

from tessera.operators import answering, state

SCORED = "q int, id int, case_no string, semantic double, law string, cited array<string>"


def test_scores_and_reasons(spark):
    c = spark.createDataFrame([(1, 1, "a", 0.5, "IPC", ["302", "34"]), (1, 2, "a", 0.2, "IPC", []), (1, 3, "b", 0.1, "BNS", None), (2, 4, "a", 0.3, None, ["302"])], SCORED)
    named = spark.createDataFrame([(1, "IPC", "302"), (1, "IPC", "34"), (3, "IPC", "1")], "q int, statute string, section string")
    crossed = spark.createDataFrame([(1, "b"), (1, "b"), (9, "a")], "q int, case_no string")
    rows = {r["id"]: (r["score"], r["reasons"]) for r in answering.scored(c, named, crossed, "q", "case_no").collect()}
    assert rows == {
        1: (0.75, ["cites section 302, 34, which the question names"]), 2: (0.2, ["matched the question semantically"]),
        3: (0.35, ["cross-referenced to the retrieved provision"]), 4: (0.3, ["matched the question semantically"]),
    }
    weighed = answering.scored(c, named, crossed, "q", "case_no", answering.WEIGHTS | {"law": 0.1})
    assert weighed.where("id = 2").first()["reasons"] == ["decided under the IPC"]
    best = answering.judgments(answering.scored(c, named, crossed, "q", "case_no"), "q", "case_no", "id")
    assert sorted((r["q"], r["id"], r["rank"]) for r in best.collect()) == [(1, 1, 1), (1, 3, 2), (2, 4, 1)]
    assert answering.judgments(answering.scored(c.limit(0), named, crossed, "q", "case_no"), "q", "case_no", "id").count() == 0


RUNS = "q int, run int, rank int, chunk_id int, parent string, court string, yr int, section_type string, title string, text string, score double"


def test_context(spark):
    runs = spark.createDataFrame([
        (1, 0, 1, 10, "p", "HIGH COURT", 1990, "ratio", "A v. B", "text", 0.5), (1, 1, 1, 10, "p", "HIGH COURT", 1990, "ratio", "A v. B", "text", 0.9),
        (1, 0, 2, 11, "p", "HIGH COURT", 1991, "", "C v. D", "a v. b was OVERRULED", 0.8), (1, 0, 3, 12, None, "HIGH COURT", None, None, "E v. F", "cites C v. D", 0.6),
        (1, 0, 4, 13, "", "TRIBUNAL", 1991, "ratio", "G", "x", 2.0),
    ], RUNS)
    rows = [tuple(r) for r in answering.context(runs, "q", 5, answering.admitted(["high court"])).orderBy("rank").collect()]
    assert rows == [(1, 12, "E v. F", 0.6, 1, "good_law", 1.0), (1, 10, "A v. B", 0.575, 2, "overruled", 0.95)]
    assert answering.context(runs, "q", 1).first()["chunk_id"] == 13
    assert answering.context(runs.limit(0), "q").count() == 0


def test_filters(spark):
    r = spark.createDataFrame([(1, "Delhi High Court", 1999, "facts", "t", "about bail"), (2, None, None, None, None, None), (3, "Supreme Court", 2005, "ratio", "Bail", "")], "id int, court string, yr int, section_type string, title string, text string")
    ids = lambda **f: sorted(x["id"] for x in r.where(answering.admitted(**f)).collect())
    assert ids() == [1, 2, 3]
    assert ids(courts=["high"]) == [1]
    assert ids(year_from=2000) == [2, 3] and ids(year_to=2000) == [1, 2]
    assert ids(topics=["BAIL"]) == [1, 3]
    assert ids(statuses=["ratio"]) == [2, 3]


def test_provenance(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, h string")
    there = spark.createDataFrame([(1, "a"), (2, "x"), (4, None), (5, "e")], "k int, h string")
    assert {tuple(r) for r in state.provenance_status(known, there, "k", "h").collect()} == {(1, "ok"), (2, "changed"), (3, "missing"), (4, "ok"), (5, "unrecorded")}
