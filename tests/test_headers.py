"""Headers of judgments, titles, maxims, sections over pages, splitting, linked citations and resumed runs, against plain cases and loops."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import headers as h
from tessera.functions import maxims
from tessera.operators import citations, splitting, state


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("header, court", [
    ("IN THE SUPREME COURT OF INDIA\nx", "SUPREME COURT OF INDIA"), ("in the high court of delhi at new delhi\n", "high court of delhi"),
    ("PETITIONER: A\nRESPONDENT: B", "SUPREME COURT OF INDIA"), ("BEFORE SH. RAO, SESSIONS JUDGE, Pune\n", "SESSIONS COURT, PUNE"),
    ("BEFORE SH. RAO, DISTRICT JUDGE\nnothing", "DISTRICT COURT"), ("IN THE argued COURT", None), ("", None), (None, None),
])
def test_court(spark, header, court):
    assert one(spark, h.court_of(F.col("t")), t=header) == court


@pytest.mark.parametrize("header, title", [
    ("Gopal K.S. (Retd.) And Anr vs Union Of India And Ors", "Gopal K.S. (Retd.) And Anr v. Union Of India And Ors"),
    ("PETITIONER: Ram Lal Vs. RESPONDENT: State of Bihar DATE OF JUDGMENT", "Ram Lal v. State of Bihar"), ("And Anr vs Union Of India", None),
    ("Ram Lal Through Counsel vs State of Bihar", None), ("no parties", None), (None, None),
])
def test_title(spark, header, title):
    assert one(spark, h.title_of(F.col("t")), t=header) == title


def test_other_fields(spark):
    m = one(spark, h.metadata_of(F.col("a"), F.col("b")), a="Civil Appeal No. 12 of 1998\nHon'ble Mr. Justice B Roy\n", b="heard on 05-06-2007; the petition is\nallowed")
    assert (m["case_number"], m["date"], m["decision"], m["bench"]) == ("12 of 1998", "05-06-2007", "Petition Is\nAllowed", ["B Roy"])
    empty = one(spark, h.metadata_of(F.col("a"), F.col("b")), a="", b="")
    assert [empty[k] for k in ("court", "case_number", "date", "case_title", "decision", "bench")] == [None] * 5 + [[]]


def test_maxims(spark):
    assert one(spark, maxims.marked(F.col("t")), t="Non compos mentis; ad hocs, IN REM") == "[[Non compos mentis||Not of sound mind.]]; ad hocs, [[IN REM||A legal action against a thing or status, not a person.]]"
    assert one(spark, maxims.marked(F.col("t")), t="") == ""
    assert one(spark, maxims.marked(F.col("t")), t=None) is None


def test_sections_carry_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "start\nFACTS\nhe left\nORDER\n"), (1, 2, "went on\n1. HELD:\nso"), (1, 3, "end"), (2, 1, " "), (2, 2, None)], "d int, p int, t string")
    rows = [tuple(r) for r in splitting.split_sections(pages, "d", "p", "t").orderBy("d", "p", "idx").collect()]
    assert rows == [(1, 1, 0, "PREAMBLE", "start"), (1, 1, 1, "FACTS", "he left"), (1, 2, 0, "FACTS", "went on"), (1, 2, 1, "KEY_POINTS", "so"), (1, 3, 0, "KEY_POINTS", "end")]


def packed_by_hand(parts, most, carry):
    out, now = [], []
    for p in parts:
        if now and sum(len(x.split()) for x in now) + len(p.split()) > most:
            out.append(" ".join(now))
            now = now[-carry:]
        now = now + [p]
    return out + [" ".join(now)]


def test_recursive_split(spark):
    sentences = [f"S{i} " + "w " * (i % 7) + "end." for i in range(60)]
    text = " ".join(s.replace("w end", "w end") for s in sentences)
    got = one(spark, splitting.recursive_split(F.col("t"), 20, 8), t=text)
    assert got == packed_by_hand([s for s in re.split(r"(?<=[.?!])\s+(?=[A-Z])", text)], 20, 8)
    marked = "first part here\n\nPara 2 second part is longer\n\n3. third " + "w " * 10
    got = one(spark, splitting.recursive_split(F.col("t"), 8, 2, True, 1), t=marked)
    assert got == packed_by_hand(["first part here", "second part is longer", "third " + ("w " * 10).strip()], 8, 1)
    plain = " ".join(f"w{i}" for i in range(23))
    assert one(spark, splitting.recursive_split(F.col("t"), 10, 3), t=plain) == [" ".join(f"w{i}" for i in range(a, min(a + 10, 23))) for a in (0, 7, 14, 21)]
    assert one(spark, splitting.recursive_split(F.col("t"), 10, 3), t="") == [""]


@pytest.mark.parametrize("text, most, overlap, pieces", [
    ("a b\n\nc d\n\n e f\nORDER\ng. h i j k l m. n", 4, 1, ["a b c d", "d e f", "g.", "h i j k", "k l m.", "n"]),
    ("a b\n\nc d", 3, 5, ["a b", "a b c d"]), ("a  b\nc", 3, 1, ["a  b\nc"]), ("A one. B two. C three", 4, 2, ["A one. B two.", "B two. C three"]), ("  ", 4, 1, []), (None, 4, 1, None),
])
def test_judgment_chunks(spark, text, most, overlap, pieces):
    assert one(spark, splitting.judgment_chunks(F.col("t"), most, overlap), t=text) == pieces


def test_parents_and_children(spark):
    s = spark.createDataFrame([("a.pdf", 1, "FACTS", "He saw it in (1998) 2 SCC 3. " * 30), ("a.pdf", 2, "ORDER", "  "), ("b.pdf", 1, "ORDER", "Para 7 short")], "f string, page int, section string, t string")
    rows = splitting.parents_and_children(s, F.col("f"), "page", "section", "t", ["f"], 64, 32, 8, 1).collect()
    assert len({r["chunk_id"] for r in rows}) == len({(r["parent_chunk_id"], r["text"], r["chunk_id"]) for r in rows})
    assert all(r["text"] in r["parent_text"] and len(r["text"].split()) <= 32 for r in rows)
    assert [(r["para_numbers"], r["section_type"]) for r in rows if r["f"] == "b.pdf"] == [([7], "order")]
    assert {r["f"] for r in rows} == {"a.pdf", "b.pdf"} and all(r["page"] == 1 for r in rows)


def test_numbers_that_are_no_int_are_kept(spark):
    """A card's number that begins a line stopped the whole query."""
    t = "4614064946860265. Paid [3] and Para 2147483648, [07] [7]\n" + "9" * 38 + ". End"
    s = spark.createDataFrame([("a", 1, "FACTS", t), ("b", 1, "FACTS", "[" + "1" * 39 + "] and [5] [" + "2" * 40 + "]"), ("c", 1, "FACTS", "none")], "f string, page int, section string, t string")
    rows = splitting.parents_and_children(s, F.col("f"), "page", "section", "t", ["f"]).collect()
    assert {r["f"]: r["para_numbers"] for r in rows} == {"a": [3, 7, 2147483648, 4614064946860265, 10**38 - 1], "b": [5, None], "c": []}


def test_case_citations(spark):
    p = "Ram Lal Singh v. State of Bihar, "
    pages = spark.createDataFrame([
        (1, 1, p + "(1998) 2 SCC 3 and AIR 1999 SC 5; ibid. and supra"), (1, 2, "see (2001) 4 SCC 7"), (1, 3, None), (2, 1, "see (2001)  4 SCC 7, id."), (1, 4, "x" * 300 + " AIR 1999 SC 5"),
    ], "d int, p int, t string")
    got = {tuple(r) for r in citations.case_citations(pages, "d", "p", "t").collect()}
    name = "Ram Lal Singh v. State of Bihar"
    assert got == {
        (1, 1, "(1998) 2 SCC 3", name, None), (1, 1, "AIR 1999 SC 5", name, None), (1, 1, "IBID", name, "ibid"), (1, 1, "SUPRA", name, "supra"),
        (1, 2, "(2001) 4 SCC 7", name, None), (2, 1, "(2001) 4 SCC 7", None, None), (1, 4, "AIR 1999 SC 5", name, None),
    }


def test_a_stopped_run_goes_on(spark, tmp_path):
    built = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "i long, t string")
    path = str(tmp_path / "store")
    state.resume(built, built.where("i < 5"), "i", "i", "t", 4, path)  # slice 0 is whole, slice 1 is not
    stored = spark.read.parquet(path)
    assert sorted(r["i"] for r in stored.collect()) == [4, 5, 6, 7, 8, 9]
    both = stored.select("i", "t").unionByName(built.where("i < 4"))
    plan = state.resume_plan(built, both, "i", "i", "t", 4).first()
    assert (plan["total"], plan["reused"], plan["to_do"], plan["first_to_do"], plan["slices_to_do"]) == (10, 10, 0, None, 0)
    assert state.remaining(built, both, "i", "i", "t", 4).count() == 0
    empty = state.resume_plan(built.limit(0), both, "i", "i", "t", 4).first()
    assert (empty["total"], empty["first_to_do"], empty["slices_to_do"]) == (0, None, 0)


def test_no_city_begins_within_another_and_goes_on_after_it():
    from tessera.functions.legal import CITIES

    for a in CITIES:
        for b in CITIES:
            words = a.split()
            assert a == b or not any(b.startswith(" ".join(words[k:]) + " ") for k in range(1, len(words)))


def test_the_longest_city_counts(spark):
    from pyspark.sql import functions as F

    from tessera.functions.legal import court_city

    rows = [("court at pune and New Delhi", "NEW DELHI"), ("Delhi", "DELHI"), ("nowhere", None), ("", None), (None, None), ("DELHIX", None)]
    got = spark.createDataFrame(rows, "t string, w string").select(court_city(F.col("t")).alias("c"), "w").collect()
    assert [r.c for r in got] == [r.w for r in got]
