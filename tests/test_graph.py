"""The stored graph: increments in any order, buckets that stay as they are, label lookup without meeting all labels."""

from itertools import permutations

import pytest

from tessera.operators import graph
from tessera.sources.store import new_path

EDGES = "src string, dst string, relation string, o int"
PARTS = [
    [("Case::a v. b", "Court::x", "decided_by", 1), ("Case::a v. b", "Case::c", "cites", 2)],
    [("Case::a v. b", "Case::c", "cites_resolved", 1), ("Case::c", "Section::section 30 of code", "interprets", 3), (None, "Case::c", "cites", 2)],
    [("Case::c", "Section::section 30 of code", "interprets", 3), ("Case::long title here", "Court::x", "decided_by", 1)],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "relation").collect())


@pytest.mark.parametrize("order", list(permutations(range(3)))[::2])
def test_increments_in_any_order_equal_one_build(spark, order):
    path = new_path(spark, "t-graph")
    for k in (*order, order[0]):
        graph.merge(frame(spark, PARTS[k]), path)
    whole = graph.first_relations(frame(spark, [r for p in PARTS for r in p if r[0]]))
    assert rows_of(graph.stored(spark, path)) == rows_of(whole)


def test_untouched_buckets_keep_their_files_and_nothing_adds_nothing(spark):
    path = new_path(spark, "t-graph")
    graph.merge(frame(spark, [(f"Case::{i}", "Court::x", "decided_by", 1) for i in range(60)]), path)
    before = set(graph.stored(spark, path).inputFiles())
    graph.merge(frame(spark, [("Case::7", "Court::y", "decided_by", 1)]), path)
    after = set(graph.stored(spark, path).inputFiles())
    assert len(before & after) >= len(before) - 4 and graph.stored(spark, path).count() == 61
    graph.merge(frame(spark, []), path)
    assert set(graph.stored(spark, path).inputFiles()) == after
    assert graph.stored(spark, new_path(spark, "t-none")).count() == 0


def test_words_find_labels_that_hold_them(spark):
    e = frame(spark, [r for p in PARTS for r in p if r[0]])
    q = spark.createDataFrame([(1, "What did Titl say"), (2, "abc v. b"), (3, "ction 30"), (4, None), (5, "court x here")], "q int, t string")
    hit = graph.seeds(e, q, "q", "t")
    assert {(r.q, r.id) for r in hit.collect()} == {(1, "Case::long title here"), (3, "Section::section 30 of code"), (5, "Case::long title here")}
    assert "NestedLoop" not in hit._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in hit._jdf.queryExecution().executedPlan().toString()
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["C", "c ", "a v. B", "long title here", "c", None])], "id int, title string")
    got = graph.related_chunks(e, chunks, q, "q", "t", "title", "id", 2)
    assert sorted((r.q, r.id, r["rank"]) for r in got.collect()) == [(1, 3, 1), (3, 0, 1), (3, 1, 2), (5, 3, 1)]


def test_chains_start_at_the_title_or_the_nearest_name(spark):
    e = frame(spark, [("Case::ram lal v. state", "Case::old case", "cites", 1), ("Case::old case", "Court::x", "decided_by", 1), ("Case::ram das v. union", "Court::x", "decided_by", 1)])
    q = spark.createDataFrame([(1, "Old Case"), (2, "Ram and the State"), (3, "zz yy"), (4, "RAM"), (5, None)], "q int, t string")
    assert {(r.q, r.id) for r in graph.starts(e, q, "q", "t").collect()} == {(1, "Case::old case"), (2, "Case::ram lal v. state"), (4, "Case::ram das v. union")}
    chain = graph.citation_chain(e, q.where("q = 2"), "q", "t", 2).collect()
    assert sorted((r.hops, r.node, r.parent, r.relation) for r in chain) == [
        (0, "Case::ram lal v. state", None, None), (1, "Case::old case", "Case::ram lal v. state", "cites"), (2, "Court::x", "Case::old case", "decided_by")]
