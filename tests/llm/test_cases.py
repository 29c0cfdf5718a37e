"""Null ids, long texts, empty tables, repeated rows, ties and clashing names of the operators."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, labels, op1_substrings, op3_bpe, op4_quality, op5_lm, op7_topk, op8_decontaminate, op9_sharding, op10_toxicity

ROWS = "doc_id long, text string, ids string, n_tokens string, at string, shard string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], ROWS)


def test_another_pattern_is_split_as_the_library_does(tmp_path, spark):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"a ": 256, b"a b": 257}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    for pattern in (r"[^\n]+|\n", r"(?:a|b)( ?)|\s+|.", r"\S+| "):
        public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        texts = ["a b", "a b a b\na", "", None, " a  b", "x a b"]
        got = {r.doc_id: list(r["ids"]) for r in op3_bpe.encode(docs(spark, list(enumerate(texts))), path=str(path), pattern=pattern).collect()}
        assert got == {i: public.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_bpe_of_null_ids_repeated_rows_and_a_text_over_a_slice(spark):
    public = __import__("tiktoken")
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = public.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    long = " ".join(f"word{rng.randrange(3000)}" for _ in range(150_000))
    assert len(long) > op3_bpe.SLICE
    rows = op3_bpe.digests(docs(spark, [(None, "one two"), (1, "one two"), (1, "one two"), (2, long)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == [(False, 1, 2), (False, 1, 2), (False, 2, len(known.encode_ordinary(long))), (True, 0, 2)]


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("op", [op4_quality, op10_toxicity])
def test_scores_of_null_ids_empty_tables_and_no_labels(spark, op):
    d = docs(spark, [(None, "some words"), (1, None), (1, None), (2, "")])
    model = op.train(d, spark.createDataFrame([], LABELS))
    rows = op.score(d, model).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5} and all(isinstance(r.held_out, bool) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False] and {r.predicted for r in rows} == {1}
    assert op.score(d.limit(0), model).count() == 0


def test_the_drawn_labels_are_bounded_in_characters(spark):
    d = docs(spark, [(i, "x" * 100) for i in range(50)] + [(99, "y" * 10_000)])
    y = spark.createDataFrame([(i, (i or 0) % 2, 0) for i in [*range(50), 99, None]], LABELS)
    every = labels.labelled(d, y, "quality", F.lit(True), 100)
    assert len(every) == 51 and set(every["text"].str.len()) == {100, 10_000}
    few = labels.labelled(d, y, "quality", F.lit(True), 100, 1000)
    assert 0 < len(few) <= 10 and set(few["text"].str.len()) == {100}
    assert few["doc_id"].tolist() == labels.labelled(d, y, "quality", F.lit(True), 100, 1000)["doc_id"].tolist()


def test_substrings_of_null_ids_and_a_long_text(spark):
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefghij ") for _ in range(900))
    long = "".join(rng.choice("klmnopqrst ") for _ in range(5 << 20)) + part
    rows = {r.doc_id: (r.n_bytes, r.n_removed) for r in op1_substrings.dedup(docs(spark, [(None, part), (1, long), (2, None)])).collect()}
    assert rows == {None: (900, 900), 1: ((5 << 20) + 900, 900), 2: (0, 0)}


def test_lm_scores_of_null_ids_and_clashing_names(spark):
    d = docs(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)])
    rows = op5_lm.score(d).collect()
    assert len(rows) == 4 and op5_lm.score(d.limit(0)).count() == 0
    assert len({round(r.log_likelihood, 9) for r in rows if r.doc_id in (None, 1)}) == 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cb int")


def test_top_k_of_empty_tables_and_repeated_ids(spark):
    v = op7_topk.quantize(vectors(spark, [(0, [1.0, 0.5]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [-1.0, 0.0]), (9, None), (None, [1.0, 1.0])]))
    got = op7_topk.top_k(v.where("vec_id = 0"), v, 2).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 7, 64 * 32 + 32 * 32)] * 1 + [(2, 7, 64 * 32 + 32 * 32)]
    assert op7_topk.top_k(v.limit(0), v).count() == 0 and op7_topk.top_k(v.where("vec_id = 0"), v.limit(0)).count() == 0


def test_shards_of_ids_that_cannot_be_parted(spark, tmp_path):
    d = docs(spark, [(5, "x" * 900), (5, "x" * 900), (6, "y" * 2000), (None, "z"), (7, None)])
    rows = op9_sharding.assign(d, limit=1000).collect()
    assert len(rows) == 5
    by = {r.doc_id: r for r in rows}
    # two rows of one id share all bits, one document is over the limit alone
    assert (by[5].fits, by[5].shard_bytes, by[5].depth) == (False, 1800, op9_sharding.MAX_DEPTH) and (by[6].fits, by[6].shard_bytes) == (False, 2000)
    assert by[7].fits and by[None].fits and by[7].n_bytes == 0
    assert op9_sharding.assign(d.limit(0)).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rng = random.Random(3)
    d = docs(spark, [(i, "w" * rng.randrange(400)) for i in range(120)] + [(3, "again"), (None, "n")])
    path = str(tmp_path / "shards")
    op9_sharding.write_shards(d, path, limit=4000)
    back = spark.read.option("basePath", path).parquet(path)
    assert sorted(map(str, back.select("doc_id", "text", "id").collect())) == sorted(map(str, d.select("doc_id", "text", "id").collect()))
    own = [c for c in back.columns if c.strip("_") == "shard" and c != "shard"]
    sizes = back.groupBy(*own).agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(sizes) > 4 and max(r.n for r in sizes) <= 4000


def test_places_and_ties_of_benchmark_items(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    items = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, None, 0), (4, "", 0)], "item_id long, text string, doc_id int")
    d = docs(spark, [(None, f"before {item} after"), (1, f"{item}"), (1, f"{item}"), (2, None), (3, item.replace("lazy", "lasy"))])
    rows = op8_decontaminate.matches(d, items).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.distance) for r in rows)
    # both items at one place count, and each row of a repeated document
    assert got == sorted([(True, 0, 1, 0), (True, 0, 2, 0)] + 2 * [(False, 1, 1, 0), (False, 1, 2, 0)] + [(False, 3, 1, 1), (False, 3, 2, 1)])
    for r in rows:
        text = op8_decontaminate.normal({None: f"before {item} after", 1: item, 3: item.replace("lazy", "lasy")}[r.doc_id])
        found = text[r.start:r.end]
        assert found in (item, item.replace("lazy", "lasy")), found
    assert op8_decontaminate.matches(d.limit(0), items).count() == 0 and op8_decontaminate.matches(d, items.limit(0)).count() == 0


def test_the_usual_pattern_is_the_one_that_blanks_part():
    import public_tokenizers

    assert op3_bpe.BLANK_PATTERN == public_tokenizers.PATTERN
