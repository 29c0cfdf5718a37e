"""The stored inverted index against brute force: batches in any order, replayed batches, blocks that are skipped, files that are not opened."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted
from tessera.sources.store import new_path


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(40))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(out)]


def brute(docs, queries, k):
    ts = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs]
    n, mean = len(ts), sum(len(t) for _, t in ts) / len(ts)
    df = Counter(w for _, t in ts for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if r < 0 else r for w, r in raw.items()}
    out = {}
    for q, text in queries:
        scored = []
        for i, t in ts:
            c = Counter(t)
            s = round(sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in re.findall("[a-z0-9]+", text.lower()) if w in c), 6)
            if s > 0:
                scored.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


QUERIES = [(1, "w3 w40 w40"), (2, "W55"), (3, "none of these"), (4, "w1 w2 w58 w59"), (5, "")]


def close(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]] and all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(a[q], b[q]))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_batches_in_any_order_and_again_equal_one_build(spark, monkeypatch, order):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    data = [*texts(300), (300, None), (301, "")]
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "k long, body string, term string, block int").repartition(3)
    path, q = new_path(spark, "test-inverted"), spark.createDataFrame(QUERIES, "q long, t string")
    for b in (*order, order[0]):
        inverted.add(frame(data[b::3]), path, b, "k", "body")
    close(got(inverted.search(spark, path, q, "q", "t", 7)), brute(data, QUERIES, 7))


def test_blocks_under_the_kth_score_are_skipped_and_other_buckets_not_opened(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    # a rare word stands often in a few neighbouring documents and once in one of each later block
    data = [(i, "rare " * 30) if i < 12 else (i, "rare " + "filler " * 60) if i % 8 == 0 else (i, f"other{i} filler") for i in range(400)]
    d = spark.createDataFrame(data, "k long, body string").coalesce(1)
    path, asked = new_path(spark, "test-inverted"), [(1, "rare")]
    inverted.add(d, path, 0, "k", "body")
    q = spark.createDataFrame(asked, "q long, t string")
    post, weighted, limits = inverted.plan(spark, path, q, "q", "t")
    first = limits.orderBy("most", ascending=False).limit(2)
    rest = inverted.survivors(limits, first, inverted.score(post, weighted, first, 1), 5)
    assert limits.count() > 40 and rest.count() == 0
    close(got(inverted.search(spark, path, q, "q", "t", 5)), brute(data, asked, 5))
    files = lambda p: p.select(F.input_file_name()).distinct().count()
    assert "PartitionFilters: [isnotnull(bucket" in post.select("term")._jdf.queryExecution().executedPlan().toString()
    assert files(post) == 1 < files(inverted.postings(spark, path))


def test_index_of_nothing_and_search_without_an_index(spark):
    data, q = texts(60, 2), spark.createDataFrame(QUERIES, "q long, t string")
    d = spark.createDataFrame(data + [(None, "w1 w2")], "k long, body string")
    close(got(inverted.once(q, d, "q", "t", "k", "body", 4)), brute(data, QUERIES, 4))
    path = new_path(spark, "test-inverted")
    inverted.add(d.limit(0), path, 0, "k", "body")
    assert inverted.search(spark, path, q, "q", "t", 4).count() == 0
    inverted.add(d, path, 1, "k", "body")
    assert inverted.search(spark, path, q.limit(0), "q", "t", 4).count() == 0
