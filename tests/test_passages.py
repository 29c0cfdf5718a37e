"""Passages over long groups against a plain loop: sentences and passages over the borders of texts, chunks and blocks, missing values, ties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import passages

SCHEMA = "k long, id long, txt string"


def texts(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = [rng.choice("abcd") * 2 for _ in range(rng.choice([1, 3, 9, 30 if rng.random() < 0.2 else 4]))]
            words[0] = words[0].capitalize() if rng.random() < 0.7 else words[0]
            parts.append(" ".join(words) + rng.choice([".", ";", ":", "", ". "]))
        out.append((rng.randrange(3), rng.randrange(n) if rng.random() < 0.9 else None, rng.choice([" ", "", "\n"]) + rng.choice([" ", "\n"]).join(parts)))
    odd = [(7, 1, "\n"), (7, 2, " "), (8, 1, "  "), (8, 2, ""), (9, 1, None), (None, 1, "A b. C"), (6, 1, "one. Two"), (6, 2, " \t"), (6, 3, "(three)"), (5, 1, "\n"), (5, 2, "x")]
    none = [(4, i, "no end") for i in range(40)]
    return out + odd + none + [(0, i, b) for i in range(20) for b in (" ", "\n", None)]


def loop(rows, most, carry):
    out = []
    for k in {r[0] for r in rows} - {None}:
        mine = sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        s = [x for x in (y.strip(" ") for y in re.split(r"(?<=[.;:])\s+(?=[A-Z(\[])", " ".join(r[2] for r in mine))) if x]
        done, now = [], []
        for n in (len(x.split()) for x in s):
            if now and sum(now) + n > most:
                done.append(sum(now))
                now = now[max([i for i in range(len(now)) if sum(now[i:]) >= carry], default=0):]
            now = now + [n]
        out += [(k, i, n) for i, n in enumerate(done + ([sum(now)] if now else []))]
    return sorted(out)


@pytest.mark.parametrize("bits, block, most, carry", [(12, 8192, 22, 4), (2, 7, 22, 4), (0, 1, 22, 4), (1, 16, 12, 30), (3, 5, 1, 1)])
def test_passages_are_those_of_a_loop(spark, monkeypatch, bits, block, most, carry):
    monkeypatch.setattr(passages, "CHUNK_BITS", bits)
    monkeypatch.setattr(passages, "BLOCK", block)
    rows = texts(bits)
    got = passages.passage_sizes(spark.createDataFrame(rows, SCHEMA).repartition(5), ["k"], "id", "txt", most, carry)
    assert sorted(map(tuple, got.collect())) == loop(rows, most, carry)
    assert (7, 0, 0) in loop(rows, most, carry)


def test_a_long_group_is_dealt_over_tasks(spark, monkeypatch):
    """One key's texts were joined and folded in one task, at a cost that grows with their square."""
    monkeypatch.setattr(passages, "BLOCK", 64)
    rows = spark.range(3000).select(F.lit(1).alias("k"), "id", F.lit("One two three. Four five; Six seven eight nine.").alias("txt"))
    seen = []
    written = passages.written
    monkeypatch.setattr(passages, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    n = passages.passage_sizes(rows, ["k"], "id", "txt", 20, 4).count()
    most = {name: df.agg(F.max(F.size(c))).first()[0] for name, df in seen for c in df.columns if c in ("_rest", "_counts")}
    assert n > 1500 and most["blocks"] <= 64 + 21 and most["chunks"] <= 3 << passages.CHUNK_BITS and dict(seen)["blocks"].count() == -(-9000 // 64)
