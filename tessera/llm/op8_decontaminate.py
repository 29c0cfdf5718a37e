"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may stand in a document with floor(BUDGET * m) edits. Cut into one piece more than that, at least one piece
must stand there unchanged: an automaton over all pieces finds such hits in one reading of a text, and Myers' bit-parallel
distance verifies the item around each hit (any number of edits up to the budget; lower case, runs of white space as one blank).

The items are broadcast in groups of at most ``GROUP_CHARS`` characters: a larger benchmark takes more passes over the documents,
never a larger broadcast.

Defined cases: null and empty texts or items match nothing; an item is matched whole, a part of it is no match; the best match
of an item in a document is reported (ties: the earliest end); repeated rows give repeated rows; null ids pass through;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

BUDGET = 0.06
GROUP_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of near-equal length."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``pattern`` in ``text``, if within ``most`` edits; the earliest of equals."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = most + 1, -1
    get = eq.get
    for j, c in enumerate(text):
        x = get(c, 0)
        xv = x | mv
        xh = (((x & pv) + pv) ^ pv) | x
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= most else None


class Matcher:
    """An automaton over the pieces of (item_id, normal text) items."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items = [(i, t, int(budget * len(t))) for i, t in items]
        by: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                if piece:
                    by.setdefault(piece, []).append((k, offset + len(piece)))
        self.machine = ahocorasick.Automaton()
        for piece, uses in by.items():
            self.machine.add_word(piece, uses)
        self.machine.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of the best match of each item, in the normal text."""
        spots: dict[int, list[int]] = {}
        for end, uses in self.machine.iter(text):
            for k, offset in uses:
                spots.setdefault(k, []).append(end + 1 - offset)
        out = []
        for k, starts in spots.items():
            item, pattern, most = self.items[k]
            best = None
            starts.sort()
            i = 0
            while i < len(starts):  # overlapping windows are read once
                a = max(0, starts[i] - most)
                b = starts[i] + len(pattern) + most
                i += 1
                while i < len(starts) and starts[i] - most <= b:
                    b = starts[i] + len(pattern) + most
                    i += 1
                found = myers(pattern, text[a:b], most)
                if found and (best is None or found[0] < best[0]):
                    best = found[0], a + found[1]
            if best:
                end = best[1]
                back = text[max(0, end - len(pattern) - most):end][::-1]
                start = end - myers(pattern[::-1], back, most)[1]
                out.append((item, start, end, best[0]))
        return sorted(out)


def groups(items: DataFrame, item_col: str = "item_id", item_text: str = "text"):
    """Lists of (item_id, normal text) of at most GROUP_CHARS characters (one item at least)."""
    group: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").toLocalIterator():
        text = normal(row["t"])
        if not text:
            continue
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append((row["i"], text))
        size += len(text)
    if group:
        yield group


HIT = "doc_id long, item_id long, start int, end int, distance int"


def matches(docs: DataFrame, items: DataFrame, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, distance): items found in documents; offsets are into the normal text."""
    spark = docs.sparkSession
    prepare(spark)

    def one_pass(group):
        shared = spark.sparkContext.broadcast(group)

        def run(batches):
            matcher = Matcher(shared.value, budget)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        rows += [(doc, *hit) for hit in matcher(normal(text))]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "start", "end", "distance"])

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, HIT)

    out = None
    for group in groups(items):
        out = one_pass(group) if out is None else out.unionByName(one_pass(group))
    return out if out is not None else spark.createDataFrame([], HIT)


def keep_clean(docs: DataFrame, items: DataFrame, budget: float = BUDGET, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item stands."""
    spark = docs.sparkSession
    prepare(spark)
    at, schema = docs.columns.index(text_col), docs.schema

    def one_pass(df, group):
        shared = spark.sparkContext.broadcast(group)

        def run(batches):
            matcher = Matcher(shared.value, budget)
            for batch in batches:
                yield batch.filter(pa.array([not (t and matcher(normal(t))) for t in batch.column(at).to_pylist()], pa.bool_()))

        return df.mapInArrow(run, schema)

    for group in groups(items):
        docs = one_pass(docs, group)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
