"""Linking near-duplicates from hash buckets, without pairs within a bucket.

``members`` keeps of each bucket with several ids its smallest id (the representative) and the other ids: one row per id
and bucket. ``link`` verifies every member against its representative, joins what is alike by distributed
union-find, and then compares only members of a bucket that are still in different components: within a bucket (in
blocks of bounded size), each member outside the largest component against the others through an inverted index, until
one component is left. So no link that some bucket offers between components is lost, a bucket of many alike ids costs
one comparison an id, and only a forest of links leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, n_shuffle

#: Rows of a block of a bucket; a task holds two.
BLOCK = 2000
#: Cells of a bucket's table of sets and elements, up to which it is laid out.
DENSE = 4_000_000


def members(rows: DataFrame, again: Column | None = None) -> DataFrame:
    """(key, rep, id) from (key, id): ids of a bucket but its smallest. ``again``: and rows that repeat (key, id), flagged, of the keys it names."""
    by = Window.partitionBy("key").orderBy("id")
    # in order of id: nothing of a bucket is held but the row before
    named = rows.repartition(n_shuffle(rows.sparkSession), "key").select("key", "id", F.first("id").over(by).alias("rep"), F.lag("id").over(by).eqNullSafe(F.col("id")).alias("again"))
    if again is not None:
        return named.where((F.col("again") & again) | (~F.col("again") & (F.col("rep") != F.col("id"))))
    return named.where("rep <> id and not again").select("key", "rep", "id")


def _groups(batches, by: list[str]):
    """Tables of whole groups, from batches sorted by ``by``; a table has one group, or few rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < BLOCK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        ends = _ends(t, by)
        if len(ends) > 1:
            yield t.slice(0, ends[-2]), ends[:-1]
            t = t.slice(ends[-2])
        held = pa.concat_tables([t]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _ends(t, by)


def _ends(t: pa.Table, by: list[str]) -> list[int]:
    new = np.zeros(t.num_rows - 1, dtype=bool)
    for c in by:
        x = t.column(c).to_numpy()
        new |= x[1:] != x[:-1]
    return [*(np.flatnonzero(new) + 1).tolist(), t.num_rows]


def _rest(prepare: Callable):
    """Links between components of one bucket: rows (key, x, y, id, label, content...) sorted by bucket in, a forest of links out."""

    def forest(ids: np.ndarray, labels: np.ndarray, near: Callable) -> list[tuple[int, int]]:
        kinds, inv, many = np.unique(labels, return_inverse=True, return_counts=True)
        root = list(range(len(kinds)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out, left = [], len(root)
        # the largest component's members are met by all others, so they need not be asked
        for i in np.flatnonzero(inv != int(many.argmax())):
            if left == 1:
                break
            hit = np.flatnonzero(near(i))
            for k in np.unique(inv[hit]):
                a, b = find(inv[i]), find(k)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left -= 1
                    j = hit[inv[hit] == k][0]
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return out

    def run(batches):
        for t, ends in _groups(batches, ["key", "x", "y"]):
            make = prepare(t)
            ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
            out, start = [], 0
            for end in ends:
                if (labels[start:end] != labels[start]).any():
                    out += forest(ids[start:end], labels[start:end], make(start, end))
                start = end
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return run


def link(found: DataFrame, content: Callable[[DataFrame], DataFrame], alike: Callable[[DataFrame], DataFrame], neighbours: Callable) -> DataFrame:
    """(id, label) of ids that some verified link joins.

    ``found``: a materialised ``members`` table. ``content(ids)``: (id, content...) of an (id) table. ``alike(pairs)``:
    the (a, b) of those rows of (a, b, left content, right content) that are alike. ``neighbours(table)``: for an Arrow table of
    buckets, a function of a bucket's first and last row that gives a function from a row number to which rows are alike to it.
    """
    ids = materialize(found.select("id").unionByName(found.select(F.col("rep").alias("id"))).distinct(), "candidates")
    held = materialize(content(ids), "content")
    left = held.select(F.col("id").alias("a"), F.struct(*[c for c in held.columns if c != "id"]).alias("left"))
    right = held.select(F.col("id").alias("b"), F.struct(*[c for c in held.columns if c != "id"]).alias("right"))
    stars = found.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    edges = materialize(alike(stars.join(left, "a").join(right, "b").select("a", "b", "left", "right")), "links")
    labels = materialize(components(edges), "labels")
    # buckets of three ids or more that are still in several components; of buckets with the same ids one will do
    whole = found.select("key", "id").unionByName(found.select("key", F.col("rep").alias("id")).distinct())
    whole = whole.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = whole.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.where("n > 2 and lo <> hi").groupBy("n", "ids").agg(F.min("key").alias("key"))
    rest = whole.join(mixed.select("key", "n"), "key")
    # a large bucket is cut in blocks, and every two blocks meet
    rest = rest.withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("c", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    rest = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rest = rest.select("key", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), "id", "label")
    rest = rest.join(held, "id").repartition(n_shuffle(ids.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    more = materialize(rest.mapInArrow(_rest(neighbours), "a long, b long"), "links")
    if more.isEmpty():
        return labels
    # the stars found before stand for the links they came from
    return components(labels.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(more))


class Overlap:
    """Exact overlaps of one set with all sets of a bucket, from an inverted index; ``shares``: of each set's elements."""

    def __init__(self, sets: list[np.ndarray], shares: list[np.ndarray] | None = None):
        self.n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.n)
        _, item = np.unique(np.concatenate(sets), return_inverse=True)
        by = np.argsort(item, kind="stable")
        self.owner = owner[by]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(item))))
        self.items = np.split(item, np.cumsum(self.n)[:-1])
        self.shares, self.share = shares, None if shares is None else np.concatenate(shares)[by]
        self.table = None
        if len(sets) * (len(self.start) - 1) <= DENSE:
            self.table = np.zeros((len(sets), len(self.start) - 1), dtype=np.float32)
            self.table[owner, item] = 1

    def jaccard(self, i: int) -> np.ndarray:
        if self.table is not None:  # whole numbers, exact in float32
            common = self.table @ self.table[i]
            return common / np.maximum(self.n[i] + self.n - common, 1)
        own = self.items[i]
        lists = [self.owner[self.start[k]:self.start[k + 1]] for k in own]
        common = np.bincount(np.concatenate(lists), minlength=len(self.n)) if lists else np.zeros(len(self.n))
        return common / np.maximum(self.n[i] + self.n - common, 1)

    def least(self, i: int) -> np.ndarray:
        """The sum over common elements of the smaller share."""
        own = self.items[i]
        if not len(own):
            return np.zeros(len(self.n))
        at = [slice(self.start[k], self.start[k + 1]) for k in own]
        mine = np.repeat(self.shares[i], [x.stop - x.start for x in at])
        return np.bincount(np.concatenate([self.owner[x] for x in at]), np.minimum(mine, np.concatenate([self.share[x] for x in at])), len(self.n))
