"""Passages of whole sentences over the texts of long groups, without one task that sees a group.

Each text is cut into its sentences' numbers of words; these are sorted by ranges of key and order, and taken in chunks. What a chunk begins with may go on
with the sentence before, so chunks are joined by one small row each. Sentences are then dealt in blocks, each with the few before it that a passage can still hold. A block
says, for each passage that can be open where it begins, which one is open where it ends and how many were closed; following these rows gives each block the passage that is
open and its place, and all blocks are cut at once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import let
from ..sources.store import ship, written
from .chunking import SENTENCE

#: Texts of a chunk as a power of two, sentences of a block, sentences that one more task is made for, most tasks.
CHUNK_BITS, BLOCK, TASK_SENTENCES, MOST_TASKS = 12, 1 << 13, 1 << 18, 1024


def closed(sums: list[int], a: int, b: int, most: int, carry_words: int) -> Iterator[tuple[int, int, int]]:
    """Of sentences with ``sums`` words before each: (a, b, n) for each passage that is closed from the open one [a, b) on, n its words and [a, b) the one open after it; the last has n = -1 and is not closed.

    A passage begins with as many sentences of the one before as it takes to reach ``carry_words``, and holds one more at least.
    """
    while (c := max(b, a + 1, bisect_right(sums, sums[a] + most) - 1)) < len(sums) - 1:
        n = sums[c] - sums[a]
        a, b = max(a, bisect_right(sums, sums[c] - carry_words) - 1), c + 1
        yield a, b, n
    yield a, len(sums) - 1, -1


def ways(counts: np.ndarray, look: int, most: int, carry_words: int) -> list[tuple[int, int, int]]:
    """(held, held after, closed): for each number of sentences that a passage can hold where a block begins, ``look`` sentences into ``counts``, the number where it ends and the passages closed."""
    sums = [0, *np.cumsum(counts).tolist()]
    out, seen = [], {}
    for held in range(min(look, 1), look + 1):
        a = look - held
        if held > 1 and sums[look] - sums[a] > most and sums[look - 1] - sums[a + 1] >= carry_words:
            break
        n, mine = 0, []
        for a, b, words in closed(sums, a, look, most, carry_words):
            if words < 0:
                out.append((held, b - a, n))
            elif (a, b) in seen:  # from here on another's way
                end, left = seen[a, b]
                out.append((held, end, n + 1 + left))
                break
            else:
                n += 1
                mine.append((a, b))
        held, end, total = out[-1]
        seen.update({s: (end, total - i - 1) for i, s in enumerate(mine)})
    return out


def _sentences_of(batches, by):
    """Of a chunk's texts, the words before the first sentence that surely begins in it, and those of its sentences."""
    for x in batches:
        rows = []
        for parts, counts, starts, ends in zip(x["_parts"], x["_counts"], x["_starts"], x["_ends"]):
            begins = np.ones(len(counts), bool)
            firsts = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(int)
            begins[firsts] = np.concatenate([[True], np.asarray(ends, bool)[:-1] & np.asarray(starts, bool)[1:]])
            sums = np.add.reduceat(np.asarray(counts, np.int64), np.flatnonzero(begins))
            rows.append((int(sums[0]), sums[1:], bool(starts[0]), bool(ends[-1])))
        yield pd.concat([x[[*by, "_c"]].reset_index(drop=True), pd.DataFrame(rows, columns=["_head", "_rest", "_starts", "_ends"])], axis=1)


def _ways_of(batches, by, most, carry_words):
    for x in batches:
        found = [ways(np.asarray(c), look, most, carry_words) for c, look in zip(x["_counts"], x["_look"])]
        yield x[[*by, "_k"]].assign(_held=[[w[0] for w in f] for f in found], _after=[[w[1] for w in f] for f in found], _closed=[[w[2] for w in f] for f in found])


def _followed(x, by):
    """The open passage's sentences and its place at the beginning of each block of a group."""
    x = x.sort_values("_k")
    held = idx = 0
    out = []
    for ins, after, n in zip(x["_held"], x["_after"], x["_closed"]):
        out.append((held, idx))
        at = list(ins).index(held)
        held, idx = int(after[at]), idx + int(n[at])
    return x[[*by, "_k"]].assign(_open=[o[0] for o in out], _idx=[o[1] for o in out])


def _cut(batches, by, most, carry_words):
    for x in batches:
        out = []
        for counts, look, held, idx, last in zip(x["_counts"], x["_look"], x["_open"], x["_idx"], x["_last"]):
            sums = [0, *np.cumsum(counts).tolist()]
            found, a = [], look - held
            for a, b, n in closed(sums, a, look, most, carry_words):
                found.append(n if n >= 0 else sums[b] - sums[a])
            found = found if last else found[:-1]
            out.append((np.arange(idx, idx + len(found)), found))
        n = [len(f) for _, f in out]
        y = {c: np.repeat(x[c].to_numpy(), n) for c in by}
        yield pd.DataFrame(y | {"idx": np.concatenate([o[0] for o in out] or [[]]).astype(np.int32), "n_words": np.concatenate([o[1] for o in out] or [[]]).astype(np.int32)})


def _like(df: DataFrame, by: list[str], rest: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema] + [rest])


def _chunks(texts: DataFrame, by: list[str], order: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(by, _c, _head, _rest, _starts, _ends): sentences of chunks of texts in order; and the keys with a text that is white space, but not only blanks."""
    whole = F.col(text).isNotNull() & (F.trim(text) != "")
    for c in by:
        whole &= F.col(c).isNotNull()
    # texts move once, to tell apart those of equal order; from there on only numbers do
    t = texts.where(whole).select(*by, F.col(order).alias("_order"), F.col(text).alias("_text"))
    t = t.withColumn("_tie", F.row_number().over(Window.partitionBy(*by, "_order").orderBy("_text")))
    words = lambda p: F.regexp_count(p, F.lit(r"[^ \t\n\r]+"))
    counts = F.when(F.col("_text").rlike(r"\S"), F.transform(F.split("_text", SENTENCE), words)).alias("_counts")
    t = written(t.select(*by, "_order", "_tie", counts, F.col("_text").rlike(r"^\s*[A-Z(\[]").alias("_starts"), F.col("_text").rlike(r"[.;:]\s*\z").alias("_ends")), "sentences")
    at = [*by, F.col("_order").asc_nulls_last(), "_tie"]
    s = written(t.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_at", F.monotonically_increasing_id()).drop("_order", "_tie"), "ordered")
    # a monotonic id is the task's number and then the row's place in the task
    g = s.where("_counts is not null").groupBy(*by, F.shiftright("_at", CHUNK_BITS).alias("_c")).agg(F.sort_array(F.collect_list(F.struct("_at", "_counts", "_starts", "_ends"))).alias("_t"))
    of = lambda f: F.transform("_t", f)
    g = g.select(*by, "_c", of(lambda t: F.size(t["_counts"])).alias("_parts"), F.flatten(of(lambda t: t["_counts"])).alias("_counts"), of(lambda t: t["_starts"]).alias("_starts"), of(lambda t: t["_ends"]).alias("_ends"))
    c = g.mapInPandas(lambda b: _sentences_of(b, by), _like(g, by, "_c long, _head long, _rest array<int>, _starts boolean, _ends boolean"))
    return written(c, "chunks"), s.where("_counts is null").select(*by).distinct()


def _blocks(chunks: DataFrame, by: list[str], look: int) -> DataFrame:
    """(by, _k, _counts, _look, _last): words of a block's sentences, after those of the ``look`` sentences before it."""
    w = Window.partitionBy(*by).orderBy("_c")
    h = chunks.select(*by, "_c", "_head", F.size("_rest").alias("_m"), (F.coalesce(F.lag("_ends").over(w), F.lit(True)) & (F.col("_starts") | F.lag("_c").over(w).isNull())).alias("_own"))
    h = h.withColumn("_m", F.col("_m") + F.col("_own").cast("int")).withColumns({
        "_q": F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"), "_all": F.sum("_m").over(Window.partitionBy(*by)),
        "_more": F.sum(F.when(F.col("_own"), 0).otherwise(F.col("_head"))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    # a chunk's last sentence goes on in the heads up to and with that of the next chunk in which a sentence begins
    back = Window.partitionBy(*by).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_add", F.coalesce(F.last(F.when(F.col("_m") > 0, F.col("_more")), ignorenulls=True).over(back), F.max("_more").over(Window.partitionBy(*by))) - F.col("_more"))
    h = h.where("_m > 0").select(*by, "_c", "_m", "_own", "_q", "_all", "_add")
    every: Column = F.when(F.col("_own"), F.concat(F.array(F.col("_head").cast("int")), "_rest")).otherwise(F.col("_rest"))
    x = chunks.select(*by, "_c", "_head", "_rest").join(F.broadcast(h), [*by, "_c"])  # a row to a chunk
    last = F.floor((F.col("_all") - 1) / BLOCK)
    x = x.select(*by, "_q", "_m", "_add", every.alias("_n"), last.alias("_end"), F.explode(F.sequence(F.floor(F.col("_q") / BLOCK), F.least(last, F.floor((F.col("_q") + F.col("_m") - 1 + look) / BLOCK)))).alias("_k"))
    begin = F.greatest(F.lit(0), F.col("_k") * BLOCK - look - F.col("_q"))
    end = F.least(F.col("_m").cast("long"), (F.col("_k") + 1) * BLOCK - F.col("_q"))
    part = let(begin, lambda a: F.transform(F.slice("_n", (a + 1).cast("int"), (end - a).cast("int")), lambda n, i: n + F.when(i + a == F.col("_m") - 1, F.col("_add")).otherwise(0).cast("int")))
    x = x.where(begin < end).select(*by, "_k", "_end", F.struct((F.col("_q") + begin).alias("q"), part.alias("n")).alias("_p"))
    # numbers pack well, so their bytes say little about the work
    n_tasks = int(min(MOST_TASKS, 1 + (h.agg(F.sum("_m")).first()[0] or 0) // TASK_SENTENCES))
    g = x.repartition(n_tasks, *by, "_k").groupBy(*by, "_k").agg(F.sort_array(F.collect_list("_p")).alias("_p"), (F.first("_end") == F.col("_k")).alias("_last"))
    return g.select(*by, "_k", F.flatten(F.transform("_p", lambda p: p["n"])).alias("_counts"), (F.col("_k") * BLOCK - F.col("_p")[0]["q"]).cast("int").alias("_look"), "_last")


def passage_sizes(texts: DataFrame, by: list[str], order: str, text: str, most: int = 220, carry_words: int = 40) -> DataFrame:
    """(by, idx, n_words): the passages of ``chunking.passages`` over a group's texts, joined by blanks in their order and, where that is equal, in that of the texts.

    Groups without a key have none; a missing text is none, a missing order comes last.
    """
    ship(texts.sparkSession)
    chunks, odd = _chunks(texts, by, order, text)
    b = written(_blocks(chunks, by, max(most, carry_words) + 1), "blocks")
    found = b.mapInPandas(lambda x: _ways_of(x, by, most, carry_words), _like(b, by, "_k long, _held array<int>, _after array<int>, _closed array<int>"))
    entries = found.groupBy(*by).applyInPandas(lambda x: _followed(x, by), _like(b, by, "_k long, _open int, _idx int"))
    rows = _like(b, by, "idx int, n_words int")
    out = b.join(F.broadcast(entries), [*by, "_k"]).mapInPandas(lambda x: _cut(x, by, most, carry_words), rows)
    # a group that is white space, but not only blanks, is one sentence without words
    blank = odd.join(chunks.select(*by).distinct(), by, "left_anti").select(*by, F.lit(0).alias("idx"), F.lit(0).alias("n_words"))
    return out.unionByName(blank)
