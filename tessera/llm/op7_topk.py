"""Exact top-k inner-product search by aggregation without random access.

Every block of candidates keeps one sorted list per vector component. A query reads the lists of its components
in step, from the top where its weight is positive and from the bottom where it is negative, a round of positions
at a time. What has been read of a candidate, with the lists' extremes or the values at the read heads for the rest,
bounds its score from below and above. A candidate whose upper bound is under the k-th best lower bound is out, and a
query stops reading as soon as few enough remain that finishing them is cheaper than the next round; those scores
are then resolved. Bounds are computed for a whole block of queries by matrix products, since a list's read head
is the same for all queries of one sign.

Candidates and queries meet block by block (a grid of query blocks x candidate blocks), never row by row, and each
meeting returns k rows a query at most. A block of candidates is sorted once, into a row that holds its ids, values and lists.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, as query or candidate; a query meets
vectors of its own length only; equal scores rank by the smaller id; a repeated id is kept as separate candidates,
and no row with the query's own id is a candidate of it; fewer than k candidates give fewer rows; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table

K = 20
SCALE = 64
QUERY_MODULUS = 20
#: Rows of a block on either side of the grid.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
#: Read heads of the rounds, as fractions of a list.
ROUNDS = (0.25, 0.5, 0.7, 0.8, 0.9, 0.95)
OUT = "query_id long, vec_id long, score long"


def quantize(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; rows with unusable vectors go."""
    x = F.col(vec_col).cast("array<double>")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ok.alias("ok")
    ).select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"))


def lists_of(x: np.ndarray) -> np.ndarray:
    """The values of each component in rising order: a list is read from its end for a positive weight, from its start for a negative one."""
    return np.sort(x, axis=0)


def bounded(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, x: np.ndarray, k: int, kind, lists: np.ndarray | None = None):
    """([(query row, candidate rows that bounds leave, share of the lists read)], query rows that the rounds did not resolve)."""
    n = len(x)
    xs = lists_of(x) if lists is None else lists
    pos, neg = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    w = np.hstack([pos, neg])
    low, high = xs[0], xs[-1]
    active = np.arange(len(q))
    keep: list[tuple[int, np.ndarray, float]] = []
    for part in ROUNDS:
        if not len(active):
            break
        depth = max(1, int(n * part))
        top, bottom = xs[n - depth], xs[depth - 1]
        seen_top, seen_bottom = x >= top, x <= bottom
        up = np.hstack([np.where(seen_top, x, top), np.where(seen_bottom, x, bottom)]).astype(kind)
        lo = np.hstack([np.where(seen_top, x, low), np.where(seen_bottom, x, high)]).astype(kind)
        at = w[active]
        lower = at @ lo.T
        lower[qid[active][:, None] == cid[None, :]] = np.iinfo(np.int64).min // 4 if kind is np.int64 else -np.inf
        cut = np.partition(lower, n - min(k, n), axis=1)[:, n - min(k, n)]
        del lower
        upper = at @ up.T
        alive = upper >= cut[:, None]
        counts = alive.sum(1)
        done = counts <= max(8 * k, n // 16)
        for row in np.flatnonzero(done):
            keep.append((int(active[row]), np.flatnonzero(alive[row]), part))
        active = active[~done]
    return keep, active


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, x: np.ndarray, k: int, lists: np.ndarray | None = None):
    """The k best (query, candidate, score) of one block by bounded list reads; ``cid`` in rising order."""
    n, d = x.shape
    big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d
    # whole numbers are exact in float32 under 2**24 and in float64 under 2**53
    kind = np.float32 if big < 2**23 else np.float64 if big < 2**52 else np.int64
    keep, active = bounded(qid, q, cid, x, k, kind, lists)
    rows_q, rows_c, scores = [], [], []

    def best(qi: int, cand: np.ndarray, s: np.ndarray) -> None:
        own = cid[cand] == qid[qi]
        if own.any():
            cand, s = cand[~own], s[~own]
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            take = s >= cut
            cand, s = cand[take], s[take]
        by = np.lexsort((cid[cand], -s))[:k]
        rows_q.append(np.full(len(by), qid[qi]))
        rows_c.append(cid[cand[by]])
        scores.append(s[by].astype(np.int64))

    exact, xk = q.astype(kind), x.astype(kind)
    for qi, cand, _ in keep:
        best(qi, cand, xk[cand] @ exact[qi])
    if len(active):  # lists read to their ends: both bounds are the score
        s = exact[active] @ xk.T
        every = np.arange(n)
        for row, qi in enumerate(active):
            best(qi, every, s[row])
    return (np.concatenate(a) if a else np.empty(0, np.int64) for a in (rows_q, rows_c, scores))


BLOCK = "b int, width int, ids binary, x binary, lists binary"


def _blocks(df: DataFrame, n: int, sort: bool) -> DataFrame:
    """One row for each of ``n`` blocks and each length of vectors: ids in rising order, their vectors, and with ``sort`` the sorted lists."""
    def pack(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(ids), -1)[order]
        lists = lists_of(x).tobytes() if sort else b""
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([key[1].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "x": [x.tobytes()], "lists": [lists]})

    keyed = df.withColumns({"b": F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"), "width": F.size("v")})
    return keyed.groupBy("b", "width").applyInArrow(pack, BLOCK)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) over quantized (vec_id, v) tables."""
    spark = queries.sparkSession
    prepare(spark)
    n, nq = candidates.count(), queries.count()
    cb, qb = max(1, -(-n // candidate_block)), max(1, -(-nq // query_block))
    c = _blocks(candidates, cb, True).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    q = _blocks(queries, qb, False).select(F.col("b").alias("qb"), "width", F.col("ids").alias("qids"), F.col("x").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("b"))

    def meet(batches):
        long = lambda raw: np.frombuffer(raw.as_py(), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, lists, qids, qs, width = (batch.column(name)[row] for name in ("ids", "x", "lists", "qids", "q", "width"))
                d = width.as_py()
                found = search_block(long(qids), long(qs).reshape(-1, d), long(ids), long(x).reshape(-1, d), k, long(lists).reshape(-1, d))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in found], ["query_id", "vec_id", "score"])

    met = c.join(q, ["b", "qb", "width"]).select("ids", "x", "lists", "qids", "q", "width").mapInArrow(meet, OUT)
    # k rows of each candidate block at most meet again for a query
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantize(table(spark, sf_dir, "embeddings"))
    return top_k(v.where(F.pmod("vec_id", F.lit(QUERY_MODULUS)) == 0), v)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
