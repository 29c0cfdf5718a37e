"""A vector index as partitioned files: cells, blocks of vectors, 8-bit codes.

``build`` fits the cells on a bounded sample and puts every row into one, as a partition of files. A row of the files is a block of
vectors of one cell: their ids, their components, and their codes, as separate columns. ``search`` asks the cells nearest to
each query, so all other partitions are pruned before anything is read, and multiplies blocks by blocks of queries. ``search_coded`` reads the
codes alone first: with what a code can be wrong by, each score has an upper and a lower bound, and only rows whose upper bound reaches the
k-th best lower bound are scored by their components. Its rows are those of the exact search.

Vectors that are null, of another length than ``dim``, or that hold null or non-finite components take no part, in the index or as queries.
Scores are rounded to six places; ties go to the smaller id; repeated rows are rows of their own; an empty table gives an empty index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import new_path, ship, written
from .lexical import best_rows
from .ranking import top_k

#: Most rows that the cells are fitted on, drawn by a hash of the id; all rows are indexed.
SAMPLE = 40_000
BLOCK, QUERY_BLOCK = 1024, 256
#: Rows of a cell that go to one task when its blocks are made: a hot cell is dealt over many.
CELL_ROWS = 64 * BLOCK
ROUNDS = 12
#: Rows and queries of one group where all queries meet all rows.
GROUP_ROWS, GROUP_QUERIES = 64 * BLOCK, 2048


def _valid(df: DataFrame, id_col: str, vector: str, dim: int, more: list[str] | None = None) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *(more or ()))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cell_count(rows: int) -> int:
    """One cell up to 256 rows, then a cell to a hundred rows, from 4 to 4,096."""
    return 1 if rows <= 256 else max(4, min(rows // 100, 4096))


def draw(vectors: DataFrame, rows: int, sample: int) -> DataFrame:
    """The ``sample`` rows of least hash of the id; where these are few of the ``rows``, only rows of small hashes move for it."""
    hashed = F.xxhash64("id")
    if rows > 2 * sample:
        most = int(-(1 << 63) + (1 << 64) * (1.1 * sample + 1000) / rows)
        near = vectors.where(hashed <= most)
        # ids that repeat may leave too few
        vectors = near if most < 1 << 63 and near.count() >= sample else vectors
    return vectors.orderBy(hashed, "id").limit(sample)


def centroids(vectors: DataFrame, n_cells: int, rows: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of the cells, by k-means for inner products on at most ``sample`` of the ``rows`` (drawn by a hash of the id, so each run draws alike)."""
    drawn = draw(vectors, rows, sample).select("v").toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 0))
    x = _matrix(drawn.column("v"))
    c = x[np.linspace(0, len(x) - 1, min(n_cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(c)) > 0
        c = np.where(held[:, None], sums, c)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _scale(vectors: DataFrame) -> DataFrame:
    """(dim, low, high): the range of each component; a task sends one row a batch and component."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1]), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], ["dim", "low", "high"])

    return vectors.select("v").mapInArrow(run, "dim int, low double, high double").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _codes(x: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x - low) / step), 0, 255).astype(np.uint8)


def build(df: DataFrame, path: str, id_col: str, vector: str, dim: int, n_cells: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of ``df`` below ``path``: ``blocks`` (partitioned by cell), ``cells`` and ``scale``. Building again replaces it."""
    spark = df.sparkSession
    ship(spark)
    vectors = _valid(df, id_col, vector, dim)
    rows = vectors.count()
    n_cells = n_cells or cell_count(rows)
    centres = centroids(vectors, n_cells, rows, sample)
    spark.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    _scale(vectors).coalesce(1).write.mode("overwrite").parquet(f"{path}/scale")
    low, step = _read_scale(spark, path)
    shared = spark.sparkContext.broadcast((centres, low, step))  # at most 4,096 centres

    def assign(batches):
        c = shared.value[0]
        for b in batches:
            x = _matrix(b.column(1))
            cell = (x @ c.T).argmax(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1)], ["cell", "id", "v"])

    placed = written(vectors.mapInArrow(assign, "cell int, id long, v array<double>"), "placed")
    deals = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).alias("deals"))  # at most a row a cell
    dealt = placed.join(F.broadcast(deals), "cell").withColumn("deal", F.pmod(F.xxhash64("id"), "deals")).repartition("cell", "deal").sortWithinPartitions("cell", "id")

    def pack(batches):
        _, low, step = shared.value
        task, made = TaskContext.get().partitionId(), 0
        cell, ids, parts = None, [], []

        def block():
            nonlocal made
            x = np.concatenate(parts)
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made], pa.int64()), pa.array([np.concatenate(ids)]), pa.array([x.astype("<f8").tobytes()], pa.binary()),
                 pa.array([_codes(x, low, step).tobytes()], pa.binary()), pa.array([cell], pa.int32())], ["block", "ids", "vectors", "codes", "cell"])

        for b in batches:
            cells, keys, x = b.column("cell").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("v"))
            at = 0
            while at < len(cells):
                if parts and (cells[at] != cell or sum(map(len, ids)) >= BLOCK):
                    yield block()
                    ids, parts = [], []
                cell = cells[at]
                room = BLOCK - sum(map(len, ids))
                end = min(at + room, int(np.searchsorted(cells, cell, side="right")))
                ids.append(keys[at:end])
                parts.append(x[at:end])
                at = end
        if parts:
            yield block()

    blocks = dealt.select("cell", "id", "v").mapInArrow(pack, "block long, ids array<long>, vectors binary, codes binary, cell int")
    blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")


def _read_scale(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(spark.read.parquet(f"{path}/scale").collect())  # a row a component
    low, high = np.array([r.low for r in rows]), np.array([r.high for r in rows])
    return low, np.maximum((high - low) / 255, 1e-300)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("block long, ids array<long>, vectors binary, codes binary, cell int").parquet(f"{path}/blocks")


def probes(spark: SparkSession, path: str, queries: DataFrame, query_id: str, vector: str, dim: int, n_probe: int | None) -> DataFrame:
    """(cell, part, qids, q): the queries that ask each cell, in matrices of at most ``QUERY_BLOCK`` rows; all cells where ``n_probe`` is None."""
    ship(spark)
    rows = sorted(spark.read.parquet(f"{path}/cells").collect())  # at most 4,096
    centres = np.array([r.centre for r in rows])
    shared = spark.sparkContext.broadcast(centres)
    most = len(centres) if n_probe is None else min(n_probe, len(centres))

    def ask(batches):
        c = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            if len(x) and most:
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :most]
                at = np.repeat(np.arange(len(x)), most)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["cell", "id", "v"])

    def pack(batches):
        made, task = 0, TaskContext.get().partitionId()
        for b in batches:
            cells = b.column("cell").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
            for s, e in zip(cuts[:-1], cuts[1:]):
                for a in range(s, e, QUERY_BLOCK):
                    part = b.slice(a, min(e - a, QUERY_BLOCK))
                    made += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cells[a]], pa.int32()), pa.array([task << 32 | made], pa.int64()), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                         pa.array([_matrix(part.column("v")).astype("<f8").tobytes()], pa.binary())], ["cell", "part", "qids", "q"])

    asked = _valid(queries, query_id, vector, dim).mapInArrow(ask, "cell int, id long, v array<double>")
    asked = asked.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(8))).repartition("cell", "deal").sortWithinPartitions("cell", "id").drop("deal")
    return asked.mapInArrow(pack, "cell int, part long, qids array<long>, q binary")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        at = np.arange(len(score))
    at = at[np.isfinite(score[at])]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _own(ids: np.ndarray, qids: np.ndarray, score: np.ndarray, others_only: bool) -> np.ndarray:
    return np.where(ids[None, :] == qids[:, None], -np.inf, score) if others_only else score


def _met(spark: SparkSession, path: str, asked: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks of the asked cells beside the queries that ask them; other partitions are never opened."""
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # at most 4,096 numbers
    return blocks(spark, path).where(F.col("cell").isin(cells)).select("cell", "block", *columns).join(asked, "cell")


def _multiplied(pairs: DataFrame, k: int, others_only: bool) -> DataFrame:
    """(query_id, id, score): the k best of each meeting of a block (ids, vectors) and a block of queries (qids, q)."""
    def run(batches):
        for b in batches:
            for ids, raw, qids, q in zip(*(b.column(c) for c in ("ids", "vectors", "qids", "q"))):
                ids, qids = np.array(ids.as_py()), np.array(qids.as_py())
                x = np.frombuffer(raw.as_py(), "<f8").reshape(len(ids), -1)
                score = _own(ids, qids, np.round(np.frombuffer(q.as_py(), "<f8").reshape(len(qids), -1) @ x.T, 6), others_only)
                best = [_best(s, ids, k) for s in score]
                n = [len(x) for x in best]
                at = np.concatenate(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(ids[at]), pa.array(score[np.repeat(np.arange(len(qids)), n), at])], ["query_id", "id", "score"])

    found = pairs.select("ids", "vectors", "qids", "q").mapInArrow(run, "query_id long, id long, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), k, ["query_id"], "score", "id").select("query_id", "rank", "id", "score")


def _k_best(parts, qids: np.ndarray, q: np.ndarray, k: int, others_only: bool) -> pa.Table:
    """(query_id, id, score): the k best of each query over (ids, vectors) parts, one part in memory at a time with what is best so far."""
    found, waiting, least = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})], 0, np.full(len(qids), -np.inf)
    for ids, x in parts:
        score = _own(ids, qids, np.round(q @ x.T, 6), others_only)
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
        who, at = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        found.append(pa.table({"query_id": qids[who], "id": ids[at], "score": score[who, at]}))
        waiting += len(who)
        if waiting > 4 * k * len(qids):
            found, waiting = [best_rows(pa.concat_tables(found), k)], 0
    return best_rows(pa.concat_tables(found), k)


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _groups(rows: int, queries: int) -> tuple[int, int]:
    return max(1, -(-rows // GROUP_ROWS)), max(1, -(-queries // GROUP_QUERIES))


def _dealt_blocks(spark: SparkSession, path: str, queries: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks and (id, v, ...) of queries by (deal, asker): every query meets every block, in groups of bounded rows on both sides."""
    rows = blocks(spark, path).agg(F.sum(F.size("ids"))).first()[0] or 0
    n, m = _groups(rows, queries.count())
    b = blocks(spark, path).select(*columns).withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")).withColumn("asker", _every(m))
    return b, queries.withColumn("asker", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("deal", _every(n))


def _searched(spark: SparkSession, path: str, queries: DataFrame, k: int, others_only: bool) -> DataFrame:
    """``search`` over all cells: no query is copied to each cell, and a group of many blocks gives k rows a query."""
    def run(b: pa.Table, asked: pa.Table) -> pa.Table:
        parts = ((np.array(ids.as_py()), np.frombuffer(raw.as_py(), "<f8").reshape(len(ids), -1)) for ids, raw in zip(b.column("ids"), b.column("vectors")))
        return _k_best(parts if asked.num_rows else (), asked.column("id").to_numpy(), _matrix(asked.column("v")), k, others_only)

    ship(spark)
    b, asked = _dealt_blocks(spark, path, queries, ["block", "ids", "vectors"])
    return b.groupBy("deal", "asker").cogroup(asked.groupBy("deal", "asker")).applyInArrow(run, "query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_k(found.withColumn("score", F.round("score", 6)), k, ["query_id"], "score", "id").select("query_id", "rank", "id", "score")


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, vector: str, dim: int, k: int, n_probe: int | None = 16, others_only: bool = True) -> DataFrame:
    """(query_id, rank, id, score): the k best inner products among the rows of the ``n_probe`` nearest cells (None: all cells, so exact)."""
    if n_probe is None:
        return _ranked(_searched(spark, path, _valid(queries, query_id, vector, dim), k, others_only), k)
    asked = written(probes(spark, path, queries, query_id, vector, dim, n_probe), "probes")
    return _multiplied(_met(spark, path, asked, ["ids", "vectors"]), k, others_only)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, dim: int, k: int, part: str | None = None, others_only: bool = True) -> DataFrame:
    """(query_id, rank, id, score): the k best cosines of each query among all rows, or all of its ``part`` (a long), without an index.

    Rows and queries meet in a grid of groups of bounded size, never row by row; a group gives k rows a query, and nothing is broadcast.
    """
    ship(rows.sparkSession)
    of = lambda df: _valid(df.withColumn("_part", F.col(part).cast("long") if part else F.lit(0).cast("long")), id_col, vector, dim, ["_part"]).withColumnRenamed("_part", "part")
    r, q = of(rows), of(queries)
    n, m = _groups(rows.count(), queries.count())
    block = BLOCK

    def unit(column) -> np.ndarray:
        x = _matrix(column)
        size = np.linalg.norm(x, axis=1)
        return x / np.where(size > 0, size, 1)[:, None]

    def run(t: pa.Table, asked: pa.Table) -> pa.Table:
        parts = ((t.column("id").slice(a, block).to_numpy(), unit(t.column("v").slice(a, block))) for a in range(0, t.num_rows if asked.num_rows else 0, block))
        return _k_best(parts, asked.column("id").to_numpy(), unit(asked.column("v")) if asked.num_rows else np.zeros((0, dim)), k, others_only)

    keys = ["part", "deal", "asker"]
    left = r.where("part is not null").withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("asker", _every(m))
    right = q.where("part is not null").withColumn("asker", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("deal", _every(n))
    met = left.toDF(*left.columns).groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys))
    return _ranked(met.applyInArrow(run, "query_id long, id long, score double"), k)


def candidates(spark: SparkSession, path: str, asked: DataFrame, k: int, others_only: bool = True) -> DataFrame:
    """(cell, block, part, query_id, place, id, upper): rows that may be among a query's k best by what their codes allow."""
    low, step = _read_scale(spark, path)
    shared = spark.sparkContext.broadcast((low, step))  # two numbers a component

    def run(batches):
        low, step = shared.value
        for b in batches:
            for cell, block, part, ids, raw, qids, q in zip(*(b.column(c) for c in ("cell", "block", "part", "ids", "codes", "qids", "q"))):
                ids, qids = np.array(ids.as_py()), np.array(qids.as_py())
                x = low + np.frombuffer(raw.as_py(), np.uint8).reshape(len(ids), -1) * step
                q = np.frombuffer(q.as_py(), "<f8").reshape(len(qids), -1)
                # a code is wrong by half a step at most; the last part is rounding
                slack = (np.abs(q) @ (step / 2 * (1 + 1e-9)) + 1e-6)[:, None]
                score = _own(ids, qids, q @ x.T, others_only)
                least = np.partition(score, -k, axis=1)[:, -k:-k + 1 or None] - slack if score.shape[1] > k else np.full((len(qids), 1), -np.inf)
                who, place = np.nonzero((score + slack >= least) & np.isfinite(score))
                one = lambda v: pa.array([v.as_py()] * len(who), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [one(cell).cast(pa.int32()), one(block), one(part), pa.array(qids[who]), pa.array(place, pa.int32()), pa.array(ids[place]), pa.array(score[who, place] + slack[who, 0]),
                     pa.array(score[who, place] - slack[who, 0])], ["cell", "block", "part", "query_id", "place", "id", "upper", "lower"])

    # the components' column is not read here
    near = _met(spark, path, asked, ["ids", "codes"]).select("cell", "block", "part", "ids", "codes", "qids", "q")
    near = written(near.mapInArrow(run, "cell int, block long, part long, query_id long, place int, id long, upper double, lower double"), "bounded")
    kth = top_k(near, k, ["query_id"], "lower", "id").groupBy("query_id").agg(F.count("*").alias("n"), F.min("lower").alias("least"))
    kept = near.join(kth, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("least")))
    return kept.drop("n", "least", "lower")


def search_coded(spark: SparkSession, path: str, queries: DataFrame, query_id: str, vector: str, dim: int, k: int, n_probe: int | None = 16, others_only: bool = True) -> DataFrame:
    """The rows of ``search``, with components read only for rows whose codes leave them a chance.

    Over all cells, the k-th score in a query's nearest cells is found first: it is a floor that the k-th of all rows cannot be under, so a code's row
    leaves its task only if it may reach that.
    """
    if n_probe is None:
        asked = written(_valid(queries, query_id, vector, dim), "asked")
        near = search(spark, path, queries, query_id, vector, dim, k, 16, others_only)
        floor = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
        left = written(_may_reach(spark, path, asked.join(floor, "id", "left"), k, others_only), "left")
    else:
        asked = _valid(queries, query_id, vector, dim)
        probed = written(probes(spark, path, queries, query_id, vector, dim, n_probe), "probes")
        left = written(candidates(spark, path, probed, k, others_only), "left").select("cell", "block", "query_id", "place", "id")
    cells = [r.cell for r in left.select("cell").distinct().collect()]  # at most 4,096 numbers
    data = blocks(spark, path).where(F.col("cell").isin(cells)).select("block", "ids", "vectors")
    wanted = left.join(asked.dropDuplicates(["id"]).select(F.col("id").alias("query_id"), "v"), "query_id").select("block", "query_id", "place", "id", "v")

    def rescore(b: pa.Table, other: pa.Table) -> pa.Table:
        if not b.num_rows or not other.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x = np.frombuffer(b.column("vectors")[0].as_py(), "<f8").reshape(len(b.column("ids")[0]), -1)
        return pa.table({"query_id": other.column("query_id"), "id": other.column("id"), "score": np.einsum("ij,ij->i", _matrix(other.column("v")), x[other.column("place").to_numpy()])})

    scored = data.groupBy("block").cogroup(wanted.toDF(*wanted.columns).groupBy("block")).applyInArrow(rescore, "query_id long, id long, score double")
    return _ranked(scored, k)


def _may_reach(spark: SparkSession, path: str, asked: DataFrame, k: int, others_only: bool) -> DataFrame:
    """(cell, block, query_id, place, id): rows of all cells whose codes let them reach ``least`` of (id, v, least), or the k-th of their group where it is null."""
    low, step = _read_scale(spark, path)
    shared = spark.sparkContext.broadcast((low, step))  # two numbers a component

    def run(b: pa.Table, asked: pa.Table) -> pa.Table:
        low, step = shared.value
        out = [pa.table({"cell": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "id": pa.array([], pa.int64())})]
        qids, q = asked.column("id").to_numpy(), _matrix(asked.column("v"))
        # the scores that made the floor are rounded to six places
        least = np.nan_to_num(asked.column("least").to_numpy().astype(float), nan=-np.inf, neginf=-np.inf) - 1e-6
        for cell, block, ids, raw in zip(*(b.column(c) for c in ("cell", "block", "ids", "codes"))) if asked.num_rows else ():
            ids = np.array(ids.as_py())
            x = low + np.frombuffer(raw.as_py(), np.uint8).reshape(len(ids), -1) * step
            # a code is wrong by half a step at most; the last part is rounding
            slack = np.abs(q) @ (step / 2 * (1 + 1e-9)) + 1e-6
            score = _own(ids, qids, q @ x.T, others_only)
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] - slack)
            who, place = np.nonzero((score + slack[:, None] >= least[:, None]) & np.isfinite(score))
            one = lambda v, kind: pa.array(np.full(len(who), v.as_py()), kind)
            out.append(pa.table({"cell": one(cell, pa.int32()), "block": one(block, pa.int64()), "query_id": pa.array(qids[who]), "place": pa.array(place, pa.int32()), "id": pa.array(ids[place])}))
        return pa.concat_tables(out)

    b, q = _dealt_blocks(spark, path, asked, ["cell", "block", "ids", "codes"])
    return b.groupBy("deal", "asker").cogroup(q.groupBy("deal", "asker")).applyInArrow(run, "cell int, block long, query_id long, place int, id long")


def rescored(left: DataFrame, rows: int) -> DataFrame:
    """(query_id, rescored, share): how many rows each query reads by their components, and their share of all."""
    return left.groupBy("query_id").agg(F.count("*").alias("rescored")).withColumn("share", F.round(F.col("rescored") / rows, 6))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, expected, hits, recall) of two results of (query_id, id)."""
    hit = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    r = exact.select("query_id", "id").distinct().join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("expected"), F.count("hit").alias("hits"))
    return r.withColumn("recall", F.round(F.col("hits") / F.col("expected"), 6))


def temporary(df: DataFrame, id_col: str, vector: str, dim: int, **more) -> str:
    """Build an index that lives as long as the application; its path."""
    path = new_path(df.sparkSession, "vectors")
    build(df, path, id_col, vector, dim, **more)
    return path
