"""Helpers that the operators of this subpackage share.

``materialize`` writes a table to the folder that the cluster names in ``spark.checkpoint.dir`` and reads it
again: lineage ends at files that every executor sees, so a lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import uuid
import zipfile
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Local mode only, where driver and executors are one process.
LOCAL_DIR = "/tmp/checkpoints/tessera"
BATCH_BYTES = 2 << 20
#: Most 64-bit words of a membership bitset (32 MiB); a smaller one has sixteen bits an id.
BITSET_WORDS = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one beside the warehouse only where the session names none (tests, local mode).

    A cluster must name one: a folder of one machine is of no use to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name the executors' shared folder in spark.checkpoint.dir")
        found = LOCAL_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Ship the package to Python workers and bound the bytes of one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tessera_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession, path: str | None) -> None:
    """Delete the files of a table that nothing reads any more."""
    if path:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], salts: int = 8) -> DataFrame:
    """Inner join on ``key`` with a ``right`` of one row a key, which is repeated so that a common key's left rows meet it in several tasks."""
    salt, = fresh(left, "salt")
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.hash(*spread), F.lit(salts))).join(many, [key, salt]).drop(salt)


def crc32_text(column: str | Column) -> Column:
    """crc32 of a column's text, as a long."""
    return F.crc32(F.encode(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), "utf-8"))


# --- 64-bit mixing, vectorised -------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# --- membership bitset ---------------------------------------------------------

class Bitset:
    """A one-hash filter of longs: no false negatives; false positives only cost later work."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.int64).view(np.uint64)
        w = (h >> np.uint64(6)) & np.uint64(len(self.words) - 1)
        return (self.words[w.astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def bitset(df: DataFrame, column: str, most: int = BITSET_WORDS):
    """A broadcast ``Bitset`` of a hash of a long column of a materialized table, built by a native bit_or aggregation.

    Its size follows the rows; at most ``most`` words reach the driver, whatever the input.
    """
    words = min(most, 1 << max(12, (df.count() // 4).bit_length()))
    h = F.xxhash64(F.col(column))
    word = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))
    rows = (
        df.select(word.alias("w"), F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    found = rows.toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(out)


# --- connected components ------------------------------------------------------

def _local_forest(batches):
    """Union-find over one partition's edges, in bounded chunks; emits a forest with the same components.

    ``moved`` on a chunk's rows: some edge up to there was moved.
    """
    parent: dict = {}
    moved = False

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def flush():
        pairs = [(find(x), x) for x in list(parent) if find(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([moved] * len(pairs), pa.bool_())], ["a", "b", "moved"])

    for batch in batches:
        moved = moved or any(batch.column(2).to_pylist())
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 500_000:
            yield flush()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(id, label): connected components of long edges (a, b); label is the smallest id of the component.

    Distributed union-find: every partition first replaces its edges by a forest, then rounds of a large star and a
    small star run, each ending in local forests again, until a round moves no edge: the edges are stars then. A round
    shuffles three times: the smallest neighbours, the edges by their smaller end, and by their larger end. Only ids that
    some edge names come out; self-loops give no row; an empty input gives an empty table.
    """
    prepare(edges.sparkSession)
    schema = "a long, b long, moved boolean"
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("moved")).where("a < b")
    e = materialize(e.mapInArrow(_local_forest, schema), "edges")
    by = Window.partitionBy("b")
    while e.agg(F.max("moved")).first()[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b", (F.col("m") < F.col("a")).alias("moved"))
        small = large.withColumn("m", F.min("a").over(by)).withColumn("moved", F.expr("moved or m < a"))
        pairs = small.select(F.inline(F.array(F.struct(F.col("m").alias("a"), "b", "moved"), F.struct(F.col("m").alias("a"), F.col("a").alias("b"), "moved")))).where("a < b")
        e = materialize(pairs.mapInArrow(_local_forest, schema), "edges")
    e = e.select("a", "b").distinct()
    return e.select(F.col("b").alias("id"), F.col("a").alias("label")).unionAll(e.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
