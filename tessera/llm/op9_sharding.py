"""Sharding by extendible hashing.

A document's hash is the md5 of its id's text; the directory is indexed by the hash's leading bits. Only a bucket over the
byte limit splits, on one more bit, until every bucket fits. Buckets of one depth are summed by prefix with partial
aggregation, so a split costs a small shuffle of sums and never moves a text; the depth of all buckets follows from sums
at every depth in one pass.

Defined cases: a null id hashes as empty text and a null text counts no bytes; rows with one id share all bits and cannot be parted by
them: such a bucket keeps the deepest prefix, and ``fits`` is false if it is over the limit (also for one document larger than the limit);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

SHARD_BYTES = 1 << 20
#: Deepest prefix; 2**32 buckets of the production limit hold 4 PB.
MAX_DEPTH = 32
#: Bits summed in one pass over the sums that are still too large.
STEP = 8


def hash_bits(id_col: str) -> Column:
    """The first 32 bits of the md5 of the id's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def directory(hashed: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes): the buckets of a (h, bytes) table.

    Works on sums by hash prefix: each pass takes the buckets still over the limit down by ``STEP`` bits.
    """
    found, depth = None, 0
    live = hashed.groupBy("h").agg(F.sum("bytes").alias("bytes"))
    live = materialize(live, "hashes")
    over = live.withColumn("open", F.lit(True)).drop("open")
    while True:
        last = min(depth + STEP, MAX_DEPTH)
        depths = list(range(depth + (depth > 0), last + 1))
        sums = (
            over.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", 32 - d).alias("prefix")) for d in depths])).alias("k"), "bytes")
            .groupBy("k.depth", "k.prefix").agg(F.sum("bytes").alias("shard_bytes"))
        )
        sums = materialize(sums, "sums")
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_DEPTH)
        parent = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        top = sums.where(fits & (F.col("depth") == depths[0]))
        below = sums.where(fits & (F.col("depth") > depths[0])).withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left_semi").select("depth", "prefix", "shard_bytes")
        new = top.select("depth", "prefix", "shard_bytes").unionByName(below)
        found = new if found is None else found.unionByName(new)
        open_ = sums.where(~fits & (F.col("depth") == last))
        if last == MAX_DEPTH or open_.isEmpty():
            return found
        over = materialize(over.withColumn("p", F.shiftright("h", 32 - last)).join(open_.select(F.col("prefix").alias("p")), "p", "left_semi").select("h", "bytes"), "over")
        depth = last


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, shard, shard_bytes, fits): ``shard`` is the bucket's bits."""
    h = df.select(F.col(id_col).alias("doc_id"), hash_bits(id_col).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    h = materialize(h, "sized")
    d = materialize(directory(h.select("h", F.col("n_bytes").alias("bytes")), limit), "directory")
    depths = sorted(r[0] for r in d.select("depth").distinct().collect())  # at most 33
    if not depths:
        depths = [0]
    keyed = h.withColumn("k", F.explode(F.array(*[F.struct(F.lit(x).alias("depth"), F.shiftright("h", 32 - x).alias("prefix")) for x in depths])))
    return (
        keyed.select("doc_id", "n_bytes", "k.depth", "k.prefix").join(d, ["depth", "prefix"])
        .select("doc_id", "n_bytes", "depth", F.lpad(F.conv("prefix", 10, 2), F.col("depth"), F.lit("0")).alias("shard"), F.col("shard_bytes").cast("long").alias("shard_bytes"), (F.col("shard_bytes") <= limit).alias("fits"))
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write the rows of each bucket to a folder of its own, named b and its bits, so that no reader takes the bits for a number."""
    name, shard = fresh(df, "id", "shard")
    a = assign(df, id_col, text_col, limit).select(F.col("doc_id").alias(name), F.concat(F.lit("b"), "shard").alias(shard)).distinct()
    df.join(a, F.col(id_col).eqNullSafe(F.col(name))).drop(name).repartition(shard).write.partitionBy(shard).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE = """
WITH h AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM documents
), k AS (
  SELECT doc_id, n_bytes, d.depth, h >> (32 - d.depth) AS prefix
  FROM h, (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS depth) d
), s AS (
  SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM k GROUP BY ALL
), r AS (
  SELECT k.doc_id, k.n_bytes, k.depth, k.prefix, s.shard_bytes,
         row_number() OVER (PARTITION BY k.doc_id ORDER BY k.depth) AS rn
  FROM k JOIN s USING (depth, prefix) WHERE s.shard_bytes <= 1048576 OR k.depth = 32
)
SELECT doc_id, n_bytes, depth,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard,
       shard_bytes, shard_bytes <= 1048576 AS fits
FROM r WHERE rn = 1
"""
