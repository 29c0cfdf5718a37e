"""Top-k per group, rank fusion, boosts and reordering; every order ends in an id, so ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60

# Multipliers of a court's name, first substring wins.
COURT_MULTIPLIERS = [
    ("SUPREME COURT OF INDIA", 1.25), ("SUPREME COURT", 1.25), ("SC", 1.25), ("CONSTITUTIONAL BENCH", 1.20), ("FULL BENCH", 1.15),
    ("LARGER BENCH", 1.15), ("DIVISION BENCH", 1.10), ("HIGH COURT", 1.05), ("HC", 1.05),
]


def top_k(df: DataFrame, k: int, by: list[str], score: str, id_col: str) -> DataFrame:
    """Rows ranked 1..k in each group (Spark prunes within tasks before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(ranked: DataFrame, by: list[str], source: str, score: str, id_col: str, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (group, source, id, score); a source without a weight weighs 1."""
    w = Window.partitionBy(*by, source).orderBy(F.col(score).desc(), F.col(id_col))
    weight = F.lit(1.0)
    if weights is not None:
        for name, value in weights.items():
            weight = F.when(F.col(source) == name, value).otherwise(weight)
    r = ranked.withColumn("r", F.row_number().over(w))
    return r.groupBy(*by, id_col).agg(F.round(F.sum(weight / (k + F.col("r"))), 9).alias("fused"), F.count("*").alias("n_sources"))


def court_multiplier(court: Column) -> Column:
    out = F.lit(1.0)
    for name, value in reversed(COURT_MULTIPLIERS):
        out = F.when(F.upper(court).contains(name), value).otherwise(out)
    return out


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def expand_to_parents(hits: DataFrame, query: str, parent: str, rank: str, id_col: str) -> DataFrame:
    """The first hit of each parent, and hits without one, in their order."""
    key = F.coalesce(F.nullif(F.col(parent), F.lit("")), F.concat(F.lit("orphan:"), F.col(id_col).cast("string")))
    out = first_per_key(hits.withColumn("_key", key), [query, "_key"], [F.col(rank), F.col(id_col)]).drop("_key")
    return out.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col(rank), F.col(id_col))))


def promote(hits: DataFrame, query: str, flag: Column, rank: str, id_col: str) -> DataFrame:
    """Flagged hits first, each part in its order."""
    w = Window.partitionBy(query).orderBy(flag.cast("int").desc(), F.col(rank), F.col(id_col))
    return hits.withColumn("new_rank", F.row_number().over(w))


def passage_boost(kind: Column) -> Column:
    """Holdings gain 15 %, remarks in passing lose 10 %."""
    return F.when(kind == "ratio", 1.15).when(kind == "obiter", 0.90).otherwise(1.0)


def hybrid(ranked: DataFrame, courts: DataFrame, query: str, depth: dict[str, int], weights: dict[str, float], k: int) -> DataFrame:
    """(query, chunk_id, score, rank): each source's best hits fused by weighted reciprocal ranks, times the court's multiplier.

    Each source is cut to its own depth before anything moves for the fusion.
    """
    w = Window.partitionBy(query, "source").orderBy(F.col("score").desc(), F.col("chunk_id"))
    limits = F.create_map(*[F.lit(x) for kv in depth.items() for x in kv])
    cut = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limits[F.col("source")]).drop("_r")
    f = fuse(cut, [query], "source", "score", "chunk_id", weights)
    s = f.join(courts, "chunk_id").withColumn("score", F.round(F.col("fused") * court_multiplier(F.col("court")), 9))
    return top_k(s, k, [query], "score", "chunk_id").select(query, "chunk_id", "score", "rank")
