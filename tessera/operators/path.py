"""From questions to passages and the gate: dense and lexical hits, fusion, boosts, and whether there is enough to answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation, gate, lexical, ranking, vectors

#: Hits that each search gives to the fusion, and what each weighs.
DEPTH = {"dense": 20, "lexical": 20}
WEIGHTS = {"dense": 0.6, "lexical": 0.4}


def dense(questions: DataFrame, index: str, dim: int, k: int, n_probe: int | None) -> DataFrame:
    """(query_id, chunk_id, score) of the index below ``index``; ``questions`` has query_id and vector."""
    found = vectors.search(questions.sparkSession, index, questions, "query_id", "vector", dim, k, n_probe)
    return found.select("query_id", F.col("id").alias("chunk_id"), "score")


def sparse(questions: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score) by BM25 over (chunk_id, text)."""
    found = lexical.search(questions, passages, "query_id", "text", "chunk_id", "text", k)
    return found.select("query_id", F.col("doc_id").alias("chunk_id"), "score")


def fused(dense_hits: DataFrame, sparse_hits: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): both searches by weighted reciprocal ranks, times the court's multiplier."""
    named = lambda h, n: h.select("query_id", F.lit(n).alias("source"), "chunk_id", "score")
    return ranking.hybrid(named(dense_hits, "dense").unionByName(named(sparse_hits, "lexical")), passages.select("chunk_id", "court"), "query_id", DEPTH, WEIGHTS, k)


def decided(dense_hits: DataFrame, passages: DataFrame, choices: DataFrame) -> DataFrame:
    """(query_id, confidence, allowed, reason): the gate over what similarity found, for the law and section that a question names."""
    hits = dense_hits.join(passages.select("chunk_id", "law", "section"), "chunk_id")
    a = gate.assess(hits, choices)
    return a.select("query_id", "confidence").join(gate.gate(a), "query_id")


def answer(questions: DataFrame, passages: DataFrame, choices: DataFrame, index: str, dim: int, k: int = 5, n_probe: int | None = 16) -> DataFrame:
    """(query_id, rank, chunk_id, score, confidence, allowed, reason): the passages that a writer would get, and whether it may write.

    ``questions`` (query_id, text, vector), ``passages`` (chunk_id, text, court, law, section), ``choices`` (query_id, law, section); a question without passages has one row
    with none of them.
    """
    from ..sources.store import written

    near = written(dense(questions, index, dim, DEPTH["dense"], n_probe), "dense")
    top = fused(near, sparse(questions, passages, DEPTH["lexical"]), passages, k)
    return decided(near, passages, choices).join(top, "query_id", "left").select("query_id", "rank", "chunk_id", "score", "confidence", "allowed", "reason")


def without_law(dense_hits: DataFrame, passages: DataFrame, choices: DataFrame) -> DataFrame:
    """(query_id, allowed, reason) of the questions that name a law, with all evidence of that law removed."""
    named = choices.where(F.col("law").isNotNull())
    hits = dense_hits.join(passages.select("chunk_id", "law", "section"), "chunk_id").join(named.select("query_id", F.col("law").alias("_law")), "query_id")
    return gate.gate(gate.assess(hits.where(~F.col("law").eqNullSafe(F.col("_law"))).drop("_law"), named))


def without_each(dense_hits: DataFrame, passages: DataFrame, choices: DataFrame, k: int) -> DataFrame:
    """(query_id, removed, allowed, reason): the gate once more for each of a question's ``k`` best hits without it."""
    left = evaluation.without_each(dense_hits, "query_id", "score", "chunk_id", k).join(passages.select("chunk_id", "law", "section"), "chunk_id")
    key = F.concat_ws(":", "query_id", "removed").alias("query_id")
    pairs = left.select("query_id", "removed").distinct()
    a = gate.assess(left.select(key, "score", "law", "section"), pairs.join(choices, "query_id").select(key, "law", "section"))
    part = F.split("query_id", ":")
    return gate.gate(a).select(part[0].cast("long").alias("query_id"), part[1].cast("long").alias("removed"), "allowed", "reason")
