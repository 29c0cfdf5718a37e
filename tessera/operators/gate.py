"""Deciding whether evidence is strong enough to answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Plausibility floor, relevance threshold, hits that must reach it, least margin, score of a sure answer.
HARD, SOFT, SUPPORT, MARGIN, SURE = 0.40, 0.486, 1, 0.02, 0.60


def assess(hits: DataFrame, choices: DataFrame, hard: float = HARD, soft: float = SOFT, support: int = SUPPORT, margin: float = MARGIN) -> DataFrame:
    """Advice on each query of ``choices`` (query_id, law, section: null if none was named) from its hits (query_id, score, law, section).

    (query_id, n, peak, margin, n_support, corpus_match, section_found (-1: none named), indistinct, abstain, confidence). The margin is the best score less the third
    (or last), or the only one; a named section that came back outweighs any similarity.
    """
    c = choices.select("query_id", F.col("law").alias("want_law"), F.upper("section").alias("want_section"))
    top = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    h = hits.select("query_id", "score", "law", "section").withColumn("place", F.row_number().over(top))
    j = c.join(h, "query_id", "left")
    a = j.groupBy("query_id", "want_law", "want_section").agg(
        F.count("score").alias("n"), F.round(F.max("score"), 4).alias("peak"), F.max("score").alias("best"), F.min(F.when(F.col("place") <= 3, F.col("score"))).alias("third"),
        F.sum(F.when(F.col("score") >= soft, 1).otherwise(0)).alias("n_support"), F.max(F.col("law") == F.col("want_law")).alias("same_law"),
        F.max(F.upper("section") == F.col("want_section")).alias("same_section"))
    a = a.withColumns({
        "margin": F.round(F.col("best") - F.when(F.col("n") > 1, F.col("third")).otherwise(0.0), 4),
        "corpus_match": F.col("want_law").isNull() | F.coalesce("same_law", F.lit(False)),
        "section_found": F.when(F.col("want_section").isNotNull(), F.coalesce("same_section", F.lit(False)))})
    exact = F.coalesce("section_found", F.lit(False))
    unsupported = ~exact & ((F.col("n_support") == 0) | (F.col("peak") < soft))
    abstain = (F.col("n") == 0) | (F.col("peak") < hard) | ~F.col("corpus_match") | unsupported
    conf = (
        F.when(abstain, "none").when(F.col("section_found").isNotNull() & ~exact, "low").when(exact, "high")
        .when((F.col("peak") < soft) | (F.col("n_support") < support), "low").when(F.col("peak") >= SURE, "high").otherwise("medium")
    )
    return a.select("query_id", "n", "peak", "margin", "n_support", "corpus_match", F.coalesce(F.col("section_found").cast("int"), F.lit(-1)).alias("section_found"), ((F.col("margin") < margin) & (F.col("peak") < soft)).alias("indistinct"), abstain.alias("abstain"), conf.alias("confidence"))


def gate(assessed: DataFrame, min_sources: int = 1, min_peak: float = HARD) -> DataFrame:
    """(query_id, allowed, reason): generation goes on only with evidence; the first reason against it is named."""
    reason = (
        F.when(F.col("n") == 0, "no evidence").when(F.col("n") < min_sources, "too few sources").when(F.col("peak") < min_peak, "below the floor")
        .when(F.col("abstain"), "abstention advised").otherwise("sufficient")
    )
    return assessed.select("query_id", (reason == "sufficient").alias("allowed"), reason.alias("reason"))
