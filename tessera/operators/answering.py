"""What an answer is written from: judgments scored against a question, and the passages that reach the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from .ranking import expand_to_parents, first_per_key, passage_boost, top_k

# Weights of a judgment's signals, the least score, and how many judgments a question gets.
WEIGHTS = {"semantic": 1.0, "section": 0.25, "law": 0.0, "cross_reference": 0.25}
LEAST_SCORE, MOST_JUDGMENTS = 0.30, 5


def scored(candidates: DataFrame, named: DataFrame, crossed: DataFrame, query: str, case: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``candidates`` (query, case, semantic, law, cited) with ``score`` and ``reasons``; a signal of weight 0 is no reason, nor is a law.

    ``named`` (query, statute, section) are a question's own references, few each; ``crossed`` (query, case) cite a provision found for it.
    """
    n = named.groupBy(query).agg(F.collect_set("section").alias("_sections"), F.collect_set("statute").alias("_laws"))
    x = crossed.select(query, case).distinct().withColumn("_crossed", F.lit(True))
    j = candidates.join(n, query, "left").join(x, [query, case], "left").withColumn("_both", F.sort_array(F.array_intersect("_sections", "cited")))
    signals = [
        (F.size("_both") > 0, weights["section"], F.concat(F.lit("cites section "), F.array_join("_both", ", "), F.lit(", which the question names"))),
        (F.array_contains("_laws", F.col("law")), weights["law"], F.concat(F.lit("decided under the "), F.col("law"))),
        (F.col("_crossed"), weights["cross_reference"], F.lit("cross-referenced to the retrieved provision")),
    ]
    score, reasons = F.col("semantic") * weights["semantic"], []
    for hit, weight, why in signals:
        if weight:
            score = score + F.when(F.coalesce(hit, F.lit(False)), weight).otherwise(0.0)
            reasons.append(F.when(F.coalesce(hit, F.lit(False)), why))
    why = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    j = j.withColumns({"score": F.round(score, 4), "reasons": F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("matched the question semantically")))})
    return j.drop("_sections", "_laws", "_crossed", "_both")


def judgments(scored_rows: DataFrame, query: str, case: str, id_col: str, least: float = LEAST_SCORE, most: int = MOST_JUDGMENTS) -> DataFrame:
    """The best passage of each case that reaches ``least``, and of those the ``most`` best of each question, with ``rank``."""
    best = first_per_key(scored_rows.where(F.col("score") >= least), [query, case], [F.col("score").desc(), F.col(id_col)])
    return top_k(best, most, [query], "score", id_col)


def admitted(courts: list[str] = (), year_from: int | None = None, year_to: int | None = None, topics: list[str] = (), statuses: list[str] = ()) -> Column:
    """A reader's filters over court, yr, section_type, title and text; an unknown year passes, and so does an unknown kind of passage."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    ok = F.lit(True)
    if courts:
        ok &= legal.any_of(low("court"), [c.lower() for c in courts])
    if year_from:
        ok &= F.coalesce(F.col("yr") >= year_from, F.lit(True))
    if year_to:
        ok &= F.coalesce(F.col("yr") <= year_to, F.lit(True))
    if topics:
        wanted = [t.lower() for t in topics]
        ok &= legal.any_of(low("text"), wanted) | legal.any_of(low("title"), wanted)
    if statuses:
        wanted = [s.lower() for s in statuses]
        ok &= (low("section_type") == "") | low("section_type").isin(wanted) | legal.any_of(low("text"), wanted)
    return ok


def standing(shown: DataFrame, found: DataFrame, query: str, id_col: str) -> DataFrame:
    """``shown`` with status and confidence of its case among the passages found for the same question.

    Of passages of other cases that name it, the newest with a treatment decides; named without one it is followed, not named it is good law.
    Both sides hold what one question retrieved, which its depth bounds.
    """
    others = found.select(query, F.lower("title").alias("_other"), F.lower("text").alias("_low"), F.coalesce("yr", F.lit(0)).alias("_yr"), F.col(id_col).alias("_by")).withColumn("_treated", legal.treatment(F.col("_low")))
    t = shown.select(query, F.lower("title").alias("_title")).distinct()
    m = t.join(others, query).where(F.col("_low").contains(F.col("_title")) & (F.col("_other") != F.col("_title")))
    m = first_per_key(m, [query, "_title"], [F.col("_treated").isNull(), F.col("_yr").desc(), F.col("_by")]).select(query, "_title", "_treated", F.lit(True).alias("_named"))
    j = shown.withColumn("_title", F.lower("title")).join(m, [query, "_title"], "left")
    status = F.when(F.col("_named").isNull(), "good_law").otherwise(F.coalesce("_treated", F.lit("followed")))
    sure = F.when(F.col("_named").isNull(), 1.0).when(F.col("_treated").isNull(), 0.60).otherwise(0.95)
    return j.withColumns({"status": status, "confidence": sure}).drop("_title", "_treated", "_named")


def context(runs: DataFrame, query: str, k: int = 5, filters: Column | None = None) -> DataFrame:
    """(query, chunk_id, title, score, rank, status, confidence): of all sub-queries' runs the passages that reach the writer.

    ``runs`` (query, run, rank, chunk_id, parent, court, yr, section_type, title, text, score): the first of equal passages counts, filters apply, a parent
    stands for its passages, scores are weighed by kind, and the k best are annotated with the standing of their case.
    """
    w = first_per_key(runs, [query, "chunk_id"], [F.col("run"), F.col("rank")])
    kept = w.where(filters) if filters is not None else w
    order = F.row_number().over(Window.partitionBy(query).orderBy("run", "rank", "chunk_id"))
    p = expand_to_parents(kept.withColumn("_order", order), query, "parent", "_order", "chunk_id")
    best = top_k(p.drop("rank").withColumn("score", F.round(F.col("score") * passage_boost(F.col("section_type")), 6)), k, [query], "score", "chunk_id")
    return standing(best, kept, query, "chunk_id").select(query, "chunk_id", "title", "score", "rank", "status", "confidence")

