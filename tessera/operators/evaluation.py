"""Information-retrieval metrics over (query, rank, id) runs and (query, id) gold."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from .ordering import running
from .ranking import first_per_key, top_k


def closed_up(run: DataFrame, query: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """(query, id, rank): the first of each id's places, and ranks without gaps."""
    first = run.groupBy(query, id_col).agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank", id_col)))


def metrics_at(run: DataFrame, gold: DataFrame, k: int | list[int], query: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Per query with gold (and ``k`` of a list): precision (over min(k, length)), recall, hit, reciprocal rank, nDCG at ``k``."""
    ks = k if isinstance(k, list) else [k]
    at = F.explode(F.array(*map(F.lit, ks)))
    first = closed_up(run, query, id_col)
    g = gold.select(query, id_col).distinct().withColumn("rel", F.lit(1))
    n_gold = g.groupBy(query).agg(F.count("*").alias("n_gold")).withColumn("k", at)
    hit = (F.col("rank") <= F.col("k")) & F.col("rel").isNotNull()
    per = first.join(g, [query, id_col], "left").withColumn("k", at).groupBy(query, "k").agg(
        F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("rel").isNotNull(), F.col("rank"))).alias("best"),
        F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    z = lambda c: F.coalesce(c, F.lit(0))
    return n_gold.join(per, [query, "k"], "left").select(
        query, *(["k"] if isinstance(k, list) else []), rounded(F.coalesce(F.col("hits") / F.least("k", "n"), F.lit(0.0)), 6).alias("precision"),
        rounded(z(F.col("hits")) / F.col("n_gold"), 6).alias("recall"), (z(F.col("hits")) > 0).cast("int").alias("hit"),
        F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def macro_average(per_query: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def precision_ceilings(gold: DataFrame, ks: list[int], query: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """(k, ceiling): the best mean precision that the number of gold items allows."""
    n = gold.groupBy(query).agg(F.countDistinct(id_col).alias("n")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return n.groupBy("k").agg(F.round(F.avg(F.least("n", "k") / F.col("k")), 6).alias("ceiling"))


def name_metrics(run: DataFrame, expected: DataFrame, k: int, query: str = "query_id", name: str = "name") -> DataFrame:
    """(query, hit, rr): names match if either holds the other, in lower case; hit within ``k``, reciprocal rank of the first match."""
    e = expected.select(query, F.lower(name).alias("_e")).distinct()
    r = run.select(query, "rank", F.lower(F.trim(name)).alias("_r"))
    near = e.join(r, query, "left").withColumn("ok", F.col("_r").contains(F.col("_e")) | F.col("_e").contains(F.col("_r")))
    best = F.min(F.when(F.col("ok"), F.col("rank")))
    return near.groupBy(query).agg(F.coalesce((best <= k).cast("int"), F.lit(0)).alias("hit"), F.round(F.coalesce(1.0 / best, F.lit(0.0)), 6).alias("rr"))


def keyword_coverage(text, keywords: list[str]):
    """Share of the keywords that a text holds; 1 without keywords."""
    if not keywords:
        return F.lit(1.0)
    return sum((F.when(F.lower(text).contains(k.lower()), 1).otherwise(0) for k in keywords), F.lit(0)) / len(keywords)


def separation(df: DataFrame, by: list[str], score: str, inside) -> DataFrame:
    """Whether a threshold parts scores inside from those outside: extremes, medians, margin, and the midpoint if it does."""
    of = lambda f, c: f(F.when(c, F.col(score)))
    out = ~inside
    a = df.groupBy(*by).agg(
        of(F.min, inside).alias("in_min"), of(F.avg, inside).alias("in_mean"), of(F.median, inside).alias("in_median"), of(F.max, inside).alias("in_max"),
        of(F.min, out).alias("out_min"), of(F.avg, out).alias("out_mean"), of(F.median, out).alias("out_median"), of(F.max, out).alias("out_max"))
    parts = F.col("in_min") > F.col("out_max")
    r = [F.round(c, 4).alias(c) for c in ("in_min", "in_mean", "in_median", "in_max", "out_min", "out_mean", "out_median", "out_max")]
    return a.select(*by, *r, F.coalesce(parts, F.lit(False)).alias("separable"), F.round(F.col("in_min") - F.col("out_max"), 4).alias("margin"), F.when(parts, F.round((F.col("in_min") + F.col("out_max")) / 2, 4)).alias("threshold"))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, nearest-rank percentiles, extremes."""
    pct = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(pct(0.5), 2).alias("p50"), F.round(pct(0.95), 2).alias("p95"),
        F.round(F.min(value), 2).alias("low"), F.round(F.max(value), 2).alias("high"))


def rates(df: DataFrame, by: list[str], truth, decided) -> DataFrame:
    """Counts and rates of a yes/no decision against the truth."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), n(truth & decided).alias("tp"), n(~truth & decided).alias("fp"), n(truth & ~decided).alias("fn"), n(~truth & ~decided).alias("tn"),
        rounded(F.try_divide(n(truth & decided), n(truth)), 6).alias("tpr"), rounded(F.try_divide(n(~truth & decided), n(~truth)), 6).alias("fpr"))


def sweep(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, tp, fp, fn, tn, accuracy): every score as the threshold from which on a row counts as positive.

    Rows of one score are counted first; sums over the scores above are then running sums over ranges of scores, so all thresholds cost one
    scan. Rows without a score or without a truth take no part.
    """
    rows = df.select(F.col(score).alias("threshold"), positive.alias("_p")).where("threshold is not null and _p is not null")
    n = rows.groupBy("threshold").agg(F.count("*").alias("_n"), F.sum(F.col("_p").cast("long")).alias("_pos")).withColumn("_down", -F.col("threshold"))
    n, total = running(n, ["_down"], "_n", "_above")
    n, positives = running(n, ["_down"], "_pos", "_hits")
    tp = F.col("_hits") + F.col("_pos")
    fp = F.col("_above") + F.col("_n") - tp
    n = n.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.lit(positives) - tp).alias("fn"), (F.lit(total - positives) - fp).alias("tn"))
    return n.withColumn("accuracy", rounded((F.col("tp") + F.col("tn")) / total, 6))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the highest accuracy, of several the highest threshold."""
    return swept.orderBy(F.desc("accuracy"), F.desc("threshold")).limit(1)


def grid(values: dict[str, list[float]]) -> list[dict[str, float]]:
    """All points of a grid, the last name running fastest."""
    return [dict(zip(values, p)) for p in product(*values.values())]


def tune(candidates: DataFrame, gold: DataFrame, points: list[dict[str, float]], query: str, case: str, id_col: str, semantic: str, least: float = 0.30, k: int = 5) -> DataFrame:
    """(trial, the weights, queries, ndcg, rr, recall): each point of a weight grid by the ``k`` best cases of each query, best first.

    ``candidates`` has a boolean for each weight's name. All points are scored in one array of a row, so candidates are read once; of a case the best row
    that reaches ``least`` counts. Queries without gold take no part, queries without a hit count as 0.
    """
    names = list(points[0])
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)).cast("double")
    scores = F.array(*[F.round(F.col(semantic) + sum((flag(n) * p[n] for n in names), F.lit(0.0)), 4) for p in points])
    s = candidates.select(F.col(query).alias("_q"), F.col(case).alias("_case"), F.col(id_col).alias("_id"), F.posexplode(scores).alias("trial", "_s")).where(F.col("_s") >= least)
    best = first_per_key(s, ["trial", "_q", "_case"], [F.desc("_s"), F.col("_id")])
    run = top_k(best, k, ["trial", "_q"], "_s", "_id").select(F.struct("trial", "_q").alias("_k"), "rank", F.col("_case").alias("_c"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1)))
    want = gold.select(F.col(query).alias("_q"), F.col(case).alias("_c")).withColumn("trial", every).select(F.struct("trial", "_q").alias("_k"), "_c")
    m = metrics_at(run, want, k, "_k", "_c").withColumn("trial", F.col("_k.trial"))
    m = macro_average(m, ["trial"], ["ndcg", "rr", "recall"])
    weight = lambda n: F.get(F.array(*[F.lit(p[n]) for p in points]), F.col("trial")).alias(n)
    return m.select("trial", *map(weight, names), "queries", "ndcg", "rr", "recall").orderBy(F.desc("ndcg"), "trial")


def without_each(hits: DataFrame, query: str, score: str, id_col: str, k: int) -> DataFrame:
    """(query, removed, removed_rank, id_col, score): for each of a query's ``k`` best hits, the ``k`` best of the others.

    One more hit a query than ``k`` is enough, so nothing is searched again: at most k * (k + 1) rows a query.
    """
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(id_col))
    top = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    # the hits that may go, beside each hit; a rank after the removed one moves up
    gone = top.where(F.col("_r") <= k).select(query, F.col(id_col).alias("removed"), F.col("_r").alias("removed_rank"))
    left = top.join(gone, query).where(F.col("_r") != F.col("removed_rank"))
    return left.where(F.col("_r") - (F.col("_r") > F.col("removed_rank")).cast("int") <= k).drop("_r")
