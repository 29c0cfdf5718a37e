"""Choosing documents for a corpus: quotas, strata, gates, and checks of what was chosen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .ordering import numbered

# Least judgments of a topic, largest shares of a topic, scores, length.
FLOORS = {
    "new_codes": 45, "sexual_offences": 80, "sentencing": 80, "common_intention": 80, "cheating": 60, "theft_robbery": 60, "conspiracy": 60,
    "quashing": 60, "circumstantial": 60, "pocso": 60, "ndps": 60, "attempt": 50, "abetment": 50, "breach_of_trust": 50, "dowry_cruelty": 50,
    "dying_declaration": 50, "confession_recovery": 50, "corruption": 40, "uapa": 30, "juvenile": 25, "pmla": 25,
}
SHARES = {"murder": 0.50, "bail": 0.50}
LEAST_SCORE, FILL_SCORE, LEAST_CHARS = 6, 10, 3000


def topic_counts(rows: DataFrame, topics: str = "topics") -> DataFrame:
    # an inner explode would have the topics worked out again for a filter on their number
    return rows.select(F.explode_outer(topics).alias("topic")).where("topic is not null").groupBy("topic").agg(F.count("*").alias("n"))


def quota_state(counts: DataFrame, target: int) -> DataFrame:
    """(topic, n, short, full) of every topic with a floor or a ceiling: ceilings are rounded half to even."""
    spark = counts.sparkSession
    names = sorted({*FLOORS, *SHARES})
    quota = spark.createDataFrame([(t, FLOORS.get(t), round(SHARES[t] * target) if t in SHARES else None) for t in names], "topic string, floor long, ceiling long")
    n = F.coalesce("n", F.lit(0))
    return quota.join(counts, "topic", "left").select("topic", n.alias("n"), F.coalesce(n < F.col("floor"), F.lit(False)).alias("short"), F.coalesce(n >= F.col("ceiling"), F.lit(False)).alias("full"))


def admit(candidates: DataFrame, state: DataFrame, score: str = "score", topics: str = "topics") -> DataFrame:
    """``accepted`` and ``reason`` for each candidate against fixed counts: all topics full, general fill, first topic still short, or neither.

    ``state`` has one row a topic with a quota; it becomes one row of two small arrays.
    """
    one = state.agg(F.collect_list(F.when(F.col("full"), F.col("topic"))).alias("_full"), F.collect_list(F.when(F.col("short"), F.col("topic"))).alias("_short"))
    x = candidates.crossJoin(F.broadcast(one))
    closes = F.array_min(F.array_intersect(topics, "_short"))
    reason = (
        F.when((F.size(topics) > 0) & (F.size(F.array_except(topics, "_full")) == 0), "topic_ceiling").when(F.col(score) >= FILL_SCORE, "general_fill")
        .when(closes.isNotNull(), F.concat(F.lit("quota:"), closes)).otherwise("below_general_fill_score")
    )
    return x.withColumn("reason", reason).withColumn("accepted", F.col("reason").startswith("quota") | (F.col("reason") == "general_fill")).drop("_full", "_short")


#: Ranges that a pass over the open candidates counts, and candidates that the driver may decide one by one.
RANGES, FEW = 512, 4096


def _limits(target: int) -> tuple[dict[str, int], dict[str, int]]:
    return FLOORS, {t: round(share * target) for t, share in SHARES.items()}


def _decide(score: int, topics: list[str], counts: dict[str, int], floors: dict[str, int], ceilings: dict[str, int]) -> tuple[bool, str]:
    if topics and all(t in ceilings and counts.get(t, 0) >= ceilings[t] for t in topics):
        return False, "topic_ceiling"
    if score >= FILL_SCORE:
        return True, "general_fill"
    short = sorted(t for t in set(topics) if t in floors and counts.get(t, 0) < floors[t])
    return (True, f"quota:{short[0]}") if short else (False, "below_general_fill_score")


def _rule(counts: dict[str, int], floors: dict[str, int], ceilings: dict[str, int]) -> Column:
    """The reason of a candidate while no topic passes a limit."""
    full = F.array(*[F.lit(t) for t, c in ceilings.items() if counts.get(t, 0) >= c]).cast("array<string>")
    short = F.array(*[F.lit(t) for t, f in floors.items() if counts.get(t, 0) < f]).cast("array<string>")
    closes = F.array_min(F.array_intersect("topics", short))
    return (
        F.when((F.size("topics") > 0) & (F.size(F.array_except("topics", full)) == 0), "topic_ceiling").when(F.col("score") >= FILL_SCORE, "general_fill")
        .when(closes.isNotNull(), F.concat(F.lit("quota:"), closes)).otherwise("below_general_fill_score"))


def _taken(reason: Column) -> Column:
    return reason.startswith("quota") | (reason == "general_fill")


def harvest(candidates: DataFrame, target: int, order: list[str], held: dict[str, int] | None = None, have: int = 0, floors: dict[str, int] | None = None, ceilings: dict[str, int] | None = None) -> DataFrame:
    """``accepted`` and ``reason`` of each candidate (score, topics), decided one after the other in ``order`` while the counts of topics move.

    ``held`` are the topics' counts before, ``have`` the documents; once ``target`` is reached the rest is ``target_reached``. Between two passings of a floor, a ceiling or the target
    the rule stands still, and it decides all candidates at once. So the next passing is found by counts over ranges of places,
    range within range, until it lies among ``FEW`` candidates; those are decided in turn, and the next rule begins after them. Each topic passes its limit once: there
    are at most as many rules as limits. Null scores count as 0, null topics as none; ``order`` must settle every tie.
    """
    usual = _limits(target)
    floors, ceilings = usual[0] if floors is None else floors, usual[1] if ceilings is None else ceilings
    watched = sorted({*floors, *ceilings})
    # written first: dealing by ranges reads its input twice, and scores and topics are dear
    rows = written(candidates, "candidates")
    rows = numbered(rows.withColumns({"score": F.coalesce("score", F.lit(0)), "topics": F.array_distinct(F.coalesce("topics", F.array().cast("array<string>")))}), order, "_place")
    rows = written(rows, "numbered")
    slim = rows.select("_place", "score", F.array_intersect("topics", F.array(*map(F.lit, watched))).alias("limited"), "topics")
    n = rows.count()
    counts, have, start = dict(held or {}), have, 1
    rules: list[tuple[int, int, Column]] = []
    singles: list[tuple[int, str]] = []
    while start <= n and have < target:
        reason = _rule(counts, floors, ceilings)
        open_, end, at, seen, total = slim.withColumn("_reason", reason).where(_taken(F.col("_reason"))), n + 1, start, dict(counts), have
        rules_at = start
        while True:
            width = max(1, -(-(end - at) // RANGES))
            part = open_.where((F.col("_place") >= at) & (F.col("_place") < end)).select(F.floor((F.col("_place") - at) / width).alias("r"), F.explode(F.concat("limited", F.array(F.lit("")))).alias("t"))
            per: dict[int, dict[str, int]] = {}
            for x in part.groupBy("r", "t").agg(F.count("*").alias("n")).collect():  # at most RANGES rows a topic
                per.setdefault(x["r"], {})[x["t"]] = x["n"]
            passed = None
            for r in sorted(per):
                after = {t: seen.get(t, 0) + k for t, k in per[r].items() if t}
                crossed = any((t in floors and seen.get(t, 0) < floors[t] <= c) or (t in ceilings and seen.get(t, 0) < ceilings[t] <= c) for t, c in after.items())
                if crossed or total + per[r][""] >= target:
                    passed = r
                    break
                seen |= after
                total += per[r][""]
            if passed is None:
                at = end
                break
            at, end = at + passed * width, min(end, at + (passed + 1) * width)
            if end - at <= FEW:
                break
        rules.append((rules_at, at, reason))
        counts, have, start = seen, total, end
        if at < end:
            for x in slim.where((F.col("_place") >= at) & (F.col("_place") < end)).orderBy("_place").collect():  # at most FEW rows
                if have >= target:
                    start = x["_place"]
                    break
                took, why = _decide(x["score"], x["topics"], counts, floors, ceilings)
                singles.append((x["_place"], why))
                if took:
                    have += 1
                    for t in x["topics"]:
                        counts[t] = counts.get(t, 0) + 1
        elif at > n:
            break
    decided = F.lit(None).cast("string")
    for a, b, reason in rules:
        decided = F.when((F.col("_place") >= a) & (F.col("_place") < b), reason).otherwise(decided)
    one = rows.sparkSession.createDataFrame(singles, "_place long, _why string")  # at most FEW rows a limit
    out = rows.join(F.broadcast(one), "_place", "left").withColumn("reason", F.coalesce("_why", decided, F.lit("target_reached")))
    return out.withColumn("accepted", _taken(F.col("reason"))).drop("_place", "_why")


def missing_fields(fields: list[str]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", f) for f in fields]))


def gate_reasons(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first failed check, null if none."""
    return rows.withColumn("reason", F.coalesce(*[F.when(c, n) for n, c in checks], F.lit(None).cast("string")))


def interleave(rows: DataFrame, matched: Column, key: str, seed: str = "7") -> DataFrame:
    """``place``: two matched rows for one other, matched ones by ``key`` and others in an order drawn by an md5 of it; what is left of either follows."""
    drawn = F.when(F.col("_m"), F.lit("")).otherwise(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    r = rows.withColumn("_m", F.coalesce(matched, F.lit(False))).withColumn("_o", ~F.col("_m")).withColumn("_d", drawn)
    r = numbered(r, ["_o", "_d", key], "_r")
    n = {x["_o"]: x["n"] for x in r.groupBy("_o").agg(F.count("*").alias("n")).collect()}  # two rows
    first, others = n.get(False, 0), n.get(True, 0)
    own = F.col("_r") - F.when(F.col("_o"), first).otherwise(0)
    place = F.when(F.col("_o"), own + F.least(F.lit(first), 2 * own)).otherwise(own + F.least(F.lit(others), F.floor((own - 1) / 2)))
    return r.withColumn("place", place.cast("long")).drop("_m", "_o", "_d", "_r")


def capped_by_year(rows: DataFrame, stratum: str, year: str, order: list, per_year: int) -> DataFrame:
    """``turn`` 1 for the first ``per_year`` of a stratum and year, 2 for the rest."""
    w = Window.partitionBy(stratum, year).orderBy(*order)
    return rows.withColumn("turn", F.when(F.row_number().over(w) <= per_year, 1).otherwise(2))


def violations(rows: DataFrame, key: str, required: list[str], unique: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, problem): missing fields, repeated values of unique fields beyond the first, broken rules."""
    out = rows.select(key, F.explode(F.transform(missing_fields(required), lambda f: F.concat(F.lit("missing "), f))).alias("problem"))
    for u in unique:
        again = F.row_number().over(Window.partitionBy(u).orderBy(key)) > 1
        out = out.unionByName(rows.where(F.col(u).isNotNull()).withColumn("_a", again).where("_a").select(key, F.lit(f"duplicate {u}").alias("problem")))
    broken = F.array_compact(F.array(*[F.when(~c, n) for n, c in rules.items()]))
    return out.unionByName(rows.select(key, F.explode(broken).alias("problem")))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of either table that the other lacks, repeated rows counted."""
    n = lambda x, side: x.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(a.exceptAll(b), "only left").unionByName(n(b.exceptAll(a), "only right"))


def court_filter(courts: list[str], court: str) -> Column:
    return reduce(lambda x, y: x | y, [F.lower(court).contains(c.lower()) for c in courts])
