"""Places and running sums over a whole table, without one task that sees all rows.

The table is dealt over tasks by ranges of its order and written; each range's total comes to the driver (one number a range), and a row's
place is its place within its range plus the totals before. Rows that are equal in ``order`` stay in one range, so
``order`` should end in an id; nulls come first.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def _offsets(df: DataFrame, total: Column) -> tuple[DataFrame, int]:
    """(_range, _base): the totals of the ranges before each, and the total of all."""
    found = sorted((r["_range"], r["n"]) for r in df.groupBy("_range").agg(total.alias("n")).collect())  # one row a range
    bases = [0, *accumulate(n for _, n in found)]
    return df.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(found, bases)], "_range long, _base long"), bases[-1]


def numbered(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """``df`` with ``out``, each row's place from 1 in the order of some columns."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # a monotonic id is the task's number and then the row's place in the task
    s = written(s, "ordered").withColumn("_range", F.shiftright("_at", 33))
    bases, _ = _offsets(s, F.count("*"))
    return s.join(F.broadcast(bases), "_range").withColumn(out, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_base", "_at")


def running(df: DataFrame, order: list[str], weight: str, out: str = "before") -> tuple[DataFrame, int]:
    """``df`` with ``out``, the sum of ``weight`` over all earlier rows, and the sum over all rows."""
    s = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id().cast("long")), "ordered")
    bases, total = _offsets(s, F.coalesce(F.sum(weight), F.lit(0)).cast("long"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return s.join(F.broadcast(bases), "_range").withColumn(out, F.col("_base") + F.col("_in")).drop("_range", "_base", "_in"), total
