"""Joins on order and distance, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """Pairs of equal keys whose integer positions (``at`` and ``at_r``) are at most ``width`` apart.

    Positions are cut in cells of ``width``; a left row looks in three cells, so the join is an equi-join.
    """
    cell = F.floor(F.col(at) / width)
    r = right.withColumn("_cell", cell).withColumnRenamed(at, f"{at}_r")
    x = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    return x.join(r, [*by, "_cell"]).where(F.abs(F.col(at) - F.col(f"{at}_r")) <= width).drop("_cell")


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, most: int) -> DataFrame:
    """``left`` with the value of the nearest right row of equal keys, before or after (before wins ties), at most ``most`` away, else null.

    One ordered union, read from both ends: a two-sided as-of join.
    """
    cols = left.columns
    u = left.withColumns({"_is": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_p": F.lit(None).cast("long")})
    r = right.select(*by, at, F.col(value).alias("_v")).withColumns({"_is": F.lit(0), "_p": F.col(at).cast("long")})
    both = u.unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy(at, "_is").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*by).orderBy(F.col(at).desc(), "_is").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("_p").isNotNull(), F.struct("_p", "_v"))
    x = both.withColumns({"_b": F.last(hit, True).over(back), "_a": F.last(hit, True).over(on)}).where("_is = 1")
    gap = lambda s: F.abs(F.col(s)["_p"] - F.col(at))
    before = F.col("_a").isNull() | (F.col("_b").isNotNull() & (gap("_b") <= gap("_a")))
    pick = F.when(before, F.col("_b")).otherwise(F.col("_a"))
    return x.select(*cols, F.when(F.abs(pick["_p"] - F.col(at)) <= most, pick["_v"]).alias(value))


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """``rows`` with a dimension's value, or the default, and whether the key is there."""
    d = dim.select(*keys, F.col(value)).withColumn("found", F.lit(True))
    return rows.join(d, keys, "left").withColumns({value: F.coalesce(value, default), "found": F.coalesce("found", F.lit(False))})
