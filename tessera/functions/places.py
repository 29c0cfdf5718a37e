"""Where a pattern's matches stand in a text, from what lies between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and deep ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str, *groups: int) -> Column:
    """Array of (start, end, text, g1, ...): the matches of a pattern in order, with 0-based offsets and the groups asked for.

    The pieces that ``split`` leaves and the matches alternate, so each start is the sum of the lengths before it. The pattern must not match nothing.
    """
    hits = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    whole = F.filter(F.arrays_zip(F.split(text, pattern, -1), *hits), lambda x: x["1"].isNotNull())
    names = ["text", *(f"g{g}" for g in groups)]
    kind = "array<struct<" + ", ".join(["start: int", "end: int", *(f"{n}: string" for n in names)]) + ">>"

    def step(acc, x):
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        row = F.struct(start.alias("start"), end.alias("end"), *(x[str(i + 1)].alias(n) for i, n in enumerate(names)))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(row)).alias("found"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))
    out = F.aggregate(whole, begin, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(kind))
