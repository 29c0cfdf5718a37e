"""Bounded samples of labelled rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, materialize


#: Characters of all drawn texts together: rows that would exceed it are passed over, so a few very long texts cannot fill the driver.
MOST_CHARS = 64 << 20


def remainder(column: str, modulus: int) -> Column:
    return F.pmod(crc32_text(column), F.lit(modulus)).cast("int")


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether an id's remainder is ``rest``; a null id is not held out, and nothing is learnt from it either."""
    return F.coalesce(remainder(column, modulus) == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit_on: Column, most: int, most_chars: int = MOST_CHARS) -> pd.DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows, of ``most_chars`` characters together, that may be learnt from, drawn by a hash of the id.

    Rows without a label, with other labels than 0 and 1, or without an id take no part; an id with several
    labels is drawn with each, with the least of its texts. Whole texts only: a row that does not fit any more is passed over.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(fit_on).select("doc_id", F.col(label).cast("int").alias("y"))
    drawn = y.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    size = drawn.count()  # at most ``most`` rows: a bounded broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn) if size <= most else drawn, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = materialize(rows, "labelled")
    sizes = rows.select("doc_id", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").toPandas()  # at most a row a label
    total, fit = 0, []
    for n in sizes["n"]:
        fit.append(total + n <= most_chars)
        total += n if fit[-1] else 0
    fits = sizes[fit] if len(sizes) else sizes
    if len(fits) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fits[["doc_id", "y"]])), ["doc_id", "y"], "left_semi") if len(fits) else rows.limit(0)
    out = rows.toPandas().sort_values(["doc_id", "y"], kind="stable").reset_index(drop=True)
    out["text"] = out["text"].fillna("")
    return out
