"""The registry of queries and the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_TABLES = r"\bfrom (orders|part|documents|lineitem|conversations|events|embeddings)\b"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def fixture(spark: SparkSession, d: str, text: str) -> DataFrame:
    """A fixture's rows; its tables are passed in, not registered under shared names."""
    names = set(re.findall(_TABLES, text))
    return spark.sql(re.sub(_TABLES, r"from {\1}", text), **{n: table(spark, d, n) for n in names})


def counted_terms(texts: DataFrame, text: str, names: list[str], rows: list[tuple]) -> DataFrame:
    """A fixed table (its first column but for a leading one is ``term``) with ``n_texts``, how many texts hold each term."""
    from pyspark.sql import functions as F

    from ..functions.legal import terms_in

    n = texts.select(F.explode(F.array_distinct(terms_in(F.col(text), sorted({r[names.index("term")] for r in rows})))).alias("term")).groupBy("term").agg(F.count("*").alias("n_texts"))
    fixed = texts.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    return fixed.join(n, "term", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0)).cast("long"))


def counted_terms_sql(source: str, text: str, names: list[str], rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return f"WITH g AS (SELECT * FROM (VALUES {values}) g({', '.join(names)})), s AS ({source}), n AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT term FROM g) k JOIN s ON contains(lower({text}), lower(term)) GROUP BY 1) SELECT g.*, coalesce(n, 0) AS n_texts FROM g LEFT JOIN n USING (term)"


def located_sql(name: str, source: str, pattern: str, groups: int = 1) -> str:
    """SQL for (id, i, start_, end_, text, g1, ...) of a pattern's matches: what lies between matches gives their places."""
    p = pattern.replace("'", "''")
    hits = ", ".join(f"regexp_extract_all(txt, '{p}', {g}) AS h{g}" for g in range(groups + 1))
    more = "".join(f", h{g}[i] AS g{g}" for g in range(1, groups + 1))
    kept = ", ".join(f"h{g}" for g in range(groups + 1))
    before = "(list_sum([length(x) FOR x IN pieces[1:i]]) + coalesce(list_sum([length(x) FOR x IN h0[1:i - 1]]), 0))::BIGINT"
    return f"""{name} AS (SELECT id, i, {before} AS start_, {before} + length(h0[i]) AS end_, h0[i] AS hit{more}, pieces[i + 1] AS after
FROM (SELECT id, pieces, {kept}, unnest(range(1, len(h0) + 1)) AS i FROM (SELECT id, regexp_split_to_array(txt, '{p}') AS pieces, {hits} FROM {source})))"""
