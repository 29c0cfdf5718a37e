"""Parsing statutes: section openers, monotone numbering, chapters in force, marginal notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import section_key
from ..functions.places import let, located

# The opening of a section, a number alone on a line, chapter headings, amendment footnotes, repeals in place.
SECTION = r"(?dms)^(?:\d{1,2}\*+\s*\[\s*)?(\d{1,3}[A-Z]{0,2})\.[ \t]+(.{3,250}?)\.[ \t]*[-–—]{1,2}"
MARGIN = r"^\d{1,3}[A-Z]{0,2}\.[ \t]*$"
CHAPTER = r"(?dm)^CHAPTER\s+([IVXLC]+[A-Z]?)\s*$"
FOOTNOTE = r"(?i)^(?:Subs\.?|Ins\.?|Rep\.?|Added|Omitted|Certain|The\s+words|The\s+brackets|Clause|Chapter\s+[IVXLC]+[A-Z]?\s+(?:ins|inserted|added)|S\.\s*\d)"
REPEALED = r"(?i)^\s*\[?.*?\]?\s*Rep(?:ealed)?\.?\s+by\b"


def monotone(sections: DataFrame, by: str, order: str, number: str, title: str | None = None) -> DataFrame:
    """Rows whose section number is over all accepted before it. Footnotes, known by their ``title``, are dropped first, so they never raise the bar.

    A rejected number is never over the bar, so the running maximum of the accepted rows is that of all rows.
    """
    rows = sections if title is None else sections.where(~F.col(title).rlike(FOOTNOTE))
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    key = section_key(F.col(number))
    return rows.withColumn("_key", key).withColumn("_top", F.max("_key").over(before)).where("_top is null or _key > _top").drop("_key", "_top")


def chapters_in_force(sections: DataFrame, chapters: DataFrame, by: str, offset: str, chapter: str) -> DataFrame:
    """Each section with the latest chapter at or before its offset, before the first an empty text (null if ``chapter`` is no text): one ordered union, no range join."""
    kind = chapters.schema[chapter].dataType
    none = F.lit("" if kind.simpleString() == "string" else None).cast(kind)
    s = sections.withColumns({"_is": F.lit(1), chapter: F.lit(None).cast(kind)})
    c = chapters.select(by, offset, chapter).withColumn("_is", F.lit(0))
    w = Window.partitionBy(by).orderBy(offset, "_is").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(c, allowMissingColumns=True).withColumn(chapter, F.coalesce(F.last(chapter, ignorenulls=True).over(w), none)).where("_is = 1").drop("_is")


def without_margin(body: Column) -> Column:
    """A section's text without the heading of the next one at its end: from a number alone on one of the last six lines, then headings."""
    heading = lambda x: (F.length(x) > 0) & (F.length(x) <= 90) & ~F.right(x, F.lit(1)).isin(list(".;:,")) & (x.startswith("Of ") | ((F.upper(x) == x) & (F.lower(x) != x)))
    margin = F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: F.coalesce(F.try_element_at(F.split(body, "\n"), -i).rlike(MARGIN), F.lit(False)))
    cut = let(F.struct(F.split(body, "\n").alias("x"), F.array_min(margin).alias("m")), lambda s: F.slice(s["x"], 1, F.size(s["x"]) - F.coalesce(s["m"], F.lit(0))))
    begin = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def step(acc, x):
        drop = acc["open"] & heading(F.trim(x))
        return F.struct(F.when(drop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), (acc["open"] & drop).alias("open"))

    left = F.aggregate(F.reverse(cut), begin, step, lambda acc: F.reverse(acc["kept"]))
    return F.trim(F.array_join(left, "\n"))


def chapters(laws: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, start, chapter, chapter_title): chapter headings with the first line after each."""
    c = laws.select(doc, F.col(text).alias("_t"), F.explode(located(F.col(text), CHAPTER, 1)).alias("m"))
    tail = F.ltrim(F.substr("_t", F.col("m.end") + 1, F.lit(200)), F.lit("\n"))
    return c.select(doc, F.col("m.start").alias("start"), F.concat(F.lit("CHAPTER "), "m.g1").alias("chapter"), F.trim(F.substring_index(tail, "\n", 1)).alias("chapter_title"))


def parse(laws: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, position, section, title, text, chapter, chapter_title, repealed): the sections of each law's text, in order.

    A heading counts if its number is over all before it and it does not read like a footnote; a section runs up to the next heading that counts. A match takes along what
    follows it up to the next match, so no text is repeated, and a section's parts are joined. Laws without a heading give no rows.
    """
    t = F.col(text)
    heads = let(F.struct(located(t, SECTION, 1, 2).alias("m"), F.split(t, SECTION, -1).alias("p")), lambda s: F.arrays_zip(s["m"].alias("m"), F.slice(s["p"], 2, F.size(s["p"]) - 1).alias("after")))
    m = laws.where(t.rlike(SECTION)).select(doc, F.explode(heads).alias("_h")).select(doc, "_h.m", "_h.after")
    m = m.select(doc, F.col("m.start").alias("start"), F.col("m.g1").alias("section"), F.trim(F.regexp_replace("m.g2", r"\s+", " ")).alias("title"), F.col("m.text").alias("_match"), "after")
    w = Window.partitionBy(doc).orderBy("start")
    key = section_key(F.col("section"))
    footnote = F.col("title").rlike(FOOTNOTE)
    m = m.withColumn("_key", F.when(~footnote, key)).withColumn("_top", F.max("_key").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    counts = ~footnote & (F.col("_top").isNull() | (F.col("_key") > F.col("_top"))) & (key > F.struct(F.lit(0).alias("n"), F.lit("").alias("suffix")))
    m = m.withColumn("_own", counts).withColumn("position", F.sum(F.col("_own").cast("int")).over(w) - 1).where("position >= 0")
    part = F.struct("start", F.when(F.col("_own"), F.col("after")).otherwise(F.concat("_match", "after")).alias("t"))
    g = m.groupBy(doc, "position").agg(
        F.min("start").alias("start"), F.min_by("section", "start").alias("section"), F.min_by("title", "start").alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "").alias("_body"))
    g = g.withColumn("_body", without_margin(F.trim(F.regexp_replace("_body", r"^\s+|\s+$", ""))))
    g = chapters_in_force(g, chapters(laws, doc, text).withColumn("_c", F.struct("chapter", "chapter_title").cast("struct<chapter: string, chapter_title: string>")), doc, "start", "_c")
    return g.select(
        doc, F.col("position").cast("long").alias("position"), "section", "title", F.trim(F.regexp_replace("_body", r"\s+", " ")).alias("text"),
        F.coalesce("_c.chapter", F.lit("")).alias("chapter"), F.coalesce("_c.chapter_title", F.lit("")).alias("chapter_title"), repealed(F.col("_body")).alias("repealed"))


def repealed(body: Column) -> Column:
    return body.rlike(REPEALED)
