"""Chunks as relational operations over words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import let
from ..functions.text import words
from .ordering import running


#: Where a sentence ends and another begins.
SENTENCE = r"(?<=[.;:])\s+(?=[A-Z(\[])"


def fixed_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 220, step: int = 170) -> DataFrame:
    """(id, chunk_index, n_words, text): windows of ``size`` words each ``step``; the last is the first to reach the end.

    Windows are slices of a document's word array: no shuffle.
    """
    w = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.ceil(F.greatest(F.size("w") - size, F.lit(0)) / step).cast("int")
    x = w.select("id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, F.lit(size))
    return x.select("id", "chunk_index", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))


def windows_over(sections: DataFrame, order: str, keep: list[str], size: int = 220, step: int = 170) -> DataFrame:
    """(keep, chunk_id, chunk_index, chunk_count, n_words, text, section_text, strategy): windows of ``size`` words each ``step`` over all sections in order, each the section's of its first word.

    Sections without text take no part, the last window is the first to reach the end. A section's first word has the number of words before it, a running
    sum over ranges; each section then cuts its own part of every window that it meets, and a window's parts (at most ``size``) are joined.
    """
    s = _headed(sections).withColumn("_w", words(F.concat_ws(" ", "_head", "section_text"))).withColumn("_n", F.size("_w"))
    s, total = running(s.where("_n > 0"), [order], "_n", "_at")
    last = max(0, -(-(total - size) // step))
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step)).cast("long")
    met = F.least(F.lit(last), F.floor((F.col("_at") + F.col("_n") - 1) / step)).cast("long")
    s = s.where(first <= met).withColumn("chunk_index", F.explode(F.sequence(first, met)))
    begin = F.greatest(F.col("chunk_index") * step - F.col("_at"), F.lit(0))
    length = F.least(F.col("chunk_index") * step + size - F.col("_at"), F.col("_n")) - begin
    part = F.slice("_w", (begin + 1).cast("int"), length.cast("int"))
    s = s.select("chunk_index", F.struct("_at", F.array_join(part, " ").alias("t")).alias("p"), length.alias("n"), F.struct("_at", "section_text", *keep).alias("owner"))
    w = s.groupBy("chunk_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["t"]), " ").alias("text"), F.sum("n").alias("n_words"), F.min_by("owner", "owner._at").alias("owner"))
    return w.select(
        *[F.col(f"owner.{c}") for c in keep], F.concat(F.lit("win-"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", F.lit(0).alias("chunk_count"), "n_words", "text",
        F.col("owner.section_text").alias("section_text"), F.lit("fixed_window").alias("strategy"))


def length_stats(chunks: DataFrame, by: list[str], n: str = "n_words") -> DataFrame:
    """Least, upper median and most words; the median from counts of equal lengths, so no group is gathered."""
    c = chunks.groupBy(*by, n).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    c = c.withColumns({"_upto": F.sum("_c").over(w.orderBy(n).rowsBetween(Window.unboundedPreceding, 0)), "chunks": F.sum("_c").over(w)})
    middle = F.floor(F.col("chunks") / 2) + 1
    return c.groupBy(*by, "chunks").agg(F.min(n).alias("low"), F.min(F.when(F.col("_upto") >= middle, F.col(n))).alias("upper_median"), F.max(n).alias("high"))


def running_lines(pages: DataFrame, doc: str, text: str, share: float = 0.7, least_pages: int = 4) -> DataFrame:
    """(doc, place, line, pages): first or last lines, 80 characters, that stand on that share of a document's pages or more."""
    lines = F.split(F.trim(text), "\n")
    edge = lambda x: F.substring(F.trim(x), 1, 80)
    both = F.array(F.struct(F.lit("first").alias("place"), edge(F.get(lines, 0)).alias("line")), F.struct(F.lit("last").alias("place"), F.when(F.size(lines) > 1, edge(F.element_at(lines, -1))).alias("line")))
    n = pages.groupBy(doc).agg(F.count("*").alias("_n"))
    c = pages.select(doc, F.inline(both)).where("line is not null").groupBy(doc, "place", "line").agg(F.count("*").alias("pages"))
    return c.join(n, doc).where((F.col("_n") >= least_pages) & (F.col("pages") / F.col("_n") >= share) & (F.length("line") > 5)).drop("_n")


def without_lines(text: Column, lines: Column) -> Column:
    """A text without each of the lines of an array, literally."""
    return F.aggregate(lines, text, lambda t, x: F.replace(t, x, F.lit("")))


def sentences(text: Column) -> Column:
    """Parts that end in .;: before white space and a capital or a bracket."""
    return F.filter(F.transform(F.split(text, SENTENCE), lambda x: F.trim(x)), lambda s: s != "")


def guarded(sections: DataFrame, section: str, text: str, meta: str = "CASE_METADATA", most: int = 300, least_words: int = 5) -> DataFrame:
    """Sections of fewer than ``least_words`` words go; long ones of the metadata kind are reasoning."""
    kept = sections.where(F.size(words(F.col(text))) >= least_words)
    return kept.withColumn(section, F.when((F.col(section) == meta) & (F.length(text) > most), "REASONING").otherwise(F.col(section)))


def merged(sections: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Texts of equal keys joined in order; a group is one document's section."""
    part = F.sort_array(F.collect_list(F.struct(order, text)))
    return sections.groupBy(*by).agg(F.array_join(F.transform(part, lambda x: x[text]), " ").alias(text), F.count("*").alias("parts"))


def _headed(sections: DataFrame) -> DataFrame:
    head = F.concat("document", F.lit(" Section "), "section", F.lit(". "), "title", F.lit("."))
    return sections.withColumns({"section_text": F.trim("txt"), "_head": head}).where("section_text <> ''")


def section_whole(sections: DataFrame, keep: list[str]) -> DataFrame:
    """One chunk a section with text, its heading before it."""
    return _headed(sections).select(
        *keep, F.concat("document", F.lit("-s"), "section", F.lit("-0")).alias("chunk_id"), F.concat_ws(" ", "_head", "section_text").alias("text"), "section_text",
        F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"), F.lit("section_whole").alias("strategy"))


def _pieces(parts: Column, most: int, tail: Callable[[Column, Column], Column], whole: bool) -> Column:
    """Pieces of at most ``most`` words; ``tail`` of the words' counts and a piece (a, b, n) is (a, n) of the sentences that the next begins with.

    Only places and counts go through the fold: a sentence's words are counted once, and texts are cut at the end.
    """
    state = F.struct(F.array().cast("array<struct<a: int, b: int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))
    piece = lambda acc: F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))

    def bounds(counts):
        def step(acc, x):
            go_on = F.struct(acc["done"].alias("done"), acc["a"].alias("a"), (acc["b"] + 1).alias("b"), (acc["n"] + x).alias("n"))
            cut = let(tail(counts, acc), lambda t: F.struct(F.concat(acc["done"], piece(acc)).alias("done"), t["a"].alias("a"), (acc["b"] + 1).alias("b"), (t["n"] + x).alias("n")))
            return F.when((acc["b"] > acc["a"]) & (acc["n"] + x > most), cut).otherwise(go_on)

        return F.aggregate(counts, state, step, lambda acc: F.concat(acc["done"], piece(acc)))

    def cut_up(p):
        found = let(F.transform(p, lambda s: F.size(words(s))), bounds)
        found = found if whole else F.filter(found, lambda x: x["b"] > x["a"])
        return F.transform(found, lambda x: F.array_join(F.slice(p, x["a"] + 1, x["b"] - x["a"]), " "))

    return let(parts, cut_up)


def packed(parts: Column, most: int, carry: int = 1) -> Column:
    """Sentences packed in order into pieces of at most ``most`` words, each piece but the first beginning with the last ``carry`` of the one before."""
    def tail(counts, acc):
        return let(F.greatest(acc["b"] - carry, acc["a"]), lambda a: F.struct(a.alias("a"), F.aggregate(F.slice(counts, a + 1, acc["b"] - a), F.lit(0), lambda k, x: k + x).alias("n")))

    return _pieces(parts, most, tail, True)


def packed_passages(parts: Column, most: int, carry_words: int) -> Column:
    """As ``packed``, but a passage begins with as many of the last sentences as it takes to reach ``carry_words`` words."""
    def tail(counts, acc):
        begin = F.struct(acc["b"].alias("a"), F.lit(0).alias("n"))
        back = F.reverse(F.slice(counts, acc["a"] + 1, acc["b"] - acc["a"]))
        return F.aggregate(back, begin, lambda t, x: F.when(t["n"] >= carry_words, t).otherwise(F.struct((t["a"] - 1).alias("a"), (t["n"] + x).alias("n"))))

    return _pieces(parts, most, tail, False)


def passages(docs: DataFrame, keep: list[str], text: str, most: int = 220, carry_words: int = 40) -> DataFrame:
    """(keep, idx, text, n_words): passages of whole sentences."""
    # an inner explode would fold the sentences again for a filter on the number of pieces
    p = docs.select(*keep, F.posexplode_outer(packed_passages(sentences(F.col(text)), most, carry_words)).alias("idx", "text")).where("idx is not null")
    return p.withColumn("n_words", F.size(words(F.col("text"))))


def section_split(sections: DataFrame, keep: list[str], most: int = 220) -> DataFrame:
    """A section in pieces of whole sentences, the heading before each."""
    h = _headed(sections)
    whole = F.array("section_text")
    h = h.withColumn("_pieces", F.when(F.size(words(F.col("section_text"))) <= most, whole).otherwise(packed(sentences(F.col("section_text")), most)))
    x = h.select(*keep, "document", "section", "_head", "section_text", F.size("_pieces").alias("chunk_count"), F.posexplode("_pieces").alias("chunk_index", "_piece"))
    return x.select(
        *keep, F.concat("document", F.lit("-s"), "section", F.lit("-"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.concat_ws(" ", "_head", "_piece").alias("text"),
        "section_text", "chunk_index", "chunk_count", F.lit("section_split").alias("strategy"))


#: Chunkers of statute sections by name: (sections, columns to keep) to chunks.
STRATEGIES = {"section_whole": section_whole, "section_split": section_split, "fixed_window": lambda sections, keep: windows_over(sections, "ord", keep)}


def build(strategy: str, sections: DataFrame, keep: list[str]) -> DataFrame:
    """The chunks of a strategy; an unknown name is an error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](sections, keep)


def carry_forward(df: DataFrame, by: str, order: str, value: str, out: str) -> DataFrame:
    """The latest value at or before each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
