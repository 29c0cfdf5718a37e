"""Pages into named sections, and texts into parents and children with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from ..functions.headers import stripped
from ..functions.places import let
from ..functions.text import words
from .chunking import packed

# Headings by the section that they begin.
HEADINGS = {
    "SUMMARY": ["HEADNOTE", "HEAD NOTE", "SYNOPSIS", "ABSTRACT"],
    "FACTS": [
        "FACTS", "FACT", "BRIEF FACTS", "FACTS OF THE CASE", "FACTUAL BACKGROUND", "BACKGROUND", "FACTUAL MATRIX", "CASE OF THE PROSECUTION",
        "CASE OF THE COMPLAINANT", "PROSECUTION CASE", "RIVAL CONTENTIONS",
    ],
    "ARGUMENTS": [
        "ARGUMENTS", "ARGUMENT", "CONTENTIONS", "CONTENTION", "SUBMISSIONS", "SUBMISSION", "SUBMISSIONS ON BEHALF OF THE PETITIONER",
        "SUBMISSIONS ON BEHALF OF THE APPELLANT", "SUBMISSIONS ON BEHALF OF THE RESPONDENT", "SUBMISSIONS ON BEHALF OF STATE",
        "SUBMISSIONS ON BEHALF OF THE PROSECUTION", "ARGUMENTS ON BEHALF OF THE PETITIONER", "ARGUMENTS ON BEHALF OF THE RESPONDENT",
        "ARGUMENTS ON BEHALF OF STATE", "LEARNED COUNSEL FOR THE PETITIONER", "LEARNED COUNSEL FOR THE RESPONDENT",
    ],
    "REASONING": [
        "JUDGMENT", "JUDGEMENT", "ANALYSIS", "DISCUSSION", "FINDINGS", "FINDING", "REASONS", "CONSIDERATION", "ANALYSIS AND FINDINGS",
        "ANALYSIS AND DISCUSSION", "DISCUSSION AND FINDINGS", "REASONING AND ORDER", "REASONS FOR THE ORDER", "CONSIDERATION OF THE COURT",
    ],
    "DECISION": ["DECISION"],
    "ORDER": ["ORDER", "DIRECTIONS", "DIRECTION", "DECREE", "RELIEF", "DISPOSITION", "FINAL ORDER", "OPERATIVE ORDER", "RESULT"],
    "KEY_POINTS": ["HELD", "RATIO", "RATIO DECIDENDI", "CONCLUSION"],
    "ISSUES": ["ISSUES", "ISSUE", "QUESTIONS", "POINTS FOR DETERMINATION", "QUESTIONS OF LAW", "FRAMING OF ISSUES"],
    "CASE_METADATA": ["BENCH", "CITATION", "ACT", "CORAM"],
}
SECTION_OF = {h: s for s, hs in HEADINGS.items() for h in hs}
#: A line that is a heading, numbered or not; the longest heading counts.
HEADING_LINE = r"(?im)^\s*(?:\d+[\.\)\-]\s*)?(" + "|".join(sorted(SECTION_OF, key=len, reverse=True)) + r")\s*[:.\-]?\s*$"

# Where a text is cut: at judgments, paragraphs, numbered paragraphs, sentences.
JUDGMENT_LINE = r"(?i)\n(?:JUDGMENT|ORDER|DECREE)\n"
BLANK_LINE = r"\n\s*\n"
SENTENCE_END = r"(?<=[.?!])\s+"
SENTENCE_START = r"(?<=[.?!])\s+(?=[A-Z])"
PARAGRAPH = r"(?mi)(?:\n\n+|¶\s*\d+|\bPara(?:graph)?\s+\d+\b|^\s*\d+\.\s|\[\d+\])"


def split_sections(pages: DataFrame, doc: str, page: str, text: str, first: str = "PREAMBLE") -> DataFrame:
    """(doc, page, idx, section, text): the parts between headings; what comes before a page's first heading is of the section that the pages before end in.

    A heading with nothing under it begins no section. The carry over pages is a window by document, in which only names move.
    """
    names = F.create_map(*[F.lit(x) for kv in SECTION_OF.items() for x in kv])
    own = F.transform(F.regexp_extract_all(F.col(text), F.lit(HEADING_LINE), F.lit(1)), lambda h: names[F.upper(h)])
    parts = F.zip_with(F.split(F.col(text), HEADING_LINE, -1), F.concat(F.array(F.lit(None).cast("string")), own), lambda t, n: F.struct(n.alias("section"), stripped(t).alias("text")))
    p = pages.select(doc, page, F.filter(parts, lambda x: x["text"] != "").alias("_parts"))
    named = F.filter("_parts", lambda x: x["section"].isNotNull())
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_own", F.try_element_at(named, F.lit(-1))["section"]).withColumn("_active", F.coalesce(F.last("_own", ignorenulls=True).over(before), F.lit(first)))
    x = p.select(doc, page, "_active", F.posexplode("_parts").alias("idx", "_part"))
    return x.select(doc, page, "idx", F.coalesce("_part.section", "_active").alias("section"), F.col("_part.text").alias("text"))


def merge_in_order(sections: DataFrame, by: list[str]) -> DataFrame:
    """Sections of equal name of a page joined, in order of their first part."""
    parts = F.sort_array(F.collect_list(F.struct("idx", "text")))
    return sections.groupBy(*by, "section").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.min("idx").alias("idx"))


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def _word_windows(w: Column, most: int, step: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(most)), " "))


def recursive_split(text: Column, most: int, overlap: int, paragraphs: bool = False, carry: int | None = None) -> Column:
    """A text of more than ``most`` words in pieces of whole paragraphs, else whole sentences, else windows of words.

    Windows overlap by ``overlap`` words. Other pieces begin with the last ``carry`` paragraphs or sentences of the one before (all of them, if fewer), by
    default ``overlap`` of them too. That is the established result, but it makes a piece of each sentence and repeats it up to ``overlap`` times; a small
    ``carry`` keeps the output near the size of the input.
    """
    several = lambda found, other: let(found, lambda p: F.when(F.size(p) > 1, p).otherwise(other))
    parts = several(_kept(F.split(text, SENTENCE_START)), F.lit(None).cast("array<string>"))
    if paragraphs:
        parts = several(_kept(F.split(text, PARAGRAPH)), parts)

    def cut(w):
        return let(parts, lambda p: F.when(p.isNull(), _word_windows(w, most, most - overlap)).otherwise(packed(p, most, overlap if carry is None else carry)))

    return let(words(text), lambda w: F.when(F.size(w) <= most, F.array(text)).otherwise(cut(w)))


def judgment_chunks(text: Column, most: int = 512, overlap: int = 50) -> Column:
    """Pieces of at most ``most`` words: of each judgment of a text its paragraphs, packed; a long paragraph by sentences, a longer sentence by windows of words.

    A piece begins with the last ``overlap`` words of the one before; pieces never cross judgments. Empty for blank texts.
    """
    unit = lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n"))
    nothing = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def units(judgment):
        paras = F.transform(_kept(F.split(judgment, BLANK_LINE)), unit)
        return F.flatten(F.transform(paras, lambda p: F.when(p["n"] > most, F.transform(F.split(p["s"], SENTENCE_END), unit)).otherwise(F.array(p))))

    def step(acc, u):
        full = (acc["n"] + u["n"] > most) & (acc["now"] != "")
        now = F.trim(acc["now"])
        done = F.when(full, F.concat(acc["done"], F.array(stripped(now)))).otherwise(acc["done"])
        w = words(acc["now"])
        tail = F.when(full & (acc["n"] > overlap), F.array_join(F.slice(w, -overlap, overlap), " ")).otherwise(acc["now"])
        n = F.when(full, F.least(acc["n"], F.lit(overlap))).otherwise(acc["n"])
        packed_on = F.struct(done.alias("done"), F.concat(tail, F.lit(" "), u["s"]).alias("now"), (n + u["n"]).alias("n"))
        windows = F.struct(F.concat(done, _word_windows(words(u["s"]), most, most - overlap)).alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
        return F.when(u["n"] > most, windows).otherwise(packed_on)

    def one(judgment):
        return F.aggregate(units(judgment), nothing, step, lambda a: F.concat(a["done"], _kept(F.array(a["now"]))))

    return F.flatten(F.transform(F.split(text, JUDGMENT_LINE), one))


def parents_and_children(sections: DataFrame, source: Column, page: str, section: str, text: str, keep: list[str], parent_words: int = 512, child_words: int = 256, overlap: int = 50, carry: int | None = None) -> DataFrame:
    """One row a child: its and its parent's text and stable ids, paragraph numbers, pinpoint page and kind of passage. Blank sections have none."""
    s = sections.where(stripped(F.col(text)) != "")
    p = s.select(*keep, page, section, source.alias("_source"), F.posexplode_outer(recursive_split(F.col(text), parent_words, overlap, True, carry)).alias("_i", "_parent")).where("_i is not null")
    p = p.withColumn("parent_chunk_id", legal.stable_id(F.col("_source"), F.col(page).cast("string"), F.col(section), F.col("_i").cast("string"), F.substring("_parent", 1, 200)))
    c = p.select("*", F.posexplode_outer(recursive_split(F.col("_parent"), child_words, overlap, False, carry)).alias("_j", "_child")).where("_j is not null").where(stripped(F.col("_child")) != "")
    return c.select(
        *keep, page, section, "parent_chunk_id", legal.stable_id(F.col("parent_chunk_id"), F.col("_j").cast("string"), F.substring("_child", 1, 160)).alias("chunk_id"),
        stripped(F.col("_child")).alias("text"), stripped(F.col("_parent")).alias("parent_text"), legal.paragraph_numbers(F.col("_child")).alias("para_numbers"),
        legal.pinpoint_page(F.col("_child")).alias("scc_page"), legal.passage_kind(F.col(section), F.col("_child")).alias("section_type"))
