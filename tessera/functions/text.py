"""Text expressions; all JVM-side, with ASCII classes so that other SQL engines agree."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .places import let

# Stop words of the lexical index.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "in", "to", "is", "are", "was", "were", "that", "this", "it", "be", "has", "have",
    "had", "for", "with", "on", "at", "by", "from", "as", "but", "not",
]

# Lines that match one of these are page furniture.
FURNITURE = [
    r".*Indian\s+Kanoon.*", r"Page\s+\d+\s+of\s+\d+", r"https?://\S+", r"www\.\S+", r"Downloaded\s+from.*", r"CITATOR\s+INFO.*",
    r"SCC\s+Online\s+Web.*", r"^\s*\d{1,3}\s*$", r"^\s*-\s*\d+\s*-\s*$", r"By:\s*\w+.*Signing\s+Date.*", r"Digitally\s+signed\s+by.*",
    r"Signature\s+Not\s+Verified", r"^\s*Neutral\s+Citation.*",
]

# Document types, first match wins.
DOC_TYPES = [
    (r"SUPREME\s+COURT\s+OF\s+INDIA", "SUPREME_COURT"), (r"HIGH\s+COURT", "HIGH_COURT"), (r"DISTRICT\s+(?:COURT|JUDGE|SESSIONS)", "DISTRICT_COURT"),
    (r"TRIBUNAL|APPELLATE\s+TRIBUNAL", "TRIBUNAL"), (r"CONSUMER\s+(?:DISPUTES?|FORUM)", "CONSUMER_FORUM"), (r"NATIONAL\s+(?:GREEN|COMPANY)", "TRIBUNAL"),
]

# Code-point ranges of scripts.
SCRIPTS = {
    "hi": (0x0900, 0x097F), "kn": (0x0C80, 0x0CFF), "ta": (0x0B80, 0x0BFF), "te": (0x0C00, 0x0C7F), "ml": (0x0D00, 0x0D7F),
    "bn": (0x0980, 0x09FF), "gu": (0x0A80, 0x0AFF), "pa": (0x0A00, 0x0A7F), "or": (0x0B00, 0x0B7F), "en": (0x0041, 0x007A),
}


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as SQL engines round it: the scaled double's half goes up. ``round`` takes the halves of the shortest decimal, so 57/800 differs."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def tokens(text: Column, stop_words: bool = False) -> Column:
    """Lower-case ASCII word tokens. Those without ``stop_words`` are whole words: no part of one with other letters, digits or underscores."""
    if not stop_words:
        return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    t = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(t, lambda x: x.rlike("^[a-z0-9]+$") & ~x.isin(STOP_WORDS))


def token_text(text: Column, stop_words: bool = False) -> Column:
    """A text as ``cut_tokens`` takes it: lower case, null as empty; for whole words, letters and digits beyond ASCII become underscores."""
    low = F.coalesce(F.lower(text), F.lit(""))
    return F.regexp_replace(low, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_") if stop_words else low


#: 1 a letter or digit of a token, 2 an underscore.
_KINDS = np.array([1 if chr(i) in "0123456789abcdefghijklmnopqrstuvwxyz" else 2 if i == 95 else 0 for i in range(256)], np.uint8)


def cut_tokens(texts: pa.Array, stop_words: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of a column of ``token_text``, and the row of each: inside tasks, over the bytes of all rows at once."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    none = (pa.array([], pa.large_string()), np.zeros(0, np.int64))
    if not len(texts) or texts.buffers()[2] is None:
        return none
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    kind = _KINDS[np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]]
    word = kind > 0 if stop_words else kind == 1
    if not word.any():
        return none
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = (at[:-1] - at[0])[at[1:] > at[:-1]]
    first[edge] = word[edge]  # a text's first token does not go on from the text before
    starts = np.flatnonzero(first)
    begin = np.flatnonzero(first[word])
    chars = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]][word]
    found = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.append(begin, len(chars)).astype(np.int64)), pa.py_buffer(chars)])
    row = np.searchsorted(at[1:] - at[0], starts, side="right")
    if stop_words:
        good = (np.maximum.reduceat(kind[word], begin) == 1) & ~pc.is_in(found, value_set=pa.array(STOP_WORDS, pa.large_string())).to_numpy(zero_copy_only=False)
        found, row = found.filter(pa.array(good)), row[good]
    return found, row


def words(text: Column) -> Column:
    """White-space words; none for empty text."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def without_furniture(text: Column) -> Column:
    """Lines that are page furniture dropped."""
    # a search needs no ".*" at its ends, which would cost the square of a line's length
    found = "|".join(f"(?:{p.removeprefix('.*').removesuffix('.*')})" for p in FURNITURE)
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike("(?i)" + found)), "\n")


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"(\w)-\s*\n\s*(\w)", "$1$2")


def unglued(text: Column) -> Column:
    """A blank between aA, and after .,;: before a letter."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([.,;:])([A-Za-z])", "$1 $2")


def tidy_lines(text: Column) -> Column:
    """Each line's blanks collapsed, blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalized(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def has_phrase(phrase: Column, normalized_text: Column) -> Column:
    return F.concat(F.lit(" "), normalized_text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def _in_script(text: Column, lang: str) -> Column:
    # what leaves is replaced in runs, so a script that a text lacks costs one scan and no copy
    a, b = SCRIPTS[lang]
    return F.length(text) - F.length(F.regexp_replace(text, f"[\\x{{{a:x}}}-\\x{{{b:x}}}]+", ""))


def script_counts(text: Column) -> Column:
    """Map from language to the number of code points in its range."""
    return F.create_map(*[x for lang in SCRIPTS for x in (F.lit(lang), _in_script(text, lang))])


def languages(text: Column) -> Column:
    """(primary, secondary): the script with most code points, of equal ones English, then the one listed first; others over a twentieth."""
    order = ["en", *[x for x in SCRIPTS if x != "en"]]
    rows = lambda n: F.array(*[F.struct(n(x).alias("n"), F.lit(-i).alias("o"), F.lit(x).alias("lang")) for i, x in enumerate(order)])
    none = F.when(text.isNotNull(), 0)
    rare = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for x, (a, b) in SCRIPTS.items() if x != "en")
    counts = F.when(text.rlike(f"[{rare}]"), rows(lambda x: _in_script(text, x))).otherwise(rows(lambda x: _in_script(text, x) if x == "en" else none))

    def chosen(c):
        total = F.greatest(F.aggregate(c["all"], F.lit(0), lambda s, x: s + x["n"]), F.lit(1))
        return let(F.struct(c["all"].alias("all"), F.array_max(c["all"])["lang"].alias("top"), total.alias("total")), lambda t: F.struct(
            t["top"].alias("primary"), F.transform(F.filter(t["all"], lambda x: (x["lang"] != t["top"]) & (x["n"] / t["total"] > 0.05)), lambda x: x["lang"]).alias("secondary")))

    return let(F.struct(counts.alias("all")), chosen)


def document_type(text: Column) -> Column:
    head = F.substring(text, 1, 3000)
    chain = reduce(lambda c, p: c.when(head.rlike("(?i)" + p[0]), p[1]), DOC_TYPES[1:], F.when(head.rlike("(?i)" + DOC_TYPES[0][0]), DOC_TYPES[0][1]))
    return chain.otherwise("UNKNOWN")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


# Words that recognition splits or misspells, in order.
MISREADINGS = [
    (r"\bno where\b", "nowhere"), (r"\bany where\b", "anywhere"), (r"\bevery where\b", "everywhere"), (r"\bdeliritious\b", "deleterious"),
    (r"\bdiscretionery\b", "discretionary"), (r"\bageement\b", "agreement"), (r"\bdocumen\b", "document"), (r"\breciev\b", "receive"),
    (r"\bloan\s+ageement\b", "loan agreement"), (r"\bunder\s+stamping\b", "under-stamping"), (r"\bchar\s+erise\b", "characterise"),
    (r"\bion\s+taken\b", "action taken"), (r"\bf\s+that\b", "fact that"), (r"\battr\s+s\b", "attracts"), (r"\bpro\s+posed\b", "proposed"),
    (r"\ben\s+forced\b", "enforced"), (r"\bmis\s+take\b", "mistake"), (r"\bSecret\s+any\b", "Secretary"), (r"\bjudg\s+ment\b", "judgment"),
    (r"\bpeti\s+tioner\b", "petitioner"), (r"\brespon\s+dent\b", "respondent"), (r"\bappel\s+lant\b", "appellant"),
    (r"\bconsti\s+tution\b", "constitution"), (r"\bfunda\s+mental\b", "fundamental"), (r"\bjuris\s+diction\b", "jurisdiction"),
    (r"\bprocee\s+dings\b", "proceedings"), (r"\bcontem\s+pt\b", "contempt"), (r"\bexecu\s+tion\b", "execution"),
    (r"\binjunc\s+tion\b", "injunction"), (r"\brevision\s+al\b", "revisional"),
]


#: Any of the misread words: a text without one is left alone after one look.
ANY_MISREADING = r"(?i)\b(?:" + "|".join(p.removeprefix(r"\b") for p, _ in MISREADINGS) + ")"


def corrected(text: Column) -> Column:
    """Misread words mended, one after the other."""
    mended = lambda t: reduce(lambda x, p: F.regexp_replace(x, "(?i)" + p[0], p[1]), MISREADINGS, t)
    return let(text, lambda t: F.when(t.rlike(ANY_MISREADING), mended(t)).otherwise(t))


def without_leading_symbols(text: Column) -> Column:
    """White space and :,.-; at the start of lines dropped."""
    return F.regexp_replace(text, r"(?md)^[\s:,.\-;]+", "")


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def cleaned(text: Column, unicode: bool = True) -> Column:
    """All steps: NFKC, hyphenation, furniture, misreadings, glued words, leading symbols, blanks."""
    t = composed(text) if unicode else text
    return tidy_lines(without_leading_symbols(unglued(corrected(without_furniture(dehyphenated(t))))))


def source_text(text: Column) -> Column:
    """Soft hyphens dropped, no-break blanks plain, lines trimmed, blank lines dropped."""
    plain = F.regexp_replace(F.regexp_replace(text, "\u00ad", ""), "\u00a0", " ")
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)))
