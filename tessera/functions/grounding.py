"""Whether an answer's legal specifics stand in its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_phrase, normalized

# What counts as a claim.
SECTIONS = r"(?i)\b(?:section|sections|s\.|u/s|under\s+section)\s*(\d{1,3}[A-Z]{0,2})\b"
CITATIONS = r"(?i)(?:\bAIR\s+\d{4}\s+[A-Z]{2,4}\s+\d+\b|\(\s*\d{4}\s*\)\s*\d+\s*S\.?\s?C\.?\s?C\.?\s*\d+|\[\s*\d{4}\s*\]\s*\d+\s*S\.?\s?C\.?\s?R\.?\s*\d+|\b\d{4}\s+INSC\s+\d+\b)"
NAME = r"[A-Z][A-Za-z.&'\-]+(?:\s+[A-Z][A-Za-z.&'\-]+){0,4}"
CASES = rf"\b({NAME})\s+(?:v\.?|vs\.?)\s+({NAME})"
PUNISHMENTS = (
    r"(?i)\b(?:(?:imprisonment|term|sentence|punishment|punishable)[^.]{0,40}?(?:\b(?:one|two|three|four|five|six|seven|eight|nine|ten|fourteen|twenty)\b|\d{1,3})\s*years?"
    r"|life\s+imprisonment|imprisonment\s+for\s+life|fine\s+of\s+(?:Rs\.?|rupees)\s*[\d,]+)"
)
STATUTE_NAMES = r"(?i)\b(Indian Penal Code|Bharatiya Nyaya Sanhita|Code of Criminal Procedure|Bharatiya Nagarik Suraksha Sanhita|Indian Evidence Act|Bharatiya Sakshya|Negotiable Instruments Act|Prevention of Corruption Act|NDPS Act|POCSO)\b"
DURATIONS = r"(?i)\b((?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fourteen|fifteen|twenty|thirty|\d{1,3})\s+(?:years?|months?|days?))\b"
FINES = r"(?i)\b(?:rs\.?|rupees)\s*([\d,]+)"
LIFE = r"(?i)\b(?:life\s+imprisonment|imprisonment\s+for\s+life)\b"
REFUSAL = "The retrieved legal sources do not contain sufficient information to answer this question."


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def holds(phrase: Column, context: Column) -> Column:
    """Whether a phrase stands in normalised text as whole words; an empty one does not."""
    p = normalized(phrase)
    return (p != "") & has_phrase(p, context)


def section_supported(section: Column, context: Column) -> Column:
    return F.regexp_like(context, F.concat(F.lit(r"(?i)\b"), section, F.lit(r"\b")))


def punishment_supported(phrase: Column, context: Column) -> Column:
    """Every duration, fine and life term of the phrase stands in the normalised context."""
    life = phrase.rlike(LIFE)
    return (
        F.forall(_all(phrase, DURATIONS, 1), lambda d: holds(d, context))
        & F.forall(_all(phrase, FINES, 1), lambda f: holds(F.regexp_replace(f, ",", ""), context) | holds(f, context))
        & (~life | holds(F.lit("life imprisonment"), context) | holds(F.lit("imprisonment for life"), context))
    )


def claims(answer: Column, context: Column) -> Column:
    """Array of (kind, value, supported), in order of kind and place; none for refusals and blank answers."""
    plain = normalized(context)
    claim = lambda kind, value, ok: F.struct(F.lit(kind).alias("kind"), value.alias("value"), ok.alias("supported"))
    sides = F.arrays_zip(_all(answer, CASES).alias("whole"), _all(answer, CASES, 1).alias("a"), _all(answer, CASES, 2).alias("b"))
    found = F.concat(
        F.transform(_all(answer, SECTIONS, 1), lambda s: claim("section", F.concat(F.lit("section "), F.upper(s)), section_supported(s, context))),
        F.transform(_all(answer, CITATIONS), lambda c: claim("citation", c, holds(c, plain))),
        F.transform(sides, lambda s: claim("case_name", s["whole"], holds(s["a"], plain) & holds(s["b"], plain))),
        F.transform(_all(answer, STATUTE_NAMES, 1), lambda s: claim("statute", s, holds(s, plain))),
        F.transform(_all(answer, PUNISHMENTS), lambda p: claim("punishment", F.trim(p), punishment_supported(p, plain))),
    )
    refused = (F.trim(answer) == "") | F.lower(answer).contains(REFUSAL.lower())
    return F.when(refused, F.filter(found, lambda c: F.lit(False))).otherwise(found)


def support_rate(found: Column) -> Column:
    """Share of claims that are supported; 1 without claims."""
    n = F.size(found)
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(found, lambda c: c["supported"])) / n)


HEAD = "\n\n---\n\n**⚠ Not supported by the retrieved sources**\n\n"
ABSENT = "` does not appear in the retrieved evidence."
TAIL = "\n\n_These statements were produced by the language model but could not be traced to any retrieved passage. Treat them as unverified._"


def annotated(answer: Column, found: Column) -> Column:
    """The answer, followed by its unsupported claims."""
    bad = F.filter(found, lambda c: ~c["supported"])
    lines = F.transform(bad, lambda c: F.concat(F.lit("- "), c["kind"], F.lit(": `"), c["value"], F.lit(ABSENT)))
    return F.when(F.size(bad) == 0, answer).otherwise(F.concat(F.rtrim(answer), F.lit(HEAD), F.array_join(lines, "\n"), F.lit(TAIL)))
