"""Understanding a question: its law, its section, what kind of question it is, and whether its premises hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ways of naming the two codes.
IPC = r"(?i)\bindian\s+penal\s+code\b|\bi\.?\s*p\.?\s*c\.?\b|\bpenal\s+code\b|\bact\s+45\s+of\s+1860\b"
BNS = r"(?i)\bbharatiya\s+nyaya\s+sanhita\b|\bb\.?\s*n\.?\s*s\.?\b|\bnyaya\s+sanhita\b|\bact\s+45\s+of\s+2023\b|\bnew\s+criminal\s+(?:law|code)\b"
SECTION = r"(?i)\b(?:u/?s|under\s+section|section|sec\.?|s\.)\s*(\d{1,3}[A-Za-z]{0,2})\b"
BARE_SECTION = r"(?i)\b(?:IPC|BNS|I\.P\.C\.?|B\.N\.S\.?)\s+(\d{1,3}[A-Za-z]{0,2})\b"

# Reasons and disclosures.
REASONS = {
    "chosen": "selected by the user in the corpus selector", "both": "user asked for both statutes", "IPC": "query names the Indian Penal Code",
    "BNS": "query names the Bharatiya Nyaya Sanhita", "named": "query names both statutes, so both were searched",
    "open": "query does not name a statute, so both the IPC (repealed 2024-07-01) and the BNS (in force) were searched",
}
DISCLOSURES = {
    "IPC": "Searched the Indian Penal Code, 1860 — repealed with effect from 1 July 2024 and replaced by the Bharatiya Nyaya Sanhita, 2023.",
    "BNS": "Searched the Bharatiya Nyaya Sanhita, 2023 — in force since 1 July 2024.",
    "": "No statute was named, so both were searched: the Indian Penal Code, 1860 (repealed 1 July 2024) and the Bharatiya Nyaya Sanhita, 2023 (in force). Each result below states which one it comes from.",
}

# Cues of a question's kind.
CASE_LAW = r"(?i)\b(?:supreme\s+court|high\s+court|court\s+(?:has|have|held|said|ruled|observed)|case\s+law|judgment|judgement|precedent|ratio|held\s+in|decided|bench|landmark|authorit(?:y|ies)|which\s+cases?|what\s+cases?)\b"
APPLICATION = r"(?i)\b(?:can\s+a\s+person|can\s+someone|is\s+it\s+(?:an\s+)?(?:offence|illegal)|what\s+if|whether|would\s+it|does\s+it\s+(?:amount|constitute)|amounts?\s+to|constitutes?|liable|convicted\s+(?:for|if|when)|difference\s+between|distinguish)\b"
MENTION = r"(?i)\b(?:section|sec\.?|s\.|u/s)\s*\d{1,4}[A-Za-z]{0,2}\b|\b(?:IPC|BNS)\s+\d{1,4}[A-Za-z]{0,2}\b"
KINDS = {"unsupported": (0.0, 0.0), "case_law": (0.25, 0.75), "application": (0.45, 0.55), "direct_section": (0.75, 0.25), "natural_language": (0.6, 0.4)}

# Statute tokens beside a number, either way round, and statutes the corpus does not hold.
TOKEN = r"(IPC|BNS|I\.P\.C\.?|B\.N\.S\.?|Cr\.?\s?P\.?C\.?|BNSS|CPC|NDPS|POCSO|Evidence\s+Act|N\.?I\.?\s+Act|I\.?T\.?\s+Act)"
NUMBER = r"(\d{1,4}[A-Z]{0,2})"
BEFORE = rf"(?i){TOKEN}\s+(?:section|sec\.?|s\.)?\s*{NUMBER}\b"
AFTER = rf"(?i)(?:section|sec\.?|s\.|u/s)\s*{NUMBER}\s+(?:of\s+(?:the\s+)?)?{TOKEN}"
ABSENT = {
    "CRPC": ("Code of Criminal Procedure, 1973", r"\b(?:cr\.?\s?p\.?\s?c\.?|code\s+of\s+criminal\s+procedure)\b"),
    "BNSS": ("Bharatiya Nagarik Suraksha Sanhita, 2023", r"\b(?:b\.?n\.?s\.?s\.?|bharatiya\s+nagarik\s+suraksha)\b"),
    "EVIDENCE": ("Indian Evidence Act, 1872", r"\b(?:indian\s+)?evidence\s+act\b"),
    "BSA": ("Bharatiya Sakshya Adhiniyam, 2023", r"\bbharatiya\s+sakshya\b"),
    "NDPS": ("Narcotic Drugs and Psychotropic Substances Act, 1985", r"\b(?:n\.?d\.?p\.?s\.?|narcotic\s+drugs)\b"),
    "POCSO": ("Protection of Children from Sexual Offences Act, 2012", r"\bpocso\b"),
    "IT": ("Information Technology Act, 2000", r"\b(?:i\.?t\.?\s+act|information\s+technology\s+act)\b"),
    "NI": ("Negotiable Instruments Act, 1881", r"\b(?:n\.?i\.?\s+act|negotiable\s+instruments)\b"),
    "PC": ("Prevention of Corruption Act, 1988", r"\bprevention\s+of\s+corruption\b"),
    "HMA": ("Hindu Marriage Act, 1955", r"\bhindu\s+marriage\s+act\b"),
    "CPC": ("Code of Civil Procedure, 1908", r"\b(?:c\.?p\.?c\.?|code\s+of\s+civil\s+procedure)\b"),
    "MV": ("Motor Vehicles Act, 1988", r"\bmotor\s+vehicles?\s+act\b"),
}


def section_in(question: Column) -> Column:
    """The section a question names, or null."""
    one = lambda p: F.nullif(F.regexp_extract(question, p, 1), F.lit(""))
    return F.upper(F.coalesce(one(SECTION), one(BARE_SECTION)))


def corpus_choice(question: Column, override: Column) -> Column:
    """(law, explicit, reason, section): an override wins, then the code that is named."""
    o = F.upper(F.trim(override))
    ipc, bns = question.rlike(IPC), question.rlike(BNS)
    case = (
        F.when(o.isin("IPC", "BNS"), "chosen").when(o.isin("BOTH", "ALL", "ANY"), "both").when(ipc & ~bns, "IPC").when(bns & ~ipc, "BNS")
        .when(ipc & bns, "named").otherwise("open")
    )
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    law = F.when(case == "chosen", o).when(case.isin("IPC", "BNS"), case)
    return F.struct(law.alias("law"), (case != "open").alias("explicit"), reasons[case].alias("reason"), section_in(question).alias("section"))


def disclosure(law: Column) -> Column:
    return F.when(law == "IPC", DISCLOSURES["IPC"]).when(law == "BNS", DISCLOSURES["BNS"]).otherwise(DISCLOSURES[""])


def law_allows(choice_law: Column, row_law: Column) -> Column:
    """The filter of a choice: any row if no law was chosen."""
    return choice_law.isNull() | (choice_law == row_law)


def statute_key(token: Column) -> Column:
    c = F.upper(F.regexp_replace(token, r"[.\s]", ""))
    out = F.when(c.isin("IPC", "BNS"), c).when(c.startswith("CRPC"), "CRPC").when(c.startswith("BNSS"), "BNSS").when(c.startswith("EVIDENCE"), "EVIDENCE")
    for key in ABSENT:
        out = out.when(c.startswith(key), key)
    return out.otherwise(c)


def references(question: Column) -> Column:
    """Distinct (statute, section) of a question, both word orders."""
    def pairs(pattern, statute, number):
        return F.arrays_zip(F.regexp_extract_all(question, F.lit(pattern), F.lit(statute)).alias("s"), F.regexp_extract_all(question, F.lit(pattern), F.lit(number)).alias("n"))

    ref = lambda r: F.struct(statute_key(r["s"]).alias("statute"), F.upper(r["n"]).alias("section"))
    return F.array_distinct(F.concat(F.transform(pairs(BEFORE, 1, 2), ref), F.transform(pairs(AFTER, 2, 1), ref)))


def check_premises(questions: DataFrame, sections: DataFrame, id_col: str = "id", text_col: str = "txt") -> DataFrame:
    """(id, ok, n_refs, named, missing, absent): references of a question against a (statute, section) table.

    ``named``: references that exist; ``missing``: sections of held statutes that do not; ``absent``: statutes not held,
    by reference, or by name alone where the question has no reference.
    """
    q = questions.select(F.col(id_col).alias("id"), references(F.col(text_col)).alias("refs"), F.lower(text_col).alias("low"))
    r = q.select("id", F.inline("refs")).join(sections.select("statute", "section").distinct().withColumn("exists", F.lit(True)), ["statute", "section"], "left")
    held = F.col("statute").isin("IPC", "BNS")
    label = F.concat_ws(":", "statute", "section")
    of = lambda cond, what: F.sort_array(F.collect_set(F.when(cond, what)))
    by = r.groupBy("id").agg(of(held & F.col("exists").isNotNull(), label).alias("named"), of(held & F.col("exists").isNull(), label).alias("missing"), of(~held, F.col("statute")).alias("absent"))
    alone = F.array_sort(F.array_compact(F.array(*[F.when(F.col("low").rlike(p), k) for k, (_, p) in ABSENT.items()])))
    empty = F.array().cast("array<string>")
    out = q.join(by, "id", "left").select(
        "id", F.size("refs").alias("n_refs"), F.coalesce("named", empty).alias("named"), F.coalesce("missing", empty).alias("missing"),
        F.when(F.size("refs") == 0, alone).otherwise(F.coalesce("absent", empty)).alias("absent"))
    return out.withColumn("ok", (F.size("missing") == 0) & (F.size("absent") == 0))


def kind_of(question: Column, ok: Column, n_named: Column) -> Column:
    """What a question asks; false premises first, and cases before application before a section."""
    return (
        F.when(~ok, "unsupported").when(question.rlike(CASE_LAW), "case_law").when(question.rlike(APPLICATION), "application")
        .when((n_named > 0) | question.rlike(MENTION), "direct_section").otherwise("natural_language")
    )


def kind_weights(kind: Column) -> Column:
    """(statute weight, judgment weight) of a kind."""
    m = F.create_map(*[x for k, (a, b) in KINDS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("statute"), F.lit(b).alias("judgment")))])
    return m[kind]
