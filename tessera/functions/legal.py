"""Extraction and classification of legal texts as column expressions, in a syntax that other SQL engines share."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .places import let

# Citation formats.
CITATION_FORMATS = [
    r"\(\d{4}\)\s*\d+\s*SCC\s*\d+", r"AIR\s*\d{4}\s*[A-Z]+\s*\d+", r"\(\d{4}\)\s*\d+\s*SCR\s*\d+", r"\d{4}\s*CriLJ\s*\d+",
    r"\(\d{4}\)\s*\d+\s*SCALE\s*\d+", r"\d{4}\s*SCC\s*\(?\d*\)?\s*\d+", r"\[\d{4}\]\s*\d+\s*All\s*ER\s*\d+", r"\[\d{4}\]\s*\d+\s*AC\s*\d+",
    r"\[\d{4}\]\s*\d+\s*WLR\s*\d+", r"MANU/[A-Z]{2}/\d+/\d{4}", r"\d{4}\s*SCR\s*Supl\.?\s*\(?\d*\)?\s*\d+", r"\(\d{4}\)\s*\d+\s*ILR\s*\d+",
]

# Phrases by which a later decision treats an earlier one; the first status with a phrase wins.
TREATMENTS = {
    "overruled": ["overruled", "expressly overruled", "no longer good law", "stands overruled", "bad law"],
    "reversed": ["reversed", "set aside", "quashed and set aside", "order is set aside"],
    "distinguished": ["distinguished", "distinguishable", "is distinguished", "not applicable to the present case", "facts are different"],
    "per_incuriam": ["per incuriam", "decided without noticing", "failed to notice", "without reference to"],
    "followed": ["followed", "approved", "affirmed", "upheld", "relied upon", "consistent with", "in conformity with"],
}

# Phrases of statutory provisions.
PROVISIONS = [
    r"(?:[A-Z][a-zA-Z]+\s+){2,10}(?:Act|Code|Rules|Regulation)", r"Article\s+\d+[A-Za-z0-9()]*",
    r"Section\s+\d+[A-Za-z0-9()]*(?:\s+of\s+the\s+[A-Z][A-Za-z\s]+(?:Act|Code))?",
]
PARTIES = r"[A-Z][A-Za-z\.\s&\-()]{2,60}\s+v\.?\s+[A-Z][A-Za-z\.\s&\-()]{2,60}"

# Numbered paragraphs.
PARAGRAPHS = [r"¶\s*(\d+)", r"(?i)\bPara(?:graph)?\s+(\d+)\b", r"(?m)^\s*(\d+)\.\s", r"\[(\d+)\]"]

# Court cities.
CITIES = [
    "DELHI", "NEW DELHI", "MUMBAI", "BOMBAY", "KOLKATA", "CALCUTTA", "CHENNAI", "MADRAS", "BENGALURU", "BANGALORE", "HYDERABAD",
    "AHMEDABAD", "PUNE", "LUCKNOW", "ALLAHABAD", "PATNA", "JAIPUR", "CHANDIGARH", "KOCHI", "ERNAKULAM", "GUWAHATI", "BHOPAL", "INDORE",
    "NAGPUR", "CUTTACK", "RANCHI", "SHIMLA", "SRINAGAR", "JAMMU", "PANAJI", "GANDHINAGAR", "THIRUVANANTHAPURAM",
]

# Words of running text that a court's name never holds.
NOT_A_COURT = ["CONCEDED", "SUBMITTED", "ARGUED", "STATED", "HELD THAT", "OBSERVED"]
NOT_A_PARTY = r"(?i)^(?:and\s+(?:anr|ors|another|others)|anr|ors|another|others|etc)\b"

# What marks a holding, and what a remark in passing.
HOLDING = ["we hold", "it is held", "this court holds", "satisfied that", "ratio decidendi", "therefore held", "binding principle", "operative part"]
PASSING = ["however", "it may be noted", "observe", "in passing", "need not", "for completeness", "obiter", "assuming without deciding"]

# Statutes by name.
STATUTES = {
    "IPC": r"\b(?:indian\s+penal\s+code|I\.?P\.?C\.?|penal\s+code)\b", "BNS": r"\b(?:bharatiya\s+nyaya\s+sanhita|B\.?N\.?S\.?)\b",
    "CrPC": r"\b(?:code\s+of\s+criminal\s+procedure|Cr\.?\s?P\.?C\.?)\b", "BNSS": r"\b(?:bharatiya\s+nagarik\s+suraksha\s+sanhita|B\.?N\.?S\.?S\.?)\b",
    "Evidence": r"\b(?:indian\s+evidence\s+act|evidence\s+act|bharatiya\s+sakshya)\b", "NDPS": r"\bnarcotic\s+drugs|N\.?D\.?P\.?S\.?\b",
    "POCSO": r"\bPOCSO\b|protection\s+of\s+children\s+from\s+sexual\s+offences",
}
CORE_STATUTES = ["IPC", "BNS", "CrPC", "BNSS"]
CRIMINAL_TERMS = (
    r"\b(?:accused|conviction|convicted|acquittal|acquitted|sentence|sentenced|prosecution|bail|charge-?sheet|culpable|homicide|murder|offence|"
    r"criminal\s+appeal|FIR|investigating\s+officer|dying\s+declaration)\b"
)

# Topics of coverage.
TOPICS = {
    "murder": r"\b(?:section|s\.|u/s)\s*(?:299|300|302|304)\b|culpable homicide",
    "dowry_cruelty": r"\b304-?B\b|\b498-?A\b|dowry death",
    "attempt": r"\b(?:307|511)\b.{0,40}(?:IPC|penal)|attempt to (?:murder|commit)",
    "common_intention": r"\bsection\s*34\b|\b149\b.{0,30}(?:IPC|penal)|common intention|unlawful assembly",
    "conspiracy": r"\b120-?[AB]\b|criminal conspiracy",
    "abetment": r"\b(?:107|109|306)\b.{0,30}(?:IPC|penal)|abetment",
    "cheating": r"\b(?:415|417|420)\b.{0,30}(?:IPC|penal)|cheating",
    "breach_of_trust": r"\b(?:405|406|409)\b.{0,30}(?:IPC|penal)|criminal breach of trust",
    "theft_robbery": r"\b(?:378|379|380|392|395|397)\b.{0,30}(?:IPC|penal)|dacoity|\brobbery\b|\btheft\b",
    "sexual_offences": r"\b(?:354|375|376)\b.{0,30}(?:IPC|penal)|\brape\b|outraging.{0,20}modesty",
    "pocso": r"\bPOCSO\b|protection of children from sexual offences",
    "ndps": r"\bNDPS\b|narcotic drugs and psychotropic",
    "bail": r"\banticipatory bail\b|\b(?:437|438|439)\b.{0,30}(?:CrPC|Cr\.P\.C|code)|\bbail\b",
    "quashing": r"\b482\b.{0,30}(?:CrPC|Cr\.P\.C|code)|inherent (?:power|jurisdiction).{0,30}quash",
    "sentencing": r"rarest of rare|sentencing policy|mitigating circumstance|death sentence|life imprisonment",
    "dying_declaration": r"dying declaration",
    "confession_recovery": r"\bsection\s*27\b.{0,40}evidence|extra-?judicial confession|disclosure statement",
    "circumstantial": r"circumstantial evidence|chain of circumstances",
    "new_codes": r"bharatiya nyaya sanhita|bharatiya nagarik suraksha|bharatiya sakshya|\bBNS\b|\bBNSS\b",
    "juvenile": r"juvenile justice|\bJJ Act\b|child in conflict with law",
    "pmla": r"\bPMLA\b|prevention of money[- ]laundering",
    "uapa": r"\bUAPA\b|unlawful activities \(prevention\)|\bTADA\b|\bPOTA\b",
    "corruption": r"prevention of corruption act|\bPC Act\b",
    "arms": r"\barms act\b",
}

_dotted = lambda letters: ["".join(a + b for a, b in zip(letters, d)) + letters[-1] for d in product(("", "."), repeat=len(letters) - 1)]

#: Of each statute's and topic's pattern, lower-case strings of which any match holds one: a text without them is not searched.
NEEDS = {
    "IPC": ["penal", *_dotted("ipc")], "BNS": ["nyaya", *_dotted("bns")], "CrPC": ["procedure", "cr"], "BNSS": ["nagarik", *_dotted("bns")],
    "Evidence": ["evidence", "sakshya"], "NDPS": ["narcotic", *_dotted("ndps")], "POCSO": ["pocso", "protection"],
    "murder": ["299", "300", "302", "304", "homicide"], "dowry_cruelty": ["304", "498", "dowry"], "attempt": ["307", "511", "attempt"],
    "common_intention": ["34", "149", "common intention", "unlawful assembly"], "conspiracy": ["120", "conspiracy"], "abetment": ["107", "109", "306", "abetment"],
    "cheating": ["415", "417", "420", "cheating"], "breach_of_trust": ["405", "406", "409", "breach of trust"],
    "theft_robbery": ["378", "379", "380", "392", "395", "397", "dacoity", "robbery", "theft"], "sexual_offences": ["354", "375", "376", "rape", "outraging"],
    "pocso": ["pocso", "protection"], "ndps": ["ndps", "narcotic"], "bail": ["437", "438", "439", "bail"], "quashing": ["482", "inherent"],
    "sentencing": ["rarest of", "sentencing policy", "mitigating", "death sentence", "life imprisonment"], "dying_declaration": ["dying declaration"],
    "confession_recovery": ["27", "judicial confession", "disclosure"], "circumstantial": ["circumstan"], "new_codes": ["bharatiya", "bns"],
    "juvenile": ["juvenile", "jj act", "child in"], "pmla": ["pmla", "laundering"], "uapa": ["uapa", "unlawful activities", "tada", "pota"],
    "corruption": ["corruption", "pc act"], "arms": ["arms act"],
}

# Canonical names of citations, anchor concepts, plain-language glosses.
CANONICAL = {"air 1978 sc 597": "maneka_gandhi", "(1978) 1 scc 248": "maneka_gandhi", "(2017) 10 scc 1": "puttaswamy_2017", "air 2017 sc 4161": "puttaswamy_2017"}
CONCEPTS = {
    "Article 21": ["personal liberty", "right to life", "privacy", "due process"],
    "Basic Structure Doctrine": ["constitutional amendment", "kesavananda", "judicial review power", "secularism feature"],
    "Strict Liability": ["absolute liability", "hazardous substance", "m c mehta", "oleum gas leak"],
}
GLOSSES = {
    "audi alteram partem": "right to be heard fair hearing", "res judicata": "matter already decided finality",
    "ratio decidendi": "binding reason for decision core holding", "obiter dicta": "passing remarks not binding",
    "locus standi": "right to bring legal action standing before court", "mens rea": "criminal intent guilty mind",
    "actus reus": "criminal act physical element", "ultra vires": "beyond legal authority power",
    "habeas corpus": "unlawful detention body release", "mandamus": "compel public duty order", "suo motu": "own motion initiative",
    "ex parte": "one sided absent party", "prima facie": "first glance face value", "per incuriam": "bad law ignorance error",
}


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether lower-case text holds one of the phrases."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def citations(text: Column) -> Column:
    """Citations of all formats, upper case, blanks collapsed, distinct, sorted."""
    every = F.concat(*[found(text, p) for p in CITATION_FORMATS])
    return F.array_sort(F.array_distinct(F.transform(every, lambda c: F.upper(one_line(c)))))


def provisions(text: Column) -> Column:
    every = F.concat(*[found(text, p) for p in PROVISIONS])
    return F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda s: F.length(F.trim(s)) > 5), one_line)))


def case_names(text: Column) -> Column:
    """Names of parties either side of "v.", each side of six to 59 characters."""
    clean = F.transform(found(text, PARTIES), lambda m: F.regexp_replace(one_line(m), r"(?i)^(?:In|See|Re|Also|The)\s+", ""))
    sides = lambda m: F.filter(F.transform(F.split(m, r"(?i)\s+v\.?\s+"), lambda x: F.trim(x)), lambda s: s != "")
    ok = lambda m: (m.contains(" v.") | m.contains(" v ") | m.contains(" V.")) & F.forall(sides(m), lambda s: (F.length(s) > 5) & (F.length(s) < 60))
    return F.array_sort(F.array_distinct(F.filter(clean, ok)))


def paragraph_numbers(text: Column) -> Column:
    """Any run of digits can stand where a paragraph's number does, a card's too: exact up to 38 digits; of longer ones, which no type holds, a null at the end says that there are some."""
    every = F.concat(*[found(text, p, 1) for p in PARAGRAPHS])
    return F.array_sort(F.array_distinct(F.transform(every, lambda n: n.try_cast("decimal(38,0)"))))


def treatment(text: Column) -> Column:
    """The first status of which the text has a phrase, or null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(any_of(low, phrases), name) for name, phrases in TREATMENTS.items()])


def year_of(date: Column) -> Column:
    return F.coalesce(F.regexp_extract(date, r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int"), F.lit(0))


def court_ok(name: Column) -> Column:
    up = F.upper(name)
    n = F.length(name)
    return (n > 5) & (n < 100) & (up.contains("COURT") | up.contains("TRIBUNAL")) & ~name.rlike(r"\. [a-z]") & ~reduce(lambda a, b: a | b, [up.contains(w) for w in NOT_A_COURT])


def case_number_ok(value: Column) -> Column:
    return (F.length(value) > 3) & (F.length(value) < 80) & value.rlike(r"\d")


def date_ok(value: Column) -> Column:
    return (F.length(value) > 6) & (F.length(value) < 30) & value.rlike(r"\d")


def title_ok(value: Column) -> Column:
    first = F.trim(F.split(value, r"(?i)\s+(?:v\.?|vs\.?|VERSUS)\s+", 2)[0])
    return (F.length(value) > 5) & (F.length(value) < 200) & ~first.rlike(NOT_A_PARTY)


def court_city(text: Column) -> Column:
    """The recognised city with the longest name; of equal lengths the one listed first."""
    order = sorted(CITIES, key=len, reverse=True)
    # no city's name begins within another's and goes on after it, so one search finds all that matter
    named = found(F.upper(text), r"\b(?:" + "|".join(order) + r")\b")
    first = F.array_min(F.transform(named, lambda c: F.array_position(F.array(*map(F.lit, order)), c)))
    return let(first, lambda i: F.get(F.array(*map(F.lit, order)), i.cast("int") - 1))


def passage_kind(section: Column, text: Column) -> Column:
    """ratio, obiter, reasoning, order, facts or other, by a section's name and then its phrases."""
    up, low = F.upper(section), F.lower(text)
    reasoning = F.when(any_of(low, HOLDING), "ratio").when(any_of(low, PASSING), "obiter").otherwise("reasoning")
    return (
        F.when(up.isin("KEY_POINTS", "RATIO", "CONCLUSION"), "ratio").when(up == "REASONING", reasoning).when(up.isin("ORDER", "DECISION"), "order")
        .when(up.isin("FACTS", "BACKGROUND", "PREAMBLE"), "facts").otherwise("other")
    )


def pinpoint_page(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\((\d{4})\)\s*\d+\s*SCC\s*(\d+).*?p(?:age)?[\.:]?\s*(\d+)", 3), F.lit(""))


def _matching(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches in any case; null texts match none."""
    held = lambda low, name: reduce(lambda a, b: a | b, [low.contains(x) for x in NEEDS[name]])
    return F.array_compact(let(F.lower(text), lambda low: F.array(*[F.when(held(low, n) & text.rlike("(?i)" + p), n) for n, p in patterns.items()])))


def statutes_in(text: Column) -> Column:
    return _matching(text, STATUTES)


def criminal_score(text: Column, statutes: Column | None = None) -> Column:
    """Four for each core statute, two for each other, and a third of the criminal terms, of which 30 count; ``statutes``, if they are known."""
    weights = F.aggregate(statutes_in(text) if statutes is None else statutes, F.lit(0), lambda n, x: n + F.when(x.isin(CORE_STATUTES), 4).otherwise(2))
    return weights + F.floor(F.least(F.regexp_count(text, F.lit("(?i)" + CRIMINAL_TERMS)), F.lit(30)) / 3).cast("int")


def primary_law(statutes: Column) -> Column:
    return F.when(F.array_contains(statutes, "BNS"), "BNS").when(F.array_contains(statutes, "IPC"), "IPC").otherwise(F.coalesce(F.get(statutes, 0), F.lit("other")))


def topics_in(text: Column) -> Column:
    return _matching(text, TOPICS)


def canonical(cite: Column) -> Column:
    clean = F.lower(one_line(cite))
    names = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    return F.coalesce(names[clean], names[F.regexp_replace(clean, r"[().]", "")], clean)


def concepts_of(keywords: Column) -> Column:
    """Anchor concepts whose name equals a keyword, or of which a term holds a keyword or is held by one."""
    def near(low, terms, name):
        return F.exists(low, lambda k: (k == name.lower()) | reduce(lambda a, b: a | b, [k.contains(t) | F.lit(t).contains(k) for t in terms]))

    # keywords are worked out and lowered once, however many concepts ask
    low = F.array_distinct(F.transform(keywords, lambda k: F.lower(k)))
    return F.array_compact(let(low, lambda x: F.array(*[F.when(near(x, terms, name), name) for name, terms in CONCEPTS.items()])))


def with_glosses(text: Column) -> Column:
    """The text, with the glosses of the terms that it holds after it."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(low.contains(t), g) for t, g in GLOSSES.items()]))
    return F.when(F.size(hits) > 0, F.concat(text, F.lit("\n\n[Semantics: "), F.array_join(hits, ", "), F.lit("]"))).otherwise(text)


def marked_citations(answer: Column) -> Column:
    """Bracketed markers of an answer ("[IPC s.420]"), upper case, distinct, in order."""
    return F.array_distinct(F.transform(found(answer, r"(?i)\[((?:IPC|BNS)\s+s\.\s*\d{1,3}[A-Z]{0,2})\]", 1), lambda m: F.upper(one_line(m))))


def stable_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("::", *parts))


def section_key(number: Column) -> Column:
    """Order of section numbers: 304 < 304A < 304B < 305; others last."""
    ok = number.rlike(r"^\d+[A-Z]*$")
    return F.when(ok, F.struct(F.regexp_extract(number, r"^(\d+)", 1).try_cast("int").alias("n"), F.regexp_extract(number, r"^\d+([A-Z]*)$", 1).alias("suffix"))).otherwise(
        F.struct(F.lit(1_000_000).alias("n"), number.alias("suffix")))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Those of some terms that a text holds, in any case."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), F.lower(t)))
