"""Sections and shortened citations in texts, and how later decisions treat earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from ..functions.places import let, located
from .ranking import first_per_key

SECTION = r"(?i)section\s+(\d+[A-Z]?)"

# Section lists, how far a statute's name attributes one, sentence breaks, and the most attributed sections of a text.
SECTION_LISTS = r"\b(?:u/?s\.?|under\s+section|sections?|ss?\.)\s*(\d{1,3}[A-Z]{0,2}(?:\s*(?:,|and|&|/)\s*\d{1,3}[A-Z]{0,2})*)"
REACH = 120
BREAK = r"(?<!\bs)(?<!\bNo)(?<!\bv)[.;]\s+(?=[A-Z(\[])"
MOST = 40
NEAR = 60
NEAR_STATUTES = {"IPC": r"(?:indian\s+penal\s+code|I\.?P\.?C\.?|penal\s+code)", "BNS": r"(?:bharatiya\s+nyaya\s+sanhita|B\.?N\.?S\.?)"}
NEAR_SECTIONS = r"(?:u/?s|under\s+section|sections?|ss?\.)\s*(\d{1,3}[A-Z]{0,2})"
FULL_CITE = r"\(\d{4}\)\s*\d+\s*SCC\s*\d+|AIR\s*\d+\s*SC\s*\d+"
SHORT_CITE = r"\b(?:id\.|ibid\.|supra|ante)\b"
WINDOW = 5


def sections(text: Column) -> Column:
    """Section numbers in the order of the text."""
    return legal.found(text, SECTION, 1)


def treated(mentions: DataFrame, by: list[str], text: str, order: list) -> DataFrame:
    """(by, status, confidence) and the deciding row: the first row, in order, of which a phrase tells a treatment, else the first row as followed."""
    t = mentions.withColumn("_t", legal.treatment(F.col(text)))
    best = first_per_key(t, by, [F.col("_t").isNull(), *order])
    return best.withColumns({"status": F.coalesce("_t", F.lit("followed")), "confidence": F.when(F.col("_t").isNull(), 0.60).otherwise(0.95)}).drop("_t")


def attributed_sections(text: Column) -> Column:
    """(qualified "IPC 302", unqualified numbers) of a text, in its order, once each, at most ``MOST`` qualified.

    A number belongs to the nearest name of a statute within ``REACH`` characters, before or after, that no sentence break parts from it;
    of two equally near the earlier one.
    """
    def places(name: str, pattern: str) -> Column:
        return F.transform(located(text, f"(?i){pattern}"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(name).alias("name")))

    named = F.concat(*[places(n, p) for n, p in legal.STATUTES.items()])

    def owned(t, names, m):
        far = lambda n: F.greatest(m["start"] - n["end"], n["start"] - m["end"], F.lit(0))
        begin = lambda n: F.least(n["end"], m["end"])
        between = lambda n: F.substr(t, begin(n) + 1, F.greatest(n["start"], m["start"]) - begin(n))
        near = F.filter(names, lambda n: (far(n) <= REACH) & ~between(n).rlike(BREAK))
        statute = F.array_min(F.transform(near, lambda n: F.struct(far(n).alias("far"), n["start"].alias("start"), n["name"].alias("name"))))["name"]
        numbers = F.split(m["g1"], r"(?i)\s*(?:,|and|&|/)\s*")
        return let(statute, lambda s: F.transform(numbers, lambda x: F.struct(s.alias("statute"), F.upper(F.trim(x)).alias("number"))))

    whole = F.struct(text.alias("t"), named.alias("names"), located(text, f"(?i){SECTION_LISTS}", 1).alias("lists"))
    rows = let(whole, lambda w: F.flatten(F.transform(w["lists"], lambda m: owned(w["t"], w["names"], m))))

    def parted(r):
        known = F.transform(F.filter(r, lambda x: x["statute"].isNotNull()), lambda x: F.concat_ws(" ", x["statute"], x["number"]))
        alone = F.transform(F.filter(r, lambda x: x["statute"].isNull()), lambda x: x["number"])
        return F.struct(F.slice(F.array_distinct(known), 1, MOST).alias("qualified"), F.array_distinct(alone).alias("unqualified"))

    return let(rows, parted)


def sections_by_proximity(text: Column) -> Column:
    """Sorted "IPC:302" of sections with a statute's name within ``NEAR`` characters on either side."""
    def one(t, m):
        begin = F.greatest(m["start"] - NEAR, F.lit(0))
        return let(F.substr(t, begin + 1, m["end"] + NEAR - begin), lambda around: F.array_compact(F.array(*[
            F.when(around.rlike(f"(?i){p}"), F.concat(F.lit(f"{n}:"), F.upper(m["g1"]))) for n, p in NEAR_STATUTES.items()])))

    whole = F.struct(text.alias("t"), located(text, f"(?i){NEAR_SECTIONS}", 1).alias("found"))
    return let(whole, lambda w: F.array_sort(F.array_distinct(F.flatten(F.transform(w["found"], lambda m: one(w["t"], m))))))


def cross_references(judgments: DataFrame, sections: DataFrame, keep: list[str], text: str, statute: str = "document", number: str = "section") -> DataFrame:
    """(statute, section, keep): the judgments that name an existing section near its statute; ``sections`` (statute, number) may repeat."""
    known = sections.select(F.col(statute).alias("statute"), F.upper(number).alias("section")).distinct()
    named = judgments.select(*keep, F.explode(sections_by_proximity(F.col(text))).alias("_s"))
    named = named.select(F.substring_index("_s", ":", 1).alias("statute"), F.substring_index("_s", ":", -1).alias("section"), *keep)
    return named.join(known, ["statute", "section"])


def resolve_short(label: Column, recent: Column, paragraph: Column) -> Column:
    """What a short form stands for, from the last full citations of the document and of the paragraph, oldest first."""
    last = lambda c, n: F.try_element_at(c, F.lit(n))
    return (
        F.when(label == "ibid", F.coalesce(last(paragraph, -1), last(recent, -1))).when(label == "id", last(recent, -1))
        .when(label == "supra", F.coalesce(last(recent, -2), last(recent, -1))).when(label == "ante", last(recent, 1))
    )


def resolve_chunks(chunks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, label, resolved) of each short form: the citations of the WINDOW latest full ones at or before it, in its chunk or earlier ones.

    Chunks of one paragraph each; of a chunk, full citations come before its short forms.
    """
    norm = lambda c: legal.canonical(c)
    c = chunks.select(doc, order, F.transform(legal.found(F.col(text), "(?i)" + FULL_CITE), norm).alias("own"), legal.found(F.col(text), "(?i)" + SHORT_CITE).alias("short"))
    # of the chunks before, those with citations matter, and WINDOW of them at most
    cites = c.select(doc, order, F.posexplode("own").alias("pos", "cite"))
    w = Window.partitionBy(doc).orderBy(order, "pos")
    last = cites.withColumn("recent", F.collect_list("cite").over(w.rowsBetween(-WINDOW + 1, 0)))
    last = last.groupBy(doc, order).agg(F.max_by("recent", "pos").alias("recent"))
    j = c.join(last, [doc, order], "left").withColumn("recent", F.last("recent", ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    s = j.select(doc, order, "own", F.coalesce("recent", F.array().cast("array<string>")).alias("recent"), F.explode("short").alias("label"))
    out = resolve_short(F.lower(F.regexp_replace("label", r"\.", "")), F.col("recent"), F.col("own"))
    return s.select(doc, order, "label", out.alias("resolved")).where("resolved is not null").distinct()


#: Characters from the start of a case's name to a citation that is still of it.
NAME_REACH = 200
# Short forms, in order.
SHORT_FORMS = {"ibid": r"\bibid\.?\b", "id": r"\bid\.?\b", "supra": r"\bsupra\b"}
def linked(text: Column, name: Column) -> Column:
    """Array of (citation, case_name, resolved_from): each citation with the case named last before it, within NAME_REACH, else with the case linked before.

    Citations are taken format by format; a citation stands once with a case, and only one that is new moves the case on. Short forms belong to the case linked last.
    """
    line = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cites = F.concat(*[located(text, p) for p in legal.CITATION_FORMATS])
    shorts = F.concat(*[_shorts(text, n, p) for n, p in SHORT_FORMS.items()])
    kind = "array<struct<key: string, citation: string, case_name: string, resolved_from: string>>"
    key = lambda case, cite: F.concat(F.coalesce(case, F.lit("")), F.lit("\x01"), F.upper(cite))
    row = lambda case, cite, label: F.struct(key(case, cite).alias("key"), F.upper(cite).alias("citation"), case.alias("case_name"), label.alias("resolved_from"))
    has = lambda out, k: F.exists(out, lambda x: x["key"] == k)

    def add(state, case, cite, label):
        keep = F.struct(state["name"].alias("name"), state["out"].alias("out"))
        new = F.struct(F.coalesce(case, state["name"]).alias("name"), F.concat(state["out"], F.array(row(case, cite, label))).alias("out"))
        return F.when(has(state["out"], key(case, cite)), keep).otherwise(new)

    def link(parties, state, m):
        near = F.try_element_at(F.filter(parties, lambda p: p["start"] <= m["start"]), F.lit(-1))
        case = F.when((m["start"] - near["start"]) < NAME_REACH, line(near["text"])).otherwise(state["name"])
        return let(case, lambda c: add(state, c, line(m["text"]), F.lit(None).cast("string")))

    begin = lambda n: F.struct(n.alias("name"), F.array().cast(kind).alias("out"))

    def run(w):
        after = F.aggregate(w["cites"], begin(w["name"]), lambda state, m: link(w["parties"], state, m))
        short = lambda state, m: F.when(state["name"].isNull(), state).otherwise(add(state, state["name"], m["text"], m["label"]))
        return F.aggregate(w["shorts"], after, short, lambda state: F.transform(state["out"], lambda x: F.struct(x["citation"].alias("citation"), x["case_name"].alias("case_name"), x["resolved_from"].alias("resolved_from"))))

    whole = F.struct(cites.alias("cites"), located(text, legal.PARTIES).alias("parties"), shorts.alias("shorts"), name.alias("name"))
    return let(whole, run)


def _shorts(text: Column, label: str, pattern: str) -> Column:
    return F.transform(legal.found(text, f"(?i){pattern}"), lambda m: F.struct(m.alias("text"), F.lit(label).alias("label")))


def case_citations(pages: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, citation, case_name, resolved_from) of every page; a page goes on with the case that the pages before name last."""
    line = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    last = line(F.try_element_at(legal.found(F.col(text), legal.PARTIES), F.lit(-1)))
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    p = pages.select(doc, order, F.col(text).alias("_text"), last.alias("_own")).withColumn("_before", F.last("_own", ignorenulls=True).over(w))
    return p.select(doc, order, F.inline(linked(F.coalesce("_text", F.lit("")), F.nullif(F.col("_before"), F.lit("")))))
