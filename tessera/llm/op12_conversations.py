"""Conversation structure repair by cost layers.

The roles of a sound conversation spell ``(s?(ua)+)?``, four states of a grammar. For each turn, from the last to the first, the states that can
still be finished at a cost of at most d are a set of bits, one set for each cost layer d. Keeping, re-roling, deleting and inserting
move a turn's layers to the one before by shifts and masks, as in approximate matching with bitsets. A state can be turned into any other by
few edits, so eight layers above the cheapest tell all states apart: a turn's layers are one 32-bit word and a rising base.
The first layer that holds the start gives the cost; following the bits from the start, the least letter that stays within the cost gives the
audit. A letter has one effect in a state, so the audit names the repair.

What moves: rows without their texts (a hash stands for the text), summed by content before anything else; their order by ranges, so that a long conversation is
dealt over tasks, which return one byte a row; then each text once, to the task that writes its conversation. A conversation's own audit and its hash over all its texts, both asked for as one
value, are the only things that one task goes through: the audit's bytes in memory, the texts as a stream.

Defined cases: null ids form one conversation; null roles and texts count as one space; rows of one turn stand by role, then by the SHA-256 of their text; equal
rows of a turn stand together, and all but the first are duplicates; a role's initial is its first character, an empty role has none and fits no place;
a conversation without rows gives zeros, an empty audit and the hash of nothing; very long texts are hashed whole as a stream of rows; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_text, materialize, prepare, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LAYERS = 8
#: One bit of each layer, twice as many layers as a word has.
ONES = int("1" * 2 * LAYERS, 16)
WORD = (1 << 4 * LAYERS) - 1
#: A row's code: its place in ROLES (3: another role), plus 4 if truncated; GONE if it must be deleted.
ROLES = "sua"
GONE = 8
#: Rows of a conversation in one value of codes.
PIECE = 1 << 20
#: A state's successor by role: 0 start, 1 after s, 2 after u, 3 after a.
STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: What an inserted or re-roled row becomes in a state.
NEXT = [1, 1, 2, 1]
NAMES = ["", "user", "assistant"]
BLANKS = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


# --- layers ---------------------------------------------------------------------

def _before(layers: int, role: int) -> int:
    """Layers of the states whose step by a role leads into ``layers``."""
    out = 0
    for (state, r), then in STEP.items():
        if r == role:
            out |= (layers >> then & ONES) << state
    return out


def _closed(layers: int) -> int:
    """With inserted rows: at most two lead from any state to any other that rows follow."""
    for _ in range(2):
        layers |= (_before(layers, 1) | _before(layers, 2)) << 4 * INSERT
    return layers


@lru_cache(maxsize=1 << 16)
def earlier(word: int, code: int) -> tuple[int, int]:
    """The layers before a row with a code, and how much the base rises."""
    after = word | (ONES * 15 & ~WORD)  # every state is finished within the layers above
    layers = after << 4 * DELETE
    if code != GONE:
        more = TRUNCATED if code & 4 else 0
        layers |= _before(after, code & 3) << 4 * (KEEP + more)
        layers |= (_before(after, 1) | _before(after, 2)) << 4 * (REROLE + more)
    return _based(_closed(layers))


def _based(layers: int) -> tuple[int, int]:
    rise = 0
    while not layers & 15:
        layers >>= 4
        rise += 1
    return layers & WORD, rise


def solve(pieces: list[bytes]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its rows' codes, in pieces; memory is the codes and audit, and the layers of one piece."""
    last, base = _based(_closed(ONES * 0b1001))
    words = [(last, base)]  # after each piece, from the last
    for codes in reversed(pieces):
        word, total = words[-1]
        for c in reversed(codes):
            word, rise = earlier(word, c)
            total += rise
        words.append((word, total))
    words.reverse()

    def within(word: int, total: int, state: int, cost: int) -> bool:
        d = cost - total
        return d >= LAYERS or d >= 0 and bool(word >> 4 * d + state & 1)

    left = next(d for d in range(words[0][1], words[0][1] + LAYERS) if within(*words[0], 0, d))
    cost, state, audit = left, 0, []
    for piece, end in zip(pieces, words[1:]):
        here = [end]
        for c in reversed(piece):
            word, rise = earlier(here[-1][0], c)
            here.append((word, here[-1][1] + rise))
        here.reverse()
        out = []
        for at, code in enumerate(piece):
            while True:
                if within(*here[at + 1], state, left - DELETE):
                    out.append("D")
                    left -= DELETE
                    break
                then = STEP[state, NEXT[state]]
                if within(*here[at], then, left - INSERT):
                    out.append("I")
                    left, state = left - INSERT, then
                    continue
                more = TRUNCATED if code & 4 else 0
                kept = STEP.get((state, code & 3))
                if kept is not None and within(*here[at + 1], kept, left - KEEP - more):
                    out.append("K")
                    left, state = left - KEEP - more, kept
                else:
                    out.append("R")
                    left, state = left - REROLE - more, then
                break
        audit.append("".join(out))
    while left:
        audit.append("I")
        left, state = left - INSERT, STEP[state, NEXT[state]]
    return cost, "".join(audit)


# --- rows -----------------------------------------------------------------------

def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by their conversation and turn; copies is 0 where a row is dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = crc32_text(key) % 20
    text = F.coalesce("text", F.lit(" "))
    return df.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def undamaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows as they are."""
    return df.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with what they are ordered by: whether they have a turn, the turn, the role, the text's hash."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"), "role",
        F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest"), "text", F.col("copies").cast("long").alias("copies"))


ORDER = ["conv_id", "has", "turn", "role", "digest"]


def _codes(rows: DataFrame) -> DataFrame:
    """(ORDER, copies, code of the first copy, fault of the first copy) of the rows' contents; a conversation's dropped rows are one row of no copies."""
    trimmed = F.expr(f"trim(TRAILING {BLANKS} FROM text)")
    there = F.col("copies") > 0
    light = rows.select(
        "conv_id", *(F.when(there, F.col(c)).alias(c) for c in ORDER[1:]), "copies",
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    light = light.groupBy(*ORDER).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    light = materialize(light, "turns")
    first = light.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("has", "turn")).alias("first"))
    seen = light.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("role").eqNullSafe(F.col("r")) & F.col("digest").eqNullSafe(F.col("d")))
    again = F.struct("has", "turn") > F.col("first")
    place = F.expr(f"locate(left(role, 1), '{ROLES}')")
    initial = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    return seen.select(
        *ORDER, "copies", F.left("role", F.lit(1)).alias("initial"),
        F.when(F.col("blank") | again, GONE).when(F.col("cut"), initial + 4).otherwise(initial).cast("int").alias("code"),
        F.when(F.col("blank"), "b").when(again, "d").when(F.col("cut"), "t").otherwise("").alias("fault"))


PIECES = "conv_id long, has boolean, turn long, role string, digest binary, codes binary, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


class _Piece:
    """Neighbouring rows of one conversation."""

    def __init__(self, at):
        self.at, self.codes = at, bytearray()
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, row, copies: int, first_copy: bool) -> None:
        """Some copies of a row's content; they are blank like the first or else duplicates."""
        _, has, turn, _, _, _, initial, code, fault = row
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL)
        if has:
            self.turns += self.high is None or turn > self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        own = 1 if first_copy else 0
        self.codes += bytes([code]) * own + bytes([GONE]) * (copies - own)
        if fault and own:
            self.counts[fault] += 1
        self.counts["b" if fault == "b" else "d"] += copies - own

    def row(self):
        return (*self.at, bytes(self.codes), *self.counts.values(), self.illegal, self.turns, self.low, self.high, self.first, self.last)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def _read(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _in_batches(rows, schema: str, weight):
    """Batches of about a MiB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r)
        if size > 1 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def _pieces(batches):
    """Ordered rows to the pieces of their conversations."""
    def made():
        piece = None
        for row in _read(batches):
            left, own = row[5], True
            if piece is None or piece.at[0] != row[0]:
                if piece is not None:
                    yield piece.row()
                piece = _Piece(row[:5])
            while left:
                if len(piece.codes) >= PIECE:
                    yield piece.row()
                    piece = _Piece(row[:5])
                some = min(left, PIECE - len(piece.codes))
                piece.add(row, some, own)
                left, own = left - some, False
        if piece is not None:
            yield piece.row()

    return _in_batches(made(), PIECES, lambda r: 200 + len(r[5]))


def _summaries(batches):
    """Ordered pieces to conversations."""
    def close(conv, codes, totals, turns, low, high):
        cost, audit = solve(codes)
        return conv, high - low + 1 - turns if turns else 0, *totals, cost, audit

    def made():
        conv = None
        for c, _, _, _, _, codes, *totals, turns, low, high, first, last in _read(batches):
            if conv is None or conv[0] != c:
                if conv is not None:
                    yield close(*conv)
                conv, before = [c, [], [0, 0, 0, 0], 0, None, None], None
            if not codes:
                continue
            conv[1].append(codes)
            conv[2] = [a + b for a, b in zip(conv[2], totals)]
            conv[2][3] += before is not None and before + first not in LEGAL
            before = last
            if turns:
                conv[3] += turns - (conv[5] == low)  # a turn may go on in the next piece
                conv[4], conv[5] = low if conv[4] is None else conv[4], high
        if conv is not None:
            yield close(*conv)

    return _in_batches(made(), SUMMARY, lambda r: 100 + len(r[-1]))


def plan(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of (conv_id, turn, role, text, copies) rows."""
    prepare(rows.sparkSession)
    codes = materialize(_codes(_ordered(rows)), "codes")
    # a conversation without rows comes first of its range, as its other columns are null
    pieces = codes.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_pieces, PIECES)
    return pieces.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_summaries, SUMMARY)


def _edits(batches):
    """(conv_id, role, text, edit) of the rows that remain, conversation by conversation; (conv_id, None, None, audit) opens each."""
    def ahead():
        nonlocal state
        while letters and letters[-1] == "I":
            letters.pop()
            role = NEXT[state]
            state = STEP[state, role]
            yield conv, NAMES[role], "", "I"

    conv, letters, state = None, [], 0
    for c, head, _, _, role, _, text, copies in _read(batches):
        if head:
            yield from ahead()
            conv, letters, state = c, list(reversed(text)), 0
            yield conv, None, None, text
            continue
        for _ in range(copies):
            yield from ahead()
            edit = letters.pop()
            if edit == "D":
                continue
            kind = ROLES.index(role[0]) if edit == "K" else NEXT[state]
            state = STEP[state, kind]
            yield conv, role if edit == "K" else NAMES[kind], text, edit
    yield from ahead()


def _streamed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, in one partition."""
    ordered = _ordered(rows).where("copies > 0").select("conv_id", F.lit(False).alias("head"), *ORDER[1:], "text", "copies")
    heads = plans.select("conv_id", F.lit(True), F.lit(False), F.lit(0).cast("long"), F.lit(""), F.lit(b""), "audit", F.lit(1).cast("long"))
    return ordered.unionAll(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *ORDER[1:])


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the rows of each repaired conversation in order; edit is K, R or I."""
    prepare(rows.sparkSession)
    schema = "conv_id long, position long, role string, text string, edit string"

    def run(batches):
        def made():
            at = 0
            for conv, role, text, edit in _edits(batches):
                at = 0 if role is None else at + 1
                if role is not None:
                    yield conv, at, role, text, edit

        return _in_batches(made(), schema, lambda r: 100 + len(r[3]))

    return _streamed(rows, plans).mapInArrow(run, schema)


def hashed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of each conversation's repaired ``role:text`` lines."""
    prepare(rows.sparkSession)
    schema = "conv_id long, repaired_sha256 string"

    def run(batches):
        def made():
            conv = digest = None
            for c, role, text, _ in _edits(batches):
                if role is None:
                    if digest:
                        yield conv, digest.hexdigest()
                    conv, digest, lines = c, hashlib.sha256(), 0
                else:
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
            if digest:
                yield conv, digest.hexdigest()

        return _in_batches(made(), schema, lambda r: 200)

    return _streamed(rows, plans).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its plan, and the hash of its repaired rows."""
    plans = materialize(plan(rows), "plans")
    hashes = hashed(rows, plans).withColumnRenamed("conv_id", "c")
    return plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damage(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    """The same by least (cost, audit, lines) of each state and turn, from the last turn to the first."""
    none = "{'c': 1000000000, 'a': '', 't': ''}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def step(cost, letter: str, line: str, then: str, only: str = "true") -> str:
        return f"CASE WHEN {only} THEN {{'c': {then}.c + {cost}, 'a': '{letter}' || {then}.a, 't': {line} || {then}.t}} ELSE {none} END"

    def insert(state: int, then: str) -> str:
        return step(INSERT, "I", f"'{NAMES[NEXT[state]]}:' || chr(10)", then)

    rows = []
    for state in range(4):
        then, name = f"s{STEP[state, NEXT[state]]}", NAMES[NEXT[state]]
        ways = [step(DELETE, "D", "''", f"s{state}"), step("2 + cut", "R", f"'{name}:' || text || chr(10)", then, "NOT gone")]
        ways += [step("cut", "K", "role || ':' || text || chr(10)", f"s{to}", f"NOT gone AND role[1] = '{ROLES[r]}'") for (s, r), to in STEP.items() if s == state]
        rows.append(f"{least(*ways)} AS p{state}")
    closed = [f"{least('p0', insert(0, 'q2'))} AS q0", f"{least('p1', insert(1, 'q2'))} AS q1", "q2", "q3"]
    two = [f"{least('p2', insert(2, 'p3'))} AS q2", f"{least('p3', insert(3, 'p2'))} AS q3"]
    start = "{'c': 0, 'a': '', 't': ''}"
    return rf"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), i) ORDER BY i) AS crcs FROM range(256) r(i)),
named AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS cid, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda x, b: xor(x >> 8, crcs[xor(x, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS kind FROM named, bits),
copies AS (SELECT cid, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
o AS MATERIALIZED (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY cid) AS n, role[1] AS initial, lag(role[1]) OVER w AS before
    FROM copies WINDOW w AS (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS MATERIALIZED (SELECT *, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-
]*$') AS truncated
    FROM (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again FROM o)),
g AS MATERIALIZED (SELECT cid, i, role, text, blank OR again AS gone, truncated::INT AS cut FROM f),
walk AS (
    SELECT cid, count(*)::BIGINT AS i, q0, q1, q2, q3 FROM f, (SELECT {start} AS q0, {insert(1, 'q2')} AS q1, q2, q3 FROM (SELECT {insert(2, 'q3')} AS q2, q3 FROM (SELECT {start} AS q3)))
    GROUP BY ALL
    UNION ALL
    SELECT cid, i - 1, {', '.join(closed)} FROM (SELECT cid, i, p0, p1, {', '.join(two)} FROM (SELECT cid, i, {', '.join(rows)}
        FROM (SELECT walk.cid, walk.i, q0 AS s0, q1 AS s1, q2 AS s2, q3 AS s3, role, text, gone, cut FROM walk JOIN g ON g.cid = walk.cid AND g.i = walk.i)))),
done AS (SELECT cid, q0 FROM walk WHERE i = 0),
counts AS (SELECT cid, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.a, '') AS audit, sha256(coalesce(q0.t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM named) LEFT JOIN counts USING (cid) LEFT JOIN done USING (cid)
"""


ORACLE = _oracle()
