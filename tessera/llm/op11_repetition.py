"""Quality rules by repetition coverage.

A task lays the words of a slice of whole texts in one line, names them by numbers, and rolls a 64-bit hash over windows of
each length in numpy: the hash of n words is that of n - 1 words times a constant plus the next word. A sort shows the hashes that
come twice; windows of equal hashes are then compared word by word, so a collision never counts. Only starts whose window
and whose next window are repeated can start a longer repeated one, so prose costs one sort and junk a few small ones. What
the repeated windows cover follows from running sums; repeated lines are found by their content. Nothing is shuffled.

The verdict: a text goes if it fails the base rule (under ten words, or over a fifth of its words in repeated windows of five, first
copies included), if windows of n words equal to an earlier one cover more than ``NGRAM_LIMITS[n]`` percent of its word characters, if
lines equal to an earlier one are over 30 percent of its lines or hold over 20 percent of its word characters, or if it has more
than one symbol of ``SYMBOLS`` to ten words. These are the limits of the published repetition rules for web text.

Defined cases: a null text counts as empty and fails the base rule, as any text without words; very long texts are measured whole;
windows never cross texts; lines are compared with their blanks, and lines without a word take no part; repeated rows give repeated rows;
a null id stays null; other columns are ignored by ``measure`` and kept by ``keep_good``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, prepare, table

#: Words of a window: percent of the word characters that its repeated windows may cover.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINES_LIMIT, LINE_CHARS_LIMIT = 30, 20
SYMBOLS_LIMIT = 10
LEAST_WORDS, BASE_LIMIT, BASE_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Bytes that are measured together; a longer text is a slice of its own.
SLICE = 2 << 20
ROLL = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_LIMITS))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of an array between neighbouring bounds."""
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[bounds[1:]] - run[bounds[:-1]]


def _repeated(at: np.ndarray, h: np.ndarray, n: int, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the starts ``at`` begin a window of n words that another of them begins in the same text, and which of these are not the first; ``h`` are their hashes."""
    none = at[:0], at[:0]
    if len(at) < 2:
        return none
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return none
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    at, h = at[hit], h[hit]
    by = np.argsort(h, kind="stable")
    at, h = at[by], h[by]
    near = h[1:] == h[:-1]
    same = near & (doc[at[1:]] == doc[at[:-1]])
    for k in range(n):
        same &= ids[at[1:] + k] == ids[at[:-1] + k]
    if (same != near).any():  # two windows share a hash: compare whole windows
        at = np.sort(at)
        rows = np.stack([doc[at], *(ids[at + k] for k in range(n))], axis=1)
        _, first, which, count = np.unique(rows, axis=0, return_index=True, return_inverse=True, return_counts=True)
        which = which.ravel()
        return at[count[which] > 1], at[first[which] != np.arange(len(at))]
    later = np.concatenate(([False], same))
    return np.sort(at[later | np.concatenate((same, [False]))]), np.sort(at[later])


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words that starts at one of ``at``."""
    flags = np.zeros(size + 1, dtype=np.int64)
    flags[at] = 1
    flags[at + n] -= 1
    return np.cumsum(flags[:-1]) > 0


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text, as arrays of longs."""
    n_docs = len(texts)
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)  # a blank after each text
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    at_byte = np.concatenate(([0], np.cumsum(sizes)))
    inside = ~_SPACE[raw]
    letter = inside & ((raw & 0xC0) != 0x80)  # first bytes of code points in words
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    run = np.concatenate(([0], np.cumsum(letter)))
    chars = run[ends] - run[starts]
    at_word = np.searchsorted(starts, at_byte)
    doc = np.repeat(np.arange(n_docs), np.diff(at_word))
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t.split()], dtype=np.int64)
    out = {"n_words": np.diff(at_word), "word_chars": _sums(letter, at_byte), "n_symbols": _sums(_SYMBOL[raw], at_byte)}

    dup_lines, dup_chars, n_lines = (np.zeros(n_docs, dtype=np.int64) for _ in range(3))
    for d, t in enumerate(texts):
        seen = set()
        for line in t.split(b"\n"):
            if line.strip():
                n_lines[d] += 1
                if line in seen:
                    dup_lines[d] += 1
                    dup_chars[d] += len(b"".join(line.split()).decode("utf-8"))
                seen.add(line)
    out |= {"n_dup_lines": dup_lines, "n_lines": n_lines, "dup_line_chars": dup_chars}

    word = mix64(ids + 1)
    h, have = word.copy(), 1
    at = np.arange(len(ids))
    for n in sorted(NGRAM_LIMITS):
        for k in range(have, n):
            h[: len(h) - k] = h[: len(h) - k] * ROLL + word[k:]
        at = at[at + n <= len(ids)]
        at = at[doc[at] == doc[at + n - 1]]
        at, later = _repeated(at, h[at] ^ mix64(doc[at] + 1), n, ids, doc)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = _sums(_covered(at, n, len(ids)), at_word)
        out[f"dup_chars_{n}"] = _sums(np.where(_covered(later, n, len(ids)), chars, 0), at_word)
        at = at[np.isin(at + 1, at)]  # the starts that a longer repeated window can have
        have = n
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts; whole-number comparisons, so no rounding decides."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_LIMIT * m["n_words"])
    bad = (100 * m["n_dup_lines"] > LINES_LIMIT * m["n_lines"]) | (100 * m["dup_line_chars"] > LINE_CHARS_LIMIT * m["word_chars"])
    bad |= 100 * m["n_symbols"] > SYMBOLS_LIMIT * m["n_words"]
    for n, limit in NGRAM_LIMITS.items():
        bad |= 100 * m[f"dup_chars_{n}"] > limit * m["word_chars"]
    return failed, ~failed & ~bad


def _slices(batch, index: int):
    """Parts of a batch of about SLICE bytes, with their texts as bytes (null: empty)."""
    start, size, texts = 0, 0, []
    for i, x in enumerate(batch.column(index).cast(pa.large_binary())):
        texts.append(x.as_py() or b"")
        size += len(texts[-1])
        if size >= SLICE or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, kept, and the counts behind the verdict."""
    prepare(df.sparkSession)
    names = ["doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:]]

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, 1):
                m = measures(texts)
                failed, kept = verdicts(m)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(m[c]) for c in COUNTS[:5]), pa.array(failed), pa.array(kept), *(pa.array(m[c]) for c in COUNTS[5:])], names)

    kinds = {"base_failed": "boolean", "kept": "boolean"}
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text passes, with all their columns."""
    prepare(df.sparkSession)
    index = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, index):
                yield part.filter(pa.array(verdicts(measures(texts))[1]))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same counts by relations: words with their places, windows joined to text, groups of equal windows, covered places."""
    wins = " UNION ALL ".join(
        f"SELECT rid, {n} AS n, i, list_aggregate(ws[i:i + {n - 1}], 'string_agg', ' ') AS g FROM places WHERE i + {n - 1} <= n_words" for n in NGRAM_LIMITS)
    dup = ", ".join(f"coalesce(sum(c.chars) FILTER (c.n = {n} AND later), 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_LIMITS)
    zero = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in NGRAM_LIMITS)
    bad = " OR ".join(f"100 * dup_chars_{n} > {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
base AS (SELECT rid, doc_id, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
lines AS (SELECT rid, line, count(*) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
by_line AS (SELECT rid, sum(k)::BIGINT AS n_lines, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * chars)::BIGINT AS dup_line_chars FROM lines GROUP BY rid),
places AS (SELECT rid, ws, n_words, unnest(range(1, n_words + 1)) AS i FROM base),
wins AS ({wins}),
again AS (SELECT * FROM (SELECT rid, n, i, count(*) OVER (PARTITION BY rid, n, g) AS k, min(i) OVER (PARTITION BY rid, n, g) < i AS later FROM wins) WHERE k > 1),
cover AS (SELECT rid, n, j, bool_or(later) AS later FROM (SELECT rid, n, later, unnest(range(i, i + n)) AS j FROM again) GROUP BY rid, n, j),
c AS (SELECT cover.*, length(ws[j]) AS chars FROM cover JOIN base USING (rid)),
by_window AS (SELECT rid, count(*) FILTER (c.n = {BASE_WINDOW}) AS n_repeat_words, {dup} FROM c GROUP BY rid),
m AS (SELECT base.* EXCLUDE (ws), coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(dup_line_chars, 0) AS dup_line_chars, {zero} FROM base LEFT JOIN by_line USING (rid) LEFT JOIN by_window USING (rid)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed FROM m)
SELECT * EXCLUDE (rid), NOT base_failed AND NOT (100 * n_dup_lines > {LINES_LIMIT} * n_lines OR 100 * dup_line_chars > {LINE_CHARS_LIMIT} * word_chars OR 100 * n_symbols > {SYMBOLS_LIMIT} * n_words OR {bad}) AS kept FROM f
"""


ORACLE = _oracle()
