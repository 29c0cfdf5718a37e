"""Fuzzy line dedup by MinHash.

Lines are compared in lower case with runs of white space as one blank; their elements are runs of eight characters (a shorter line
is one element). MinHash gives a signature (one permutation for long lines), bands of it
propose candidates, exact Jaccard of the runs (0.8 or more) verifies them, and distributed union-find keeps one line of each
component: the first by doc_id and place. Equal lines are one node from the start. Buckets are linked through
representatives (see ``buckets``).

Defined cases: blank lines are kept and never compared; a null text counts as empty and stays null; a document keeps its place
even if all its lines go (its text is then empty); the line break before a removed line goes with it; equal doc_ids are told
apart by their text, and a repeated row keeps the same lines as its twin; documents without an id take no part and stay; an empty table gives no
rows; other columns are ignored by ``marks`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import Overlap, link, members
from .common import Bitset, bitset, fresh, materialize, mix64, prepare, salted_join, table
from .op6_minhash import band_keys, spark_xxhash64

RUN = 8
THRESHOLD = 0.8
REGISTERS = 48
ROWS = 4
#: Elements up to which a line has a hash for each register.
FEW = 128
#: Characters whose runs are hashed together: bounds the arrays of a step.
STEP_CHARS = 1 << 17
#: The bit of a key that marks a line's first bucket.
FIRST = 1
U = np.uint64
EMPTY = U(2**64 - 1)


def comparison(line: str) -> str:
    # of the printable characters only the blank is white space
    if line.isprintable() and "  " not in line and line[:1] != " " != line[-1:]:
        return line.lower()
    return " ".join(line.lower().split())


def line_id(line: str) -> int:
    """64-bit name of a comparison form."""
    return xxhash.xxh3_64_intdigest(line) - 2**63


def run_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(element hashes of all lines in one line, line of each).

    A run of characters under 256 is its bytes as one number, mixed; any other run folds its code points.
    """
    padded = [x if len(x) >= RUN else x + "\0" * (RUN - len(x)) for x in lines]
    sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(lines))
    joined = "".join(padded)
    try:
        raw = joined.encode("latin-1")
        wide = None
    except UnicodeEncodeError:
        wide = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        raw = wide.astype(np.uint8).tobytes()
    h = mix64(np.ndarray((len(raw) - RUN + 1,), dtype="<u8", buffer=raw, strides=(1,)))
    if wide is not None:
        far = np.flatnonzero(wide > 255)
        touched = np.zeros(len(wide) + 1, dtype=np.int64)
        np.add.at(touched, np.maximum(far - RUN + 1, 0), 1)
        np.add.at(touched, far + 1, -1)
        at = np.flatnonzero(np.cumsum(touched)[: len(h)])
        x = np.zeros(len(at), dtype=U)
        for i in range(RUN):
            x = (x ^ wide[at + i]) * U(0x9E3779B97F4A7C15)
            x ^= x >> U(29)
        h[at] = mix64(x)
    keep = np.ones(len(raw), dtype=bool)
    ends = np.cumsum(sizes)
    for i in range(1, RUN):
        keep[ends - i] = False
    return h[keep[: len(h)]], np.repeat(np.arange(len(lines)), sizes - RUN + 1)


def signatures(lines: list[str], registers: int = REGISTERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """MinHash signatures: (line numbers, (lines, registers)) of lines with few elements and of lines with many.

    Elements are counted once each, as similarity counts them. Lines of up to ``FEW`` elements take the smallest of an own hash for each register. Longer ones take one permutation
    cut in as many parts (an empty part copies a full one that a hash picks), whose registers are near independent only
    if elements are many. Lines that may be alike to one of the other kind, by their number of elements, take both.
    """
    h, owner = run_hashes(lines)
    length = np.bincount(owner, minlength=len(lines))
    size = length.copy()
    long = length >= THRESHOLD * FEW  # no repetition matters below
    if long.any():
        # over FEW of a line's 1,024 cells in use: more elements than FEW, however many; else they are counted
        pick = np.flatnonzero(long)
        x = h if len(pick) == len(lines) else h[long[owner]]
        row = np.repeat(np.arange(len(pick)), length[pick])
        cell = np.zeros(len(pick) << 10, dtype=bool)
        cell[(row << 10) + (x & U(1023)).view(np.int64)] = True
        sure = cell.reshape(-1, 1024).sum(1) > FEW
        if not sure.all():
            ask = ~sure[row]
            bits = int(len(pick)).bit_length()
            y = row[ask].astype(U) << U(64 - bits) | x[ask] >> U(bits)
            y.sort()
            new = np.ones(len(y), dtype=bool)
            new[1:] = y[1:] != y[:-1]
            seen = np.cumsum(new)[np.cumsum(length[pick[~sure]]) - 1]
            size[pick[~sure]] = np.diff(seen, prepend=0)
    out = []
    small, large = size <= FEW, size >= THRESHOLD * FEW
    few = np.flatnonzero(small)
    if len(few):
        begin = np.concatenate(([0], np.cumsum(length[few])[:-1]))
        low = (h[small[owner]] >> U(32)).astype(np.uint32)
        seed = mix64(np.arange(1, registers + 1, dtype=U)).astype(np.uint32)
        part = np.empty((registers, len(few)), dtype=np.uint32)
        y, z = np.empty_like(low), np.empty_like(low)
        for r in range(registers):  # the runs' hashes are mixed already: one seeded round sets registers apart
            np.bitwise_xor(low, seed[r], out=y)
            y *= np.uint32(0x85EBCA6B)
            np.right_shift(y, np.uint32(15), out=z)
            y ^= z
            y *= seed[r] | np.uint32(1)
            np.minimum.reduceat(y, begin, out=part[r])
        out.append((few, part.T.astype(U)))
    many = np.flatnonzero(large)
    if len(many):
        x = h if large.all() else h[large[owner]]
        fill = np.full(len(many) * registers, EMPTY, dtype=U)
        slot = (x >> U(40)).astype(np.uint32) * np.uint32(registers) >> np.uint32(24)
        np.minimum.at(fill, np.repeat(np.arange(len(many)) * registers, length[many]) + slot, x & U((1 << 40) - 1))
        fill = fill.reshape(-1, registers)
        full, hole, attempt = fill.copy(), fill == EMPTY, 0
        while hole.any():
            attempt += 1
            row, col = np.nonzero(hole)
            pick = (mix64((col + 1).astype(U) * U(0x9E3779B97F4A7C15) + U(attempt)) % U(registers)).astype(np.int64)
            got = full[row, pick]
            ok = got != EMPTY
            fill[row[ok], col[ok]] = mix64(got[ok] + U(attempt))
            hole[row[ok], col[ok]] = False
        out.append((many, fill))
    return out


def _steps(lines: list[str]):
    """Slices of ``lines`` with about STEP_CHARS characters each."""
    start, size = 0, 0
    for i, x in enumerate(lines):
        size += max(len(x), RUN)
        if size >= STEP_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(lines):
        yield slice(start, len(lines))


def bands(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, id): bucket and line, once for each distinct line of a task's batch; a line that repeats in the batch has its first bucket twice."""

    def run(batches):
        for batch in batches:
            raw: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    raw.update(t.split("\n"))
            forms: Counter[str] = Counter()
            for x, n in raw.items():
                forms[comparison(x)] += n
            forms.pop("", None)
            lines = list(forms)
            ids = np.fromiter(map(line_id, lines), dtype=np.int64, count=len(lines))
            again = np.fromiter(forms.values(), dtype=np.int64, count=len(lines)) > 1
            for part in _steps(lines):
                own, more = ids[part], again[part].copy()
                for at, sig in signatures(lines[part]):
                    keys = band_keys(sig, ROWS).view(np.int64) & -2
                    keys[:, 0] |= FIRST
                    twice = np.flatnonzero(more[at])
                    more[at] = False
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate((keys.ravel(), keys[twice, 0]))), pa.array(np.concatenate((np.repeat(own[at], keys.shape[1]), own[at][twice])))], ["key", "id"])

    return df.select(text_col).mapInArrow(run, "key long, id long")


def places(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, doc, text_key, n, line): line ``n`` of a document has the comparison form ``id``; of the ids in ``wanted``, and a few others.

    ``line`` is the form of an id in ``candidates``, once in a batch; documents without an id give only such forms.
    """
    keep, read = bitset(wanted, "id"), bitset(candidates, "id")

    def run(batches):
        for batch in batches:
            ids: dict[str, int] = {}
            texts = [(t or "").split("\n") for t in batch.column(2).to_pylist()]
            raw = list({x for t in texts for x in t})
            forms = [comparison(x) for x in raw]
            at = np.fromiter(map(line_id, forms), dtype=np.int64, count=len(forms))
            hashed = spark_xxhash64(at)
            full = np.fromiter(map(bool, forms), dtype=bool, count=len(forms))
            for k in np.flatnonzero(Bitset(keep.value).maybe(hashed) & full):
                ids[raw[k]] = int(at[k])
            shown = {int(at[k]): forms[k] for k in np.flatnonzero(Bitset(read.value).maybe(hashed) & full)}
            cols = [[], [], [], [], []]
            for doc, key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                for n, x in enumerate(lines):
                    k = ids.get(x)
                    if k is not None:
                        line = shown.pop(k, None)
                        if doc is not None or line is not None:
                            for col, v in zip(cols, (k, doc, key, n, line)):
                                col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "doc", "text_key", "n", "line"])

    rows = df.select(F.col(id_col).cast("long"), F.xxhash64(text_col), text_col)
    return rows.mapInArrow(run, "id long, doc long, text_key long, n int, line string")


def run_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(line and hash of a run as one number, sorted and distinct; where each line's begin, and the end; bits of the hash, 44 or more)."""
    width = 64 - max(20, int(len(lines)).bit_length())
    found, at = [], 0
    for part in _steps(lines):
        h, owner = run_hashes(lines[part])
        x = (owner + at).astype(U) << U(width) | h >> U(64 - width)
        x.sort()
        found.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        at += part.stop - part.start
    x = np.concatenate(found)
    return x, np.searchsorted(x, np.arange(len(lines) + 1, dtype=U) << U(width)), width


def _alike(pairs: DataFrame) -> DataFrame:
    """Jaccard of all runs, looked up for all pairs of a step at once."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).field("line").to_pylist() for c in ("left", "right"))
            number: dict[str, int] = {}
            a, b = (np.array([number.setdefault(x, len(number)) for x in side], dtype=np.int64) for side in (left, right))
            if not len(a):
                continue
            x, start, width = run_sets(list(number))
            size = np.diff(start)
            a, b = np.where(size[a] < size[b], b, a), np.where(size[a] < size[b], a, b)  # the smaller set is looked up
            common = np.zeros(len(a), dtype=np.int64)
            near = np.flatnonzero(size[b] >= THRESHOLD * size[a])  # a larger set is out by its size
            cost = np.cumsum(size[b[near]]) // STEP_CHARS
            for k in np.unique(cost):
                part = near[cost == k]
                n = size[b[part]]
                at = np.repeat(start[b[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                ask = np.repeat(a[part], n).astype(U) << U(width) | x[at] & U((1 << width) - 1)
                hit = x[np.minimum(np.searchsorted(x, ask), len(x) - 1)] == ask
                common[part] = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
            yield batch.select(["a", "b"]).filter(pa.array(common >= THRESHOLD * (size[a] + size[b] - common)))

    return pairs.mapInArrow(run, "a long, b long")


def _neighbours(table):
    """Rows of a bucket alike to row i: exact Jaccard of the runs."""
    items, start, width = run_sets(table.column("line").to_pylist())
    items = items & U((1 << width) - 1)

    def make(lo, hi):
        sets = Overlap(np.split(items[start[lo]:start[hi]], start[lo + 1:hi] - start[lo]))
        return lambda i: sets.jaccard(i) >= THRESHOLD

    return make


def lost_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_key, lost): for each document that loses lines, their numbers in order; text_key is Spark's xxhash64 of the text."""
    prepare(df.sparkSession)
    near = materialize(members(bands(df, text_col), again=F.col("key").bitwiseAND(F.lit(FIRST)) == FIRST), "members")
    found = near.where("rep <> id and not again").select("key", "rep", "id")
    candidates = materialize(found.select("id").unionByName(found.select(F.col("rep").alias("id"))).distinct(), "candidates")
    wanted = materialize(near.where("again").select("id").unionByName(candidates).distinct(), "wanted")
    at = materialize(places(df, id_col, text_col, wanted, candidates), "places")
    forms = at.where("line is not null").select("id", "line")
    labels = materialize(link(found, lambda ids: forms.join(ids, "id", "left_semi").dropDuplicates(["id"]), _alike, _neighbours), "lines")
    place = F.struct("doc", "text_key", "n")
    named = at.where("doc is not null").join(labels, "id", "left").select(place.alias("place"), F.coalesce("label", "id").alias("label"))
    first = named.groupBy("label").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
    lost = salted_join(named, first, "label", ["place"]).where("place <> first").select("place.*")
    return lost.groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("n")).alias("lost"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``df``, all columns, with each text rebuilt from its kept lines (``counts``: and n_lines, n_kept)."""
    at, key, doc, lost_key, lost, lines = fresh(df, "at", "text_key", "lost_doc", "lost_key", "lost", "lines")
    gone = lost_lines(df, id_col, text_col).select(F.col("doc").alias(doc), F.col("text_key").alias(lost_key), F.col("lost").alias(lost))
    keyed = df.withColumns({at: F.col(id_col).cast("long"), key: F.xxhash64(text_col)})
    # one row of ``gone`` a text at most: the texts stay on the streamed side
    both = keyed.join(gone.hint("shuffle_hash"), (F.col(at) == F.col(doc)) & (F.col(key) == F.col(lost_key)), "left")
    both = both.withColumn(lines, F.split(F.coalesce(text_col, F.lit("")), "\n"))
    if counts:
        both = both.withColumns({"n_lines": F.size(lines), "n_kept": F.size(lines) - F.coalesce(F.size(lost), F.lit(0))})
    # the stretches between lost lines, in one walk
    begin = f"coalesce(get(`{lost}`, k - 1) + 1, 0)"
    walk = f"flatten(transform(sequence(0, size(`{lost}`)), k -> slice(`{lines}`, {begin} + 1, coalesce(get(`{lost}`, k), size(`{lines}`)) - {begin})))"
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.expr(walk), "\n"))
    return both.withColumn(text_col, text).select(*df.columns, *(("n_lines", "n_kept") if counts else ()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, kept_sha256)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, counts=True).select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
