"""Byte-level BPE by replaying the merges over a corpus shard.

A task takes the distinct pre-tokens that it has not met before, lays their bytes out in one line of symbols and keeps
an inverted index from each mergeable pair (by the token it makes) to the positions where the pair stands. The
merges are applied in rank order over all these words at once: a rank takes its positions in order, joins the two
symbols, and only the two neighbouring pairs of each joined place enter the index again. A pair that a
merge brings into being with a lower rank than the current one is taken first, as a word-by-word encoder would. Each document's ids are then its
pre-tokens' ids in order. Nothing is shuffled, and a task holds the words of one shard only.

Defined cases: a null text counts as empty (no ids, the hash of no bytes); special tokens are ordinary text; pre-tokens that
are tokens as a whole are that token; very long texts are encoded whole; repeated rows give repeated rows; other
columns pass unless named like a new one, then the new one wins; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import prepare, table

#: Characters of words and pieces that a task remembers; beyond it starts anew (bounded memory, same ids).
REMEMBERED = 8 << 20
#: Characters that are encoded together, and go out together.
SLICE = 1 << 20
SEP = (1 << 31) - 1
SHIFT = 32
#: The usual pre-token pattern: text can be split at its blanks before it.
BLANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places of a rank that are joined one by one rather than as arrays.
FEW = 12


def default_vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of the vocabulary that op3 names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Merges:
    """Ranks, and the tables that a replay needs."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        compiled = regex.compile(pattern)
        self.find = compiled.findall if not compiled.groups else lambda text: [m.group() for m in compiled.finditer(text)]
        #: whether a blank between two other characters always begins a pre-token
        self.by_blanks = pattern == BLANK_PATTERN
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << SHIFT | b] = rank
        self.keys = np.array(sorted(self.pairs) + [2**63 - 1], dtype=np.int64)
        self.made = np.array([self.pairs.get(k, -1) for k in self.keys.tolist()], dtype=np.int64)
        #: tokens that a pair of a lower rank contains
        self.risky = {s for k, r in self.pairs.items() for s in (k >> SHIFT, k & SEP) if r < s}
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.first = np.full(1 << 16, -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a << 8 | b] = self.ranks.get(bytes([a, b]), -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        rest = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                rest.append(i)
        if not rest:
            return out
        lengths = np.array([len(words[i]) for i in rest])
        raw = np.frombuffer(b"\0".join(words[i] for i in rest), dtype=np.uint8)
        sym = np.empty(len(raw) + 2, dtype=np.int64)
        sym[1:-1] = self.byte_id[raw]
        ends = np.cumsum(lengths + 1)  # a separator stands before each word and after the last
        sym[0] = SEP
        sym[ends] = SEP
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        #: rank of the pair that starts at a position, or -1
        pair = np.full(n, -1, dtype=np.int64)
        pair[1:-2] = self.first[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        pair[ends[:-1]] = -1
        pair[ends - 1] = -1
        at = np.flatnonzero(pair >= 0)
        rank = pair[at]
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(rank)) + 1)) if len(rank) else np.empty(0, np.int64)
        index: dict[int, list[int]] = {int(rank[c]): p.tolist() for c, p in zip(cuts, np.split(at, cuts[1:]))}
        heap = list(index)
        heapify(heap)
        lists = index, heap
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            if len(places) <= FEW or not self._join_many(r, np.array(places), sym, nxt, prv, pair, lists):
                places.sort()
                self._join_few(r, places, sym, nxt, prv, pair, lists)
        live = sym[sym >= 0]
        marks = np.flatnonzero(live == SEP)
        ids = live.astype("<u4").tobytes()
        for i, a, b in zip(rest, marks[:-1].tolist(), marks[1:].tolist()):
            out[i] = ids[4 * a + 4: 4 * b]
        return out

    def _enter(self, ranks, places, lists) -> None:
        index, heap = lists
        for k, p in zip(ranks, places):
            if k in index:
                index[k].append(p)
            else:
                index[k] = [p]
                heappush(heap, k)

    def _made(self, keys):
        slot = np.searchsorted(self.keys, keys)
        return np.where(self.keys[slot] == keys, self.made[slot], -1)

    def _join_many(self, r, p, sym, nxt, prv, pair, lists) -> bool:
        """Join all places of one rank at once; False, and nothing done, if that brings up a pair of a lower rank."""
        p = np.sort(p[(sym[p] >= 0) & (pair[p] == r)])
        p = p[np.concatenate(([True], p[1:] != p[:-1]))] if len(p) else p
        q = nxt[p]
        if r in self.risky:
            made = self._made(np.concatenate((sym[prv[p]] << SHIFT | r, r << SHIFT | sym[nxt[q]], [r << SHIFT | r])))
            if ((made >= 0) & (made < r)).any():
                return False
        if len(p) > 1 and (clash := p[1:] == q[:-1]).any():  # runs such as "aaa": the leftmost goes first
            free, took = np.ones(len(p), dtype=bool), -1
            for k in range(len(p)):
                if p[k] == took:
                    free[k] = False
                else:
                    took = q[k]
            p, q = p[free], q[free]
        after = nxt[q]
        sym[p], sym[q] = r, -1
        nxt[p], prv[after] = after, p
        before = prv[p]
        places = np.concatenate((before, p))
        keys = np.concatenate((sym[before] << SHIFT | r, r << SHIFT | sym[after]))
        made = self._made(keys)
        pair[places] = made
        good = made >= 0
        self._enter(made[good].tolist(), places[good].tolist(), lists)
        return True

    def _join_few(self, r, places, sym, nxt, prv, pair, lists) -> None:
        """One place after the other; stops if a pair of a lower rank comes up, which then goes first."""
        sym, nxt, prv, pair = (memoryview(x) for x in (sym, nxt, prv, pair))
        get = self.pairs.get
        for k, p in enumerate(places):
            if sym[p] < 0 or pair[p] != r:
                continue
            q = nxt[p]
            after, before = nxt[q], prv[p]
            sym[p], sym[q] = r, -1
            nxt[p], prv[after] = after, p
            made = get(sym[before] << SHIFT | r, -1), get(r << SHIFT | sym[after], -1)
            pair[before], pair[p] = made
            good = [(m, x) for m, x in zip(made, (before, p)) if m >= 0]
            if good:
                self._enter(*zip(*good), lists)
                if min(good)[0] < r:
                    index, heap = lists
                    index[r] = index.pop(r, []) + places[k + 1:]
                    heappush(heap, r)
                    return

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Encoder:
    """Encodes texts shard by shard; remembers the words of this task only.

    With the usual pattern a blank between two other characters always begins a pre-token, so what stands between such blanks is split
    into pre-tokens once for each distinct piece; a text with other white space beside a blank is split whole, and so is every text under another pattern.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}
        self.held = 0

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        words = self.words
        fresh = list({w for p in split for w in p if w not in words})
        words.update(zip(fresh, self.merges.replay([w.encode() for w in fresh])))
        self.held += sum(map(len, fresh)) + 16 * len(fresh)
        get = words.__getitem__
        return [b"".join(map(get, p)) for p in split]

    def __call__(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # millions of small strings and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > REMEMBERED:
            self.words, self.pieces, self.held = {}, {}, 0
        find, pieces = self.merges.find, self.pieces
        if not self.merges.by_blanks:
            return self._ids([find(t) for t in texts])
        cut = [t.split(" ") for t in texts]
        fresh = list({w for c in cut for w in c[1:] if w not in pieces})
        good = [w for w in fresh if w and not w[0].isspace() and not w[-1].isspace()]
        pieces.update(dict.fromkeys(fresh))
        self.held += sum(map(len, fresh)) + 16 * len(fresh)
        pieces.update(zip(good, self._ids([find(" " + w) for w in good])))
        get = pieces.__getitem__
        out: list[bytes | None] = [None] * len(texts)
        whole = []
        firsts = self._ids([find(c[0]) for c in cut])
        for i, c in enumerate(cut):
            rest = list(map(get, c[1:]))
            if None in rest or (rest and (not c[0] or c[0][-1].isspace())):
                whole.append(i)
            else:
                out[i] = firsts[i] + b"".join(rest)
        for i, ids in zip(whole, self._ids([find(texts[i]) for i in whole])):
            out[i] = ids
        return out


def _merges(spark: SparkSession, path: str | None, pattern: str | None):
    at, usual = (path, pattern) if path and pattern else default_vocabulary()
    with open(path or at, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((data, pattern or usual))


_built: dict = {}


def _encoder(shared) -> Encoder:
    key = hashlib.sha256(shared.value[0] + shared.value[1].encode()).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Merges(*shared.value)
    return Encoder(_built[key])


def _slices(batch, text_col: str):
    """Parts of a batch of about SLICE characters, with their texts (null: empty)."""
    texts = [x or "" for x in batch.column(text_col).to_pylist()]
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start:i + 1]
            start, size = i + 1, 0


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, ids_col: str = "ids", decoded: bool = False) -> DataFrame:
    """All columns of ``df`` but ``text_col``, with ``ids_col`` (array of int) and ``n_tokens``; ``decoded``: and ``text_col`` as decoded from the ids."""
    spark = df.sparkSession
    prepare(spark)
    shared = _merges(spark, path, pattern)
    rest = [f for f in df.schema.fields if f.name not in (text_col, ids_col, "n_tokens")]
    more = [T.StructField(text_col, T.StringType())] if decoded else []
    schema = T.StructType([*rest, *more, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            for part, texts in _slices(batch, text_col):
                ids = encoder(texts)
                lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                cols = [part.column(f.name) for f in rest]
                if decoded:
                    cols.append(pa.array([encoder.merges.decode(x).decode() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(lengths)], [*(f.name for f in rest), *(f.name for f in more), ids_col, "n_tokens"])

    return df.select(*[f.name for f in rest], text_col).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``df`` with ``text_col`` (binary) as the bytes of the ids: null for null ids, an error for an unknown id."""
    spark = df.sparkSession
    prepare(spark)
    shared = _merges(spark, path, pattern)
    rest = [f for f in df.schema.fields if f.name != text_col]

    def run(batches):
        merges = _encoder(shared).merges
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            raw = [None if x is None else merges.decode(np.array(x, dtype="<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(raw, pa.binary())], [*(f.name for f in rest), text_col])

    return df.select(*[f.name for f in rest]).mapInArrow(run, T.StructType([*rest, T.StructField(text_col, T.BinaryType())]))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, hash both."""
    spark = df.sparkSession
    prepare(spark)
    shared = _merges(spark, path, pattern)

    def run(batches):
        encoder = _encoder(shared)
        decode = encoder.merges.decode
        for batch in batches:
            for part, texts in _slices(batch, text_col):
                ids = encoder(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(decode(x)).hexdigest() for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    from pyspark.sql import functions as F

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
