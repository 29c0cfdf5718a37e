"""Exact substring dedup with suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

1. Winnowing gives every string of ``LENGTH`` bytes one content-defined anchor, the leftmost smallest hash of its ``GRAM``-byte
   strings. Equal strings have equal anchors at equal offsets, so a string can only repeat among the strings of the same anchor.
   The strings of one anchor occurrence are consecutive: they make one segment, and each string of the corpus is in one segment only.
2. Segments of anchors that repeat, equal ones once, are dealt to tasks by anchor. An anchor with more than ``HOT_ROWS`` rows is
   dealt on: half of its strings by the bytes that all of that half share, and so on, down to single strings, which are counted.
3. A task sorts in shards: a suffix array of each shard, sampled at every ``GRID``-th byte from the anchor, by Larsson-Sadakane
   refinement (groups of equal prefixes are refined by the ranks of what follows, doubling the depth), with Kasai's common
   prefixes. The shards of one anchor are merged by binary search. Between two samples, strings are equal if the next sample's suffixes share
   the rest of them and the bytes before it are equal, which each of the ``GRID`` offsets tests by sorting. So every byte offset is judged exactly.
4. The spans go back to the documents by hashes of their text.

Defined cases: null texts count as empty; texts of fewer than ``LENGTH`` bytes lose nothing; matches never cross documents and may overlap, also
in one document; repeated rows are copies of each other; ties in winnowing go to the left; spans are judged on the input;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitset, bitset, materialize, mix64, n_shuffle, prepare, table
from .op6_minhash import spark_xxhash64

LENGTH = 200
GRAM = 64
SPREAD = LENGTH - GRAM + 1
#: Distance of the samples: two letters of seven bytes, each letter a 63-bit number.
GRID = 14
LETTERS = -(-LENGTH // GRID)
STEP_BYTES = 1 << 20
SHARD_BYTES = 1 << 20
#: Rows of an anchor that one task takes at most.
HOT_ROWS = 32_768
SALTS = 8
U = np.uint64


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """min of x[i : i + width] for every i with all of it inside."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span: len(x) - span + 1]) if span < width else out


def anchors(texts: list[bytes]):
    """(anchor, text, position, first start, last start) for texts of LENGTH bytes or more: positions in the text; starts of the strings it owns."""
    if not texts:
        return (np.empty(0, np.int64),) * 5
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h, span = raw.astype(U), 1
    while span < GRAM:  # a hash of 2, 4, ... GRAM bytes
        h = (h[:-span] * U(0x9E3779B97F4A7C15) ^ (h[span:] >> U(29))) + h[span:] * U(0xC2B2AE3D27D4EB4F)
        span *= 2
    h = mix64(h)
    bits = U(int(len(raw)).bit_length())
    key = (h >> bits << bits) | np.arange(len(h), dtype=U)  # the least of equal leading bits is the leftmost
    first = (_slide(key, SPREAD) & ((U(1) << bits) - U(1))).astype(np.int64)
    change = np.zeros(len(first) + 1, dtype=bool)
    change[0] = True
    change[1:-1] = first[1:] != first[:-1]
    ends = begin + sizes - LENGTH + 1  # strings from here on would cross into the next text
    change[begin] = True
    change[ends] = True
    at = np.flatnonzero(change)
    s0, s1 = at[:-1], at[1:] - 1
    owner = np.searchsorted(begin, s0, side="right") - 1
    ok = s0 < ends[owner]
    s0, s1, owner = s0[ok], s1[ok], owner[ok]
    p = first[s0]
    return h[p].view(np.int64), owner, p - begin[owner], s0 - begin[owner], s1 - begin[owner]


def _grouped(batch) -> dict:
    """(hashes, bytes) -> [text, copies] of a batch's long texts."""
    out: dict = {}
    for key, more, t in zip(batch.column("key").to_pylist(), batch.column("more").to_pylist(), batch.column("text").to_pylist()):
        if t and len(t) * 4 >= LENGTH:
            raw = t.encode()
            if len(raw) >= LENGTH:
                k = (key, more, len(raw))
                if k in out:
                    out[k][1] += 1
                else:
                    out[k] = [raw, 1]
    return out


def _steps(items):
    part, size = [], 0
    for x in items:
        part.append(x)
        size += len(x[1][0])
        if size >= STEP_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _anchor_counts(batches):
    for batch in batches:
        ids, counts = [], []
        for part in _steps(_grouped(batch).items()):
            a, owner, *_ = anchors([x[1][0] for x in part])
            ids.append(a)
            counts.append(np.array([x[1][1] for x in part], dtype=np.int64)[owner])
        if ids:
            a, inv = np.unique(np.concatenate(ids), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.bincount(inv, np.concatenate(counts)).astype(np.int64))], ["anchor", "n"])


SEGMENTS = "anchor long, seg_id long, n long, bhi int, seg binary, places array<struct<key: long, more: int, n_bytes: long, lo: int>>"
PLACE = pa.struct([("key", pa.int64()), ("more", pa.int32()), ("n_bytes", pa.int64()), ("lo", pa.int32())])


def _segments(keep):
    def run(batches):
        for batch in batches:
            rows: dict[tuple[int, int], list] = {}
            for part in _steps(_grouped(batch).items()):
                a, *rest = anchors([x[1][0] for x in part])
                if not len(a):
                    continue
                maybe = Bitset(keep.value).maybe(spark_xxhash64(a))
                for anchor, o, p, s0, s1 in zip(a[maybe].tolist(), *(x[maybe].tolist() for x in rest)):
                    place, (raw, copies) = part[o]
                    seg = raw[s0: s1 + LENGTH]
                    seg_id = xxhash.xxh3_64_intdigest(seg) - 2**63
                    row = rows.get((anchor, seg_id))
                    if row is None:
                        rows[anchor, seg_id] = [copies, p - s0, seg, [(*place, s0)]]
                    else:
                        row[0] += copies
                        row[3].append((*place, s0))
            flat = [x for r in rows.values() for x in r[3]]
            cols = list(zip(*flat)) or [()] * 4
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PLACE)], fields=list(PLACE))
            offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows.values()]))).astype(np.int32)
            n, bhi, seg = (pa.array([r[i] for r in rows.values()], t) for i, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.binary())))
            ids = [pa.array([k[i] for k in rows], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, n, bhi, seg, pa.ListArray.from_arrays(pa.array(offsets), inner)], ["anchor", "seg_id", "n", "bhi", "seg", "places"])

    return run


# --- suffix arrays of a task ----------------------------------------------------

def _letters(raw: np.ndarray, pos: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The GRID bytes at each position as two numbers of seven nine-bit fields; 0 is past the end."""
    out = []
    n = len(raw)
    for half in (0, 7):
        key = np.zeros(len(pos), dtype=np.int64)
        for j in range(half, half + 7):
            q = pos + j
            key = key << 9 | np.where(q < end, raw[np.minimum(q, n - 1)].astype(np.int64) + 1, 0)
        out.append(key)
    return out[0], out[1]


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading equal fields, of seven, from the xor of two letters' halves."""
    return sum((x >> (9 * f) == 0).astype(np.int64) for f in range(7))


def suffix_array(bucket: np.ndarray, hi: np.ndarray, lo: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Sampled suffixes in order of (bucket, bytes), whole ones equal in order of segment; a sample's next one in its segment is the next element."""
    n = len(bucket)
    depth = int(np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))), [n]))).max(initial=0))
    where = np.arange(n)
    sa = np.lexsort((lo, hi, bucket))
    new = np.ones(n, dtype=bool)
    a, b = sa[1:], sa[:-1]
    new[1:] = (bucket[a] != bucket[b]) | (hi[a] != hi[b]) | (lo[a] != lo[b])
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, where, 0))
    h = 1
    while h < depth:
        single = new & np.concatenate((new[1:], [True]))
        live = np.flatnonzero(~single)
        if not len(live):
            break
        pos = sa[live]
        q = np.minimum(pos + h, n - 1)
        follow = np.where((pos + h < n) & (seg[q] == seg[pos]), rank[q] + 1, 0)
        key = rank[pos] << 32 | follow
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        sa[live] = pos
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[live] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, live, 0))
        h *= 2
    return sa


def common_prefixes(sa: np.ndarray, bucket: np.ndarray, hi: np.ndarray, lo: np.ndarray, seg: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Kasai's common prefix in bytes of each sampled suffix with its predecessor, 0 at the start of a bucket; all segments in step.

    A suffix shares at least one letter less with its predecessor than the sample before it does with its own.
    """
    n = len(sa)
    before = np.full(n, -1, dtype=np.int64)
    same = bucket[sa[1:]] == bucket[sa[:-1]]
    before[sa[1:][same]] = sa[:-1][same]
    first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    last = np.concatenate((first[1:], [n]))
    left = (last - 1)[seg]  # last sample of the segment
    out = np.zeros(n, dtype=np.int64)
    k = np.zeros(len(first), dtype=np.int64)
    for t in range(int((last - first).max(initial=0))):
        segs = np.flatnonzero(first + t < last)
        i = first[segs] + t
        j = before[i]
        have = j >= 0
        kk = np.where(have, np.maximum(k[segs] - 1, 0), 0)
        # no string is longer than LETTERS
        most = np.where(have, np.minimum(np.minimum(left[i] - i, left[j] - j) + 1, LETTERS), 0)
        go = np.flatnonzero(have)
        while len(go):
            go = go[kk[go] < most[go]]
            x, y = i[go] + kk[go], j[go] + kk[go]
            go = go[(hi[x] == hi[y]) & (lo[x] == lo[y])]
            kk[go] += 1
        k[segs] = kk
        part = np.zeros(len(i), dtype=np.int64)
        at = np.flatnonzero(have & (kk < most))
        x, y = i[at] + kk[at], j[at] + kk[at]
        top = _equal_bytes(hi[x] ^ hi[y])
        part[at] = np.where(top < 7, top, 7 + _equal_bytes(lo[x] ^ lo[y]))
        out[i] = np.where(have, np.minimum(kk * GRID + part, np.minimum(room[i], room[j])), 0)
    return out


class Shard:
    """The sampled suffixes, in order, at which some owned string of the segments begins or before which it does."""

    def __init__(self, first: int, segs: list):
        """``first``: number of the first segment; segs: (group number, bhi, bytes)."""
        sizes = np.array([len(s[2]) for s in segs])
        bhi = np.array([s[1] for s in segs])
        group = np.array([s[0] for s in segs])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        raw = np.frombuffer(b"".join(s[2] for s in segs), dtype=np.uint8)
        skip = bhi % GRID
        count = (sizes - 1 - skip) // GRID + 1
        seg = np.repeat(np.arange(len(segs)), count)
        number = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        pos = (begin + skip)[seg] + GRID * number
        end = (begin + sizes)[seg]
        place = (bhi // GRID)[seg] - number  # in samples before the anchor
        hi, lo = _letters(raw, pos, end)
        bucket = group[seg] * 64 + place + 40
        sa = suffix_array(bucket, hi, lo, seg)
        lcp = common_prefixes(sa, bucket, hi, lo, seg, end - pos)
        blo = bhi - (sizes - LENGTH)
        # buckets are whole in or out, so no common prefix spans what is left out
        use = (place >= 0)[sa]
        sa = sa[use]
        self.lcp = lcp[sa]
        self.bucket, self.seg, self.b0 = bucket[sa], seg[sa] + first, place[sa] * GRID
        self.blo, self.bhi = blo[seg[sa]], bhi[seg[sa]]
        self.room = (end - pos)[sa]
        before = np.zeros((2, len(sa)), dtype=U)
        for c in range(1, GRID):
            q = pos[sa] - c
            byte = np.where(q >= begin[seg[sa]], raw[np.maximum(q, 0)], 0).astype(U)
            before[(c - 1) // 7] |= byte << U(8 * ((c - 1) % 7))
        self.before = before
        self.words = lambda: self._words(sa, hi, lo, seg)

    @staticmethod
    def _words(sa, hi, lo, seg) -> np.ndarray:
        """LETTERS letters of each suffix in order, as rows."""
        q = sa[:, None] + np.arange(LETTERS)
        ok = np.minimum(q, len(seg) - 1)
        inside = (q < len(seg)) & (seg[ok] == seg[sa][:, None])
        out = np.empty((len(sa), 2 * LETTERS), dtype=np.int64)
        out[:, 0::2] = np.where(inside, hi[ok], 0)
        out[:, 1::2] = np.where(inside, lo[ok], 0)
        return out

    def merge(self, other: Shard) -> Shard:
        """One order of both: each suffix of the other finds its place in this one by binary search."""
        mine = np.column_stack((self.bucket, self.words()))
        his = np.column_stack((other.bucket, other.words()))
        lo, hi = np.zeros(len(his), np.int64), np.full(len(his), len(mine))
        while (lo < hi).any():
            open_ = np.flatnonzero(lo < hi)
            mid = (lo[open_] + hi[open_]) // 2
            a, b = his[open_], mine[mid]
            differ = a != b
            col = differ.argmax(1)
            r = np.arange(len(a))
            less = differ[r, col] & (a[r, col] < b[r, col])
            hi[open_[less]] = mid[less]
            lo[open_[~less]] = mid[~less] + 1
        to = np.zeros(len(mine) + len(his), dtype=bool)
        to[lo + np.arange(len(his))] = True
        out = object.__new__(Shard)

        def both(a, b):
            x = np.empty((len(to), *a.shape[1:]), dtype=a.dtype)
            x[~to], x[to] = a, b
            return x

        for name in ("bucket", "seg", "b0", "blo", "bhi", "room"):
            setattr(out, name, both(getattr(self, name), getattr(other, name)))
        out.before = np.stack([both(a, b) for a, b in zip(self.before, other.before)])
        rows = both(mine, his)
        differ = rows[1:] != rows[:-1]
        col = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        at = np.minimum(col, rows.shape[1] - 1)
        r = np.arange(len(at))
        part = np.where(col < rows.shape[1], _equal_bytes(rows[1:][r, at] ^ rows[:-1][r, at]), 0)
        lcp = np.where(col == 0, 0, np.minimum((np.maximum(col, 1) - 1) * 7 + part, np.minimum(out.room[1:], out.room[:-1])))
        out.lcp = np.concatenate(([0], lcp))
        out.words = lambda: rows[:, 1:]
        return out

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """(segment, bytes before the anchor) of the strings that stand in two places of this shard."""
        segs, offs = [], []
        for d in range(GRID):
            b = self.b0 + d
            own = np.flatnonzero((b >= self.blo) & (b <= self.bhi))
            run = np.cumsum(self.lcp < LENGTH - d)[own]
            again = np.zeros(len(own), dtype=bool)
            again[1:] = run[1:] == run[:-1]
            again[:-1] |= again[1:]
            own, run = own[again], run[again]
            if not len(own):
                continue
            if d:
                x = self.before[0][own] & U((1 << 8 * min(d, 7)) - 1)
                y = self.before[1][own] & U((1 << 8 * max(d - 7, 0)) - 1)
                by = np.argsort(mix64((run.astype(U) * U(0x9E3779B97F4A7C15) ^ x) * U(0xC2B2AE3D27D4EB4F) ^ y), kind="stable")
                own, run, x, y = own[by], run[by], x[by], y[by]
                same = np.zeros(len(own), dtype=bool)
                same[1:] = (run[1:] == run[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                same[:-1] |= same[1:]
                own = own[same]
            segs.append(self.seg[own])
            offs.append(b[own])
        return (np.concatenate(segs), np.concatenate(offs)) if segs else (np.empty(0, np.int64),) * 2


def repeats(groups: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of repeated bytes; groups: lists of (copies, bhi, bytes) of one anchor each, segments numbered through."""
    segs = [s for g in groups for s in g]
    sizes = np.array([len(s[2]) for s in segs])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    cover = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
    found, small, at = [], [], 0

    def sort(part):
        # segments of a part are consecutive in a large group, and named one by one in shards of several small ones
        s = Shard(0, [x[1:] for x in part])
        s.seg = np.array([x[0] for x in part])[s.seg]
        return s

    size = 0
    for g, group in enumerate(groups):
        named = [(at + k, g, s[1], s[2]) for k, s in enumerate(group)]
        at += len(group)
        if len(group) == 1:
            continue
        total = sum(len(s[2]) for s in group)
        if total <= SHARD_BYTES:
            small += named
            size += total
            if size >= SHARD_BYTES:
                found.append(sort(small))
                small, size = [], 0
            continue
        parts, part, have = [], [], 0
        for x in named:
            part.append(x)
            have += len(x[3])
            if have >= SHARD_BYTES:
                parts.append(sort(part))
                part, have = [], 0
        if part:
            parts.append(sort(part))
        while len(parts) > 1:
            parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        found += parts
    if small:
        found.append(sort(small))
    bhi = np.array([s[1] for s in segs])
    for s in found:
        seg, b = s.hits()
        start = begin[seg] + bhi[seg] - b
        np.add.at(cover, start, 1)
        np.add.at(cover, start + LENGTH, -1)
    on = np.cumsum(cover)[:-1] > 0
    owner = np.repeat(np.arange(len(segs)), sizes)
    copied = np.array([s[0] > 1 for s in segs])
    on |= copied[owner]
    edge = np.ones(len(on), dtype=bool)
    edge[1:] = (on[1:] != on[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(edge)
    last = np.concatenate((first[1:], [len(on)]))
    keep = on[first]
    seg = owner[first[keep]]
    return seg, first[keep] - begin[seg], last[keep] - begin[seg]


def _sharded(batches):
    """(anchor, seg_id, a, b) from rows (key, anchor, seg_id, off, n, bhi, seg) sorted by key."""
    groups: dict[int, dict[bytes, list]] = {}
    size = 0

    def flush():
        lists = [[(v[0], v[1], seg) for seg, v in g.items()] for g in groups.values()]
        owners = [v[2] for g in groups.values() for v in g.values()]
        seg, a, b = repeats(lists) if lists else (np.empty(0, np.int64),) * 3
        many = np.array([len(o) for o in owners], dtype=np.int64)
        flat = np.array([x for o in owners for x in o], dtype=np.int64).reshape(-1, 3)
        start = np.cumsum(many) - many
        rows = np.repeat(np.arange(len(seg)), many[seg]) if len(seg) else np.empty(0, np.int64)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(many[seg]) - many[seg], many[seg]) if len(seg) else rows
        own = flat[start[seg[rows]] + nth] if len(rows) else np.empty((0, 3), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array((a[rows] + own[:, 2]).astype(np.int32)), pa.array((b[rows] + own[:, 2]).astype(np.int32))], ["anchor", "seg_id", "a", "b"])

    for batch in batches:
        for key, anchor, seg_id, off, n, bhi, seg in zip(*(batch.column(i).to_pylist() for i in range(7))):
            g = groups.get(key)
            if g is None:
                if size >= 4 * SHARD_BYTES:
                    yield flush()
                    groups, size = {}, 0
                g = groups[key] = {}
            v = g.get(seg)
            if v is None:
                g[seg] = [n, bhi, [(anchor, seg_id, off)]]
                size += len(seg)
            else:
                v[0] += n
                if v[2][-1] != (anchor, seg_id, off):
                    v[2].append((anchor, seg_id, off))
    yield flush()


def _halves(batches):
    """Each row's strings in two rows, dealt by the bytes that all strings of that half of the range share."""
    names = ["key", "anchor", "seg_id", "off", "n", "bhi", "seg", "x", "y"]
    types = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    for batch in batches:
        out = [[] for _ in names]
        for key, anchor, seg_id, off, n, bhi, seg, x, y in zip(*(batch.column(c).to_pylist() for c in names)):
            blo = bhi - (len(seg) - LENGTH)
            mid = (x + y) // 2
            for u, v in ((x, mid), (mid + 1, y)):
                top, low = min(bhi, v), max(blo, u)
                if low > top:
                    continue
                a = bhi - top
                part = seg[a: bhi - low + LENGTH]
                shared = seg[bhi - u: bhi - v + LENGTH]
                new = xxhash.xxh3_64_intdigest(shared, seed=(key ^ u << 8 ^ v) & (1 << 64) - 1) - 2**63
                for c, z in zip(out, (new, anchor, seg_id, off + a, n, top, part, u, v)):
                    c.append(z)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows in groups of HOT_ROWS at most, and what is left of larger ones: groups of one string each."""
    schema = "key long, anchor long, seg_id long, off int, n long, bhi int, seg binary, x int, y int"
    done, single, merged = [], [], False
    while True:
        hot = materialize(rows.groupBy("key").agg(F.count("*").alias("rows")).where(f"rows > {HOT_ROWS}").select("key"), "hot")
        n = hot.count()
        if not n:
            return _all([*done, rows]), _all(single)
        hot = F.broadcast(hot) if n <= 100_000 else hot
        done.append(rows.join(hot, "key", "left_anti"))
        over = rows.join(hot, "key", "left_semi")
        if not merged:  # a segment has a row from each batch that holds it; one goes on, and halves of different rows stay apart
            over = over.groupBy("key", "anchor", "seg_id", "off", "x", "y").agg(F.sum("n").alias("n"), F.first("bhi").alias("bhi"), F.first("seg").alias("seg"))
            rows, merged = materialize(over.select(*rows.columns), "merged"), True
            continue
        halves = materialize(over.mapInArrow(_halves, schema), "halves")
        single.append(halves.where("x = y"))
        rows = halves.where("x < y")


def _all(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _key(text: Column) -> list[Column]:
    """Two hashes of a text."""
    return [F.xxhash64(text).alias("key"), F.hash(text).alias("more")]


def _joined(runs: Column) -> Column:
    """Sorted ranges with those that overlap or touch made one."""
    def step(done, r):
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) > 0) & (r["a"] <= last["b"]), F.concat(rest, F.array(grown))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, F.array().cast("array<struct<a: int, b: int>>"), step)


def covers(found: DataFrame) -> DataFrame:
    """(anchor, seg_id, a, b): the ranges of repeated bytes of each segment, none twice."""
    rows = found.select(F.col("anchor").alias("key"), "anchor", "seg_id", F.lit(0).alias("off"), "n", "bhi", "seg", F.lit(0).alias("x"), F.lit(SPREAD - 1).alias("y"))
    dealt, single = _dealt(rows)
    shards = dealt.select("key", "anchor", "seg_id", "off", "n", "bhi", "seg").repartition(n_shuffle(found.sparkSession), "key").sortWithinPartitions("key")
    cover = shards.mapInArrow(_sharded, "anchor long, seg_id long, a int, b int")  # a key's rows are in one task, equal segments once
    if single is not None:
        twice = single.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
        ones = single.join(twice, "key", "left_semi").select("anchor", "seg_id", F.struct(F.col("off").alias("a"), (F.col("off") + LENGTH).alias("b")).alias("r"))
        # a segment has no more strings than bytes
        runs = ones.groupBy("anchor", "seg_id").agg(_joined(F.sort_array(F.collect_set("r"))).alias("runs"))
        cover = cover.unionByName(runs.select("anchor", "seg_id", F.inline("runs")))
    return cover


def places(found: DataFrame, cover: DataFrame) -> DataFrame:
    """(key, more, n_bytes, lo, a, b): each place of a covered segment with each of its ranges.

    A segment's ranges stand once in ``cover``, so the join grows with the batches that hold the segment; Spark deals a segment's many rows
    over tasks, as both sides come from files (adaptive skew joins).
    """
    rows = found.select("anchor", "seg_id", "places").join(cover, ["anchor", "seg_id"])
    return rows.select("a", "b", F.explode("places").alias("at")).select("at.*", "a", "b")


def spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, more, n_bytes, spans): byte ranges to remove from each text that has some; key and more are Spark's xxhash64 and hash of it."""
    spark = df.sparkSession
    prepare(spark, 4 << 20)  # equal segments of a batch go once
    texts = df.select(*_key(F.col(text_col)), F.col(text_col).alias("text"))
    twice = texts.mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    keep = bitset(materialize(twice, "anchors"), "anchor")
    found = materialize(texts.mapInArrow(_segments(keep), SEGMENTS), "segments")
    back = places(found, materialize(covers(found), "cover"))
    span = F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    return back.groupBy("key", "more", "n_bytes").agg(F.collect_set(span).alias("spans"))


def union(found) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, with ``content``, the removed runs and the kept bytes."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))  # copies of one text meet its spans in several tasks
    found = spans(df, text_col).withColumnsRenamed({"key": "_key", "more": "_more", "n_bytes": "_n"}).withColumn("_salt", salts)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    # short texts have no spans; they are spread by their id
    key, more = _key(F.col("text"))
    docs = docs.withColumns({"key": F.when(F.col("n") >= LENGTH, key).otherwise(F.xxhash64("doc_id")), "more": more, "salt": F.pmod(F.hash("doc_id"), F.lit(SALTS))})
    on = (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")) & (F.col("more") == F.col("_more")) & (F.col("n") == F.col("_n"))
    both = docs.join(found.hint("shuffle_hash"), on, "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (t or "").encode()
                runs = union(s)
                at, kept = 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                row = (len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"a": a, "b": b} for a, b in runs] if content else None, rest)
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            k = 6 if content else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols[:k], types))], ["doc_id", *names[:k]])

    more_cols = ", spans array<struct<a: int, b: int>>, kept binary" if content else ""
    return both.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more_cols}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), content=False)
