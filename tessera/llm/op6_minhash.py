"""Near-duplicate documents by ProbMinHash.

A text's elements are its shingles of five words (lower case, split at white space; a shorter text is one shingle), weighted by
1 + ln(occurrences). Each element sends arrivals of a Poisson process whose rate is its weight to random registers, and a register keeps
the element of its first arrival, so two texts agree on a register with the probability Jaccard similarity of their weights. Elements whose
next arrival comes after all registers' first ones stop early. Bands of registers propose candidates, and exact
similarity decides: a link needs a probability Jaccard or a plain set Jaccard of the shingles of 0.8 or more. A text with repeated shingles
also has the bands of its unweighted ones, so both similarities propose.

Texts with equal weighted shingles collapse before any comparison; buckets are linked through representatives (see
``buckets``), and classes are the components of the links.

Defined cases: a null text, or one without words, is in no group (a class of its own); ties and repeated rows are copies of one class,
named by its smallest doc_id; very long texts are read whole; equal doc_ids are told apart by their text, of which the kept one is picked by its hash; rows without an id
form copies like others, after all ids (class_id is null if no row of the class has one), and those without words stay apart; an empty table gives no rows; other columns are
ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buckets import Overlap, link, members
from .common import Bitset, bitset, fresh, materialize, mix64, prepare, salted_join, table

WORDS = 5
THRESHOLD = 0.8
REGISTERS = 64
ROWS = 4
BANDS = REGISTERS // ROWS
U = np.uint64


class Shingler:
    """Weighted shingles of texts; remembers the hashes of a task's words, boundedly."""

    def __init__(self, width: int = WORDS):
        self.width, self.known = width, {}
        self.factor = mix64(np.arange(1, width + 1, dtype=U)) | U(1)

    def words(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        split = text.lower().split()
        try:
            return np.fromiter(map(known.__getitem__, split), dtype=U, count=len(split))
        except KeyError:
            for w in set(split):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, split), dtype=U, count=len(split))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, occurrences)."""
        w = self.words(text or "")
        n = len(w) - self.width + 1
        if len(w) == 0:
            return w, np.empty(0, np.int64)
        if n < 1:
            h = mix64((w * self.factor[: len(w)]).sum(dtype=U)[None] + U(len(w)))
        else:
            h = w[:n] * self.factor[0]
            for i in range(1, self.width):
                h = h + w[i:n + i] * self.factor[i]
            h = mix64(h)
        h.sort()
        first = np.concatenate(([True], h[1:] != h[:-1]))
        at = np.flatnonzero(first)
        return h[first], np.diff(np.concatenate((at, [len(h)])))


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(hashes: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) element hashes of first arrivals for ``n`` weighted sets laid out in one line.

    Every round is one arrival of each live element; an element lives while its time is under its set's latest register.
    """
    time = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, dtype=U)
    seed, rate, own = hashes, weight, owner
    clock = np.zeros(len(hashes))
    step = 0
    while len(seed):
        step += 1
        r = mix64(seed + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        clock = clock - np.log(((r >> U(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
        slot = own * registers + (mix64(r) % U(registers)).astype(np.int64)
        np.minimum.at(time, slot, clock)
        won = time[slot] == clock
        who[slot[won]] = seed[won]
        live = clock < time.reshape(n, registers).max(1)[own]
        seed, rate, own, clock = seed[live], rate[live], own[live], clock[live]
    return who.reshape(n, registers)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, bands) hashes of runs of ``rows`` registers."""
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=U), (n, m // rows)).copy()
    for i in range(rows):
        key = mix64(key * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def similarity(ha, ca, hb, cb) -> tuple[float, float]:
    """(probability Jaccard of the weights, Jaccard of the sets), exact."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0, 0.0
    plain = len(common) / (len(ha) + len(hb) - len(common))
    wa, wb = weights(ca), weights(cb)
    # sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i): max picks b where b_j / a_j exceeds b_i / a_i
    ratio = wb[ib] / wa[ia]
    order = np.argsort(ratio, kind="stable")
    ratio, xa, xb = ratio[order], wa[ia][order], wb[ib][order]
    below = np.concatenate(([0.0], np.cumsum(xa)))[:-1]  # of those with no larger ratio, a counts
    total_b = np.concatenate((np.cumsum(xb[::-1])[::-1], [0.0]))[1:]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    s = (below + xa + only_a) / xa + (total_b + only_b) / xb
    return float((1 / s).sum()), plain


def signed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, sid, bands): sid names the weighted shingles (null without words)."""
    prepare(df.sparkSession)

    def run(batches):
        shingle = Shingler()
        for batch in batches:
            made = [shingle(t) for t in batch.column(2).to_pylist()]
            sids = [xxhash.xxh3_64_intdigest(h.tobytes() + c.astype("<u4").tobytes()) - 2**63 if len(h) else None for h, c in made]
            place: dict[int, int] = {}
            for k, s in enumerate(sids):
                if s is not None:
                    place.setdefault(s, k)
            at = np.fromiter(place.values(), dtype=np.int64)
            bands: list = [None] * len(made)
            for i in range(0, len(at), 512):
                part = at[i:i + 512]
                sizes = [len(made[k][0]) for k in part]
                sig = signatures(np.concatenate([made[k][0] for k in part]), weights(np.concatenate([made[k][1] for k in part])), np.repeat(np.arange(len(part)), sizes), len(part))
                for k, row in zip(part, band_keys(sig).view(np.int64)):
                    bands[k] = row
                # weights of one where none repeats: such a signature is the unweighted one already
                again = [k for k in part if made[k][1].max() > 1]
                if again:
                    sizes = [len(made[k][0]) for k in again]
                    sig = signatures(np.concatenate([made[k][0] for k in again]), np.ones(sum(sizes)), np.repeat(np.arange(len(again)), sizes), len(again))
                    for k, row in zip(again, band_keys(sig).view(np.int64)):
                        bands[k] = np.union1d(bands[k], row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "sid", "bands"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), text_col)
    return rows.mapInArrow(run, "doc_id long, text_key long, sid long, bands array<long>")


def shingles_of(df: DataFrame, ids: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, hashes, counts) of the weighted shingles named in ``ids``, read from the texts again."""
    keep = bitset(ids, "id")

    def run(batches):
        shingle, sent = Shingler(), set()
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                h, c = shingle(t)
                if len(h):
                    s = xxhash.xxh3_64_intdigest(h.tobytes() + c.astype("<u4").tobytes()) - 2**63
                    rows.append((s, h, c))
            if not rows:
                continue
            hashed = spark_xxhash64(np.array([r[0] for r in rows], dtype=np.int64))
            maybe = Bitset(keep.value).maybe(hashed)
            out = []
            for r, ok in zip(rows, maybe):
                if ok and r[0] not in sent:
                    out.append(r)
                    if len(sent) < 500_000:
                        sent.add(r[0])
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.int64()), pa.array([r[1].view(np.int64) for r in out], pa.list_(pa.int64())),
                pa.array([r[2].astype(np.int32) for r in out], pa.list_(pa.int32()))], ["id", "hashes", "counts"])

    return df.select(text_col).mapInArrow(run, "id long, hashes array<long>, counts array<int>").join(ids, "id", "left_semi").dropDuplicates(["id"])


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 (seed 42) of longs, the published algorithm for eight bytes."""
    p1, p2, p3, p4, p5 = (U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, n: (v << U(n)) | (v >> U(64 - n))
    with np.errstate(over="ignore"):
        h = np.full(len(x), U(42) + p5 + U(8), dtype=U)
        h ^= rot(x.view(U) * p2, 31) * p1
        h = rot(h, 27) * p1 + p4
        h ^= h >> U(33)
        h *= p2
        h ^= h >> U(29)
        h *= p3
        h ^= h >> U(32)
    return h.view(np.int64)


def _alike(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            keep = []
            get = lambda side: (batch.column(side).field("hashes"), batch.column(side).field("counts"))
            (lh, lc), (rh, rc) = get("left"), get("right")
            for i in range(batch.num_rows):
                s = similarity(*(x[i].values.to_numpy() for x in (lh, lc, rh, rc)))
                keep.append(max(s) >= THRESHOLD)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _neighbours(table):
    """Rows of a bucket alike to row i: exact set Jaccard, and probability Jaccard of all that may reach it.

    With weights as shares of their sums, the probability Jaccard is at most the sum of the smaller shares: its term of a shingle is
    1 / sum_j max(a_j / a_i, b_j / b_i), which neither share exceeds.
    """
    cut = lambda c: [x.values.to_numpy() for x in table.column(c)]
    all_hashes, all_counts = [x.view(U) for x in cut("hashes")], cut("counts")

    def make(lo, hi):
        hashes, counts = all_hashes[lo:hi], all_counts[lo:hi]
        shares = [w / w.sum() for w in map(weights, counts)]
        repeats = np.array([c.max() > 1 for c in counts])
        sets = Overlap(hashes, shares)

        def near(i):
            out = sets.jaccard(i) >= THRESHOLD
            maybe = ~out if repeats[i] else ~out & repeats
            if maybe.any():
                for j in np.flatnonzero(maybe & (sets.least(i) >= THRESHOLD - 1e-9)):
                    out[j] = similarity(hashes[i], counts[i], hashes[j], counts[j])[0] >= THRESHOLD
            return out

        return near

    return make


def _classed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, kept)."""
    s = materialize(signed(df, id_col, text_col), "signed")
    # rows order by id, those without one last, then by text
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    one = s.where("sid is not null").groupBy("sid").agg(F.min(place).alias("first"), F.max("bands").alias("bands"), F.count("*").alias("copies"))
    one = materialize(one, "texts")
    rows = one.select(F.col("sid").alias("id"), F.explode("bands").alias("key"))
    found = materialize(members(rows), "members")
    labels = link(found, lambda ids: shingles_of(df, ids, text_col), _alike, _neighbours)
    named = one.select("sid", "first", "copies").join(labels, F.col("sid") == F.col("id"), "left").select("sid", "first", "copies", F.coalesce("label", "sid").alias("label"))
    named = materialize(named, "named")
    top = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    of = salted_join(named.select("sid", "label"), top, "label", ["sid"]).select("sid", "first", "class_size")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    worded = salted_join(s.where("sid is not null").select("doc_id", "text_key", "sid"), of, "sid", ["doc_id", "text_key"]).select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"))
    blank = s.where("sid is null").select("doc_id", "text_key")
    copies = F.count("*").over(Window.partitionBy("doc_id", "text_key"))
    named_blank = blank.where("doc_id is not null").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), copies.alias("class_size"), F.lit(True).alias("kept"))
    other_blank = blank.where("doc_id is null").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return worded.unionByName(named_blank).unionByName(other_blank)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, kept): class_id is the smallest doc_id of the class, whose row is kept."""
    return _classed(df, id_col, text_col).select("doc_id", "class_id", "class_size", "kept")


#: A character that Python's split does not take for white space.
_WORD = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that are their class's first document (repeated rows: one; rows without id and words: all)."""
    at, key, own, gone_id, gone_key, none, gone_none = fresh(df, "at", "text_key", "own", "gone_id", "gone_key", "none", "gone_none")
    long = F.col(id_col).cast("long")
    gone = _classed(df, id_col, text_col).where("not kept")
    gone = gone.select(F.coalesce("doc_id", F.lit(0)).alias(gone_id), F.col("doc_id").isNull().alias(gone_none), F.col("text_key").alias(gone_key))
    apart = long.isNull() & ~F.coalesce(F.col(text_col).rlike(_WORD), F.lit(False))
    keyed = df.withColumns({at: F.coalesce(long, F.lit(0)), none: long.isNull(), key: F.xxhash64(text_col), own: F.when(apart, F.monotonically_increasing_id())})
    kept = keyed.join(gone, (F.col(at) == F.col(gone_id)) & (F.col(none) == F.col(gone_none)) & (F.col(key) == F.col(gone_key)), "left_anti")
    return kept.dropDuplicates([at, none, key, own]).drop(at, none, key, own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
