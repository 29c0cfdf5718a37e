"""Document scores by masked pseudo-likelihood.

A bidirectional window network predicts every token from the tokens on both sides, by a softmax in two levels: the classes of the left and
the right neighbour are embedded, added and squashed, a softmax gives the class of the masked token, and within a class a word has its
corpus frequency. A document's score is the sum of the conditional log-probabilities of all its tokens.

Everything is learnt from the whole corpus. Every word, however rare, has the probability within its class of its own count over all
documents, so the probabilities of all words of a class sum to 1. The most frequent words, which every task holds, have classes by frequency; all other words
have classes by hash, so that only the sum of the logarithms of their counts is needed of them, which a join gives. Words are named by 64-bit hashes. Counts of
(left, masked, right) classes over all documents are sufficient statistics of the network's loss, which is minimised on them in numpy by Adam. The number of
frequency classes grows with the ninth root of the tokens, so these cells with the cube root. What reaches the driver is bounded by the frequent words and the cells.

Defined cases: null and empty texts have no tokens, the sum 0 and a null mean; whole texts are read; repeated rows give repeated
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, table

#: Words that every task holds; all others take the join.
VOCABULARY = 100_000
#: Frequency classes up to BASE_TOKENS tokens; more beyond.
CLASSES = 64
#: Classes of the other words, by hash.
RARE = 8
BASE_TOKENS = 4_000_000
EDGE = 0
WIDTH = 16
STEPS = 150
#: Words whose hashes a task remembers.
REMEMBERED = 300_000


class Hasher:
    """64-bit hashes of a text's words; remembers a task's words, boundedly."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) - 2**63
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n) of the words of all documents, summed in each task before the shuffle."""

    def run(batches):
        hashed = Hasher()
        for batch in batches:
            h, n = np.unique(np.concatenate([np.empty(0, np.int64), *map(hashed, batch.column(0).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Lexicon:
    """Classes and log p(word | class) of the frequent words; classes, and the logarithms of their sums, of the others."""

    def __init__(self, h: np.ndarray, n: np.ndarray, rare_mass: np.ndarray):
        """``h``, ``n``: the frequent words, most frequent first; ``rare_mass``: tokens of each class of the others."""
        total = int(n.sum() + rare_mass.sum())
        self.bands = int(CLASSES * max(1.0, total / BASE_TOKENS) ** (1 / 9))
        self.size = self.bands + RARE
        before = np.cumsum(n) - n
        cls = 1 + np.minimum(self.bands - 2, (self.bands - 1) * before // max(int(n.sum()), 1)).astype(np.int64)
        log_p = np.log(n / np.bincount(cls, n, minlength=self.size)[cls]) if len(n) else np.empty(0)
        by = np.argsort(h, kind="stable")
        self.h, self.cls, self.log_p = h[by], cls[by], log_p[by]
        self.log_rare = np.log(np.maximum(rare_mass, 1))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """(classes, known part of the sum of log p(word | class), hashes of the words whose log counts it lacks)."""
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        known = self.h[at] == h if len(self.h) else np.zeros(len(h), dtype=bool)
        rare = h[~known]
        kind = rare_class(rare)
        cls = np.empty(len(h), dtype=np.int64)
        cls[known] = self.cls[at[known]]
        cls[~known] = self.bands + kind
        return cls, float(self.log_p[at[known]].sum() - self.log_rare[kind].sum()), rare


def rare_class(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(40)).astype(np.int64) % RARE


def lexicon(counts: DataFrame) -> Lexicon:
    """The lexicon of an (h, n) table; the driver gets the frequent words and RARE sums."""
    top = counts.orderBy(F.col("n").desc(), "h").limit(VOCABULARY).toArrow()  # bounded by VOCABULARY
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    kind = F.shiftrightunsigned("h", 40) % RARE
    mass = np.zeros(RARE, dtype=np.int64)
    for r in counts.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).collect():  # RARE rows
        mass[r["kind"]] = r["n"]
    return Lexicon(h, n, mass - np.bincount(rare_class(h), n, minlength=RARE).astype(np.int64))


def encoded(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_tokens, within, cls, rare): the known part of the sum of log p(word | class), the tokens' classes as 16-bit integers, the words to ask for."""
    rare_type = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32())]))

    def run(batches):
        hashed = Hasher()
        for batch in batches:
            sizes, within, codes, asked = [], [], [], []
            for t in batch.column(2).to_pylist():
                h = hashed(t)
                cls, known, rare = shared.value(h)
                sizes.append(len(h))
                within.append(known)
                codes.append(cls.astype("<u2").tobytes())
                asked.append(np.unique(rare, return_counts=True))
            offsets = np.concatenate(([0], np.cumsum([len(a[0]) for a in asked]))).astype(np.int32)
            flat = [pa.array(np.concatenate([np.empty(0, np.int64), *(a[i] for a in asked)]).astype(t)) for i, t in ((0, np.int64), (1, np.int32))]
            inner = pa.StructArray.from_arrays(flat, fields=list(rare_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(within, pa.float64()), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), inner)],
                ["row", "doc_id", "n_tokens", "within", "cls", "rare"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, "row long, doc_id long, n_tokens long, within double, cls binary, rare array<struct<h: long, k: int>>")


def _line(codes: list[bytes]) -> np.ndarray:
    """The classes of all texts in one line, with an edge before and after each."""
    edge = np.array([EDGE], dtype="<u2").tobytes()
    return np.frombuffer(edge + b"".join([c + edge for c in codes]), dtype="<u2").astype(np.int64)


def context_counts(coded: DataFrame, size: int) -> DataFrame:
    """(cell, n): how often class b stands between classes a and c, cell = (a * size + c) * size + b; size**3 rows at most."""

    def run(batches):
        total = np.zeros(size**3, dtype=np.int64)
        for batch in batches:
            cls = _line(batch.column(0).to_pylist())
            a, b, c = cls[:-2], cls[1:-1], cls[2:]
            inside = b != EDGE
            np.add.at(total, ((a * size + c) * size + b)[inside], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return coded.select("cls").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def fit(cells: np.ndarray, n: np.ndarray, size: int = CLASSES, seed: int = 5) -> np.ndarray:
    """log p(class | left, right) as a (C * C, C) table, from the network trained on the counts."""
    rng = np.random.default_rng(seed)
    count = np.zeros((size * size, size))
    count.reshape(-1)[cells] = n
    weight = count / max(count.sum(), 1)
    mass = weight.sum(1, keepdims=True)
    prior = np.log(count.sum(0) + 1) - np.log(count.sum() + size)
    p = {"l": rng.normal(0, 0.3, (size, WIDTH)), "r": rng.normal(0, 0.3, (size, WIDTH)), "b": np.zeros(WIDTH), "o": rng.normal(0, 0.1, (WIDTH, size)), "c": prior}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}

    def forward():
        h = np.tanh((p["l"][:, None] + p["r"][None] + p["b"]).reshape(-1, WIDTH))
        z = h @ p["o"] + p["c"]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    for t in range(1, STEPS + 1):
        h, logq = forward()
        dz = np.exp(logq) * mass - weight
        dh = (dz @ p["o"].T) * (1 - h * h)
        cube = dh.reshape(size, size, WIDTH)
        g = {"l": cube.sum(1), "r": cube.sum(0), "b": dh.sum(0), "o": h.T @ dz, "c": dz.sum(0)}
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - 0.03 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-9)
    return forward()[1].astype(np.float32)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood)."""
    spark = docs.sparkSession
    prepare(spark)
    counts = materialize(word_counts(docs, text_col), "words")
    words = lexicon(counts)
    size = words.size
    coded = materialize(encoded(docs, spark.sparkContext.broadcast(words), id_col, text_col), "coded")
    asked = coded.select("row", F.inline("rare")).join(counts, "h").groupBy("row").agg(F.sum(F.col("k") * F.log("n")).alias("more"))
    counted = context_counts(coded, size).toArrow()
    net = spark.sparkContext.broadcast(fit(counted.column("cell").to_numpy(), counted.column("n").to_numpy(), size))

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            if not len(sizes):
                continue
            cls = _line(batch.column(3).to_pylist())
            a, b, c = cls[:-2], cls[1:-1], cls[2:]
            each = np.where(b == EDGE, 0.0, net.value[a * size + c, b].astype(np.float64))
            ends = np.cumsum(sizes + 1)
            run_sum = np.concatenate(([0.0], np.cumsum(each), [each.sum()]))
            begin = ends - sizes - 1
            total = run_sum[begin + sizes] - run_sum[begin] + batch.column(2).to_numpy()
            mean = np.divide(total, sizes, where=sizes > 0, out=np.zeros(len(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(mean, mask=sizes == 0)], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    whole = coded.join(asked, "row", "left").select("doc_id", "n_tokens", (F.col("within") + F.coalesce("more", F.lit(0.0))).alias("within"), "cls")
    return whole.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
