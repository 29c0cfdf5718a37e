"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector (words that enough training documents hold) plus the mean of its character trigrams' vectors
(any word). Two gated recurrent layers read a window from both sides, attention pools the states, and a
linear unit gives the window's log-odds. All overlapping windows of a text are scored (``WINDOW`` words, each starting
``STRIDE`` after the one before) and the highest is the document's score.

Trained in numpy by back-propagation through time on a bounded sample of labelled rows (``SAMPLE``). A label names a
document and not a place in it, so each round trains on the window of a toxic document that scores highest, and on the
highest and a random window of a clean one; a toxic document without any window that looks toxic is left out of
the round as mislabelled.

Defined cases: null and empty texts score as the empty window of padding; whole texts are read, however long; repeated rows give
repeated rows; labels, lang, source and doc_id are never inputs; with no labels to learn from every score is 0.5; an
empty table gives no rows; a null id is scored and not held out; other columns are ignored.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .labels import held_out, labelled, remainder

SAMPLE = 2400
WINDOW, STRIDE = 24, 16
D_WORD, D_CHAR, HIDDEN = 8, 8, 8
TRIGRAMS = 1 << 12
LEAST_DOCS = 3
ROUNDS = 4
#: Updates of a round; small samples are read more often for it.
LEAST_UPDATES = 60
#: A toxic document none of whose windows looks toxic so far (log-odds) is taken for mislabelled and not learnt from.
UNLIKELY = -1.5
THRESHOLD = 0.3
PAD, RARE = 0, 1
STRIP = ".,;:!?\"'()[]{}<>|*#$%&~@+=-_/\\`^"


def tokens(text: str) -> list[str]:
    return text.lower().split()


class Numbers(dict):
    """A lexicon's numbers; gives a new word the next one."""

    def __init__(self, lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        lex = self.lexicon
        plain = word.strip(STRIP) or word
        self[word] = k = len(lex.plain)
        lex.plain.append(plain)
        lex.word_ids.append(lex.vocabulary.get(plain, RARE))
        return k


class Lexicon:
    """Numbers for tokens: 0 is padding, a task's distinct words follow; remembers boundedly many."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.number = Numbers(self)
        self.plain: list[str] = [""]
        self.word_ids: list[int] = [PAD]

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of ^word$, all words in one line, and where each word's begin."""
    coded = [f"^{w}$".encode() for w in words]
    raw = np.frombuffer(b"".join(coded) + b"\0\0", dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(c) for c in coded])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = ((raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * 2654435761 >> 12) & (TRIGRAMS - 1)
    keep = np.ones(len(h), dtype=bool)
    ends = begin + sizes
    keep[ends - 1] = False
    long = sizes >= 3
    keep[(ends - 2)[long]] = False
    counts = np.where(long, sizes - 2, sizes - 1)
    return h[keep], np.concatenate(([0], np.cumsum(counts)[:-1]))


def windows(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW token numbers, document of each window); a document has one window at least."""
    sizes = np.array([len(x) for x in numbers])
    count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    line = np.concatenate([*numbers, np.zeros(WINDOW, dtype=np.int32)])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[doc] + nth * STRIDE
    at = (start[:, None] + np.arange(WINDOW)).astype(np.int64)
    inside = at < (begin + sizes)[doc][:, None]
    return np.where(inside, line[np.minimum(at, len(line) - 1)], PAD), doc


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, n_words: int, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 0.3 / np.sqrt(s[0]) if len(s) > 1 and s[0] < 100 else 0.1, s).astype(np.float32)
        d, h = D_WORD + D_CHAR, HIDDEN
        self.p = {
            "word": g(n_words, D_WORD), "char": g(TRIGRAMS, D_CHAR), "a": np.zeros(2 * h, np.float32), "o": g(2 * h, 1)[:, 0], "b": np.zeros(1, np.float32),
            **{k + s: v for s in "fb" for k, v in (("w", g(d, 3 * h) * 3), ("u", g(h, 3 * h)), ("c", np.zeros(3 * h, np.float32)))},
        }
        self.p["word"][PAD] = 0
        self.p["word"][RARE] = 0

    def inputs(self, word_ids, plain):
        """Vectors of distinct words; row 0, the padding, is zero."""
        x = np.zeros((len(plain), D_WORD + D_CHAR), dtype=np.float32)
        x[:, :D_WORD] = self.p["word"][word_ids]
        tri, begin = trigrams(plain)
        n = np.diff(np.concatenate((begin, [len(tri)])))
        x[:, D_WORD:] = np.add.reduceat(self.p["char"][tri], begin, axis=0) / n[:, None]
        x[0] = 0
        return x, (tri, begin, n)

    def _read(self, xp, mask, side, keep):
        """Hidden states of one direction, (time, batch, HIDDEN)."""
        h = HIDDEN
        u = self.p["u" + side]
        state = np.zeros((xp.shape[0], h), dtype=np.float32)
        out = np.zeros((xp.shape[1], xp.shape[0], h), dtype=np.float32)
        steps = range(xp.shape[1]) if side == "f" else range(xp.shape[1] - 1, -1, -1)
        trace = []
        for t in steps:
            x = xp[:, t]
            s = state @ u
            zr = 1 / (1 + np.exp(-(x[:, :2 * h] + s[:, :2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h:] + r * s[:, 2 * h:])
            m = mask[:, t, None]
            new = state + m * (1 - z) * (n - state)
            if keep:
                trace.append((t, state, s[:, 2 * h:], z, r, n, m))
            state = new
            out[t] = state
        return out, trace

    def _tables(self, x, side):
        proj = x @ self.p["w" + side] + self.p["c" + side]
        return np.ascontiguousarray(-proj[:, :2 * HIDDEN]), np.ascontiguousarray(proj[:, 2 * HIDDEN:])

    def _scan(self, tables, at, side):
        """As ``_read`` without a trace, for scoring: gathers step by step and works in place."""
        h, b = HIDDEN, len(at)
        gates, cand = tables
        u = self.p["u" + side]
        ug, uc = np.ascontiguousarray(-u[:, :2 * h]), np.ascontiguousarray(u[:, 2 * h:])
        state = np.zeros((b, h), dtype=np.float32)
        out = np.empty((at.shape[1], b, h), dtype=np.float32)
        g, n, s = np.empty((b, 2 * h), np.float32), np.empty((b, h), np.float32), np.empty((b, 2 * h), np.float32)
        columns = np.ascontiguousarray(at.T)
        for t in range(at.shape[1]) if side == "f" else range(at.shape[1] - 1, -1, -1):
            col = columns[t]
            np.take(gates, col, axis=0, out=g, mode="clip")
            np.matmul(state, ug, out=s)
            g += s
            np.minimum(g, 80, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.matmul(state, uc, out=n)
            n *= g[:, h:]
            n += np.take(cand, col, axis=0)
            np.tanh(n, out=n)
            n -= state
            n *= 1 - g[:, :h]
            if not col.all():
                n *= (col != PAD)[:, None]
            state = np.add(state, n, out=out[t])
        return out

    def scores(self, x, every, batch=1024):
        """Log-odds of windows, without what training needs."""
        tables = {s: self._tables(x, s) for s in "fb"}
        out = np.empty(len(every), dtype=np.float32)
        for i in range(0, len(every), batch):
            at = every[i:i + batch]
            hid = np.concatenate([self._scan(tables[s], at, s) for s in "fb"], axis=2)
            e = hid @ self.p["a"] + ((at.T != PAD) - np.float32(1)) * np.float32(30)
            e -= e.max(0)
            np.exp(e, out=e)
            out[i:i + batch] = (e * (hid @ self.p["o"])).sum(0) / e.sum(0)
        return out + self.p["b"][0]

    def forward(self, x, at, keep=False):
        """Log-odds of windows ``at`` (numbers into ``x``)."""
        mask = (at != PAD).astype(np.float32)
        states, traces, proj = [], [], {}
        for s in "fb":
            proj[s] = x @ self.p["w" + s] + self.p["c" + s]
            out, trace = self._read(proj[s][at], mask, s, keep)
            states.append(out)
            traces.append(trace)
        hid = np.concatenate(states, axis=2)  # time, batch, 2h
        e = hid @ self.p["a"] + (mask.T - 1) * 30
        e -= e.max(0)
        alpha = np.exp(e)
        alpha /= alpha.sum(0)
        pooled = np.einsum("tb,tbh->bh", alpha, hid)
        logit = pooled @ self.p["o"] + self.p["b"][0]
        return (logit, (x, at, mask, hid, alpha, pooled, traces)) if keep else logit

    def backward(self, cache, err):
        """Gradients of sum(err * logit); for the word vectors, of the rows of ``x``."""
        x, at, mask, hid, alpha, pooled, traces = cache
        h, g = HIDDEN, {}
        g["b"] = np.array([err.sum()])
        g["o"] = pooled.T @ err
        dpool = err[:, None] * self.p["o"]
        dalpha = np.einsum("bh,tbh->tb", dpool, hid)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["a"] = np.einsum("tb,tbh->h", de, hid)
        dhid = alpha[:, :, None] * dpool + de[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for k, s in enumerate("fb"):
            u = self.p["u" + s]
            du = np.zeros_like(u)
            dproj = np.zeros((*at.shape, 3 * h), dtype=np.float32)
            ds = np.zeros((len(at), h), dtype=np.float32)
            for t, before, sn, z, r, n, m in reversed(traces[k]):
                d = ds + dhid[t][:, k * h:(k + 1) * h]
                dn = d * m * (1 - z) * (1 - n * n)
                dz = -d * m * (n - before) * z * (1 - z)
                dr = dn * sn * r * (1 - r)
                dpre = np.concatenate((dz, dr, dn), axis=1)
                dsu = np.concatenate((dz, dr, dn * r), axis=1)
                dproj[:, t] = dpre
                du += before.T @ dsu
                ds = d * (1 - m * (1 - z)) + dsu @ u.T
            g["u" + s] = du
            rows = np.zeros((len(x), 3 * h), dtype=np.float32)
            np.add.at(rows, at.ravel(), dproj.reshape(-1, 3 * h))
            rows[0] = 0
            g["w" + s] = x.T @ rows
            g["c" + s] = dproj.sum((0, 1))
            dx += rows @ self.p["w" + s].T
        return g, dx


def fit(texts: list[str], y: np.ndarray, seed: int = 11):
    """(network, vocabulary) from labelled texts."""
    rng = np.random.default_rng(seed)
    seen: dict[str, np.ndarray] = {}
    for t, label in zip(texts, y):
        for w in {x.strip(STRIP) or x for x in tokens(t)}:
            seen.setdefault(w, np.zeros(2))[int(label)] += 1
    least = max(LEAST_DOCS, round(np.sqrt(len(y)) / 8))
    kept = sorted(w for w, c in seen.items() if c.sum() >= least)
    vocabulary = {w: 2 + i for i, w in enumerate(kept)}
    net = Network(len(kept) + 2)
    if len(set(y)) < 2:
        net.p["o"][:] = 0
        return net, vocabulary
    size = np.bincount(y.astype(int), minlength=2) + 1.0
    odds = np.array([np.log((seen[w][1] + 0.5) / size[1]) - np.log((seen[w][0] + 0.5) / size[0]) for w in kept])
    strength = odds * np.array([min(1, np.sqrt(seen[w].sum() / 20)) for w in kept])
    net.p["word"][2:, 0] = strength / 2
    lex = Lexicon(vocabulary)
    numbers = [lex(tokens(t)) for t in texts]
    ids, plain = np.array(lex.word_ids), lex.plain
    at, doc = windows(numbers)
    first = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
    count = np.diff(np.concatenate((first, [len(doc)])))
    prior = np.concatenate(([0, 0], strength))[ids][at].max(1)
    m1, m2, step = {}, {}, 0
    square = {k: np.zeros_like(net.p[k]) for k in ("word", "char")}
    for round_ in range(ROUNDS):
        if round_ == 0:
            s = prior
        else:
            x = net.inputs(ids, plain)[0]
            s = net.scores(x, at)
        best = np.array([a + int(np.argmax(s[a:a + n])) for a, n in zip(first, count)])
        other = first + (rng.random(len(first)) * count).astype(int)
        clean = y == 0
        learn = clean | (s[best] > (np.quantile(s[best][clean], 0.98) if round_ == 0 else UNLIKELY))
        use = np.concatenate((best[learn], other[clean]))
        target = np.concatenate((y[learn], np.zeros(clean.sum())))
        parts = max(1, len(use) // 96)
        for epoch in range(max(2, -(-LEAST_UPDATES // parts))):
            for part in np.array_split(rng.permutation(len(use)), parts):
                w, inv = np.unique(np.concatenate(([PAD], at[use[part]].ravel())), return_inverse=True)
                inv = inv[1:].reshape(-1, WINDOW)
                wid = ids[w].copy()
                wid[(rng.random(len(w)) < 0.05) & (w > 0)] = RARE
                x, (tri, begin, n) = net.inputs(wid, [plain[i] for i in w])
                logit, cache = net.forward(x, inv, keep=True)
                err = ((sigmoid(logit) - target[part]) / len(part)).astype(np.float32)
                g, dx = net.backward(cache, err)
                # tables: Adagrad on the rows of this batch; the rest: Adam
                for k, rows, grad in (("word", wid, dx[:, :D_WORD]), ("char", tri, np.repeat(dx[:, D_WORD:] / n[:, None], n, axis=0))):
                    u, place = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(u), grad.shape[1]), np.float32)
                    np.add.at(total, place, grad)
                    total += 1e-5 * net.p[k][u]
                    if k == "word":
                        total[u < 2] = 0
                    square[k][u] += total * total
                    net.p[k][u] -= 0.05 * total / np.sqrt(square[k][u] + 1e-8)
                step += 1
                for k in g:
                    grad = g[k] + 1e-5 * net.p[k]
                    m1[k] = 0.9 * m1.get(k, 0) + 0.1 * grad
                    m2[k] = 0.99 * m2.get(k, 0) + 0.01 * grad * grad
                    net.p[k] = (net.p[k] - 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net, vocabulary


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """A model from at most ``most`` labelled rows outside the held-out fold."""
    rows = labelled(docs, labels, "toxic", remainder("doc_id", 4) != 2, most)
    return fit(rows["text"].tolist(), rows["y"].to_numpy(float))


def scorer(model):
    """texts -> scores, for one task."""
    net, vocabulary = model
    lex = Lexicon(vocabulary)

    def run(texts: list[str | None]) -> np.ndarray:
        gc.disable()
        try:
            if len(lex.plain) > 300_000:
                lex.reset()
            numbers = [lex(tokens(t or "")) for t in texts]
            at, doc = windows(numbers)
            here = np.zeros(len(lex.plain), dtype=bool)
            here[at.ravel()] = True
            here[PAD] = True
            used = np.flatnonzero(here)
            at = (np.cumsum(here) - 1).astype(np.int32)[at]
            x = net.inputs(np.array(lex.word_ids)[used], [lex.plain[i] for i in used])[0]
            s = net.scores(x, at)
            return sigmoid(np.maximum.reduceat(s, np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1)))).astype(float)
        finally:
            gc.enable()

    return run


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        rate = scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                p = rate(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 4, 2).alias("held_out"), text_col).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text is not predicted toxic."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    k = df.columns.index(text_col)

    def run(batches):
        rate = scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(rate(batch.column(k).to_pylist()) < THRESHOLD))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
