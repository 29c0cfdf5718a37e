"""Each operator against brute force, an exact round trip, or planted cases; nulls, ties, empty tables, clashing columns."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, op1_substrings, op2_lines, op3_bpe, op4_quality, op5_lm, op6_minhash, op7_topk, op8_decontaminate, op9_sharding, op10_toxicity

DOCS = "doc_id long, text string, ids string, n_tokens string, _doc string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_components_of_a_long_path(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in common.components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert common.components(e.limit(0)).count() == 0


def test_substrings_equal_brute_force(spark):
    rng, length = random.Random(3), op1_substrings.LENGTH
    base = "".join(rng.choice("abcdé \n") for _ in range(1500))
    texts = [None, "", "x" * 200, "x" * 201, "abcdefghij" * 45, base[:300], base[100:500], base, base[:250] + "Z" + base[251:600], base]
    count, raws = Counter(), [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i:i + length]] += 1
    got = {r.doc_id: r for r in op1_substrings.dedup(docs(spark, texts)).collect()}
    for k, r in enumerate(raws):
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(r, cover) if not c)
        assert (got[k].n_bytes, got[k].n_removed, bytes(got[k].kept)) == (len(r), len(r) - len(kept), kept)
        assert got[k].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert got[k].n_spans == sum(1 for i in range(len(r)) if cover[i] and (i == 0 or not cover[i - 1]))


def covered(raws, length):
    """Bytes of each text under a string that starts twice."""
    count = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        out.append(cover)
    return out


def spread(rng, n, size=300):
    """Texts that share a middle and differ by single bytes on either side."""
    base = bytes(rng.randrange(97, 100) for _ in range(size))
    out = []
    for _ in range(n):
        s = bytearray(base)
        for _ in range(rng.randrange(1, 4)):
            s[rng.randrange(size)] = rng.randrange(88, 92)
        out.append(bytes(s))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_shards_of_an_anchor_merge_to_the_brute_force_spans(monkeypatch, shard):
    monkeypatch.setattr(op1_substrings, "SHARD_BYTES", shard)
    texts = spread(random.Random(5), 60)
    texts += [texts[0], texts[1][:250]]
    groups: dict = {}
    a, owner, p, s0, s1 = op1_substrings.anchors(texts)
    for k, o, at, x, y in zip(a.tolist(), owner.tolist(), p.tolist(), s0.tolist(), s1.tolist()):
        seg = texts[o][x:y + op1_substrings.LENGTH]
        v = groups.setdefault(k, {}).setdefault(seg, [0, at - x, []])
        v[0] += 1
        v[2].append((o, x))
    lists = [[(v[0], v[1], seg) for seg, v in g.items()] for g in groups.values()]
    places = [v[2] for g in groups.values() for v in g.values()]
    got = [bytearray(len(t)) for t in texts]
    for k, x, y in zip(*(z.tolist() for z in op1_substrings.repeats(lists))):
        for o, at in places[k]:
            got[o][at + x:at + y] = b"\1" * (y - x)
    assert got == covered(texts, op1_substrings.LENGTH)


@pytest.mark.parametrize("hot", [1 << 20, 12, 1])
def test_hot_anchor_is_dealt_over_tasks(spark, monkeypatch, hot):
    monkeypatch.setattr(op1_substrings, "HOT_ROWS", hot)
    raws = spread(random.Random(7), 50)
    got = {r.doc_id: r for r in op1_substrings.dedup(docs(spark, [r.decode() for r in raws]).repartition(8)).collect()}
    for k, (r, cover) in enumerate(zip(raws, covered(raws, op1_substrings.LENGTH))):
        assert bytes(got[k].kept) == bytes(b for b, c in zip(r, cover) if not c)


def test_the_way_back_of_a_hot_segment_grows_with_its_batches(spark, monkeypatch):
    """One text in n batches: its segments are covered once each, and meet one row a batch and place."""
    monkeypatch.setattr(op1_substrings, "HOT_ROWS", 4)
    text = "".join(random.Random(9).choice("abcdefgh ") for _ in range(420))
    common.prepare(spark)
    whole = common.Bitset(np.full(1 << 12, 2**64 - 1, dtype=np.uint64))
    keep = spark.sparkContext.broadcast(whole.words)
    grown = []
    for n in (6, 12):
        d = spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string").repartition(n)
        t = d.select(*op1_substrings._key(F.col("text")), "text")
        found = common.materialize(t.mapInArrow(op1_substrings._segments(keep), op1_substrings.SEGMENTS), "test")
        cover = common.materialize(op1_substrings.covers(found), "test")
        assert cover.count() == cover.select("anchor", "seg_id", "a", "b").distinct().count()
        assert cover.select("anchor", "seg_id").distinct().count() == found.select("anchor", "seg_id").distinct().count()
        grown.append((cover.count(), op1_substrings.places(found, cover).count()))
    assert grown[0][0] == grown[1][0] and grown[1][1] <= 2 * grown[0][1]
    assert {r.n_removed for r in op1_substrings.dedup(d).collect()} == {420}


def test_substrings_of_an_empty_table_and_of_clashing_columns(spark):
    d = docs(spark, ["a" * 300, None]).withColumnsRenamed({"ids": "key", "n_tokens": "seg", "_doc": "spans"})
    assert op1_substrings.dedup(d.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_removed) for r in op1_substrings.dedup(d, content=False).collect()) == [(0, 300), (1, 0)]


def test_lines_keep_one_of_a_component(spark):
    line = "the quick brown fox jumps over the lazy dog and then rests under a very old oak tree until the evening comes again"
    texts = [f"{line}\nonly here", f"other\n\n{line.upper()}  ", f"{line}s", None, "", "other"]
    rows = {r.doc_id: r for r in op2_lines.dedup(docs(spark, texts), counts=True).collect()}
    assert [rows[i].text for i in range(6)] == [texts[0], "other\n", "", None, "", ""]
    assert rows[1].n_lines == 3 and rows[1].n_kept == 2 and rows[0].ids == "x"
    assert op2_lines.dedup(docs(spark, texts).limit(0)).count() == 0


def line_jaccard(x, y):
    a, b = ({z[i:i + 8] for i in range(max(1, len(z) - 7))} for z in (x, y))
    return len(a & b) / len(a | b)


def brute_lines(texts):
    """Texts after line dedup by comparing all pairs of lines, keeping the first line of each component."""
    rows = [(d, n, " ".join(x.lower().split())) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    forms = sorted({f for *_, f in rows if f})
    root = {f: f for f in forms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(forms):
        for y in forms[:i]:
            if line_jaccard(x, y) >= 0.8:
                root[find(x)] = find(y)
    seen, out = set(), [[] for _ in texts]
    for d, n, f in rows:
        if f and find(f) in seen:
            continue
        if f:
            seen.add(find(f))
        out[d].append((texts[d] or "").split("\n")[n])
    return [None if t is None else "\n".join(x) for t, x in zip(texts, out)]


def fuzzy_lines(rng, n):
    base = [prose(rng, rng.randrange(3, 60)) for _ in range(25)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.choice((0, 0, 1, 2))):
                words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
            lines.append(" ".join(words))
        out.append("\n".join(lines))
    return out


def test_lines_equal_brute_force(spark):
    texts = [*fuzzy_lines(random.Random(17), 120), None, "", "\n\n", "a\na\nA "]
    got = [r.text for r in op2_lines.dedup(docs(spark, texts).repartition(7)).orderBy("doc_id").collect()]
    want = brute_lines(texts)
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(texts)  # banding may miss a pair at the threshold
    assert got[-4:] == want[-4:]


def test_lines_of_rows_without_id_of_twins_and_of_clashing_columns(spark):
    rows = [(None, "same line here\nx"), (1, "same line here\nx"), (1, "same line here\nx"), (1, "same line here\ny"), (2, "same line here\nx")]
    d = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, lost string, at string, lines string")
    got = Counter((r.doc_id, r.text, r.lost, r.at, r.lines) for r in op2_lines.dedup(d).collect())
    first, other = sorted(("same line here\nx", "same line here\ny"), key=lambda t: spark.sql(f"SELECT xxhash64('{t}')".replace("\n", "\\n")).first()[0])
    own = {t: t if t == first else t.split("\n")[1] for t in (first, other)}
    assert got == Counter({(None, "same line here\nx", "a", "b", "c"): 1, (1, own["same line here\nx"], "a", "b", "c"): 2, (1, own["same line here\ny"], "a", "b", "c"): 1, (2, "", "a", "b", "c"): 1})


def test_lines_that_repeat_a_phrase_meet_the_phrase(spark):
    rng = random.Random(13)
    for _ in range(20):
        phrase = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
        once, often = phrase + phrase[:7], phrase * 4
        assert line_jaccard(once, often) >= 0.8
        shared = [set(sig[list(at).index(0)]) & set(sig[list(at).index(1)]) for at, sig in op2_lines.signatures([once, often]) if {0, 1} <= set(at)]
        assert any(len(s) >= 0.5 * op2_lines.REGISTERS for s in shared)
    texts = [once, often, " ".join(["word"] * 10), " ".join(["word"] * 50)]
    assert [r.text for r in op2_lines.dedup(docs(spark, texts)).orderBy("doc_id").collect()] == [once, "", texts[2], ""]


def test_bpe_equals_the_library_and_round_trips(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = op3_bpe.default_vocabulary()
    m = op3_bpe.Merges(open(path, "rb").read(), pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=m.ranks, special_tokens={})
    rng = random.Random(1)
    texts = [None, "", " ", "aaaa aaaaa", "it's\n\n  fine ", "héé 12  3 x", "<|endoftext|>", "!" * 99, *["".join(rng.choice("ab cdE\n'1é🙂") for _ in range(80)) for _ in range(60)]]
    rows = {r.doc_id: r for r in op3_bpe.digests(docs(spark, texts)).collect()}
    ids = {r.doc_id: list(r.ids) for r in op3_bpe.encode(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert ids[i] == want and rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=50), rng.normal(size=(50, 4))
    ids, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(v[ids[i]] @ v[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(op4_quality._margins((0.5, w, v), ids, x, np.array([0]))[0][0], 0.5 + w[ids] @ x + pairs)


def test_quality_learns_junk(spark):
    rng = random.Random(2)
    texts = [prose(rng, 60) if i % 2 else " ".join(w + "$$$" for w in prose(rng, 60).split()) for i in range(200)]
    d = docs(spark, [*texts, None, ""])
    y = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = op4_quality.score(d, op4_quality.train(d, y)).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 200]
    assert len(rows) == 202 and held and all(r.predicted == r.doc_id % 2 for r in held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in op4_quality.score(d, op4_quality.train(d, y.limit(0))).collect()} == {0.5}
    assert op4_quality.score(d.limit(0), op4_quality.train(d, y)).count() == 0


def test_network_gradients_are_right():
    net = op10_toxicity.Network(6, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["a"] += 0.3
    x = np.random.default_rng(2).normal(size=(5, op10_toxicity.D_WORD + op10_toxicity.D_CHAR)).astype(np.float32)
    x[0] = 0
    at = np.array([[1, 2, 3, 4], [2, 2, 0, 0]])
    err = np.array([0.7, -0.4], dtype=np.float32)
    _, cache = net.forward(x, at, keep=True)
    g, _ = net.backward(cache, err)
    for k in ("wf", "ub", "a", "o", "cb"):
        flat, grad = net.p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in (0, len(flat) // 2, len(flat) - 1):
            old = flat[i]
            flat[i] = old + 1e-2
            up = net.forward(x, at) @ err
            flat[i] = old - 1e-2
            down = net.forward(x, at) @ err
            flat[i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 2e-3, k


def test_toxicity_learns_a_word(spark):
    rng = random.Random(4)
    texts = [prose(rng, 80) for _ in range(160)]
    for i in range(0, 160, 4):
        w = texts[i].split()
        w.insert(rng.randrange(80), "vilest")
        texts[i] = " ".join(w)
    d = docs(spark, [*texts, None, "", "plain vilest words"])
    y = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    model = op10_toxicity.train(d, y)
    rows = {r.doc_id: r for r in op10_toxicity.score(d, model).collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id < 160]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)
    assert rows[162].predicted == 1 and rows[160].score == rows[161].score
    assert op10_toxicity.keep_clean(d, model).columns == d.columns


def test_lm_predicts_from_both_sides(spark):
    texts = ["a b " * 25] * 30 + [None, "", "a a b b " * 12]
    rows = {r.doc_id: r for r in op5_lm.score(docs(spark, texts)).collect()}
    assert rows[30].n_tokens == 0 and rows[30].log_likelihood == 0 and rows[31].mean_log_likelihood is None
    assert rows[32].mean_log_likelihood < rows[0].mean_log_likelihood < 0
    assert np.isclose(rows[0].log_likelihood, rows[0].mean_log_likelihood * 50)
    table = op5_lm.fit(np.array([5, 70, 4242]), np.array([3, 1, 9]))
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-4)


def test_lm_scores_equal_brute_force_with_rare_words(spark, monkeypatch):
    """Every token's log p(class | neighbours) + log p(word | class), added up from plain counts."""
    monkeypatch.setattr(op5_lm, "VOCABULARY", 40)
    rng = random.Random(23)
    texts = [prose(rng, rng.randrange(1, 60), words=300) for _ in range(60)] + [None, "", "once", "w1 once"]
    texts += texts[:3]
    d = docs(spark, texts)
    words = op5_lm.lexicon(op5_lm.word_counts(d))
    count = Counter(w for t in texts for w in (t or "").split())
    hashed = op5_lm.Hasher()
    cls = {w: int(words(hashed(w))[0][0]) for w in count}
    mass = Counter()
    for w, n in count.items():
        mass[cls[w]] += n
    assert len(words.h) == 40 and sum(c >= words.bands for c in cls.values()) == len(count) - 40
    cells = Counter()
    for t in texts:
        c = [op5_lm.EDGE, *(cls[w] for w in (t or "").split()), op5_lm.EDGE]
        cells.update((a * words.size + r) * words.size + b for a, b, r in zip(c, c[1:], c[2:]))
    at = sorted(cells)
    net = op5_lm.fit(np.array(at), np.array([cells[k] for k in at]), words.size)
    rows = {r.doc_id: r for r in op5_lm.score(d.repartition(5)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        c = [op5_lm.EDGE, *(cls[x] for x in w), op5_lm.EDGE]
        want = sum(float(net[a * words.size + r, b]) + np.log(count[x] / mass[b]) for x, a, b, r in zip(w, c, c[1:], c[2:]))
        assert rows[i].n_tokens == len(w) and np.isclose(rows[i].log_likelihood, want, rtol=1e-5, atol=1e-5)
    big, small = (op5_lm.Lexicon(np.array([1]), np.array([n]), np.zeros(op5_lm.RARE, np.int64)) for n in (5_000_000_000, 5_000))
    assert big.bands > small.bands == op5_lm.CLASSES
    assert op5_lm.score(d.limit(0)).count() == 0


def test_similarity_by_definition():
    rng = random.Random(7)
    for _ in range(20):
        a = {rng.randrange(30): rng.randrange(1, 4) for _ in range(12)}
        b = {rng.randrange(30): rng.randrange(1, 4) for _ in range(12)}
        pack = lambda d: (np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)]))
        wa, wb = ({k: 1 + np.log(v) for k, v in d.items()} for d in (a, b))
        want = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in {*a, *b}) for i in {*a} & {*b})
        got = op6_minhash.similarity(*pack(a), *pack(b))
        assert np.isclose(got[0], want) and np.isclose(got[1], len({*a} & {*b}) / len({*a, *b}))


def test_signatures_estimate_probability_jaccard():
    ha, hb = (common.mix64(np.arange(a, b, dtype=np.uint64)) for a, b in ((0, 300), (30, 330)))
    w = np.ones(300)
    s = op6_minhash.signatures(np.concatenate((ha, hb)), np.concatenate((w, w)), np.repeat([0, 1], 300), 2, registers=2048)
    assert abs((s[0] == s[1]).mean() - 270 / 330) < 0.04


def test_near_duplicates_form_classes(spark):
    rng = random.Random(8)
    base = prose(rng, 200, 5000).split()
    near = [*base]
    near[100] = "changed"
    chain = [*near]
    chain[10] = "moved"
    texts = [" ".join(base), prose(rng, 200, 5000), " ".join(near), " ".join(chain), None, "", " ".join(base).upper(), "one two"]
    got = {r.doc_id: r.class_id for r in op6_minhash.classes(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 5, 6: 0, 7: 7}
    kept = op6_minhash.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 5, 7] and kept.columns == docs(spark, texts).columns
    assert op6_minhash.classes(docs(spark, texts).limit(0)).count() == 0


def test_repeated_shingles_lift_low_set_jaccard():
    pack = lambda own, n: (np.concatenate((np.arange(10), own)).astype(np.uint64).view(np.int64), np.array([n] * 10 + [1] * len(own)))
    for own, n in ((6, 100), (8, 1000), (30, 2)):
        rows = [pack(np.arange(100 * k, 100 * k + own), n) for k in (1, 2)] + [pack(np.arange(300, 400), 1)]
        near = op6_minhash._neighbours(pa.table({"hashes": pa.array([r[0] for r in rows], pa.list_(pa.int64())), "counts": pa.array([r[1] for r in rows], pa.list_(pa.int32()))}))(0, len(rows))
        for i, a in enumerate(rows):
            want = [max(op6_minhash.similarity(a[0].view(np.uint64), a[1], b[0].view(np.uint64), b[1])) >= 0.8 for b in rows]
            assert list(near(i)) == want
        assert near(0)[1] == (n > 2)


def test_equal_sets_with_other_counts_are_candidates(spark):
    rng = random.Random(14)
    words = prose(rng, 60, 5000).split()
    texts = [" ".join(words), " ".join(words[:30] * 1 + words[30:35] * 400 + words[30:])]
    a, b = (op6_minhash.Shingler()(t) for t in texts)
    assert op6_minhash.similarity(*a, *b)[1] >= 0.8 > op6_minhash.similarity(*a, *b)[0]
    bands = [set(r.bands) for r in op6_minhash.signed(docs(spark, texts)).orderBy("doc_id").collect()]
    assert len(bands[0]) == op6_minhash.BANDS < len(bands[1]) and bands[0] & bands[1]
    assert {r.class_id for r in op6_minhash.classes(docs(spark, texts)).collect()} == {0}


def test_rows_without_id_or_with_a_shared_one_are_told_apart(spark):
    rng = random.Random(15)
    a, b, c, d, e = (prose(rng, 60, 5000) for _ in range(5))
    rows = [(None, a), (None, a.upper()), (None, b), (None, None), (None, None), (None, " \u2003"), (1, c), (None, c), (7, d), (7, e), (7, e), (8, None), (8, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in op6_minhash.classes(t).collect())
    assert got == {(None, None, 2, True): 1, (None, None, 2, False): 1, (None, None, 1, True): 4, (1, 1, 2, True): 1, (None, 1, 2, False): 1, (7, 7, 1, True): 1, (7, 7, 2, True): 2, (8, 8, 2, True): 2}
    kept = [(r.doc_id, r.text if r.text not in (a, a.upper()) else a) for r in op6_minhash.keep_one(t).collect()]
    assert Counter(kept) == Counter([(None, a), (None, b), (None, None), (None, None), (None, " \u2003"), (1, c), (7, d), (7, e), (8, None)])


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-40, 40, (300, 16)) / 64
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [0.5])]
    v = op7_topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in op7_topk.top_k(v.where("vec_id % 20 = 0"), v, 20, candidate_block=120, query_block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    z = np.floor(x * 64).astype(int)
    for q in range(0, 300, 20):
        s = sorted((-int(z[q] @ z[i]), i) for i in range(300) if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -t) for k, (t, i) in enumerate(s)]
    assert set(got) == set(range(0, 300, 20))


def test_bounds_resolve_queries_without_all_candidates():
    rng = np.random.default_rng(16)
    x = rng.normal(size=(2000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids, at = np.arange(2000), np.arange(0, 2000, 20)
    keep, left = op7_topk.bounded(ids[at], x[at], ids, x, 20, np.float32)
    assert len(left) == 0 and all(len(c) <= 160 for _, c, _ in keep)
    q, c, s = op7_topk.search_block(ids[at], x[at], ids, x, 20)
    for i in at:
        want = sorted((-int(x[i] @ x[j]), j) for j in ids if j != i)[:20]
        assert [(-v, j) for v, j in sorted(zip(s[q == i], c[q == i]), key=lambda r: (-r[0], r[1]))] == want


def test_queries_stop_early_where_few_values_are_large():
    """Lists with a short head of large values: a quarter of them is enough, and the result is that of all products."""
    rng = np.random.default_rng(17)
    x = np.floor(rng.exponential(size=(1500, 12)) ** 4).astype(np.int64)
    ids, at = np.arange(1500), np.arange(0, 1500, 50)
    keep, left = op7_topk.bounded(ids[at], x[at] + 1, ids, x, 5, np.float64)
    parts = [part for _, _, part in keep]
    assert len(left) == 0 and len(keep) == len(at) and sum(p == op7_topk.ROUNDS[0] for p in parts) > len(at) // 2
    q, c, s = op7_topk.search_block(ids[at], x[at] + 1, ids, x, 5)
    for i in at:
        want = sorted((-int((x[i] + 1) @ x[j]), j) for j in ids if j != i)[:5]
        assert [(-v, j) for v, j in sorted(zip(s[q == i], c[q == i]), key=lambda r: (-r[0], r[1]))] == want


def test_myers_equals_dynamic_programming():
    rng = random.Random(10)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (9, 25))
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
            row = new
        best = min(row)
        found = op8_decontaminate.myers(p, t, len(p) - 1)
        assert found == ((best, row.index(best)) if best < len(p) and row.index(best) else found if best == len(p) else found)


def test_benchmark_items_are_found_with_edits(spark):
    rng = random.Random(11)
    items = [prose(rng, 30, 900) for _ in range(5)]
    edited = items[2].replace("w", "v", 2)
    texts = [f"before {items[0]} after", prose(rng, 300, 900), f"x\n{edited.upper()}", None, "", items[1][: len(items[1]) // 2]]
    b = spark.createDataFrame([*enumerate(items), (9, None), (10, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in op8_decontaminate.matches(docs(spark, texts), b).collect()}
    assert got == {(0, 0, 0), (2, 2, 2)}
    assert sorted(r.doc_id for r in op8_decontaminate.keep_clean(docs(spark, texts), b).collect()) == [1, 3, 4, 5]


def test_buckets_split_until_they_fit(spark):
    rng = random.Random(12)
    rows = op9_sharding.assign(docs(spark, [*(prose(rng, rng.randrange(200)) for _ in range(300)), None, ""]), limit=4000).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.n_bytes
    assert len(rows) == 302 and all(r.shard_bytes == sums[r.shard] <= 4000 and r.fits and len(r.shard) == r.depth for r in rows)
    prefixes = sorted(sums)
    assert all(not b.startswith(a) for a, b in zip(prefixes, prefixes[1:]))


def test_decode_is_the_inverse_of_encode(spark):
    texts = ["a b  c", None, "", "é\u4e2d\U0001f600 x" * 50, "aaaa" * 400]
    d = op3_bpe.encode(docs(spark, texts), decoded=True)
    assert [r.text for r in d.orderBy("doc_id").collect()] == [t or "" for t in texts]
    back = op3_bpe.decode(d.withColumn("ids", F.when(F.col("doc_id") != 2, F.col("ids"))))
    assert [r.text if r.text is None else r.text.decode() for r in back.orderBy("doc_id").collect()] == [texts[0], "", None, *texts[3:]]
    assert op3_bpe.encode(docs(spark, texts).limit(0)).count() == 0


def test_forgetting_words_gives_the_same_ids(monkeypatch):
    path, pattern = op3_bpe.default_vocabulary()
    with open(path, "rb") as f:
        merges = op3_bpe.Merges(f.read(), pattern)
    texts = [prose(random.Random(i), 40) for i in range(30)]
    whole = op3_bpe.Encoder(merges)(texts)
    monkeypatch.setattr(op3_bpe, "REMEMBERED", 10)
    small = op3_bpe.Encoder(merges)
    assert [small([t])[0] for t in texts] == whole


def test_a_vocabulary_beyond_16_bits(spark):
    """Ids of any size under 2**31: the ranks of a small vocabulary moved up by a million."""
    base = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    lines = b"\n".join(base64.b64encode(t) + b" %d" % (r + 1_000_000) for t, r in base.items())
    merges = op3_bpe.Merges(lines, r"\w+|\W")
    assert np.frombuffer(op3_bpe.Encoder(merges)(["abcbc d"])[0], dtype="<u4").tolist() == [1_000_257, 1_000_258, 1_000_032, 1_000_100]


SF = "/root/testdata/sf0.01"


def auc(scores, truth):
    good, bad = [s for s, t in zip(scores, truth) if t], [s for s, t in zip(scores, truth) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("op, label, least_accuracy, least_auc", [(op4_quality, "quality", 0.9, 0.95), (op10_toxicity, "toxic", 0.9, 0.7)])
def test_held_out_accuracy(spark, op, label, least_accuracy, least_auc):
    truth = {r.doc_id: r[label] for r in common.table(spark, SF, "labels").collect()}
    rows = [r for r in op.query(spark, SF).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(rows) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= least_accuracy * len(rows)
    assert auc([r.score for r in rows], [truth[r.doc_id] for r in rows]) >= least_auc


def edit_distance_inside(p, t):
    """Least edits that turn ``p`` into some part of ``t``, cell by cell."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(31)
    items = [prose(rng, rng.randrange(4, 14), 60) for _ in range(12)] + ["short", "x"]
    texts = [None, "", "x"]
    for _ in range(40):
        t = list(prose(rng, rng.randrange(5, 20), 60))
        if rng.random() < 0.6:
            part = list(rng.choice(items))
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(part) + 1)
                part[k:k + rng.randrange(2)] = rng.choice(["", "q", "7"])
            k = rng.randrange(len(t) + 1)
            t[k:k] = part
        texts.append("".join(t))
    texts += texts[5:8]
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n, p = op8_decontaminate.normal(t), op8_decontaminate.normal(item)
            best = edit_distance_inside(p, n)
            if n and best <= int(op8_decontaminate.BUDGET * len(p)):
                want.add((d, i, best))
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in op8_decontaminate.matches(docs(spark, texts).repartition(3), b).collect()}
    assert got == want and len(want) > 15
    assert op8_decontaminate.matches(docs(spark, texts), b.limit(0)).count() == 0 == op8_decontaminate.matches(docs(spark, texts).limit(0), b).count()


def near_classes(texts):
    """Smallest row of each text's class, comparing all pairs."""
    made = [op6_minhash.Shingler()(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(made):
        for j in range(i):
            if len(a[0]) and len(made[j][0]) and max(op6_minhash.similarity(*a, *made[j])) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def near_copies(rng, n):
    base = [prose(rng, rng.randrange(8, 200)) for _ in range(8)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_recall_against_brute_force(spark):
    texts = [*near_copies(random.Random(41), 150), None, "", "one word"]
    want = near_classes(texts)
    got = {r.doc_id: r.class_id for r in op6_minhash.classes(docs(spark, texts).repartition(6)).collect()}
    linked = [i for i in range(len(texts)) if want[i] != i]
    assert len(linked) > 60 and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)
    assert all(got[i] == i for i in range(len(texts)) if want.count(want[i]) == 1)


def test_pipeline_equals_a_brute_force_chain(spark, tmp_path):
    import tiktoken

    import corpus_pipeline

    rng = random.Random(51)
    texts = near_copies(rng, 60) + fuzzy_lines(rng, 30) + [None, "", "  \n\n"]
    bad = [prose(rng, 40) + " vile poison slur " * 4 for _ in range(60)]
    items = [prose(rng, 25, 5000) for _ in range(3)]
    texts += bad + [f"{prose(rng, 20)} {i} {prose(rng, 10)}" for i in items]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t or ""), "mine", "at") for i, t in enumerate(texts)]
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long, label string, key string")
    y = spark.createDataFrame([(i, 1, int("slur" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for name, t in (("documents", d), ("labels", y), ("benchmark", b)):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)

    toxic = {r.doc_id for r in op10_toxicity.score(d, op10_toxicity.train(d, y)).collect() if r.predicted}
    ids = [i for i in range(len(texts)) if i not in toxic]
    kept = brute_lines([texts[i] for i in ids])
    first = near_classes(kept)
    blank = [not (t or "").split() for t in kept]
    left = [(i, t) for k, (i, t) in enumerate(zip(ids, kept)) if blank[k] or first[k] == k]
    clean = []
    for i, t in left:
        n = op8_decontaminate.normal(t)
        if not any(n and edit_distance_inside(p, n) <= int(op8_decontaminate.BUDGET * len(p)) for p in map(op8_decontaminate.normal, items)):
            clean.append((i, t or ""))
    assert 20 < len(clean) < len(texts) - 60
    path, pattern = op3_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(r) for a, r in (x.split() for x in f.read().splitlines() if x)}
    bpe = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {i: t for i, t in clean}
    have = {r.doc_id: r for r in got}
    assert len(have) == len(got) and len(set(have) ^ set(want)) <= 2  # banding may miss a pair at the threshold
    same = [i for i in have if i in want and have[i].text == want[i]]
    assert len(same) >= 0.95 * len(want)
    assert all(list(r.ids) == bpe.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and (r.label, r.key) == ("mine", "at") for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        common.table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
