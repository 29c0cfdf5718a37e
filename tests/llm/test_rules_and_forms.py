"""op11 to op13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import op11_repetition, op12_conversations, op13_fim

DOCS = "doc_id long, text string, n long, form string, output string, key string, doc string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", "w") for i, t in enumerate(texts)] + [(None, "a b c", 1, None, None, None, None)], DOCS)


# --- op11 -----------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len("".join(WORD.findall(x))) for x in again)}
    for n in op11_repetition.NGRAM_LIMITS:
        wins = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        count, seen, cover, every = Counter(wins), set(), set(), set()
        for i, w in enumerate(wins):
            if count[w] > 1:
                every |= set(range(i, i + n))
            if w in seen:
                cover |= set(range(i, i + n))
            seen.add(w)
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in cover)
        if n == 5:
            out["n_repeat_words"] = len(every)
    return out


def texts_with_repeats(rng, n):
    out = []
    for _ in range(n):
        t = "".join(rng.choice("ab é") + rng.choice(["", " ", "\n", "\t", "\x1c", "\xa0", "|"]) for _ in range(rng.randrange(120)))
        cut = rng.randrange(1 + len(t))
        out.append(t + t[cut:] if rng.random() < 0.5 else t)
    return out


def test_repetition_equals_brute_force():
    rng = random.Random(1)
    texts = ["", " ", "a", "a b c d e a b c d e", "x y\nx y\n\n x y\nx y", "w " * 50, *texts_with_repeats(rng, 200)]
    got = op11_repetition.measures([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {c: int(v[i]) for c, v in got.items()} == brute_counts(t)


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op11_repetition, "mix64", lambda x: (x % 3).astype(np.uint64))
    monkeypatch.setattr(op11_repetition, "ROLL", np.uint64(1))
    texts = texts_with_repeats(random.Random(2), 60)
    got = op11_repetition.measures([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {c: int(v[i]) for c, v in got.items()} == brute_counts(t)


def test_repetition_verdicts_of_rows(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    line = "this line of eight words comes again here"
    texts = [None, "", prose, f"{prose} {prose}", "\n".join([line] * 9), " ".join(f"w{i}$$$" for i in range(40)), f"{prose}\n" + " ".join(f"q{i}" for i in range(300_000)), prose]
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in op11_repetition.measure(d).collect()}
    assert [rows[i].base_failed for i in range(8)] == [True, True, False, True, True, False, False, False]
    assert [rows[i].kept for i in range(8)] == [False, False, True, False, False, False, True, True]
    assert rows[None].n_words == 3 and rows[6].n_words == 300_060 and len(rows) == 9
    kept = op11_repetition.keep_good(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 6, 7]
    assert op11_repetition.measure(d.limit(0)).count() == 0 and op11_repetition.keep_good(d.limit(0)).count() == 0


# --- op12 -----------------------------------------------------------------------

def brute_plan(codes):
    """Cheapest and then least audit by a search over (row, state)."""
    step = op12_conversations.STEP
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if i == len(codes) and s in (0, 3):
            return cost, audit
        if (cost, audit, i, s) in seen or len(audit) > 2 * len(codes) + 4:
            continue
        seen.add((cost, audit, i, s))
        for role in (1, 2):
            if (s, role) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, step[s, role]))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            if c != op12_conversations.GONE:
                for role in (1, 2):
                    if (s, role) in step:
                        heapq.heappush(heap, (cost + 2 + c // 4, audit + "R", i + 1, step[s, role]))
                if (s, c & 3) in step:
                    heapq.heappush(heap, (cost + c // 4, audit + "K", i + 1, step[s, c & 3]))


def test_layers_equal_a_search_of_all_edits():
    rng = random.Random(4)
    for _ in range(400):
        codes = bytes(rng.randrange(9) for _ in range(rng.randrange(7)))
        k = rng.randrange(len(codes) + 1)
        assert op12_conversations.solve([codes]) == brute_plan(codes)
        assert op12_conversations.solve([codes[:k], codes[k:]]) == brute_plan(codes)


def test_eight_layers_tell_all_states_apart():
    open_, seen = [op12_conversations._based(op12_conversations._closed(op12_conversations.ONES * 0b1001))[0]], set()
    while open_:
        w = open_.pop()
        if w not in seen:
            seen.add(w)
            assert w >> 28 == 15
            open_ += [op12_conversations.earlier(w, c)[0] for c in range(9)]


CONVERSATIONS = "conv_id long, turn long, role string, text string, codes string, digest string, head string"


def brute_report(rows):
    """The whole contract on plain lists."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        convs[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes, faults = set(), bytearray(), Counter()
        for _, role, text in rs:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            code = "sua".find(role[:1]) if role[:1] else 3
            codes.append(8 if fault in ("b", "d") else (code if code >= 0 else 3) + 4 * (fault == "t"))
        cost, audit = brute_plan(bytes(codes))
        lines, s, i = [], 0, 0
        for e in audit:
            row = rs[i] if e != "I" else None
            i += e != "I"
            if e == "D":
                continue
            kind = "sua".index(row[1][0]) if e == "K" else op12_conversations.NEXT[s]
            s = op12_conversations.STEP[s, kind]
            lines.append(f"{row[1] if e == 'K' else ['', 'user', 'assistant'][kind]}:{row[2] if row else ''}")
        turns = [r[0] for r in rs if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["b"], faults["d"], faults["t"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversation_rows(rng, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Yes.", "No", "", None, " \t", "é? ", "What!\n", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


def test_conversations_equal_brute_force(spark):
    rows = conversation_rows(random.Random(5), 60)
    d = spark.createDataFrame([(*r, "c", "d", "h") for r in rows], CONVERSATIONS)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in op12_conversations.report(op12_conversations.damage(d)).collect()}
    assert got == brute_report(rows)
    assert op12_conversations.report(op12_conversations.damage(d.limit(0))).count() == 0


@pytest.mark.parametrize("most", [1, 2, 5])
def test_a_conversation_in_pieces_has_the_same_summary(monkeypatch, most):
    """A long conversation's pieces, cut anywhere, add up."""
    rng = random.Random(6)
    rows, turn = [], 0
    for _ in range(30):
        turn += rng.choice([0, 1, 2])
        copies, code = rng.choice([1, 1, 3]), rng.randrange(9)
        initial = "x" if code == 8 else "suax"[code & 3]
        rows.append((7, True, turn, initial, b"%d" % len(rows), copies, initial, code, "d" if code == 8 else "t" if code & 4 else ""))
    names = ["conv_id", "has", "turn", "role", "digest", "copies", "initial", "code", "fault"]

    def summary(parts):
        pieces = [p for rs in parts for p in op12_conversations._pieces([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rs])])]
        return [r for b in op12_conversations._summaries(pieces) for r in b.to_pylist()]

    want = summary([rows])
    monkeypatch.setattr(op12_conversations, "PIECE", most)
    assert summary([rows]) == want
    assert summary([rows[:11], rows[11:12], rows[12:]]) == want


def test_repaired_rows_of_a_conversation(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "cut off"), (2, 0, "user", " ")]
    d = op12_conversations.undamaged(spark.createDataFrame([(*r, "", "", "") for r in rows], CONVERSATIONS))
    plans = op12_conversations.plan(d)
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {1: (6, "IKKDK"), 2: (3, "D")}
    got = sorted((r.position, r.role, r.text, r.edit) for r in op12_conversations.repaired(d, plans).collect())
    assert got == [(1, "user", "", "I"), (2, "assistant", "Hello.", "K"), (3, "user", "Hi.", "K"), (4, "assistant", "cut off", "K")]


# --- op13 -----------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_form(doc_id, text):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def form_texts(rng):
    base = ["", None, " ", "\n\t", "a", " a", "a ", "x<P>y", "<", "<S", "P><M", "é日本 \U0001f600\xa0b \x1cc\x00d", "a" * 5000, "word " * 3000]
    return base + ["".join(rng.choice(["a", "é", " ", "\n", "<", "S>", "\U0001f600", "<P>"]) for _ in range(rng.randrange(40))) for _ in range(150)] + ["same text here"] * 8


def test_forms_equal_brute_force_and_come_back(spark):
    texts = form_texts(random.Random(7))
    d = docs(spark, texts)
    want = {i: brute_form(i, t or "") for i, t in [*enumerate(texts), (None, "a b c")]}
    assert {w[1] for w in want.values()} == {"plain", "spm", "psm"}
    rows = op13_fim.restored(op13_fim.transform(d)).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows} == want
    assert all(r.restored == (r.text or "") for r in rows) and {r.key for r in rows} == {"z", None}
    for r in op13_fim.digests(d).collect():
        n, form, p, m, out = want[r.doc_id]
        text = "a b c" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert (r.output_sha256, r.restored_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (out, text))
    assert op13_fim.transform(d.limit(0)).count() == op13_fim.digests(d.limit(0)).count() == 0


def test_parts_of_a_long_text_have_its_offsets():
    split = op13_fim.splitter()
    for t in form_texts(random.Random(8)):
        want = [0, *(m.end() for m in TOKEN.finditer(t or ""))]
        for most in (1, 2, 7, 1 << 18):
            assert op13_fim.offsets(split, t or "", most).tolist() == want
