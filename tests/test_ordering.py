"""Places, running sums, windows over all sections and admission against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, ordering, selection


def test_places_and_sums_over_all_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.randrange(5)) for i in range(500)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "id long, g int, w int, _base string, place string").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    d = d.drop("_base", "place")
    got = ordering.numbered(d, ["g", "id"])
    assert [(r.id, r.place) for r in got.orderBy("place").collect()] == [(r[0], i + 1) for i, r in enumerate(want)]
    run, total = ordering.running(d, ["g", "id"], "w")
    before, sums = 0, {}
    for r in want:
        sums[r[0]] = before
        before += r[2]
    assert total == before and {r.id: r.before for r in run.collect()} == sums
    empty, none = ordering.running(d.limit(0), ["g", "id"], "w")
    assert none == 0 and empty.count() == 0 and ordering.numbered(d.limit(0), ["id"]).count() == 0


def test_no_stage_of_a_numbering_is_one_task(spark):
    d = ordering.numbered(spark.range(1000).repartition(8), ["id"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("size, step", [(220, 170), (5, 3), (4, 4)])
def test_windows_run_on_over_sections(spark, size, step):
    rng = random.Random(size)
    sections = [(i, "IPC", str(i), f"t{i}", rng.choice(["", "  ", None, " ".join(f"w{i}.{j}" for j in range(rng.randrange(60)))])) for i in range(40)]
    words, owner = [], []
    for o, document, section, title, text in sections:
        if (text or "").strip():
            own = f"{document} Section {section}. {title}. {text.strip()}".split()
            words += own
            owner += [o] * len(own)
    want, start = [], 0
    while start < len(words):
        want.append((f"win-{len(want)}", owner[start], " ".join(words[start:start + size])))
        if start + size >= len(words):
            break
        start += step
    d = spark.createDataFrame(sections, "ord int, document string, section string, title string, txt string").repartition(5)
    got = chunking.windows_over(d, "ord", ["ord"], size, step).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.ord, r.text) for r in got] == want
    assert any(len({owner[i] for i in range(len(words)) if words[i] in w.split()}) > 1 for _, _, w in want)
    assert chunking.windows_over(d.limit(0), "ord", ["ord"], size, step).count() == 0


def test_an_unknown_strategy_is_an_error(spark):
    with pytest.raises(ValueError):
        chunking.build("none", spark.range(1), [])


@pytest.mark.parametrize("m, o", [(6, 3), (1, 9), (9, 0), (0, 4), (5, 1)])
def test_interleaving_equals_two_for_one(spark, m, o):
    d = spark.range(m + o).withColumn("m", F.col("id") < m)
    got = [r.m for r in selection.interleave(d, F.col("m"), "id").orderBy("place").collect()]
    want, a, b = [], m, o
    while a or b:
        for is_matched, n in ((True, min(2, a)), (False, min(1, b))):
            want += [is_matched] * n
            a, b = (a - n, b) if is_matched else (a, b - n)
    assert got == want


FLOORS, CEILINGS = {"a": 5, "b": 12, "c": 3}, {"b": 20, "d": 8}


def loop(rows, target, held, have):
    counts, out = Counter(held), {}
    for key, score, topics in rows:
        score, topics = score or 0, sorted(set(topics or []))
        if have >= target:
            out[key] = "target_reached"
            continue
        took, out[key] = selection._decide(score, topics, counts, FLOORS, CEILINGS)
        if took:
            have += 1
            counts.update(topics)
    return out


@pytest.mark.parametrize("seed, target, few", [(1, 1000, 1), (2, 1000, 40), (3, 60, 4), (4, 25, 1), (5, 0, 4)])
def test_admission_equals_a_loop_on_any_order(spark, monkeypatch, seed, target, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "RANGES", 5)
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 6, 8, 9, 10, 14]), rng.choice([None, [], ["a"], ["b"], ["b", "d"], ["d"], ["a", "c"], ["x"], ["b", "b"]])) for i in range(200)]
    rng.shuffle(rows)
    held = {"a": 1, "d": 2}
    d = spark.createDataFrame([(i, k, s, t) for i, (k, s, t) in enumerate(rows)], "turn int, k int, score int, topics array<string>").repartition(3)
    got = selection.harvest(d, target, ["turn"], held, 3, FLOORS, CEILINGS).collect()
    want = loop(rows, target, held, 3)
    assert {r.k: r.reason for r in got} == want and len(got) == 200
    assert all(r.accepted == (r.reason == "general_fill" or r.reason.startswith("quota")) for r in got)


def test_admission_of_nothing(spark):
    d = spark.createDataFrame([], "k int, score int, topics array<string>")
    assert selection.harvest(d, 10, ["k"]).count() == 0
