from __future__ import annotations

import random
from fractions import Fraction
from heapq import heapify, heapreplace

import pytest

from balanza.llm.common import Scratch
from balanza.llm.mixing import Blocks, apportion, mix, mixed_texts
from tests.llm.conftest import WORD


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = Fraction(total - sum(most * sizes[s] for s in capped), sum(w[s] for s in free)) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s] if s in capped else w[s] * level) for s in names}
        capped |= over


def highest_quotients(votes, seats, most):
    heap = [(-Fraction(v), p, 0) for p, v in votes.items() if most[p] > 0]
    heapify(heap)
    out = dict.fromkeys(votes, 0)
    for _ in range(seats):
        if not heap:
            break
        _, p, k = heap[0]
        out[p] += 1
        heapreplace(heap, (-Fraction(votes[p], 2 * k + 3) if k + 1 < most[p] else Fraction(1), p, k + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_apportionment_is_by_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for g in range(4):
        votes = {p: rng.choice([1, 2, 2, 7, 50, 1000]) * rng.randint(1, 30) for p in range(rng.randint(1, 25))}
        seats = rng.randint(1, 200)
        most = {p: 10**6 for p in votes}
        rows += [(g, p, float(v), seats, most[p]) for p, v in votes.items()]
        expected |= {(g, p): q for p, q in highest_quotients(votes, seats, most).items()}
    df = spark.createDataFrame(rows, "g long, p long, votes double, seats long, most long")
    got = {(r["g"], r["p"]): r["quota"] for r in apportion(df, Scratch(spark, "t"), "t").collect()}
    assert got == expected


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "Z", None])
        rows.append((i, " ".join(f"w{j}" for j in range(rng.choice([0, 1, 5, 40, 300]))), source))
    return rows + [(1000, None, "a"), (1001, None, "empty"), (1002, "x " * 30_000, "b"), (1002, "x " * 30_000, "b"), (None, "null id", "c")]


def test_targets_and_limits(docs):
    rows = corpus()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    expected = plain_targets(sizes)
    got = mix(docs(rows), Blocks(words=4, per_shard=64)).collect()
    assert len(got) == len(rows)
    by_size = {v: k for k, v in sizes.items()}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(expected[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(8, 0.02 * t)


def test_reruns_agree(docs):
    d = docs(corpus())
    runs = [sorted(map(tuple, mix(x).drop("spans").collect()), key=repr) for x in (d, d.repartition(7))]
    assert runs[0] == runs[1]


def test_texts_hold_the_taken_words(docs):
    rows = corpus()
    d = docs(rows)
    taken = mix(d)
    out = mixed_texts(d, taken)
    assert out.columns == d.columns and out.schema == d.schema
    words, texts = {}, dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    sums = {}
    for r in taken.collect():
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["taken"]
    assert words == {k: v for k, v in sums.items() if v}


def test_empty_table_and_no_words(docs):
    assert mix(docs([])).collect() == []
    r = mix(docs([(1, None), (2, " ")])).collect()
    assert [(x["target"], x["taken"]) for x in r] == [(0.0, 0), (0.0, 0)]
