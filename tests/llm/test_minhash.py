from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from balanza.llm.minhash import Sketcher, Sketching, likeliest, merged, near_duplicates, shingle_sets, without_near_copies
from tests.llm.conftest import WORD, normal


def shingles(text, k=2):
    w = WORD.findall(normal(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k=2, percent=80):
    """doc_id, set size, smallest doc_id reachable; ids are unique and not null."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def test_against_brute_force_with_chains_and_a_large_cluster(docs):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        texts += family(rng, [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 80))], 5, 6)
    # One family over several blocks, whose members are linked by chains only in part.
    texts += family(rng, [f"v{i}" for i in range(120)], 150, 12)
    texts += ["", " \n\t", "one", "ONE", "one two", "two one", "é É", "a\x0bb a\x1cb", "x " * 20_000]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = near_duplicates(docs(rows), Sketching(block=16))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_nulls_repeated_rows_and_empty_table(docs):
    rows = [(1, None), (2, "a b c"), (2, "a b c"), (3, "A b C"), (None, "a b c"), (None, None)]
    got = sorted(map(tuple, near_duplicates(docs(rows)).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (None, 2, None, True), (None, 0, None, True)], key=repr)
    assert near_duplicates(docs([])).collect() == []


def test_stage_uses_five_words_and_keeps_columns(docs):
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["other"] + base[101:]
    far = base[:100] + [f"x{i}" for i in range(100)]
    d = docs([(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(far)), (None, "lost"), (8, None)])
    out = without_near_copies(d)
    assert out.columns == d.columns
    assert {r["doc_id"] for r in out.collect()} == {5, 7, 8, None}


def test_registers_merge_and_estimates_follow_the_likelihood():
    s = Sketching(registers=512)
    k = Sketcher(s)
    a, b = shingle_sets(pa.array([" ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(300, 1200))]), 1)
    ra, rb, ru = k.registers([a, b, np.union1d(a, b)])
    assert (merged(ra, rb) == ru).all()
    guess = likeliest(ra[None], rb[None], np.array([900.0]), np.array([900.0]), s.base)[0]
    assert abs(guess - 600 / 1200) < 0.1


def test_sketch_of_a_long_set_does_not_depend_on_the_cells():
    k = Sketcher(Sketching())
    sets = shingle_sets(pa.array(["a b c", " ".join(map(str, range(3000))), "z"]), 2)
    assert (k.minima(sets, 7) == k.minima(sets, 100_000)).all()


def test_long_words_of_a_regular_make_are_told_apart(docs):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word + " y"), (2, other + " y"), (3, word + " y")]
    one, two, three = shingle_sets(pa.array([t for _, t in rows]), 2)
    assert one.tolist() == three.tolist() != two.tolist()
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(docs(rows)).collect()) == [(1, 1), (2, 2), (3, 1)]
