from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from balanza.llm.dualtree import Hierarchy, Items, Rows, Search, ranked_search, search, terms
from tests.llm.conftest import normal

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) for each item row."""
    bags = [(d, Counter(TERM.findall(normal(t)))) for d, t in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item_id, text in items:
        asked = Counter(TERM.findall(normal(text)))
        found = []
        for d, c, size in bags:
            m = 75 + 25 * size * n // total
            s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, a in asked.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item_id, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def asked(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "item_id long, text string, doc_id long, score long, q long")


def some_rows():
    rng = random.Random(12)
    vocabulary = [f"{rng.choice(['wörd', 'Term', 'x'])}{int(rng.paretovariate(0.6))}" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-y", "\n"]) for _ in range(n))
    docs = [(i * 3 % 701, text(rng.randint(0, 60))) for i in range(700)]
    docs += [(800, docs[5][1])] * 3 + [(None, docs[5][1])] * 2 + [(801, None), (802, ""), (803, "., !"), (804, text(30_000)), (805, "wörd1 " * 5000)]
    items = [(i, text(rng.randint(1, 25))) for i in range(40)] + [(5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (90, None), (91, ""), (92, "unknownterm"), (93, text(3000)), (94, "wörd1 " * 900)]
    return docs, items


def test_against_brute_force(spark, docs):
    rows, items = some_rows()
    expected = brute(rows, items)
    assert shown(ranked_search(docs(rows), asked(spark, items), Search(shard=50, leaf=4, first=3))) == expected
    assert shown(ranked_search(docs(rows), asked(spark, items))) == expected


def test_items_in_several_passes(spark, docs):
    rows, items = some_rows()
    assert shown(ranked_search(docs(rows[:200]), asked(spark, items), Search(group_bytes=20_000, shard=30, first=2))) == brute(rows[:200], items)


def test_empty_tables(spark, docs):
    assert ranked_search(docs([]), asked(spark, [(1, "a")])).collect() == []
    assert ranked_search(docs([(1, "a")]), asked(spark, [])).collect() == []
    assert ranked_search(docs([(1, None)]), asked(spark, [(1, "a")])).collect() == []


def test_terms():
    for t in ("Aé-B_c 1٣ \x00x\x7f", "ÀÉ İi", "a" * 50_000, ""):
        assert [x.decode() for x in terms(t.encode())] == TERM.findall(normal(t))


def random_rows(rng, n, width):
    dense = np.where(rng.random((n, width)) < 0.2, rng.integers(1, 50, (n, width)), 0)
    at = [np.flatnonzero(r) for r in dense]
    return dense, Rows(np.cumsum([0, *map(len, at)]), np.concatenate(at), np.concatenate([r[a] for r, a in zip(dense, at)]))


def test_nodes_hold_maxima_and_every_row_once():
    dense, rows = random_rows(np.random.default_rng(1), 90, 30)
    tree = Hierarchy(rows, 30, 4)
    top = tree.maxima(30)
    assert all((top[i] == dense[m].max(0)).all() for i, m in enumerate(tree.members))
    lowest = np.concatenate([m for m, c in zip(tree.members, tree.children) if not c])
    assert sorted(lowest) == list(range(90))


def test_pairs_below_the_weakest_score_are_left_out_only():
    """The search visits few pairs, and with a known floor fewer, but returns all scores that reach it."""
    rng = np.random.default_rng(4)
    dense, _ = random_rows(rng, 400, 40)
    items = Items([" ".join(f"t{c}" for c in rng.choice(40, 5)).encode() for _ in range(30)])
    items.weigh(np.full(len(items.codes), 7))
    own = [int(t.decode()[1:]) for t in items.codes]
    mine = dense[:, own]
    at = [np.flatnonzero(r) for r in mine]
    docs = lambda: Rows(np.cumsum([0, *map(len, at)]), np.concatenate(at), np.concatenate([r[a] for r, a in zip(mine, at)]))
    ids = rng.permutation(400)
    asked_ = np.zeros((30, len(own)), np.int64)
    for i in range(30):
        s = slice(items.rows.ptr[i], items.rows.ptr[i + 1])
        asked_[i, items.rows.codes[s]] = items.rows.values[s]
    scores = asked_ @ mine.T
    w = Search(k=5, leaf=8)
    found = {i: (ids[r].tolist(), s.tolist()) for i, r, s in search(items, docs(), ids, np.zeros(30, np.int64), w)}
    kth = np.zeros(30, np.int64)
    for i in range(30):
        best = [(s, d) for s, d in sorted(zip((-scores[i]).tolist(), ids.tolist()))[:5] if s < 0]
        assert list(zip(*found[i])) == [(d, -s) for s, d in best]
        kth[i] = -best[-1][0]
    again = {i: (ids[r].tolist(), s.tolist()) for i, r, s in search(items, docs(), ids, kth, w)}
    assert again == found
    assert not list(search(items, docs(), ids, kth + 10**6, w))


def test_sums_beyond_doubles():
    items = Items([b"a b"])
    items.weigh(np.array([2**40, 1]))
    docs = Rows(np.array([0, 2, 4]), np.array([0, 1, 0, 1]), np.array([2**20, 2, 2**20, 3]))
    (_, rows, scores), = search(items, docs, np.array([1, 2]), np.zeros(1, np.int64), Search())
    assert rows.tolist() == [1, 0] and scores.tolist() == [2**60 + 3, 2**60 + 2]
