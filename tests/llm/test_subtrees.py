from __future__ import annotations

import random

import numpy as np
import pytest

from balanza.llm.subtrees import Windows, least_documents, repeated_windows, runs
from tests.llm.conftest import WORD, sha


def brute(rows, size=50):
    """(doc_id, n_words, n_removed, kept_sha256); a null id counts as the largest long."""
    rank = lambda d: 2**63 - 1 if d is None else d
    least = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            least[key] = min(least.get(key, 2**63), rank(d))
    out = []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for i in range(len(words) - size + 1):
            if least[tuple(words[i : i + size])] < rank(d):
                gone.update(range(i, i + size))
        out.append((d, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=repr)


def shown(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def mixed_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(rng.randint(30, 140)) for _ in range(6)]
    line = text(22)
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else line if rng.random() < 0.3 else text(rng.randint(1, 80)) for _ in range(rng.randint(0, 5))]
        rows.append((i * 7 % 121, rng.choice([" ", "\n", "\t ", "\x0b"]).join(sum(parts, []))))
    whole = " ".join(text(70))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "ha " * 49), (304, "ha " * 50), (305, "ha " * 3000), (306, "Ha " * 80), (307, "x y " * 60), (308, "x y " * 55)]
    rows += [(400, whole), (400, whole), (None, whole), (None, whole), (None, whole + " z"), (-5, "a " + whole)]
    return rows + [(401, " ".join(text(60_000) + passages[0]))]


@pytest.mark.parametrize("tree_bytes", [1 << 22, 3000, 200])
def test_against_brute_force(docs, tree_bytes):
    """One tree for all, groups by the longer prefix, and windows by their whole words."""
    rows = mixed_rows()
    assert shown(repeated_windows(docs(rows), Windows(tree_bytes=tree_bytes))) == brute(rows)


def test_short_windows(docs):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    assert shown(repeated_windows(docs(rows), Windows(window=6, inner=2, reach=3, tree_bytes=400))) == brute(rows, 6)
    assert shown(repeated_windows(docs(rows), Windows(window=3, inner=3, reach=1, tree_bytes=400))) == brute(rows, 3)


def test_outputs_and_empty_table(docs):
    passage = " ".join(f"w{i}" for i in range(60))
    got = {r["doc_id"]: r for r in repeated_windows(docs([(1, passage), (2, f"one two {passage} three"), (3, "short")])).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 62)] and bytes(got[2]["kept"]) == b"one two three"
    assert got[1]["spans"] == [] and got[1]["kept"] is None
    assert repeated_windows(docs([])).collect() == []


def test_hot_passage_over_many_partitions(spark):
    """A passage in all documents, each with its own words around it."""
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(20))} {passage} {' '.join(f'b{i}x{k}' for k in range(20))}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert shown(repeated_windows(df, Windows(tree_bytes=20_000))) == brute(rows)


def test_node_pairs_equal_plain_windows():
    rng = random.Random(2)
    w = Windows(window=8, inner=2, reach=5)
    docs = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(8, 40))] for _ in range(30)]
    doc, start, n, before, _, _ = runs(docs, w)
    parts = [docs[d][s : s + m + w.window - 1] for d, s, m in zip(doc, start, n)]
    found = least_documents(parts, before, n, doc, w)
    groups: dict = {}
    for p, m, b, d in zip(parts, n, before, doc):
        for t in range(m):
            key = (b - t, tuple(p[t : t + w.window]))
            groups[key] = min(groups.get(key, 99), d)
    assert all(found[i, t] == groups[(before[i] - t, tuple(p[t : t + w.window]))] for i, p in enumerate(parts) for t in range(n[i]))
    assert np.all(n <= w.reach)
