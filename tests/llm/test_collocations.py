from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from balanza.llm.collocations import Tile, Tiles, cells, chunk_words, collocations, packed, unpacked
from tests.llm.conftest import normal


def brute(rows, least=10, inside=50, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        c = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", normal(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            c.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in candidates.items():
            for q in (p[:2], p[1:]):
                if len(p) == 3:
                    covered[q] = max(covered[q], a)
        found = []
        for p, a in candidates.items():
            if len(p) == 2 and 100 * covered[p] >= inside * a and covered[p]:
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first])]
    return sorted(out)


def some_rows(seed, n, kinds):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice(['W', 'é', 'x'])}{int(rng.paretovariate(0.9)) % kinds}"
    phrases = [" ".join(word() for _ in range(rng.randint(2, 4))) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 40))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " ; \r\n"]) for p in parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


def shown(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(*r, 1, 1, "p", 1) for r in rows], "text string, lang string, n long, a long, phrase string, id long").repartition(parts)

    return make


@pytest.mark.parametrize("t", [Tiles(), Tiles(side=4, single=6, chunk_bytes=2000, bucket=300, together=4)])
def test_against_brute_force(table, t):
    rows = some_rows(1, 400, 60) + [(None, "en"), ("", "en"), (" .,;", None), ("ha " * 40_000, "fr"), ("a b c " * 9, "it"), ("a b c " * 10, "es"), ("a b c. " * 10, "pt"), ("\x00\x1c y " * 30, None), ("x" * 100_000 + " y", "en")]
    assert shown(collocations(table(rows), t)) == brute(rows)


def test_few_rows_and_other_bounds(table):
    rows = some_rows(2, 300, 20)
    assert shown(collocations(table(rows), Tiles(least=3, inside=80, first=7, side=8))) == brute(rows, 3, 80, 7)


def test_empty_table_and_no_candidates(table, spark):
    assert collocations(table([("a b", "en")]).limit(0)).collect() == []
    assert collocations(table([("a b c", "en"), (None, None)])).collect() == []


def test_frequent_line_over_many_partitions(table):
    rng = random.Random(3)
    rows = [("the very same line: " + " ".join(f"w{rng.randint(0, 300)}" for _ in range(30)), "en") for _ in range(1500)]
    assert shown(collocations(table(rows, 40), Tiles(side=16, together=4))) == brute(rows)


@pytest.mark.parametrize("tile,low", [(3 << 31 | 2, (24, 16)), (-1, (0, 0))])
def test_tile_sums(tile, low):
    rng = np.random.default_rng(1)
    t, expected = Tile(tile, 8), Counter()
    for size in (1, 3, 500, 40, 0, 7):
        codes, n = np.unique((low[0] + rng.integers(0, 8, size)) << 32 | (low[1] + rng.integers(0, 8, size)), return_counts=True)
        n = n + (1 << 40)
        t.add(codes, n)
        expected.update(dict(zip(codes.tolist(), n.tolist())))
    codes, n = t.sums()
    assert list(zip(codes.tolist(), n.tolist())) == sorted(expected.items())


def test_cells_and_blobs():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 200, 5000), rng.integers(0, 200, 5000)
    got = Counter()
    for tile, codes, n in cells(left, right, 5, Tiles(side=16, single=9)):
        assert (np.diff(codes) > 0).all()
        if tile >= 0:
            assert {(c >> 32) // 16 for c in codes.tolist()} == {tile >> 31} and (tile >> 31) + 1 <= 9
        back = unpacked(packed(codes, ascending=True), ascending=True)
        got.update(dict(zip(back.tolist(), unpacked(packed(n)).tolist())))
    assert got == Counter((left << 32 | right).tolist())


def test_chunk_words():
    codes, words, counts = chunk_words([b"A b. a", None, b"B"])
    assert [w.decode() for w in words] == ["a", "b"] and counts.tolist() == [2, 2]
    assert codes.tolist() == [0, 1, -1, 0, -1, 1, -1]
