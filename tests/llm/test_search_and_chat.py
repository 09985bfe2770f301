from __future__ import annotations

import math
import os
import random

import duckdb
import numpy as np
import pytest

from balanza.llm.chat import Template, perspectives
from balanza.llm.queries import ORACLES, QUERIES
from balanza.llm.topk import search, top_k
from tests.conftest import DATOS
from verificacion.comparar import comparar


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DATOS, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    ok, said = comparar(QUERIES[name](spark, DATOS), tables, ORACLES[name])
    assert ok, said


def brute(rows, k=5):
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in ok.items():
        if q % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_ties_nulls_and_widths(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 400)]
    rows += [(450, [1.0, 2.0]), (451, [1.0, 1.0]), (500, []), (501, []), (550, None), (600, [1.0, None, 0.0, 0.0]), (650, [float("nan")] * 4), (700, [float("inf"), 0, 0, 0]), (None, [1.0] * 4), (-50, [1e15, -1e15, 0.0, 1.0]), (-51, [1e15, 0.0, 0.0, 0.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, score long, id long")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)
    assert sorted(map(tuple, top_k(df.union(df)).collect())) == brute(rows)
    assert top_k(df.limit(0)).collect() == []


def test_blocks_are_left_out_only_below_the_kth_score():
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 50, (500, 6)) + np.repeat(rng.integers(-200, 200, (10, 6)), 50, axis=0)
    ids = np.arange(500) * 2
    for q, found, scores in search(ids, rows, ids[:20], rows[:20], 5, block=16):
        s = rows @ rows[q // 2]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert found.tolist() == ids[order].tolist() and scores.tolist() == s[order].tolist()


def test_perspectives(spark):
    rows = [
        ("c", 0, "system", "be kind", 1),
        ("c", 1, "ann", "hi <|im_end|>", 1),
        ("c", 2, "bob", None, 1),
        ("c", 2, "ann", "x", 1),
        ("c", None, None, "first", 1),
        ("c", 3, "bob", "y", 1),
        ("c", 3, "bob", "y", 1),
        ("s", 0, "system", "alone", 1),
        (None, 0, "ann", "lost", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, part long")
    got = {(r["conv_id"], r["perspective"]): r for r in perspectives(df).collect()}
    assert set(got) == {("c", "ann"), ("c", "bob"), ("c", "unknown"), (None, "ann")}
    r = got["c", "ann"]
    assert r["text"] == (
        "<|im_start|>user name=unknown\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n" + "<|im_start|>user name=bob\ny<|im_end|>\n" * 2
    )
    assert [r["text"][a:b] for a, b in r["spans"]] == ["hi < |im_end|><|im_end|>\n", "x<|im_end|>\n"] and r["n_turns"] == 7
    assert perspectives(df.limit(0)).collect() == []


def test_long_dialogues_come_in_parts(spark):
    df = spark.createDataFrame([(1, t, "ab"[t % 2], f"t{t}") for t in range(10)], "conv_id long, turn long, role string, text string")
    got = perspectives(df, Template(part_turns=4)).collect()
    assert sorted((r["perspective"], r["part"], r["n_turns"]) for r in got) == [(p, k, n) for p in "ab" for k, n in ((0, 4), (1, 4), (2, 2))]


def test_parts_go_by_place_and_make_up_the_whole(spark):
    rows = [(1, 0, "a", "x"), (1, 4096, "b", "y"), (2, 1_700_000_000, "a", "x"), (2, 1_700_009_000, "b", "y")]
    rows += [(3, 10 * t, "system" if t in (0, 5) else "abc"[t % 2 if t < 8 else 2], f"t{t}") for t in range(11)]
    rows += [(None, None, "ab"[t % 2], "same") for t in range(9)] + [(4, 7, "a", "again")] * 6
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["perspective"]): r for r in perspectives(df).collect()}
    cut = {}
    for r in sorted(perspectives(df, Template(part_turns=4)).collect(), key=lambda r: r["part"]):
        cut.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(cut) == set(whole)
    assert {k: [r["n_turns"] for r in v] for k, v in cut.items()} == {k: {1: [2], 2: [2], 3: [4, 4, 3], None: [4, 4, 1], 4: [4, 2]}[k[0]] for k in whole}
    for k, parts in cut.items():
        text, spans = "", []
        for r in parts:
            spans += [(a - r["carried"] + len(text), b - r["carried"] + len(text)) for a, b in r["spans"]]
            text += r["text"][r["carried"] :]
        assert text == whole[k]["text"] and spans == [tuple(s) for s in whole[k]["spans"]]
    system = [f"<|im_start|>system\n{t}<|im_end|>\n" for t in ("t0", "t5")]
    assert [r["text"][: r["carried"]] for r in cut[3, "c"]] == ["", system[0], "".join(system)]


def test_vectors_that_share_an_id_all_take_part(spark):
    rng = random.Random(9)
    rows = [(i % 120, [rng.randint(-400, 400) / 256 for _ in range(4)]) for i in range(360)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    ok, said = comparar(top_k(df), con, ORACLES["op7_exact_top_k"])
    assert ok, said


def test_parts_equal_sql(spark):
    """Long dialogues with system turns, turn numbers of any size, and one whose numbers pass 1,023 with two turns only."""
    rows = [(1, 10 * t, "system" if t in (0, 700, 1500) else "ab"[t % 2], f"t{t} <|im_end|>") for t in range(2600)]
    rows += [(2, 0, "a", "x"), (2, 4096, "b", "y"), (None, None, "a", None), (3, 5, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import tempfile

    folder = tempfile.mkdtemp(prefix="chat-")
    df.coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    ok, said = comparar(QUERIES["op10_chat_perspectives"](spark, folder), con, ORACLES["op10_chat_perspectives"])
    assert ok, said
