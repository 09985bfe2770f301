from __future__ import annotations

import weakref

import numpy as np
import public_tokenizers

import corpus_pipeline
from balanza.llm import common
from balanza.llm.minhash import Sketching, sketches
from balanza.llm.mixing import mixed_texts
from balanza.llm.pieces import Pieces
from balanza.llm.toxicity import CODES, Model, scored, trigram_counts
from tests.conftest import DATOS
from tests.llm.conftest import normal
from tests.llm.test_minhash import shingles


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATOS}/documents.parquet")
    columns, seen = docs.columns, []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "pieces"]
    toxic = {r[0] for r in spark.read.parquet(f"{DATOS}/labels.parquet").filter("toxic = 1").select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATOS).cache()
        rows = docs.collect()
        seen.append(rows)
        if name != "pieces":
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = [normal(r["text"]) for r in rows]
            assert len(texts) == len(set(texts))
            assert {tuple(r) for r in rows} <= {tuple(r) for r in seen[0]}
        if name == "near_dedup":
            sets = [shingles(r["text"], 5) for r in rows]
            kept = {r["doc_id"] for r in rows}
            assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
            # Whatever went was linked with something.
            before = {r["doc_id"]: shingles(r["text"], 5) for r in seen[1]}
            for d in before.keys() - kept:
                s = before[d]
                assert any(e != d and 100 * len(s & t) >= 80 * len(s | t) for e, t in before.items() if t)
    assert seen[0] and len(seen[0]) >= 150
    assert len({r["doc_id"] for r in seen[0]} & toxic) < 0.5 * len(toxic)
    assert all(r["lossless"] for r in seen[4]) and len(seen[4]) == len(seen[3])
    for rows in seen:
        assert rows


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATOS}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATOS)
    assert docs.collect() == []


def test_nulls_repeats_and_clashing_columns_through_all_stages(spark, docs):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "one two three four five six", "a"), (2, "ONE two three four five six", "a"), (2, "ONE two three four five six", "a"), (None, "one two three four five six", None)]
    rows += [(None, None, None), (3, None, "a"), (4, "", "b"), (5, " \n", None), (6, long, "b"), (7, long + " end", None), (None, "alone here without an id", "c")]
    rows += [(10 + i, f"document number {i} says its own words {i * i} and {i + 7} again", "abc"[i % 3]) for i in range(30)]
    now = docs(rows)
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATOS).cache()
        kept = now.collect()
        if name != "pieces":
            assert now.columns == columns
        if name == "exact_dedup":
            texts = [normal(r["text"]) for r in kept]
            assert len(texts) == len(set(texts))
            # Of equal texts the largest id stays; a null id is below all others.
            assert {r["doc_id"] for r in kept if normal(r["text"]) == "one two three four five six"} == {2}
            assert {r["doc_id"] for r in kept if not r["text"]} == {4}
        if name == "near_dedup":
            assert sum(r["text"].startswith("word0 word1 ") for r in kept if r["text"]) == 1
            assert any(r["doc_id"] is None for r in kept)
    assert kept and all(r["lossless"] for r in kept)


def test_a_stage_frees_what_others_keep_in_its_workers(spark, docs, monkeypatch):
    rows = docs([(1, "a b"), (2, "c d")])
    made = []
    real = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, *more: made.append(f) or real(self, f, schema, *more))
    trigram_counts(rows)
    scored(rows, Model(np.zeros(CODES**3), {}, np.zeros(0), 0.0))
    sketches(rows, Sketching())
    mixed_texts(rows, rows.selectExpr("doc_id", "1L AS size", "1L AS taken", "1 AS passes", "array(struct(0L AS lo, 1L AS hi)) AS spans").limit(0))
    assert len(made) == 4
    for f in made:
        held = common.kept("model", lambda: Pieces(public_tokenizers.path("piece_bpe_32k.model")))
        assert common.kept("model", lambda: None) is held
        gone = weakref.ref(held)
        del held
        list(f(iter([])))
        assert gone() is None
    assert common.kept("one", lambda: 1) == 1 and common.kept("two", lambda: 2) == 2 and common.kept("one", lambda: 3) == 3
    common.let_go()


def test_results_asked_for_often_outlast_a_full_memory():
    seen = common.Renewed(4000)
    seen.keep("often", 1)
    for i in range(500):
        seen.keep(f"word {i}", i)
        assert seen.find("often") == 1
        seen.keep("often", 1) if "often" not in seen else None
    assert len(seen) + len(seen.before) < 40 and seen.find("word 3") is None
