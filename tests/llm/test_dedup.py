from __future__ import annotations

from collections import defaultdict

from balanza.llm.dedup import ExactDedup, exact_dedup, without_copies
from tests.llm.conftest import normal, sha

ROWS = [(1, "Ab c"), (2, "aB C"), (3, None), (4, ""), (5, "ab  c"), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (None, "ab c"), (2, "aB C"), (None, "only")]


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = []
    for d, t in rows:
        g = groups[normal(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, sha(normal(t))))
    return sorted(out, key=repr)


def test_groups_nulls_empty_long_and_repeated_rows(docs):
    assert sorted(map(tuple, exact_dedup(docs(ROWS)).collect()), key=repr) == expected(ROWS)


def test_collisions_are_resolved_by_the_full_bytes(docs):
    rows = [(i, f"text {i % 40}") for i in range(120)]
    assert sorted(map(tuple, exact_dedup(docs(rows), digest_chars=1).collect()), key=repr) == expected(rows)


def test_state_takes_further_documents(spark, docs):
    first, more = [(1, "a"), (2, "b")], [(3, "A"), (4, "c")]
    run = ExactDedup(spark, state_partitions=2)
    run.ingest(docs(first))
    run.ingest(docs(more))
    assert sorted(map(tuple, run.result(docs(first + more)).collect()), key=repr) == expected(first + more)


def test_settings_are_put_back(spark, docs):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    exact_dedup(docs([(1, "a")]))
    assert (spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")) == before


def test_stage_keeps_columns_and_one_row_each(docs):
    d = docs([(1, "a"), (2, "A"), (2, "A"), (2, "other"), (None, "z")])
    out = without_copies(d)
    assert out.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == [(2, "A"), (2, "other"), (None, "z")]


def test_empty_table(docs):
    assert exact_dedup(docs([])).collect() == []
    assert without_copies(docs([])).collect() == []
