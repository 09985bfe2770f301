"""Ranked lexical search by a dual tree over items and documents.

1. One pass over the documents cuts them into terms, counts documents and terms and
   writes forward lists of the terms that some item has, in shards of some documents.
2. A shard's documents and the items each form a hierarchy of halves; every node holds
   the largest value of each term below it.  All values are at least 0, so the inner
   product of an item node and a document node bounds each score between them.
3. Node pairs are visited from both roots down.  A pair whose bound is below the
   weakest k-th score of the node's items is left out with all pairs below it.  A few
   shards go first; the k-th scores they give are where the others begin.

Items go in groups of bounded text, so what is sent to the tasks is bounded too; each
group is a pass of its own over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balanza.llm.common import Scratch, pieces_of, ship

#: Fixed values of the contract: ASCII letters and digits and everything beyond ASCII make terms, A-Z as a-z.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A null id is last among equal scores.
LAST = np.iinfo(np.int64).max
#: Integers below this are exact in a double.
EXACT = 1 << 53


@dataclass(frozen=True)
class Search:
    """Best documents of an item, bytes of item text in a pass, documents in a shard and below a lowest node, one shard in ``first`` goes first."""

    k: int = 20
    group_bytes: int = 1 << 20
    shard: int = 2048
    leaf: int = 32
    first: int = 16


def terms(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(TERMS).split()


class Rows:
    """Sparse rows with values of at least 0: ``codes`` and ``values`` of row i stand from ``ptr[i]`` to ``ptr[i + 1]``."""

    def __init__(self, ptr: np.ndarray, codes: np.ndarray, values: np.ndarray):
        self.ptr, self.codes, self.values = ptr, codes, values

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row (by its place in ``rows``) and entry of all entries of some rows."""
        n = self.ptr[rows + 1] - self.ptr[rows]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(rows)), n), np.repeat(self.ptr[rows], n) + inside


class Hierarchy:
    """Halves of halves of sparse rows: node 0 is the root, ``children`` of a lowest node are none.

    A node is cut by the term whose values vary most below it, the larger half of its
    values first, so that rows with the same weighty terms stay together.
    """

    def __init__(self, rows: Rows, n_codes: int, leaf: int):
        self.rows, self.members, self.children = rows, [np.arange(len(rows))], [()]
        todo = [0]
        while todo:
            node = todo.pop()
            own = self.members[node]
            if len(own) <= leaf:
                continue
            of, at = rows.take(own)
            codes, values = rows.codes[at], rows.values[at].astype(np.float64)
            total = np.bincount(codes, values, n_codes)
            spread = np.bincount(codes, values * values, n_codes) - total * total / len(own)
            term = np.zeros(len(own))
            hit = codes == spread.argmax()
            term[of[hit]] = values[hit]
            order = np.argsort(-term, kind="stable")
            half = len(own) // 2
            for part in (order[:half], order[half:]):
                self.members.append(own[part])
                self.children.append(())
            self.children[node] = (len(self.members) - 2, len(self.members) - 1)
            todo += self.children[node]

    def maxima(self, n_codes: int) -> np.ndarray:
        """The largest value of each term below each node."""
        out = np.zeros((len(self.members), n_codes), np.int64)
        # Children have larger numbers than their parent.
        for node in range(len(self.members) - 1, -1, -1):
            if self.children[node]:
                a, b = self.children[node]
                np.maximum(out[a], out[b], out=out[node])
            else:
                _, at = self.rows.take(self.members[node])
                np.maximum.at(out[node], self.rows.codes[at], self.rows.values[at])
        return out


class Items:
    """Weighted terms of the items of a group and their hierarchy, one item below each lowest node."""

    def __init__(self, texts: list[bytes | None]):
        self.codes: dict[bytes, int] = {}
        ptr, codes, counts = [0], [], []
        for t in texts:
            seen: dict[int, int] = {}
            for x in terms(t):
                c = self.codes.setdefault(x, len(self.codes))
                seen[c] = seen.get(c, 0) + 1
            codes += seen.keys()
            counts += seen.values()
            ptr.append(len(codes))
        self.counts = Rows(np.array(ptr, np.int64), np.array(codes, np.int64), np.array(counts, np.int64))

    def weigh(self, weights: np.ndarray) -> None:
        c = self.counts
        self.rows = Rows(c.ptr, c.codes, c.values * weights[c.codes])
        self.tree = Hierarchy(self.rows, len(self.codes), 1)
        #: For each node its terms and their largest weights.
        self.nodes = [(at, row[at]) for row in self.tree.maxima(len(self.codes)) for at in [np.flatnonzero(row)]]


def product(values: np.ndarray, weights: np.ndarray, largest: int) -> np.ndarray:
    """values @ weights in integers: by floating point where every sum is exact."""
    if float(weights.sum()) * largest < EXACT:
        return (values.astype(np.float64) @ weights.astype(np.float64)).astype(np.int64)
    return values @ weights


def search(items: Items, docs: Rows, ids: np.ndarray, floor: np.ndarray, w: Search, leaf: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, rows of ``docs``, scores) with the best k of a shard that reach ``floor``, the k-th score known for each item."""
    if not len(docs) or not len(items.counts):
        return
    # Only the terms of this shard.
    known, docs.codes = np.unique(docs.codes, return_inverse=True)
    here = np.full(len(items.codes) + 1, -1, np.int64)
    here[known] = np.arange(len(known))
    tree = Hierarchy(docs, len(known), leaf or w.leaf)
    top = tree.maxima(len(known))
    largest = int(docs.values.max(initial=0))
    weakest = np.maximum(floor, 1)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(node: int, at: np.ndarray) -> np.ndarray:
        codes, weights = items.nodes[node]
        mine = here[codes]
        use = mine >= 0
        return product(top[np.ix_(at, mine[use])], weights[use], largest)

    def below(at: np.ndarray) -> np.ndarray:
        return np.array([c for a in at for c in tree.children[a] or (a,)], np.int64)

    def score(item: int, node: int, at: np.ndarray) -> None:
        """The item against all documents below the given nodes, best bounds first."""
        while any(tree.children[a] for a in at):
            at = below(at)
            at = at[bounds(node, at) >= weakest[item]]
        b = bounds(node, at)
        order = np.argsort(~b, kind="stable")
        at, b = at[order], b[order]
        s = slice(items.rows.ptr[item], items.rows.ptr[item + 1])
        weight = np.zeros(len(known), np.int64)
        mine = here[items.rows.codes[s]]
        weight[mine[mine >= 0]] = items.rows.values[s][mine >= 0]
        done, step = 0, 1
        while done < len(at) and b[done] >= weakest[item]:
            rows = np.concatenate([tree.members[a] for a in at[done : done + step]])
            of, entry = docs.take(rows)
            scores = np.zeros(len(rows), np.int64)
            np.add.at(scores, of, docs.values[entry] * weight[docs.codes[entry]])
            use = scores >= weakest[item]
            rows, scores = np.concatenate([best[item][0], rows[use]]) if item in best else rows[use], np.concatenate([best[item][1], scores[use]]) if item in best else scores[use]
            order = np.lexsort((ids[rows], ~scores))[: w.k]
            best[item] = rows[order], scores[order]
            if len(order) == w.k:
                weakest[item] = max(weakest[item], scores[order[-1]])
            done, step = done + step, step * 2

    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        node, at = todo.pop()
        at = at[bounds(node, at) >= weakest[items.tree.members[node]].min()]
        if not len(at):
            continue
        if items.tree.children[node]:
            todo += [(c, below(at)) for c in items.tree.children[node]]
        else:
            score(int(items.tree.members[node][0]), node, at)
    for item, (rows, scores) in best.items():
        yield item, rows, scores


SHARDS = "n_docs long, n_terms long, ids binary, nulls binary, sizes binary, ptr binary, codes binary, tf binary"
FOUND = "item int, doc_id long, score long"


def ranked_search(docs: DataFrame, items: DataFrame, w: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each row of ``items`` (item_id, text).

    ``docs`` has doc_id and text.  Terms are runs of ASCII letters and digits and all
    characters beyond ASCII, A-Z as a-z.  Only scores above 0 count; equal scores go by
    ascending doc_id, null last.  Null and empty texts have no terms: such documents are
    never found nor counted, such items have no rows.  Rows that share an id are each
    ranked, repeated items each get their ranks.  Other columns are ignored; an empty
    table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "search")
    asked = items.select("item_id", F.col("text").cast("binary").alias("data"))
    asked = scratch.keep(asked.withColumn("q", F.monotonically_increasing_id()), "items")
    text = asked.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n_groups = max(1, -(-2 * text // w.group_bytes))
    group = F.pmod(F.xxhash64("q"), F.lit(n_groups))
    parts = []
    for g in range(n_groups):
        rows = asked.filter(group == g).collect()
        if rows:
            found = one_group(docs, [r["data"] for r in rows], scratch, f"group-{g}", w)
            of = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(rows)], "item int, q long")
            parts.append(scratch.keep(found.join(of, "item").select("q", "rank", "doc_id", "score"), f"found-{g}"))
    if not parts:
        parts = [spark.createDataFrame([], "q long, rank int, doc_id long, score long")]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def ranks(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def one_group(docs: DataFrame, texts: list[bytes | None], scratch: Scratch, label: str, w: Search) -> DataFrame:
    """(item, rank, doc_id, score) of some items, numbered from 0."""
    asked = Items(texts)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of consecutive documents of a task: those that have a term of an item, and the counts of all."""
        get = asked.codes.get
        held: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
        n_docs = n_terms = 0

        def shard() -> pa.RecordBatch:
            ids = np.array([LAST if h[0] is None else h[0] for h in held], "<i8")
            ptr = np.cumsum([0, *(len(h[2]) for h in held)])
            empty = [np.zeros(0, "<i4")]
            blobs = [ids, np.array([h[0] is None for h in held], "?"), np.array([h[1] for h in held], "<i8"), ptr.astype("<i8")]
            blobs += [np.concatenate(empty + [h[i] for h in held]).astype("<i4") for i in (2, 3)]
            columns = [pa.array([x], pa.int64()) for x in (n_docs, n_terms)] + [pa.array([x.tobytes()], pa.binary()) for x in blobs]
            return pa.record_batch(columns, [c.split()[0] for c in SHARDS.split(", ")])

        for b in pieces_of(batches, "data"):
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist()):
                own = terms(data)
                if not own:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(own)
                at = np.fromiter(map(get, own, repeat(-1)), np.int32, len(own))
                codes, tf = np.unique(at[at >= 0], return_counts=True)
                if len(codes):
                    held.append((doc_id, len(own), codes, tf))
                if len(held) >= w.shard:
                    yield shard()
                    held.clear()
                    n_docs = n_terms = 0
        if n_docs:
            yield shard()

    shards = source.mapInArrow(index, SHARDS).withColumn("shard", F.monotonically_increasing_id())
    shards = scratch.keep(shards, f"{label}-shards")
    n, total = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(asked.codes), np.int64)
        for b in batches:
            for x in b.column("codes"):
                count += np.bincount(np.frombuffer(x.as_buffer(), "<i4"), minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], ["code", "df"])

    # One row for each term of these items, whose text is bounded.
    df = np.zeros(len(asked.codes), np.int64)
    for r in shards.select("codes").mapInArrow(frequencies, "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
        df[r["code"]] = r["df"]
    asked.weigh(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64))

    def against(floor: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, nulls, sizes, ptr, codes, tf = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in zip(("ids", "nulls", "sizes", "ptr", "codes", "tf"), ("<i8", "?", "<i8", "<i8", "<i4", "<i4")))
                    m = np.repeat(75 + 25 * sizes * n // max(total, 1), np.diff(ptr))
                    tf = tf.astype(np.int64)
                    rows = Rows(ptr, codes.astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 12 * m))
                    for item, at, scores in search(asked, rows, ids, floor, w):
                        doc_ids = pa.array(ids[at], pa.int64(), mask=nulls[at])
                        yield pa.record_batch([pa.array(np.full(len(at), item), pa.int32()), doc_ids, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

        return run

    ahead = F.pmod(F.xxhash64("shard"), F.lit(w.first)) == 0
    none = np.zeros(len(texts), np.int64)
    early = scratch.keep(ranks(shards.filter(ahead).drop("shard").mapInArrow(against(none), FOUND), w.k), f"{label}-early")
    floor = none.copy()
    for r in early.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= w.k).collect():
        floor[r["item"]] = r["s"]
    late = shards.filter(~ahead).drop("shard").mapInArrow(against(floor), FOUND)
    return ranks(late.unionByName(early.drop("rank")), w.k)
