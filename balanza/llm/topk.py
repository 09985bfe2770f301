"""Exact top-k search by inner product, block at a time.

Vectors are quantised to integers.  Ranges of identifiers form shards, and shards
hold forward indexes: blocks of consecutive vectors with the maximum and minimum
of each component.  For a query, the sum over components of the larger product
bounds every score in a block; blocks are scored in the order of their bounds
until the next bound is below the k-th score found.  Queries go to the shards in
blocks as well; the best k of each shard are merged for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balanza.llm.common import Scratch, ship

#: Vectors in a block, in a shard, and queries in a query block.
BLOCK, SHARD, QUERIES = 128, 4096, 256
#: Integers below this are exact in a double.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def packed(ids: np.ndarray, rows: np.ndarray) -> dict:
    return {"ids": ids.astype("<i8").tobytes(), "vectors": rows.astype("<i8").tobytes(), "n": len(ids), "width": rows.shape[1] if len(ids) else 0}


def pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) as records of at most ``most`` vectors of one width, ids ascending."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush(width: int) -> Iterator[pa.RecordBatch]:
        parts = held.pop(width)
        ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(ids, kind="stable")
        for i in range(0, len(ids), most):
            at = order[i : i + most]
            yield pa.RecordBatch.from_pylist([packed(ids[at], rows[at])], schema=PACKED)

    for b in batches:
        if not b.num_rows:
            continue
        column = b.column("vector")
        widths = column.value_lengths().to_numpy()
        values = column.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)
        ids = b.column("id").to_numpy()
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            rows = values[starts[at][:, None] + np.arange(w)]
            held.setdefault(int(w), []).append((ids[at], rows))
            if sum(len(p[0]) for p in held[int(w)]) >= 4 * most:
                yield from flush(int(w))
    for w in list(held):
        yield from flush(w)


PACKED = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("n", pa.int32()), ("width", pa.int32())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers: by floating point where every sum is exact, by unbounded integers, cut off to a long, where one could overflow."""
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if largest < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LONG - 1, LONG).astype(np.int64)


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best k of one shard: (query id, vector ids, scores), ties to smaller ids."""
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)
    # Both products as one, so that their sum is cut off as a score is.
    bounds = products(np.concatenate([above, below], axis=1), np.concatenate([high, low], axis=1))
    for q in range(len(query_ids)):
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in np.argsort(~bounds[q], kind="stable"):
            # A block whose bound equals the k-th score may still hold a smaller id.
            if len(best) >= k and bounds[q, at] < best[-1]:
                break
            s = slice(starts[at], starts[at] + block)
            scores = products(queries[q : q + 1], rows[s])[0]
            use = ids[s] != query_ids[q]
            if len(best) >= k:
                use &= scores >= best[-1]
            best_ids, best = np.concatenate([best_ids, ids[s][use]]), np.concatenate([best, scores[use]])
            order = np.lexsort((best_ids, ~best))[:k]
            best_ids, best = best_ids[order], best[order]
        yield query_ids[q], best_ids, best


def unpacked(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{name}ids"], "<i8")
    return ids, np.frombuffer(row[f"{name}vectors"], "<i8").reshape(len(ids), -1)


def quantised(vectors: DataFrame) -> DataFrame:
    """(id, vector of integers floor(256 x)); vectors null or with null or non-finite components are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vector"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest scores of each query, ties to smaller vec_id.

    ``vectors`` has vec_id and embedding.  Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all rows but those of the query's own id.
    Only vectors of the query's width are its candidates.  Null ids, null vectors and
    vectors with a null or non-finite component take no part; an empty vector scores 0
    with other empty ones.  Rows that share an id are each a query and a candidate, and
    the best k are those of all queries of one id together; rows alike in id and vector
    count once.  A score beyond a long counts as the nearest long.  Fewer candidates than k give fewer rows; an
    empty table gives none.  Other columns are ignored.
    """
    ship(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "top-k")
    rows = scratch.keep(quantised(vectors).distinct(), "vectors")
    record = "ids binary, vectors binary, n int, width int"
    n_rows, n_asked = rows.count(), rows.filter(F.col("id") % every == 0).count()
    shards = rows.repartitionByRange(max(1, -(-n_rows // SHARD)), F.col("id"), F.xxhash64("vector")).mapInArrow(lambda bs: pack(bs, SHARD), record)
    shards = scratch.keep(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = rows.filter(F.col("id") % every == 0).repartition(max(1, -(-n_asked // QUERIES)))
    asked = scratch.keep(asked.mapInArrow(lambda bs: pack(bs, QUERIES), record), "queries")
    # Each block of queries goes to each shard of its width; both sides are blocks, joined by the width.
    blocks = asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "width")
    pairs = blocks.join(shards.select("shard", "width"), "width").repartition("shard")
    pairs = pairs.join(shards.select("shard", "ids", "vectors"), "shard").select("q_ids", "q_vectors", "ids", "vectors")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                found = list(search(*unpacked(row, ""), *unpacked(row, "q_"), k))
                counts = [len(f[1]) for f in found]
                columns = [np.repeat([f[0] for f in found], counts), *(np.concatenate([f[j] for f in found]) for j in (1, 2))]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    best = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
