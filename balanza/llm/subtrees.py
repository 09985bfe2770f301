"""Removal of repeated word windows by prefix-partitioned suffix trees.

A word is removed where a window of ``window`` words that covers it also starts in
a document with a smaller id.

1. Every window has an anchor: the leftmost smallest hash among its first ``reach``
   inner strings of ``inner`` words.  Consecutive windows with one anchor are a run;
   equal windows have equal words around equal anchors.  Runs whose anchor stands in
   one document only are left out, and equal runs become one piece with the
   smallest document that has it.
2. Pieces are dealt out by the prefix of the suffix that starts at their anchor.  The
   prefix has ``inner`` words; where pieces of more than ``tree_bytes`` share it, it
   has all words that the windows around an anchor have in common; where that is
   still too much, each window goes by its whole ``window`` words, which is the
   answer without a tree.  So no task holds more than a bounded number of bytes.
3. In each group the suffixes from the anchors on form a tree, the words before them,
   read backwards, a second one: sorted rows with the common extension of neighbours,
   whose stretches of at least a depth are the internal nodes of that depth.  A
   window that starts q words before its anchor is the pair of a node of depth
   ``window - q`` in the first and one of depth q in the second; the smallest
   document of the pair's leaves is its answer.
4. Answers go back to the runs by hash and to the documents as word ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import Scratch, pieces_of, ship
from balanza.llm.hashing import mixed

#: A null id counts as the largest long.
LAST = np.iinfo(np.int64).max
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Seeds of a piece's digest and of the two hashes of a single window.
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


@dataclass(frozen=True)
class Windows:
    """Words of a window, of an anchor, anchor places in a window, bytes of pieces in one tree."""

    window: int = 50
    inner: int = 4
    reach: int = 36
    tree_bytes: int = 4 << 20

    @property
    def common(self) -> int:
        """Words from the anchor on that lie in every window with this anchor."""
        return self.window - self.reach + 1


def encoded(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words and the distinct words."""
    d = pa.array(words, pa.binary()).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    at, distinct = encoded(words)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[at]


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each size n, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def string_hashes(h: np.ndarray, start: np.ndarray, sizes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Hash of the words start .. start + size - 1 for each pair; a word counts by its place in the string."""
    if not len(start):
        return np.zeros(0, np.uint64)
    j = ragged(sizes)
    with np.errstate(over="ignore"):
        v = mixed(h[np.repeat(start, sizes) + j] + (j.astype(np.uint64) + np.uint64(1)) * STEP + seed)
        return mixed(np.add.reduceat(v, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - have : width - have + n])


def runs(docs: list[list[bytes]], w: Windows) -> tuple[np.ndarray, ...]:
    """(document, start, windows, words before the anchor, anchor, digest) of the runs of windows of some documents."""
    sizes = np.array([len(d) for d in docs], np.int64)
    n = np.maximum(sizes - w.window + 1, 0)
    if not n.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = word_hashes(list(chain.from_iterable(docs)))
    places = np.arange(len(h) - w.inner + 1)
    x = string_hashes(h, places, np.full(len(places), w.inner), SEEDS[0])
    # The upper half of the hash decides, then the place.
    half = np.uint64(32)
    low = smallest((x >> half << half) | places.astype(np.uint64), w.reach)
    base = np.cumsum(sizes) - sizes
    at = np.repeat(base, n) + ragged(n)
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.concatenate([first, [len(at)]]))
    start, anchor = at[first], anchor[first]
    doc = np.repeat(np.arange(len(docs)), n)[first]
    return doc, start - base[doc], size, anchor - start, x[anchor], string_hashes(h, start, size + w.window - 1, SEEDS[0])


def tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows and the number of leading symbols that neighbours share: the tree of these strings."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    differ = rows[order][1:] != rows[order][:-1]
    return order, np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if rows.shape[1] else np.zeros(len(rows) - 1, np.int64)


def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node of this depth above each leaf: neighbours with ``depth`` symbols in common stand below one node."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(common < depth)])
    return out


def least_documents(words: list[list[bytes]], before: np.ndarray, n: np.ndarray, least: np.ndarray, w: Windows) -> np.ndarray:
    """For each piece and window of it the smallest document with that window, in one row of ``reach`` for each piece.

    A piece is the words of ``n`` windows; its anchor has ``before`` words before it
    and ``least`` is the smallest document that has the piece.
    """
    code, _ = encoded(list(chain.from_iterable(words)))
    sizes = np.array([len(x) for x in words], np.int64)
    start = np.cumsum(sizes) - sizes
    at, end = start + before, start + sizes

    def column(place: np.ndarray, ok: np.ndarray) -> np.ndarray:
        return np.where(ok, code[np.clip(place, 0, len(code) - 1)], -1)

    right = np.stack([column(at + k, at + k < end) for k in range(w.window)], axis=1)
    left = np.stack([column(at - 1 - k, at - 1 - k >= start) for k in range(w.reach - 1)], axis=1) if w.reach > 1 else np.zeros((len(words), 0), code.dtype)
    ahead, behind = tree(right), tree(left)
    out = np.full((len(words), w.reach), LAST, np.int64)
    for q in range(w.reach):
        # The window that starts q words before the anchor is number before - q of its piece.
        use = np.flatnonzero((before - q >= 0) & (before - q < n))
        if not len(use):
            continue
        both = nodes(*ahead, w.window - q)[use] * len(words) + nodes(*behind, q)[use]
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
        low = np.minimum.reduceat(least[use][order], first)
        out[use[order], (before - q)[use[order]]] = np.repeat(low, np.diff(np.concatenate([first, [len(use)]])))
    return out


def steps_of(found: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each piece the windows from which on another document is the smallest."""
    change = np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    change &= np.arange(found.shape[1]) < n[:, None]
    _, t = np.nonzero(change)
    offsets = np.concatenate([[0], np.cumsum(change.sum(1))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(found[change], pa.int64())], ["t", "least"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


RUNS = "rank long, key long, start int, n int, before int, anchor long, digest long"
PIECES = "anchor long, digest long, wide long, n int, before int, least long, words binary"
ANSWERS = "anchor long, digest long, steps array<struct<t: int, least: bigint>>"
SINGLES = "one long, two long, anchor long, digest long, t int, least long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>, kept binary"


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def repeated_windows(docs: DataFrame, w: Windows = Windows()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans, kept for each row of ``docs`` (doc_id, text).

    ``spans`` are the removed word ranges [start, end); ``kept`` is the remaining words
    joined by one space, as UTF-8, null where nothing is removed.  Null texts have no
    words; shorter texts than a window are kept whole.  A window counts as repeated
    only if a document with a smaller id has it: rows that share an id do not remove
    each other's words, and a null id counts as the largest long.  Repeated rows are
    each answered.  Other columns are ignored; an empty table gives none.  Windows are
    compared as words inside a tree; equal pieces meet by two 64-bit hashes, single
    windows of an oversized group by two others.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "windows")
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("rank"),
        F.xxhash64("doc_id", "text").alias("key"),
        F.col("text").cast("binary").alias("data"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "data"):
            doc, start, n, before, anchor, digest = runs([(x or b"").split() for x in b.column("data").to_pylist()], w)
            rank, key = (b.column(c).to_numpy()[doc] for c in ("rank", "key"))
            small = [pa.array(x, pa.int32()) for x in (start, n, before)]
            yield pa.record_batch([long(rank), long(key), *small, long(anchor), long(digest)], [c.split()[0] for c in RUNS.split(", ")])

    every = scratch.keep(source.select("rank", "key", "data").mapInArrow(cut, RUNS), "runs")
    shared = every.groupBy("anchor").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).filter("lo < hi").select("anchor")
    hits = scratch.keep(every.join(scratch.keep(shared, "shared"), "anchor", "left_semi"), "hits")
    scratch.drop("runs", "shared")
    scratch.tidy()

    # Each distinct run once, cut out of the smallest document that has it.
    found = hits.groupBy("anchor", "digest").agg(F.min(F.struct("rank", "key", "start")).alias("at"), F.first("n").alias("n"), F.first("before").alias("before"))
    wanted = found.groupBy("at.rank", "at.key").agg(F.collect_list(F.struct("anchor", "digest", "n", "before", "at.start")).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "data"):
            rows: list[tuple] = []
            parts: list[list[bytes]] = []
            for rank, data, wanted in zip(*(b.column(c).to_pylist() for c in ("rank", "data", "wanted"))):
                words = data.split()
                for p in wanted:
                    parts.append(words[p["start"] : p["start"] + p["n"] + w.window - 1])
                    rows.append((p["anchor"], p["digest"], p["n"], p["before"], rank))
            if not rows:
                continue
            anchor, digest, n, before, least = (np.array(c, np.int64) for c in zip(*rows))
            sizes = np.array([len(p) for p in parts], np.int64)
            h = word_hashes(list(chain.from_iterable(parts)))
            wide = string_hashes(h, np.cumsum(sizes) - sizes + before, np.full(len(parts), w.common), SEEDS[0])
            columns = [long(anchor), long(digest), long(wide), pa.array(n, pa.int32()), pa.array(before, pa.int32()), long(least), pa.array([b" ".join(p) for p in parts], pa.binary())]
            yield pa.record_batch(columns, [c.split()[0] for c in PIECES.split(", ")])

    pieces = source.select("rank", "key", "data").join(wanted, ["rank", "key"]).mapInArrow(cut_out, PIECES)
    pieces = scratch.keep(pieces, "pieces")
    scratch.tidy()

    size = F.sum(F.length("words") + 64)
    large = scratch.keep(pieces.groupBy("anchor").agg(size.alias("b")).filter(F.col("b") > w.tree_bytes).select("anchor", F.lit(True).alias("large")), "large")
    huge = pieces.join(large, "anchor").groupBy("wide").agg(size.alias("b")).filter(F.col("b") > w.tree_bytes)
    huge = scratch.keep(huge.select("wide", F.lit(True).alias("huge")), "huge")
    dealt = pieces.join(large, "anchor", "left").join(huge, "wide", "left")
    by_window = F.col("large").isNotNull() & F.col("huge").isNotNull()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees over whole groups; several small ones stand in one forest, which their prefixes keep apart."""
        held: list[tuple] = []
        size, group, last = 0, None, None

        def answer() -> pa.RecordBatch:
            anchor, digest, n, before, least, words = zip(*held)
            n, before, least = (np.array(x, np.int64) for x in (n, before, least))
            found = least_documents([x.split() for x in words], before, n, least, w)
            return pa.record_batch([pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), steps_of(found, n)], ["anchor", "digest", "steps"])

        for b in pieces_of(batches, "words"):
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("grp", "anchor", "digest", "n", "before", "least", "words"))):
                if held and g != group and size > w.tree_bytes // 4:
                    yield answer()
                    held, size = [], 0
                group = g
                # Rows alike in id and text give the same piece; one is enough.
                if (row[0], row[1]) != last:
                    held.append(tuple(row))
                    size += len(row[5]) + 64
                last = row[0], row[1]
        if held:
            yield answer()

    grouped = dealt.filter(~by_window).select(F.when(F.col("large").isNull(), F.col("anchor")).otherwise(F.col("wide")).alias("grp"), "anchor", "digest", "n", "before", "least", "words")
    trees = grouped.repartition("grp").sortWithinPartitions("grp", "anchor", "digest").mapInArrow(grow, ANSWERS)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "words", 500_000):
            parts = [x.split() for x in b.column("words").to_pylist()]
            n = b.column("n").to_numpy().astype(np.int64)
            sizes = np.array([len(p) for p in parts], np.int64)
            h = word_hashes(list(chain.from_iterable(parts)))
            t = ragged(n)
            start = np.repeat(np.cumsum(sizes) - sizes, n) + t
            one, two = (string_hashes(h, start, np.full(len(start), w.window), s) for s in SEEDS[1:])
            rest = [long(np.repeat(b.column(c).to_numpy(), n)) for c in ("anchor", "digest", "least")]
            yield pa.record_batch([long(one), long(two), *rest[:2], pa.array(t, pa.int32()), rest[2]], [c.split()[0] for c in SINGLES.split(", ")])

    alone = scratch.keep(dealt.filter(by_window).select("anchor", "digest", "n", "least", "words").mapInArrow(singles, SINGLES), "singles")
    least = scratch.keep(alone.groupBy("one", "two").agg(F.min("least").alias("least")), "least")
    whole = alone.drop("least").join(least, ["one", "two"]).groupBy("anchor", "digest").agg(F.sort_array(F.collect_set(F.struct("t", "least"))).alias("steps"))
    answers = scratch.keep(trees.unionByName(whole), "answers")
    scratch.drop("pieces", "large", "huge", "singles", "least")
    scratch.tidy()

    def range_of(s, k):
        until = F.coalesce(F.get("steps", k + 1)["t"], F.col("n"))
        return F.struct((F.col("start") + s["t"]).cast("long").alias("start"), (F.col("start") + until + (w.window - 1)).cast("long").alias("end"), (s["least"] < F.col("rank")).alias("gone"))

    met = hits.join(answers, ["anchor", "digest"]).filter(F.exists("steps", lambda s: s["least"] < F.col("rank")))
    met = met.select("rank", "key", F.explode(F.filter(F.transform("steps", range_of), lambda s: s["gone"])).alias("s"))
    marked = met.groupBy("rank", "key").agg(F.collect_set(F.struct("s.start", "s.end")).alias("ranges"))
    marked = scratch.keep(marked, "marked")
    scratch.drop("answers", "hits")
    scratch.tidy()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "data"):
            out: list[tuple] = []
            for doc_id, data, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "data", "ranges"))):
                words = (data or b"").split()
                spans: list[list[int]] = []
                for lo, hi in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                edges = [0, *chain.from_iterable(spans), len(words)]
                kept = b" ".join(chain.from_iterable(words[lo:hi] for lo, hi in zip(edges[::2], edges[1::2])))
                gone = sum(hi - lo for lo, hi in spans)
                out.append((doc_id, len(words), gone, hashlib.sha256(kept).hexdigest(), [{"start": lo, "end": hi} for lo, hi in spans], kept if spans else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return source.join(marked, ["rank", "key"], "left").select("doc_id", "data", "ranges").mapInArrow(remove, RESULT)
