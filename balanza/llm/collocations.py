"""Collocations of two and three words, counted in tiles of frequency-ranked ids.

1. Chunks of documents are cut into words, numbered within the chunk.  Words of at
   least ``least`` occurrences get ids by falling frequency; each chunk learns the ids
   of its words through a join and is written again as ids.
2. A pair of ids is a cell of a square tile of ``side`` x ``side``.  Tiles of frequent
   words are dealt out one by one, all others in buckets of tiles.  A chunk sends its
   distinct cells with counts; where a tile gets many, they are added up in a dense
   array with ``bincount``, else as sorted coordinates.
3. Frequent pairs are ranked by frequency in their turn, and the chunks learn the ids
   of their pairs from the tiles.  A pair followed by a word, where the two last words
   are a frequent pair too, is again a cell of two ids, counted in the same way.
4. Scores, cuts and the longer candidates are joins of the three tables of counts.

A phrase of ``least`` occurrences has only parts of as many, so nothing is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balanza.llm.common import Scratch, pieces_of, ship
from balanza.llm.hashing import mixed
from balanza.llm.mixing import ranked

#: Fixed values of the contract: separators of pieces, here all as a byte that UTF-8 never has, and spaces in them.
BREAK = b"\xff"
TABLE = bytes(255 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c in (9, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))
LOW = np.int64((1 << 32) - 1)


@dataclass(frozen=True)
class Tiles:
    """``least`` occurrences of a candidate; the percentage of it that a longer one must have to displace it; rows of each language.

    ``side`` of a tile; tiles (a, b) with (a + 1)(b + 1) up to ``single`` are dealt out
    alone; text bytes of a chunk; cells in a bucket of the other tiles; chunks whose
    cells of a tile are added up together first.
    """

    least: int = 10
    inside: int = 50
    first: int = 2000
    side: int = 1024
    single: int = 32
    chunk_bytes: int = 8 << 20
    bucket: int = 4_000_000
    together: int = 64


def tokens(data: bytes | None) -> list[bytes]:
    """Words, with a break behind each piece."""
    return (data or b"").translate(TABLE).replace(BREAK, b" \xff ").split() + [BREAK]


def packed(x: np.ndarray, kind: str = "<i8", ascending: bool = False) -> bytes:
    """Numbers, compressed; ascending ones as differences."""
    return zlib.compress((np.diff(x, prepend=np.int64(0)) if ascending else x).astype(kind).tobytes(), 1)


def unpacked(blob: bytes, kind: str = "<i8", ascending: bool = False) -> np.ndarray:
    x = np.frombuffer(zlib.decompress(blob), kind).astype(np.int64)
    return np.cumsum(x) if ascending else x


def encoded(docs: list[bytes | None]) -> pa.DictionaryArray:
    """Words and breaks of some documents, each distinct one once."""
    return pa.array([t for x in docs for t in tokens(x)], pa.binary()).dictionary_encode()


def numbered_words(parts: list[pa.DictionaryArray]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word numbers with -1 for a break, the distinct words and their counts."""
    d = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
    codes, words = d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()
    at = words.index(BREAK)
    codes = np.where(codes == at, -1, codes - (codes > at))
    del words[at]
    # A row of breaks is one break.
    codes = codes[(codes >= 0) | np.concatenate([[True], codes[:-1] >= 0])]
    return codes, words, np.bincount(codes[codes >= 0], minlength=len(words))


def chunk_words(docs: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    return numbered_words([encoded(docs)])


def cells(left: np.ndarray, right: np.ndarray, buckets: int, t: Tiles) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tile, ascending codes, counts) of the id pairs; a code is left * 2 ** 32 + right, buckets of tiles have negative numbers."""
    codes, n = np.unique(left << np.int64(32) | right, return_counts=True)
    a, b = (codes >> np.int64(32)) // t.side, (codes & LOW) // t.side
    tile = a << np.int64(31) | b
    bucket = -1 - (mixed(tile.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    tile = np.where((a + 1) * (b + 1) <= t.single, tile, bucket)
    order = np.argsort(tile, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1]]))
    for lo, hi in zip(first, [*first[1:], len(order)]):
        at = order[lo:hi]
        yield int(tile[at[0]]), codes[at], n[at]


class Tile:
    """Sums of the counts of one tile or bucket: a dense array once a single tile gets many cells, else sorted coordinates."""

    def __init__(self, tile: int, side: int):
        self.side, self.dense = side, None
        self.corner = None if tile < 0 else ((tile >> 31) * side, (tile & ((1 << 31) - 1)) * side)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.folded = 0, 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((codes, n))
        self.waiting += len(codes)
        if self.waiting > max(self.side * self.side, self.folded):
            self.fold()

    def fold(self) -> None:
        if not self.parts:
            return
        codes, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        self.parts, self.waiting = [], 0
        if self.corner and (self.dense is not None or len(codes) * 16 > self.side * self.side):
            if self.dense is None:
                self.dense = np.zeros(self.side * self.side, np.int64)
            cell = ((codes >> np.int64(32)) - self.corner[0]) * self.side + (codes & LOW) - self.corner[1]
            # Sums of one call are exact in doubles; those of all calls are integers.
            self.dense += np.bincount(cell, n, len(self.dense)).astype(np.int64)
            return
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.parts, self.folded = [(codes[first], np.add.reduceat(n, first))], len(first)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        if self.dense is None:
            return self.parts[0]
        at = np.flatnonzero(self.dense)
        return (at // self.side + self.corner[0]) << np.int64(32) | (at % self.side + self.corner[1]), self.dense[at]


CHUNKS = "lang string, codes binary, words array<string>, counts array<bigint>"
PARTS = "lang string, tile long, part long, chunk long, codes binary, counts binary"


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [f for f, _ in fields])


def rows_of(batches: Iterator[pa.RecordBatch], blob: str) -> Iterator[dict]:
    for b in pieces_of(batches, blob, 4_000_000):
        yield from b.to_pylist()


def added_up(batches: Iterator[pa.RecordBatch], t: Tiles, keys: tuple[str, ...], least: int | None) -> Iterator[pa.RecordBatch]:
    """Sums for each key of rows sorted by ``keys``: packed, or one row for each cell of at least ``least``."""
    tile, key = None, None

    def result() -> Iterator[pa.RecordBatch]:
        codes, n = tile.sums()
        if least is None:
            yield batch([(*key, None, packed(codes, ascending=True), packed(n))], PARTS)
            return
        at = np.flatnonzero(n >= least)
        if len(at):
            yield pa.record_batch([pa.array([key[0]] * len(at), pa.string()), pa.array(np.full(len(at), key[1])), pa.array(codes[at]), pa.array(n[at])], ["lang", "tile", "code", "a"])

    for r in rows_of(batches, "codes"):
        k = tuple(r[c] for c in keys)
        if k != key:
            if tile:
                yield from result()
            tile, key = Tile(k[1], t.side), k
        tile.add(unpacked(r["codes"], ascending=True), unpacked(r["counts"]))
    if tile:
        yield from result()


def sent(chunk: int, lang: str, left: np.ndarray, right: np.ndarray, buckets: int, salts: int, t: Tiles) -> Iterator[pa.RecordBatch]:
    if len(left):
        yield batch([(lang, tile, chunk % salts, chunk, packed(codes, ascending=True), packed(n)) for tile, codes, n in cells(left, right, buckets, t)], PARTS)


def frequent(parts: DataFrame, t: Tiles) -> DataFrame:
    """(lang, tile, code, a) of the cells of at least ``least``: sums of some chunks first, then of all."""
    keys = ("lang", "tile", "part")
    some = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(added_up, t=t, keys=keys, least=None), PARTS)
    every = some.repartition("lang", "tile").sortWithinPartitions("lang", "tile")
    return every.mapInArrow(partial(added_up, t=t, keys=("lang", "tile"), least=t.least), "lang string, tile long, code long, a long")


def numbered(df: DataFrame, order: list[Column], name: str, scratch: Scratch, label: str) -> DataFrame:
    """``df`` with its place within its language, from 0, by range partitions."""
    rows = scratch.keep(ranked(df, [F.col("lang"), *order], "seat", scratch, f"{label}-parts"), f"{label}-places")
    first = rows.groupBy("lang").agg(F.min("seat").alias("first"))
    out = scratch.keep(rows.join(first, "lang").withColumn(name, F.col("seat") - F.col("first")).drop("seat", "first"), label)
    scratch.drop(f"{label}-parts", f"{label}-places")
    return out


def learn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the ids of their words in place of numbers, -1 for a break or another word."""
    for b in pieces_of(batches, "codes"):
        chunk, lang, blobs, known = (b.column(c) for c in ("chunk", "lang", "codes", "known"))
        for i in range(b.num_rows):
            codes, own = unpacked(blobs[i].as_py(), "<i4"), known[i].values
            number, ids = own.field("code").to_numpy(), np.full(len(codes) + 1, -1, np.int64)
            # There are no more numbers than words; a break's -1 finds the last place.
            ids[number] = own.field("id").to_numpy()
            yield batch([(chunk[i].as_py(), lang[i].as_py(), packed(ids[codes], "<i4"))], "chunk long, lang string, ids binary")


def pair_cells(batches: Iterator[pa.RecordBatch], buckets: int, salts: int, t: Tiles) -> Iterator[pa.RecordBatch]:
    for r in rows_of(batches, "ids"):
        ids = unpacked(r["ids"], "<i4")
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        yield from sent(r["chunk"], r["lang"], ids[at], ids[at + 1], buckets, salts, t)


def lists(batches: Iterator[pa.RecordBatch], t: Tiles) -> Iterator[pa.RecordBatch]:
    """The frequent pairs of a tile as one row, from rows sorted by tile and code."""
    held, key = [], None
    schema = "lang string, tile long, codes binary, ids binary"

    def row() -> pa.RecordBatch:
        codes, ids = (np.array(x, np.int64) for x in zip(*held))
        return batch([(*key, packed(codes, ascending=True), packed(ids, "<i4"))], schema)

    for b in batches:
        for lang, tile, code, pair in zip(*(b.column(c).to_pylist() for c in ("lang", "tile", "code", "pair"))):
            if held and (lang, tile) != key:
                yield row()
                held = []
            key = lang, tile
            held.append((code, pair))
    if held:
        yield row()


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk has of a tile's frequent pairs; the row with the list comes first among those of a tile."""
    key, codes, ids = None, None, None
    for r in rows_of(batches, "codes"):
        if r["ids"] is not None:
            key, codes, ids = (r["lang"], r["tile"], r["part"]), unpacked(r["codes"], ascending=True), unpacked(r["ids"], "<i4")
        elif (r["lang"], r["tile"], r["part"]) == key:
            mine = unpacked(r["codes"], ascending=True)
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            hit = codes[at] == mine
            if hit.any():
                yield batch([(r["chunk"], r["lang"], packed(mine[hit], ascending=True), packed(ids[at[hit]], "<i4"))], "chunk long, lang string, codes binary, pairs binary")


def triple_cells(batches: Iterator[pa.RecordBatch], buckets: int, salts: int, t: Tiles) -> Iterator[pa.RecordBatch]:
    """Cells (pair id, id of the next word) where both pairs of the three words are frequent."""
    for r in rows_of(batches, "ids"):
        words = unpacked(r["ids"], "<i4")
        codes = np.concatenate([unpacked(x["codes"], ascending=True) for x in r["known"]])
        pairs = np.concatenate([unpacked(x["pairs"], "<i4") for x in r["known"]])
        order = np.argsort(codes)
        codes, pairs = codes[order], pairs[order]
        own = np.where((words[:-1] >= 0) & (words[1:] >= 0), words[:-1] << np.int64(32) | np.maximum(words[1:], 0), -1)
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        pair = np.where(codes[at] == own, pairs[at], -1)
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        yield from sent(r["chunk"], r["lang"], pair[at], words[at + 2], buckets, salts, t)


def collocations(docs: DataFrame, t: Tiles = Tiles()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` collocations of each language of ``docs`` (text, lang).

    A null language is ``und``; null and empty texts have no words.  Candidates are
    phrases of 2 or 3 words within a piece with at least ``least`` occurrences; the
    score is floor(1000000 a a / (l r)) of the lowest-scoring cut, ties to the shorter
    first part, in exact arithmetic.  A pair inside a candidate of three words with
    ``inside`` percent of its occurrences is dropped.  Equal scores go by falling
    occurrences, then phrase.  Repeated rows count each; other columns are ignored; an
    empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "collocations")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts become numbers slice by slice, so that few words are at hand as objects.
        held: dict[str, list[pa.DictionaryArray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, words, counts = numbered_words(parts)
                if words:
                    yield batch([(lang, packed(codes, "<i4"), [x.decode("utf-8", "replace") for x in words], counts.tolist())], CHUNKS)
            held.clear()

        for b in pieces_of(batches, "data"):
            texts: dict[str, list[bytes | None]] = {}
            for lang, data in zip(b.column("lang").to_pylist(), b.column("data").to_pylist()):
                texts.setdefault(lang, []).append(data)
                size += len(data or b"")
            for lang, own in texts.items():
                held.setdefault(lang, []).append(encoded(own))
            if size >= t.chunk_bytes:
                yield from flush()
                size = 0
        yield from flush()

    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("data"))
    chunks = scratch.keep(source.mapInArrow(cut, CHUNKS).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    n_chunks = chunks.count()
    salts = max(1, n_chunks // t.together)
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("chunk", "lang", "code", "w.words", "w.counts")
    all_counts = words.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    total = scratch.keep(chunks.select("lang", F.expr("aggregate(counts, 0L, (s, x) -> s + x)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "total")
    buckets = max(1, -(-(total.agg(F.sum("n")).first()[0] or 0) // t.bucket))
    vocabulary = numbered(all_counts.filter(F.col("f") >= t.least), [F.desc("f"), F.col("word")], "id", scratch, "vocabulary")

    met = words.join(vocabulary.select(F.col("lang").alias("of"), "word", "id"), (F.col("lang") == F.col("of")) & (F.col("words") == F.col("word")))
    known = met.groupBy("chunk", "lang").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    texts = chunks.select("chunk", "lang", "codes").join(known, ["chunk", "lang"])
    texts = scratch.keep(texts.mapInArrow(learn_words, "chunk long, lang string, ids binary"), "texts")
    scratch.drop("chunks")
    scratch.tidy()

    parts = scratch.keep(texts.mapInArrow(partial(pair_cells, buckets=buckets, salts=salts, t=t), PARTS), "pair-cells")
    pairs = numbered(frequent(parts, t), [F.desc("a"), F.col("code")], "pair", scratch, "pairs")
    listed = pairs.repartition("lang", "tile").sortWithinPartitions("lang", "tile", "code").mapInArrow(partial(lists, t=t), "lang string, tile long, codes binary, ids binary")
    listed = listed.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))), "chunk": F.lit(None).cast("long")})
    both = parts.drop("counts").withColumn("ids", F.lit(None).cast("binary")).unionByName(listed)
    both = both.repartition("lang", "tile", "part").sortWithinPartitions("lang", "tile", "part", F.col("ids").isNull())
    own = both.mapInArrow(answers, "chunk long, lang string, codes binary, pairs binary")
    own = own.groupBy("chunk", "lang").agg(F.collect_list(F.struct("codes", "pairs")).alias("known"))
    triples = texts.join(own, ["chunk", "lang"]).mapInArrow(partial(triple_cells, buckets=buckets, salts=salts, t=t), PARTS)
    triples = scratch.keep(frequent(triples, t).drop("tile"), "triples")
    scratch.drop("texts", "pair-cells")
    scratch.tidy()
    return scored(vocabulary, pairs.drop("tile"), triples, total, t)


def scored(vocabulary: DataFrame, pairs: DataFrame, triples: DataFrame, total: DataFrame, t: Tiles) -> DataFrame:
    """The best phrases from the counts of words (lang, id, word, f), pairs (lang, code, a, pair) and triples (lang, code, a)."""
    two = pairs.select("lang", "pair", F.shiftright("code", 32).alias("i"), F.col("code").bitwiseAND(F.lit(int(LOW))).alias("j"), "a")
    three = triples.select("lang", F.shiftright("code", 32).alias("pair"), F.col("code").bitwiseAND(F.lit(int(LOW))).alias("k"), "a")

    def word(df: DataFrame, c: str) -> DataFrame:
        return df.join(vocabulary.select("lang", F.col("id").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}")), ["lang", c])

    def score(l: str, r: str) -> Column:  # noqa: E741
        """Products stay exact in 38 digits."""
        wide = [f"CAST({c} AS DECIMAL(16, 0))" for c in ("a", "a", l, r)]
        return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide[0]} * {wide[1]})) div ({wide[2]} * {wide[3]})")

    first = two.select("lang", "pair", "i", "j", F.col("a").alias("f_ij"))
    second = two.select("lang", F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("f_jk"), F.col("pair").alias("tail"))
    longer = three.join(first, ["lang", "pair"]).join(second, ["lang", "j", "k"])
    held = longer.select("lang", "pair", "a").unionByName(longer.select("lang", F.col("tail").alias("pair"), "a"))
    held = held.groupBy("lang", "pair").agg(F.max("a").alias("longer"))

    short = word(word(two, "i"), "j").join(held, ["lang", "pair"], "left").filter(F.coalesce(100 * F.col("longer") < t.inside * F.col("a"), F.lit(True)))
    short = short.select("lang", F.concat_ws(" ", "word_i", "word_j").alias("phrase"), "a", F.col("f_i").alias("l"), F.col("f_j").alias("r"), score("f_i", "f_j").alias("score"))
    long = word(word(word(longer, "i"), "j"), "k").withColumns({"s1": score("f_i", "f_jk"), "s2": score("f_ij", "f_k")})
    one = F.col("s1") <= F.col("s2")
    long = long.select(
        "lang", F.concat_ws(" ", "word_i", "word_j", "word_k").alias("phrase"), "a",
        F.when(one, F.col("f_i")).otherwise(F.col("f_ij")).alias("l"), F.when(one, F.col("f_jk")).otherwise(F.col("f_k")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = short.unionByName(long).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= t.first)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
