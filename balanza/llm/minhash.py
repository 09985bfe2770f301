"""Near-duplicate detection with SetSketch registers.

A document is the set of its word shingles.  Register i of its sketch is the
truncated minimum over the set of exponential values, on an exponentially spaced
scale: floor(1 - log_b min x_i).  Sketches of parts merge by the maximum, and equal
registers are likelier the more alike two sets are.  Bands of registers find
candidates; a joint likelihood of the registers of two sets, whose sizes are known,
estimates their similarity; full sets confirm each link.

Each document of a bucket is first compared by estimate with the bucket's smallest
document only.  Members that are not surely close to it, in buckets that hold several
clusters so far, are then compared among each other in blocks.  By the triangle
inequality of the distance 1 - J, two linked documents end up in one cluster.  Clusters are then compared by full sets in blocks: a task holds two
blocks of one cluster and returns a spanning forest of the links it found.  A large
cluster first meets a few of its own documents; only those that these leave outside
the largest part are compared with all its blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import Scratch, let_go, pieces_of, ship
from balanza.llm.components import components
from balanza.llm.hashing import mixed, prefix_sums, range_hashes


@dataclass(frozen=True)
class Sketching:
    """Parameters of the operator.

    ``words`` in a shingle; ``registers`` of a sketch, ``bands`` of ``rows`` seeded
    registers each; ``base`` and ``rate`` of the scale; ``percent`` of similarity that
    makes a link; ``slack`` in standard errors of an estimate; ``block`` documents of a
    cluster in a block; ``pivots`` of a large cluster.  At a similarity of 0.8 a
    pair shares no band with a probability of some 5e-6.
    """

    words: int = 2
    registers: int = 128
    bands: int = 64
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    percent: int = 80
    slack: float = 7.0
    block: int = 128
    pivots: int = 4
    seed: int = 31

    @property
    def wanted(self) -> float:
        return self.percent / 100

    @property
    def least(self) -> float:
        """Estimates below this rule a link out."""
        return max(0.0, self.wanted - self.slack * math.sqrt(self.wanted * (1 - self.wanted) / self.registers))


LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: True for the bytes of ASCII white space; all bytes of other characters are 128 or more.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Words of more bytes are hashed by themselves.
LONG_WORD = 32


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``words`` lower-cased words, or all words where there are fewer."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]
    data = LOWER_BYTES[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    space = IS_SPACE[data]
    # A word begins after white space and ends at the next.
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stop = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    w = mixed(range_hashes(prefix_sums(data), begin, stop) + (stop - begin).astype(np.uint64))
    # The polynomial modulo 2 ** 64 tells apart short words only: some long ones of a regular make agree in it.
    for i in np.flatnonzero(stop - begin > LONG_WORD):
        w[i] = xxhash.xxh3_64_intdigest(data[begin[i] : stop[i]].tobytes())
    first = np.concatenate([[0], np.searchsorted(begin, ends)])
    runs = np.zeros(max(0, len(w) - words + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            runs = mixed(runs * np.uint64(3) + w[k : len(w) - words + 1 + k])
    out = []
    for lo, hi in zip(first, first[1:]):
        if hi - lo >= words:
            out.append(np.unique(runs[lo : hi - words + 1]))
        elif hi > lo:
            h = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for x in w[lo:hi]:
                    h = mixed(h * np.uint64(3) + x)
                # A short sequence is no run of the full length.
                out.append(mixed(h + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Sketcher:
    """Registers and bands of shingle sets."""

    def __init__(self, s: Sketching):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.factor = rng.integers(1, 1 << 63, s.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, s.registers, dtype=np.uint64)
        self.picks = np.stack([np.sort(rng.choice(s.registers, s.rows, replace=False)) for _ in range(s.bands)])

    def minima(self, sets: list[np.ndarray], cells: int = 2048) -> np.ndarray:
        """Smallest value of each set for each register: affine maps of scrambled hashes.  No set is empty."""
        out = np.full((len(sets), len(self.factor)), np.iinfo(np.uint64).max, np.uint64)
        values, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(sets)), sizes)
        with np.errstate(over="ignore"):
            for i in range(0, len(values), cells):
                y = values[i : i + cells, None] * self.factor
                y += self.shift
                lo, hi = of[i], of[min(i + cells, len(values)) - 1]
                starts = np.maximum(np.concatenate([[i], ends[lo:hi]]) - i, 0)
                np.minimum(out[lo : hi + 1], np.minimum.reduceat(y, starts), out=out[lo : hi + 1])
        return out

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """floor(1 - log_b of the exponential minimum) around 2 ** 15, cut off to 16 bits."""
        u = (self.minima(sets) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        with np.errstate(divide="ignore"):
            k = np.floor(1 - np.log(-np.log1p(-u) / self.s.rate) / math.log(self.s.base))
        return np.clip(k + (1 << 15), 0, 65535).astype("<u2")

    def bands(self, registers: np.ndarray) -> np.ndarray:
        """One value for each set and band."""
        h = np.arange(self.s.bands, dtype=np.uint64)[None]
        with np.errstate(over="ignore"):
            for k in range(self.s.rows):
                h = mixed(h * np.uint64(0x100000001B3) + registers[:, self.picks[:, k]].astype(np.uint64))
        return h.view(np.int64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float, grid: int = 101) -> np.ndarray:
    """Similarity of largest joint likelihood, from the numbers of larger, smaller and equal registers and both set sizes.

    With u and v the shares of the sizes in their sum, a register is larger in a with
    probability p(u - v J), smaller with p(v - u J) and equal otherwise, where
    p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, less = (a > b).sum(-1)[..., None], (a < b).sum(-1)[..., None]
    equal = a.shape[-1] - more - less
    u = (na / (na + nb))[..., None]
    v = 1 - u
    j = np.linspace(0, 1, grid) * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (base - 1) / base) / np.log(base)
    up, down = p(u - v * j), p(v - u * j)
    fit = more * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))
    return np.take_along_axis(j, fit.argmax(-1)[..., None], -1)[..., 0]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    """Union-find over the documents of a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def connecting(
    ids: np.ndarray, known: np.ndarray, side: np.ndarray, regs: np.ndarray, sizes: np.ndarray, s: Sketching, holds: Callable[[int, int], bool]
) -> list[tuple[int, int]]:
    """Pairs that connect what was not connected: side 0 with side 1, or within side 0 where there is no other.

    ``known`` is each row's component so far.  Pairs are tried by falling estimate;
    pairs already connected are left out, as are those that an estimate surely rules
    out; ``holds`` decides on the others.
    """
    forest, first = Forest(len(ids)), {}
    for i, c in enumerate(known.tolist()):
        forest.join(first.setdefault(c, i), i)
    place, two = np.arange(len(ids)), bool((side == 1).any())
    found, pairs = [], []
    for i in np.flatnonzero(side == 0):
        near = np.flatnonzero((known != known[i]) & ((side == 1) if two else (place > i)))
        near = near[100 * np.minimum(sizes[i], sizes[near]) >= s.percent * np.maximum(sizes[i], sizes[near])]
        if len(near):
            guess = likeliest(regs[i][None], regs[near], np.full(len(near), sizes[i]), sizes[near], s.base)
            pairs += [(-g, int(i), int(j)) for g, j in zip(guess, near) if g >= s.least]
    for _, i, j in sorted(pairs):
        if forest.find(i) != forest.find(j) and holds(i, j):
            forest.join(i, j)
            found.append((int(ids[i]), int(ids[j])))
    return found


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of one key together, from batches sorted by the keys."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGES)


def sketches(docs: DataFrame, s: Sketching) -> DataFrame:
    """doc_id, n, digest (of the set), registers, bands for each row of ``docs`` (doc_id, text); nulls for empty sets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sketcher = Sketcher(s)
        for b in pieces_of(batches, "text"):
            sets = shingle_sets(b.column("text"), s.words)
            full = [i for i, x in enumerate(sets) if len(x)]
            regs: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if full:
                r = sketcher.registers([sets[i] for i in full])
                for i, x, y in zip(full, r, sketcher.bands(r)):
                    regs[i], bands[i] = x.tobytes(), y
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            n = pa.array([len(x) for x in sets], pa.int64())
            columns = [b.column("doc_id"), n, pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "n", "digest", "registers", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "doc_id long, n long, digest binary, registers binary, bands array<long>"
    )


def estimates(pairs: DataFrame, s: Sketching) -> DataFrame:
    """``pairs`` (a, b, a_n, a_registers, b_n, b_registers) as (a, b, guess)."""

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, s.registers) for c in ("a_registers", "b_registers"))
                na, nb = (b.column(c).to_numpy().astype(np.float64) for c in ("a_n", "b_n"))
                g = np.concatenate([likeliest(ra[i : i + 500], rb[i : i + 500], na[i : i + 500], nb[i : i + 500], s.base) for i in range(0, len(na), 500)])
                yield pa.record_batch([b.column("a"), b.column("b"), pa.array(g)], ["a", "b", "guess"])

    return pairs.mapInArrow(guess, "a long, b long, guess double")


def block_tasks(rows: DataFrame, group: list[str], payload: list[str], s: Sketching) -> DataFrame:
    """Deal the rows (group, id, part, payload) of each group to tasks (group, x, y) of two blocks, as side 0 and side 1.

    ``part`` is a row's component so far; rows of one part need no comparison.  A small
    group is one task.  In a larger one the largest part makes blocks r .. r + m - 1 and
    the rest blocks 0 .. r - 1; task (x, y), x <= y and x < r, compares block x with
    block y, so that each pair with a row of the rest meets once.
    """
    counts = rows.groupBy(*group, "part").agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*group).agg(F.sum("c").alias("size"), F.max(F.struct("c", "part")).alias("main")).filter("main.c < size")
    one = F.col("size") <= s.block
    main = F.when(one, F.lit(0)).otherwise(F.col("main.c"))
    sizes = sizes.select(
        *group,
        F.ceil((F.col("size") - main) / s.block).alias("r"),
        F.ceil(main / s.block).alias("m"),
        F.when(~one, F.col("main.part")).alias("main"),
    )
    rows = rows.join(sizes, group).withColumn("outside", F.coalesce(F.col("part") != F.col("main"), F.lit(True)))
    salt = F.xxhash64(F.lit(s.seed), "id")
    rows = rows.withColumn("k", F.when(F.col("outside"), F.pmod(salt, F.col("r"))).otherwise(F.col("r") + F.pmod(salt, F.greatest("m", F.lit(1)))))
    cells = [*group, "x", "y", "side", "id", "part", *payload]
    left = rows.filter("outside").withColumns({"x": F.col("k"), "y": F.explode(F.expr("sequence(k, r + m - 1)")), "side": F.lit(0)})
    right = rows.filter("k > 0").withColumns({"x": F.explode(F.expr("sequence(0L, least(k, r) - 1)")), "y": F.col("k"), "side": F.lit(1)})
    keys = [*group, "x", "y"]
    return left.select(*cells).unionByName(right.select(*cells)).repartition(*keys).sortWithinPartitions(*keys)


def arrays(group: list[dict], *names: str) -> list[np.ndarray]:
    return [np.array([r[c] for r in group], np.int64) for c in names]


def candidate_clusters(nodes: DataFrame, s: Sketching, scratch: Scratch) -> DataFrame:
    """(id, root): documents that chains of near estimates within buckets connect.  ``nodes`` has id, n, registers, bands."""
    bands = nodes.select("id", F.posexplode("bands").alias("band", "value"))
    buckets = bands.groupBy("band", "value").agg(F.min("id").alias("least"), F.count("*").alias("m")).filter("m > 1")
    rows = bands.join(buckets, ["band", "value"]).filter("id <> least").select("band", "value", "id", "least")
    rows = scratch.keep(rows, "bucket-members")
    pairs = rows.select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    side = nodes.select("id", "n", "registers")
    for c in "ab":
        pairs = pairs.join(side.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("registers").alias(f"{c}_registers")), c)
    guesses = scratch.keep(estimates(pairs, s), "estimates")
    stars = guesses.filter(F.col("guess") >= s.least).select("a", "b")
    # Each document's smallest near one, and that one's, tells most of what is connected already.
    near = stars.groupBy("a").agg(F.min("b").alias("near"))
    further = near.select(F.col("a").alias("of"), F.col("near").alias("further"))
    near = near.join(further, F.col("near") == F.col("of"), "left").select(F.col("a").alias("id"), F.coalesce("further", "near").alias("near"))
    near = scratch.keep(near, "near")
    # Members not surely close to the smallest are compared among themselves, where they are of several parts.
    far = guesses.filter(F.col("guess") < s.wanted).select(F.col("a").alias("id"), F.col("b").alias("least"))
    rest = rows.join(far, ["id", "least"]).join(near, "id", "left").select("band", "value", "id", F.coalesce("near", "id").alias("part"))
    open_ = rest.groupBy("band", "value").agg(F.min("part").alias("r0"), F.max("part").alias("r1")).filter("r0 <> r1").select("band", "value")
    rest = scratch.keep(rest.join(open_, ["band", "value"]), "bucket-rest")
    scratch.drop("bucket-members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["band", "value", "x", "y"]):
            ids, part, at, n = arrays(group, "id", "part", "side", "n")
            regs = np.stack([np.frombuffer(r["registers"], "<u2") for r in group])
            yield edge_batch(connecting(ids, part, at, regs, n, s, lambda i, j: True))

    tasks = block_tasks(rest.join(side, "id"), ["band", "value"], ["n", "registers"], s)
    more = scratch.keep(tasks.mapInArrow(compare, "a long, b long"), "bucket-edges")
    return scratch.keep(components(stars.unionByName(more), scratch, "clusters"), "clusters")


def confirmed_links(members: DataFrame, s: Sketching, scratch: Scratch) -> DataFrame:
    """Edges (a, b), confirmed on full sets, that connect whatever links connect; ``members`` has cluster, id, registers, text."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    members = scratch.keep(members.join(sizes, "cluster"), "members")
    large = members.filter(F.col("size") > s.block)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for b in pieces_of(batches, "text", 500_000):
            masks = []
            for x, pivots in zip(shingle_sets(b.column("text"), s.words), b.column("pivots").to_pylist()):
                key = tuple(p["id"] for p in pivots)
                if key not in held:
                    held = {key: shingle_sets(pa.array([p["text"] for p in pivots], pa.string()), s.words)}
                masks.append(sum(1 << i for i, o in enumerate(held[key]) if alike(x, o, s.percent)))
            yield pa.record_batch([b.column("id"), b.column("cluster"), pa.array(masks, pa.int32())], ["id", "cluster", "mask"])

    # A few documents of each large cluster, by seeded order, meet all others of it.
    picked = large.groupBy("cluster").agg(
        *(F.min(F.struct(F.xxhash64(F.lit(s.seed + k), "id").alias("h"), "id", "text")).alias(f"p{k}") for k in range(s.pivots))
    )
    chosen = (F.struct(F.col(f"p{k}.id").alias("id"), F.col(f"p{k}.text").alias("text")) for k in range(s.pivots))
    picked = scratch.keep(picked.select("cluster", F.array(*chosen).alias("pivots")), "pivots")
    met = large.join(picked, "cluster").select("id", "cluster", "text", "pivots")
    met = scratch.keep(met.mapInArrow(meet, "id long, cluster long, mask int"), "met")
    # Pivots that some document links with both are connected; the number of masks is bounded by that of the pivots.
    masks = met.filter("mask > 0").groupBy("cluster").agg(F.collect_set("mask").alias("masks"))

    def grown(mask: Column) -> Column:
        return F.aggregate("masks", mask, lambda m, x: F.when(m.bitwiseAND(x) != 0, m.bitwiseOR(x)).otherwise(m))

    linked = met.filter("mask > 0").join(masks, "cluster")
    for _ in range(s.pivots):
        linked = linked.withColumn("mask", grown(F.col("mask")))
    # The first pivot of a connected set names the part, which its own document belongs to.
    first_pivot = F.log2(F.col("mask").bitwiseAND(-F.col("mask"))).cast("int")
    linked = linked.join(picked.select("cluster", F.transform("pivots", lambda p: p["id"]).alias("p")), "cluster")
    parts = scratch.keep(linked.select(F.col("id").alias("of"), F.get("p", first_pivot).alias("part")), "parts")
    first = parts.filter("of <> part").select(F.col("of").alias("a"), F.col("part").alias("b"))
    rows = members.join(parts, F.col("id") == F.col("of"), "left").withColumn("part", F.coalesce("part", "id")).drop("of", "size")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["cluster", "x", "y"]):
            ids, part, at = arrays(group, "id", "part", "side")
            regs = np.stack([np.frombuffer(r["registers"], "<u2") for r in group])
            sets = shingle_sets(pa.array([r["text"] for r in group], pa.string()), s.words)
            n = np.array([len(x) for x in sets])
            yield edge_batch(connecting(ids, part, at, regs, n, s, lambda i, j: alike(sets[i], sets[j], s.percent)))

    tasks = block_tasks(rows, ["cluster"], ["registers", "text"], s)
    return first.unionByName(scratch.keep(tasks.mapInArrow(compare, "a long, b long"), "links"))


def near_duplicates(docs: DataFrame, s: Sketching = Sketching()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A document is
    linked with another if 100 * intersection >= percent * union of their sets of
    shingles; component_id is the smallest doc_id that links reach.  Null and empty
    texts and texts of white space have 0 shingles and are linked with nothing.  A
    null id takes no part: its component is null and the row is kept.  Repeated rows
    are linked as equal sets are, and share their id; rows of one id with different
    texts are each linked by their own text.  Other columns are ignored; an empty table gives none.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.keep(sketches(docs, s), "sketches")
    # Equal sets are one node, named by its smallest id.
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(named.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    nodes = named.join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("id")))
    nodes = scratch.keep(nodes.select("id", "digest", "n", "registers", "bands").dropDuplicates(["id", "digest"]), "nodes")
    clusters = candidate_clusters(nodes, s, scratch)
    inside = nodes.select("id", "registers").join(clusters, "id").select("id", F.col("root").alias("cluster"), "registers")
    texts = docs.select(F.col("doc_id").cast("long").alias("of"), "text")
    edges = confirmed_links(inside.join(texts, F.col("id") == F.col("of")).drop("of"), s, scratch)
    roots = scratch.keep(components(edges, scratch, "components"), "components")
    known = classes.join(roots, "id", "left").select(F.col("digest").alias("d"), F.coalesce("root", "id").alias("root"))
    out = rows.join(known, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of each component the document with the smallest id."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    dropped = scratch.keep(near_duplicates(docs, Sketching(words=words)).filter("NOT kept").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["doc_id"], "left_anti")
