"""Mixing sources to target weights by Sainte-Laguë apportionment.

All words of a source, in a seeded order of its documents, form a sequence that
is cut into shards and these into blocks of equal size.  The blocks of the mix are
seats: they go to the sources by highest quotients target / (2k + 1), then, within
each source, to its shards by highest quotients of their sizes.  Each shard has an
integer quota; it takes all its blocks as often as the quota allows and the rest in
a seeded order.  Ranks over sources, shards and quotients come from range
partitions with offsets, never from one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balanza.llm.common import WORD, Scratch, let_go, n_words, ship

#: Fixed values of the contract: weights by source order, and how often a document is taken at most.
WEIGHTS = (5, 2, 1)
MOST = 3


@dataclass(frozen=True)
class Blocks:
    """``words`` in a block, ``per_shard`` blocks in a shard on average, ``seed`` of the order."""

    words: int = 16
    per_shard: int = 2048
    seed: int = 20240607


def ranked(df: DataFrame, order: list[Column], name: str, scratch: Scratch, label: str) -> DataFrame:
    """Number the rows 0, 1, ... in a total order: range partitions, then the counts before each as offsets."""
    parts = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = scratch.keep(parts, label)
    counts = parts.groupBy("part").count()
    # One row for each range partition: as many as the cluster has shuffle partitions.
    offsets = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("place", place).join(offsets, "part").withColumn(name, F.col("offset") + F.col("place")).drop("part", "place", "offset")


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target, which never is over ``most`` times the size.

    The excess of the sources at their limit is shared again by weight among the
    others until none is above; each round is one aggregate over the sources.
    """
    order = [F.col("source").asc_nulls_last()]
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = scratch.keep(ranked(sizes, order, "rank", scratch, "source-ranks").withColumn("weight", w.cast("double")), "weights")
    limit = F.col("source_size") * most
    level, total = 0.0, rows.agg(F.sum("source_size")).first()[0] or 0
    while True:
        # A source is at its limit once a level of some round has put it above; the level only rises.
        capped = F.col("weight") * level > limit
        fixed, free = rows.agg(F.sum(F.when(capped, limit)), F.sum(F.when(~capped, F.col("weight")))).first()
        after = (total - (fixed or 0)) / free if free else level
        if after <= level:
            break
        level = after
    return rows.withColumn("target", F.least(F.col("weight") * level, limit.cast("double")))


def apportion(parties: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Sainte-Laguë: ``parties`` (g, p, votes, seats, most) with ``quota`` by highest quotients votes / (2k + 1).

    ``seats`` is the number of seats of the group g, ``most`` the largest quota of the
    party p.  Ties go to the smaller party.  Seats that a divisor known to be too large
    gives are certain; only the quotients between those and what a divisor known to be
    too small gives, about two or three for each party, are ranked.
    """
    per_group = parties.groupBy("g").agg(F.sum("votes").alias("v"), F.count("*").alias("n"))
    rows = parties.join(per_group, "g")
    fair = F.when(F.col("v") > 0, F.col("votes") / F.col("v")).otherwise(F.lit(0.0))

    def bound(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(c, F.col("most"))).cast("long")

    sure = bound(F.floor(fair * (F.col("seats") - F.col("n") / 2.0) + 0.5) - 1)
    possible = bound(F.floor(fair * (F.col("seats") + F.col("n") / 2.0) + 0.5) + 1)
    rows = scratch.keep(rows.withColumn("sure", sure).withColumn("possible", possible), f"{label}-parties")
    quotients = rows.filter("possible > sure").select("g", "p", "votes", F.explode(F.expr("sequence(sure, possible - 1)")).alias("k"))
    order = [F.col("g"), (F.col("votes") / (2 * F.col("k") + 1)).desc(), F.col("p"), F.col("k")]
    numbered = scratch.keep(ranked(quotients, order, "at", scratch, f"{label}-quotients"), f"{label}-order")
    left = rows.groupBy("g").agg((F.max("seats") - F.sum("sure")).alias("open"))
    first = numbered.groupBy("g").agg(F.min("at").alias("start")).join(left, "g")
    won = numbered.join(first, "g").filter("at - start < open").groupBy("g", "p").agg(F.count("*").alias("won"))
    quota = F.col("sure") + F.coalesce(F.col("won"), F.lit(0))
    return rows.join(won, ["g", "p"], "left").select("g", "p", "votes", quota.alias("quota"))


def mix(docs: DataFrame, blocks: Blocks = Blocks(), weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Columns: doc_id, size (words of the text), source_size, target (of its source),
    taken (words, repeats counted), passes (how often the whole text is taken) and
    spans (word ranges [lo, hi) taken once more).  taken never exceeds ``most`` times
    the size.

    Null and empty texts have size 0 and take 0; a null source is one source, last in
    order; null ids and repeated rows are documents like any other (equal rows share
    what falls to them, in any order); an empty table or one without words gives
    targets of 0.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = scratch.keep(targets(sizes, scratch, weights, most), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0

    per_source = F.greatest(F.lit(1), F.ceil(F.col("source_size") / (blocks.words * blocks.per_shard)))
    shard = F.pmod(F.xxhash64(F.lit(blocks.seed), "doc_id", "size"), per_source)
    known = sources.select(F.col("source").alias("of"), "source_size", "target", F.col("rank").alias("g"))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).withColumn("p", shard)

    shards = rows.filter("size > 0").groupBy("g", "p").agg(F.sum("size").alias("words"))
    shards = scratch.keep(shards.withColumn("blocks", F.ceil(F.col("words") / blocks.words)), "shards")
    limits = shards.groupBy("g").agg((F.sum("blocks") * most).alias("most"))
    parties = sources.withColumnRenamed("rank", "p").join(limits.withColumnRenamed("g", "p"), "p")
    seats = F.lit(round(total / blocks.words)).cast("long")
    parties = parties.select(F.lit(0).cast("long").alias("g"), "p", F.col("target").alias("votes"), seats.alias("seats"), "most")
    of_source = apportion(parties, scratch, "sources").select(F.col("p").alias("g"), F.col("quota").alias("seats"))
    parties = shards.join(of_source, "g").select("g", "p", F.col("words").cast("double").alias("votes"), "seats", (F.col("blocks") * most).alias("most"))
    quotas = apportion(parties, scratch, "shards").select("g", "p", "quota").join(shards, ["g", "p"])

    # The seeded choice in a shard: whole passes, then a run of blocks from a seeded start, around the end if need be.
    start = F.pmod(F.xxhash64(F.lit(blocks.seed), "g", "p"), F.col("blocks"))
    quotas = quotas.withColumns({"passes": F.floor(F.col("quota") / F.col("blocks")), "start": start})
    end = F.col("start") + F.col("quota") % F.col("blocks")
    at = lambda block: F.least(block * blocks.words, F.col("words"))
    quotas = scratch.keep(
        quotas.select(
            "g",
            "p",
            "passes",
            at(F.col("start")).alias("lo"),
            at(F.least(end, F.col("blocks"))).alias("hi"),
            at(F.greatest(end - F.col("blocks"), F.lit(0))).alias("wrap"),
        ),
        "quotas",
    )
    # By rows, so that repeated rows stand one after the other.
    seeded = Window.partitionBy("g", "p").orderBy(F.xxhash64(F.lit(blocks.seed + 1), "doc_id"), "doc_id", "size")
    seeded = seeded.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.filter("size > 0").withColumn("b", F.sum("size").over(seeded)).withColumn("a", F.col("b") - F.col("size"))
    placed = placed.join(quotas, ["g", "p"])

    def overlap(lo: Column, hi: Column) -> Column:
        lo = F.greatest(F.col("a"), lo)
        return F.struct((lo - F.col("a")).alias("lo"), (F.least(F.col("b"), hi) - F.col("a")).alias("hi"))

    spans = F.filter(F.array(overlap(F.lit(0), F.col("wrap")), overlap(F.col("lo"), F.col("hi"))), lambda s: s["hi"] > s["lo"])
    placed = placed.withColumn("spans", spans)
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    taken = (F.col("passes") * F.col("size") + extra).cast("long")
    head = ["doc_id", "size", "source_size", "target"]
    out = placed.select(*head, taken.alias("taken"), F.col("passes").cast("int").alias("passes"), "spans")
    rest = rows.filter("size = 0").select(
        *head, F.lit(0).cast("long").alias("taken"), F.lit(0).alias("passes"), F.array().cast("array<struct<lo: bigint, hi: bigint>>").alias("spans")
    )
    return out.unionByName(rest)


def numbered(key: str, order: Column) -> Column:
    """1, 2, ... within the rows of one key."""
    return F.row_number().over(Window.partitionBy(key).orderBy(order))


def mixed_texts(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row for each whole pass and one for each further span of words.

    The text of a span reaches from its first to its last word, white space between
    kept; ``n_chars``, where there is one, follows the text.  Rows that the mix does
    not take are left out.  doc_id tells which document a row comes from.
    """
    ship(docs.sparkSession)
    schema = docs.schema
    # Rows that share an id are told apart by their size and a number; the shuffle is by the id alone.
    spans = taken.select(
        F.col("doc_id").alias("_mix_of"),
        numbered("doc_id", F.col("size")).alias("_mix_m"),
        F.col("taken").alias("_mix_taken"),
        F.col("passes").alias("_mix_passes"),
        F.col("spans").alias("_mix_spans"),
    )
    rows = docs.select("*", numbered("doc_id", n_words(F.col("text"))).alias("_mix_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_mix_of")) & (F.col("_mix_n") - F.col("_mix_m") == 0)
    rows = rows.join(spans, same).filter("_mix_taken > 0")
    words = re.compile(WORD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            index, texts = [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "_mix_passes", "_mix_spans"))
            for i, (text, passes, more) in enumerate(zip(*columns)):
                index += [i] * (passes + len(more))
                texts += [text] * passes
                if more:
                    at = [m.span() for m in words.finditer(text)]
                    texts += [text[at[s["lo"]][0] : at[s["hi"] - 1][1]] for s in more]
            out = batch.take(pa.array(index, pa.int64()))
            made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
            columns = [made[f.name].cast(out.column(f.name).type) if f.name in made else out.column(f.name) for f in schema]
            yield pa.record_batch(columns, [f.name for f in schema])

    return rows.mapInArrow(cut, schema)
