"""Chat formatting: one rendering of a dialogue for each participant's point of view.

In a participant's rendering their turns are the assistant's and are learnt; every
other speaker is a user, named by their own role name.  System turns instruct and
are nobody's.  A rendering is a row with the text and the character spans to learn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import Scratch
from balanza.llm.mixing import ranked


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the turns that make one part of a very long dialogue."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    system: str = "system"
    part_turns: int = 1024


def escaped(text: Column, template: Template) -> Column:
    """The text with the template's marks broken up, so that a text cannot open or close a turn."""
    for mark in (template.start, template.end.strip()):
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
    return text


def dialogues(rows: DataFrame, template: Template) -> DataFrame:
    """conv_id, part, earlier, turns: the turns of each part in order, and the system turns of the parts before it.

    Only the turns of dialogues of more than one part are numbered, by range partitions; the others are one group each.
    """
    turn = F.struct("turn", "role", "text")
    ordered = F.sort_array(F.collect_list(turn))
    scratch = Scratch(rows.sparkSession, "chat")
    sizes = rows.groupBy("conv_id").count().filter(F.col("count") > template.part_turns)
    long = scratch.keep(sizes.select(F.col("conv_id").alias("of")), "long")
    of_long = F.col("conv_id").eqNullSafe(F.col("of"))
    none = F.array().cast("array<struct<turn: bigint, role: string, text: string>>")
    whole = F.lit(0).cast("long").alias("part"), none.alias("earlier")
    if long.isEmpty():
        return rows.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", *whole, "turns")
    short = rows.join(long, of_long, "left_anti").groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", *whole, "turns")

    # The last key tells equal turns apart, so that many of them do not share a range.
    split = rows.join(long, of_long, "left_semi").withColumn("tie", F.monotonically_increasing_id())
    placed = scratch.keep(ranked(split, [F.col(c) for c in ("conv_id", "turn", "role", "text", "tie")], "at", scratch, "ranges").drop("tie"), "places")
    first = scratch.keep(placed.groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("first")), "first")
    part = F.floor((F.col("at") - F.col("first")) / template.part_turns).cast("long")
    placed = placed.join(first, of_long).select("conv_id", part.alias("part"), "turn", "role", "text")
    parts = placed.groupBy("conv_id", "part").agg(ordered.alias("turns"))
    system = placed.filter(F.col("role") == template.system).select(F.col("conv_id").alias("of"), F.col("part").alias("before"), "turn", "role", "text")
    later = placed.select("conv_id", "part").distinct().join(system, of_long & (F.col("before") < F.col("part")))
    later = later.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("of_part")).agg(ordered.alias("earlier"))
    parts = parts.join(later, of_long & (F.col("part") == F.col("of_part")), "left")
    return short.unionByName(parts.select("conv_id", "part", F.coalesce("earlier", none).alias("earlier"), "turns"))


def perspectives(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, perspective, part, n_turns, carried, text, spans for each participant of each dialogue.

    ``turns`` has conv_id, turn, role and text.  Participants are the roles of a dialogue
    but the system's.  ``spans`` are the [start, end) characters (code points) of ``text`` that the
    perspective's own turns and their end marks cover: the loss mask.  Turns are in the order of
    turn, then role, then text, nulls first; each row is a turn, repeated rows too.  A
    null role is the speaker "unknown", a null text is empty, a null turn stands
    first, rows with a null conv_id form one dialogue.  A dialogue of system turns only has
    no participant and gives no row; an empty table gives none.  Other columns are ignored.

    A dialogue of more than ``part_turns`` turns is rendered in parts, each a row, so that no task
    holds an unbounded dialogue: turns are counted off by their place, whatever their numbers.
    A later part begins with the system turns of the parts before it: ``carried`` is the length of
    that beginning.  ``n_turns`` counts the part's own turns.  Every participant has every part, so
    that the parts of a perspective in order, each without its beginning, are the whole rendering.
    """
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), escaped(F.coalesce("text", F.lit("")), template).alias("text"))
    rows = rows.withColumn("role", escaped(F.col("role"), template))
    speakers = rows.filter(F.col("role") != template.system).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    views = dialogues(rows, template).join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def rendered(t: Column) -> Column:
        own = t["role"] == F.col("perspective")
        name = F.when(t["role"] == template.system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["role"]))
        head = F.concat(F.lit(template.start), name, F.lit("\n"))
        body = F.concat(t["text"], F.lit(template.end))
        return F.struct(head.alias("head"), body.alias("body"), own.alias("own"))

    views = views.withColumn("shown", F.transform(F.concat("earlier", "turns"), rendered))
    place = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(t["head"])
        end = start + F.char_length(t["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    spans = F.aggregate("shown", place, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"])), "")
    carried = F.aggregate(F.slice("shown", 1, F.size("earlier")), F.lit(0), lambda n, t: n + F.char_length(t["head"]) + F.char_length(t["body"]))
    return views.select(
        "conv_id", "perspective", "part", F.size("turns").alias("n_turns"), carried.cast("long").alias("carried"), text.alias("text"), spans.alias("spans")
    )
