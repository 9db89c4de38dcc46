"""Quotation linking in conversations (operator 2, native).

A line that begins with one or more ``>`` is quoted, as deep as it has them. A quoted line is a passage: it is
normalised (lower case, runs of white space one space) and its hash joined to the unquoted lines of the same
conversation; the first message that says it is its original, if that comes before the quoting one. The message
that most of a message's lines of depth 1 come from (of equally many the later) is what it replies to; a message
that quotes nothing known replies to the message before it, the one of the greatest lower turn that is there (turns may
have gaps), and the first begins a thread.

Each message gets its thread's first turn and its depth below it by pointer doubling over (conversation, turn),
so that ordering by (conv_id, thread_turn, depth, turn) puts every reply behind what it replies to. No step
gathers a conversation in one task: the originals are a minimum with map-side combine, one for each line, the joins
are on (conversation, line) and (conversation, turn), where Spark splits what is uneven, and the message before is
looked up within ranges of (conversation, turn) that are dealt evenly, and at their edges.

Null and empty texts are messages without lines. Rows without a conversation or turn are threads of their own.
Rows of one conversation and turn are one message that has the lines of both; each row is returned. Other columns
are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written

QUOTED = "^((?:[\\x20\\x09]*>)+)[\\x20\\x09]?(.*)$"


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def _line(x: Column) -> Column:
    marks = F.regexp_extract(x, QUOTED, 1)
    body = F.when(marks != "", F.regexp_extract(x, QUOTED, 2)).otherwise(x)
    return F.struct(
        F.char_length(F.regexp_replace(marks, "[^>]", "")).alias("level"), body.alias("body"), normalised(body).alias("norm")
    )


def _before(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, before): before is the greatest lower turn of the conversation, null for its first.

    Rows are sorted in ranges, so that one conversation may fill many; the last row of each range, one for each
    task, is what the next range's first row looks back to."""
    ranged = written(
        nodes.repartitionByRange("conv_id", "turn").withColumn("part", F.spark_partition_id()), "ranged"
    )
    ends = ranged.groupBy("part").agg(F.max(F.struct("conv_id", "turn")).alias("end"))
    edges = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("edge"))
    inside = Window.partitionBy("part").orderBy("conv_id", "turn")
    looked = ranged.withColumn("last", F.lag(F.struct("conv_id", "turn")).over(inside)).join(F.broadcast(edges), "part")
    seen = F.coalesce("last", "edge")
    return looked.select("conv_id", "turn", F.when(seen["conv_id"] == F.col("conv_id"), seen["turn"]).alias("before"))


def quote_threads(messages: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, role, parent_turn, thread_turn, depth, n_quoted, n_linked, content, formatted), a row for
    each row of messages; content is the text without quoted lines."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    split = rows.withColumn("lines", F.transform(F.split("text", "\\r?\\n"), _line))
    known = split.where("conv_id is not null and turn is not null")
    lines = known.select("conv_id", "turn", F.explode("lines").alias("x")).select(
        "conv_id", "turn", "x.level", "x.norm"
    ).where("norm <> ''").select("conv_id", "turn", "level", F.md5("norm").alias("mark"))
    quoted = written(lines.where("level > 0"), "quoted")
    asked = quoted.select("conv_id", "mark").distinct()
    origins = (
        lines.where("level = 0").join(asked, ["conv_id", "mark"], "left_semi")
        .groupBy("conv_id", "mark").agg(F.min("turn").alias("origin"))
    )
    linked = written(quoted.join(origins, ["conv_id", "mark"]).where("origin < turn"), "linked")
    votes = linked.where("level = 1").groupBy("conv_id", "turn", "origin").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("votes", "origin")).getField("origin").alias("chosen"))
    nodes = known.select("conv_id", "turn").distinct()
    before = _before(nodes)
    state = written(
        before.join(chosen, ["conv_id", "turn"], "left")
        .withColumn("parent", F.coalesce("chosen", "before"))
        .select(
            "conv_id", "turn", "parent", F.coalesce("parent", "turn").alias("up"),
            F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("done"),
        ),
        "replies",
    )
    for _ in range(most_rounds):
        active = state.where("not done")
        if active.isEmpty():
            break
        # only messages that don't know their thread yet look further up
        above = state.select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends")
        )
        after = written(
            active.join(above, ["conv_id", "up"]).select(
                "conv_id", "turn", "parent", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
                F.col("ends").alias("done"),
            ).union(state.where("done")),
            "replies",
        )
        release(state)
        state = after
    else:
        raise RuntimeError("threads have not converged")
    release(quoted)
    counts = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("linked"))
    zero = F.lit(0).cast("long")
    own = F.filter("lines", lambda x: x["level"] == 0)
    told = split.select(
        "conv_id", "turn", "role",
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.btrim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), F.lit("\n ")).alias("content"),
    )
    out = told.join(state, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role",
        F.col("parent").alias("parent_turn"),
        F.coalesce("up", "turn").alias("thread_turn"),
        F.coalesce("depth", zero).alias("depth"),
        "n_quoted",
        F.coalesce("linked", zero).alias("n_linked"),
        "content",
        F.concat(F.coalesce("role", F.lit("")), F.lit(": "), "content").alias("formatted"),
    )
