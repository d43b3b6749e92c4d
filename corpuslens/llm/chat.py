"""Chat formatting: cumulative snapshots collapse to their longest conversation.

Logs often store a conversation again after every turn. Each conversation gets a
hash of every prefix of its turns; one whose whole hash is a proper prefix of a
longer one is dropped by an anti-join, equal ones keep the smallest id, and what
is left is rendered. Long conversations are hashed and rendered in blocks of
turns, so that none has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.session import stage

BLOCK_TURNS = 256
PART_TURNS = 512


def _hashed_turns(turns: DataFrame) -> DataFrame:
    """One row per turn with its position in the conversation and both prefix hashes."""
    rows = (
        turns.where(F.col("conv_id").isNotNull())
        .select(
            "conv_id",
            F.coalesce("turn", F.lit(-1)).cast("bigint").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .dropDuplicates()
        .withColumns(
            {
                "h1": F.xxhash64(F.lit("a"), "role", "text"),
                "h2": F.xxhash64(F.lit("b"), "role", "text"),
                "block": F.floor(F.col("turn") / BLOCK_TURNS).cast("bigint"),
            }
        )
    )
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inner).cast("bigint"))
    rows = stage(rows, "chat-turns")
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    starts = sizes.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(whole).alias("n_turns"),
    )
    placed = rows.join(starts, ["conv_id", "block"]).withColumn("pos", F.col("start") + F.col("place"))
    return placed.withColumns({"s1": F.xxhash64("pos", "h1"), "s2": F.xxhash64("pos", "h2")})


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, p1, p2): the hash of the first `pos` turns."""
    small = turns.select("conv_id", "block", "pos", "n_turns", "s1", "s2")
    blocks = small.groupBy("conv_id", "block").agg(F.bit_xor("s1").alias("b1"), F.bit_xor("s2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = blocks.select(
        "conv_id",
        "block",
        *[F.coalesce(F.bit_xor(b).over(before), F.lit(0).cast("bigint")).alias(f"before_{b}") for b in ("b1", "b2")],
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = small.withColumns({"r1": F.bit_xor("s1").over(upto), "r2": F.bit_xor("s2").over(upto)})
    return run.join(held, ["conv_id", "block"]).select(
        "conv_id",
        "pos",
        "n_turns",
        F.col("r1").bitwiseXOR(F.col("before_b1")).alias("p1"),
        F.col("r2").bitwiseXOR(F.col("before_b2")).alias("p2"),
    )


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hashed turns, and (conv_id, n_turns, n_copies) of the conversations to keep."""
    placed = stage(_hashed_turns(turns), "chat-placed")
    prefixes = _prefixes(placed)
    ends = F.col("pos") == F.col("n_turns")
    whole = (
        prefixes.where(ends)
        .groupBy("n_turns", "p1", "p2")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    shorter = (
        prefixes.where(~ends)
        .groupBy(F.col("pos").alias("n_turns"), "p1", "p2")
        .agg(F.count("*").alias("n"))
        .drop("n")
    )
    kept = whole.join(shorter, ["n_turns", "p1", "p2"], "left_anti")
    return placed, kept.select("conv_id", "n_turns", "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies and rendered `text` of every maximal conversation.

    A conversation is the list of its turns by `turn` (null first; rows of one turn
    by role, then text; equal rows count once). Null role or text reads as empty.
    Rows without conv_id are left out; a table without rows gives none. Parts of
    `PART_TURNS` turns keep the rendering of a very long conversation bounded; all
    others have part 0 alone. Marker strings inside a text are broken up.
    """
    placed, kept = maximal_conversations(turns)
    safe = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", "<| $1 |>")
    rendered = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), safe, F.lit("<|im_end|>\n"))
    lines = placed.select(
        "conv_id", "pos", F.floor((F.col("pos") - 1) / PART_TURNS).cast("bigint").alias("part"), rendered.alias("line")
    ).join(kept, "conv_id")
    return (
        lines.groupBy("conv_id", "part")
        .agg(
            F.first("n_turns").alias("n_turns"),
            F.first("n_copies").alias("n_copies"),
            F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"),
        )
        .select("conv_id", "part", "n_turns", "n_copies", F.array_join("lines.line", "").alias("text"))
    )
