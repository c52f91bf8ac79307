"""Preference formatting: one prompt and two masked completions per pair of conversations.

Built-in functions only. The longest common turn prefix of the chosen and the rejected
conversation is rendered once as the prompt; what follows in each is its completion, with the
character spans that count for training (the assistant's texts and their ends).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import take
from wattline.session import spool

# How a turn is written, and whose turns are trained on.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def conversations_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order as an array of (role, text).

    Rows with a null conversation id are left out, those with a null turn come first; ties of a
    turn go by role and text, repeated rows count once. Null roles and texts become empty.
    """
    rows = take(turns, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns the two arrays share at their start."""
    most = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, most), F.slice(b, 1, most), lambda x, y: x == y)
    first = F.array_position(pairs, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(most).cast("int")


def completion(turns: Column, start: Column) -> Column:
    """(text, spans) of the turns from ``start`` on; spans are [first, past the last] characters to train on."""
    zero = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        head = F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE))
        a = (F.length(acc["text"]) + F.length(head)).cast("int")
        b = (a + F.length(t["text"]) + F.lit(len(CLOSE))).cast("int")
        span = F.array(F.struct(a.alias("a"), b.alias("b")))
        spans = F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(F.concat(acc["text"], rendered(t)).alias("text"), spans.alias("spans"))

    rest = F.when(start < F.size(turns), F.slice(turns, start + 1, F.size(turns))).otherwise(F.slice(turns, 1, 0))
    return F.aggregate(rest, zero, add)


def format_pairs(pairs: DataFrame, *ids: str) -> DataFrame:
    """The columns ``ids``, then n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``pairs`` has the arrays of (role, text) ``chosen`` and ``rejected``. Equal conversations
    have empty completions on both sides, and one that is the start of the other on its own
    side. Spans are arrays of (a, b), counted in characters of the completion. A null
    conversation counts as one without turns. Columns not named in ``ids`` are ignored.
    """
    nothing = F.array().cast(pairs.schema["chosen"].dataType)
    rows = pairs.select(*ids, *[F.coalesce(pairs[c], nothing).alias(f"{c}_turns") for c in ("chosen", "rejected")])
    c, r, n = F.col("chosen_turns"), F.col("rejected_turns"), F.col("n_prompt_turns")
    rows = rows.withColumn("n_prompt_turns", common_prefix(c, r))
    prompt = F.array_join(F.transform(F.slice(c, 1, n), rendered), "")
    rows = rows.select(*ids, "n_prompt_turns", prompt.alias("prompt"), completion(c, n).alias("c"), completion(r, n).alias("r"))
    return rows.select(
        *ids, "n_prompt_turns", "prompt", F.col("c.text").alias("chosen"), F.col("r.text").alias("rejected"),
        F.col("c.spans").alias("chosen_spans"), F.col("r.spans").alias("rejected_spans"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """(conv_id, partner_id): conversations two by two in the order of their ids.

    Of an odd number the last is given the one before it; a single one has no partner.
    Positions come from a range-partitioned sort and one offset per range.
    """
    ranges = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = conversations.select("conv_id").repartitionByRange(ranges, "conv_id").sortWithinPartitions("conv_id")
    stored = spool(ordered.withColumn("at", F.monotonically_increasing_id()), "conversation-order")
    sizes = stored.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # one row per range
    offsets, total = [], 0
    for row in sorted(sizes):
        offsets.append((row["part"], total))
        total += row["n"]
    offsets = conversations.sparkSession.createDataFrame(offsets or [(0, 0)], "part bigint, before bigint")
    placed = stored.join(offsets, F.shiftright("at", 33) == offsets["part"])
    placed = placed.select("conv_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    other = F.col("place").bitwiseXOR(F.lit(1).cast("bigint"))
    asked = placed.select("conv_id", F.when(other < total, other).otherwise(F.col("place") - 1).alias("place"))
    return asked.join(placed.withColumnRenamed("conv_id", "partner_id"), "place").select("conv_id", "partner_id")


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, partner_id, chosen, rejected): a conversation, and it with its last reply taken from its neighbour.

    A conversation without a reply is rejected with the neighbour's reply added; a neighbour
    without one gives an empty reply.
    """
    of = neighbours(conversations)
    reply = F.coalesce(F.try_element_at(F.filter("turns", lambda t: t["role"] == TRAINED), F.lit(-1))["text"], F.lit(""))
    replies = conversations.select(F.col("conv_id").alias("partner_id"), reply.alias("reply"))
    rows = conversations.join(of, "conv_id").join(replies, "partner_id")
    last = F.aggregate("turns", F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda s, t: F.struct(
        (s["i"] + 1).alias("i"), F.when(t["role"] == TRAINED, s["i"] + 1).otherwise(s["at"]).alias("at")))["at"]
    rows = rows.withColumn("last", last)
    given = F.struct(F.lit(TRAINED).alias("role"), F.col("reply").alias("text"))
    swapped = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("last"), given).otherwise(F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    rejected = F.when(F.col("last") > 0, swapped).otherwise(F.concat("turns", F.array(given)))
    return rows.select("conv_id", "partner_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))
