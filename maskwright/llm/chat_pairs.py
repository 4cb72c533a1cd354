"""Chat formatting: preference pairs with their longest common turn prefix rendered once.

``format_pairs`` takes pairs of conversation ids. The prompt is the longest run of leading turns that
are equal in both (role and text), rendered once; what follows in either conversation is
its completion, rendered, with a mask over the characters that a loss may see: the texts of
assistant turns, end marks included. ``pair_by_opening`` makes pairs from a table of
conversations: conversations with the same first turn, taken two by two (the lower id is
chosen), near ids first; at most one of each first turn is left over, and it is paired with
itself without its last assistant turn and what follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of a turn (ChatML); in texts their opening is broken by a blank.
OPEN, CLOSE, GUARD = "<|im_start|>", "<|im_end|>", "<|im_"


def gather_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order (turn, role, text), null roles and texts empty."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return conversations.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def rendered(turns: Column) -> Column:
    """Turns as text."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), F.replace(t["text"], F.lit(GUARD), F.lit("<| im_")), F.lit(CLOSE + "\n"))))


def loss_spans(turns: Column) -> Column:
    """``start:end`` of what a loss may see in rendered turns, joined by commas: assistant texts and their end marks."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() AS array<string>)").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = begin + F.length(F.replace(t["text"], F.lit(GUARD), F.lit("<| im_"))) + len(CLOSE)
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: F.concat_ws(",", acc["spans"]))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask`` of rows with two turn arrays.

    ``pairs`` has chosen_id, rejected_id, chosen_turns, rejected_turns. Equal conversations have an empty completion
    on both sides. A shorter conversation that the other continues has an empty completion.
    """
    n = common_turns(F.col("chosen_turns"), F.col("rejected_turns"))
    rows = pairs.withColumn("prompt_turns", n.cast("long"))
    rest = lambda c: F.slice(F.col(c), F.col("prompt_turns").cast("int") + 1, F.greatest(F.size(c) - F.col("prompt_turns").cast("int"), F.lit(0)))
    rows = rows.select("chosen_id", "rejected_id", "prompt_turns", F.slice("chosen_turns", 1, F.col("prompt_turns").cast("int")).alias("p"), rest("chosen_turns").alias("c"), rest("rejected_turns").alias("r"))
    return rows.select("chosen_id", "rejected_id", "prompt_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), loss_spans(F.col("c")).alias("chosen_mask"), loss_spans(F.col("r")).alias("rejected_mask"))


def _run_shifts(low: int, high: int) -> list[int | None]:
    """Bits by which ids are shifted to runs, round by round; None: one run. A round's run holds at most BUCKET runs of the one before."""
    bits = BUCKET.bit_length() - 1
    shifts: list[int | None] = [bits]
    while low >> shifts[-1] != high >> shifts[-1]:
        if (high >> shifts[-1]) - (low >> shifts[-1]) < BUCKET:
            return [*shifts, None]
        shifts.append(shifts[-1] + bits)
    return shifts


def pair_by_opening(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pairs of all conversations of a table, ready for :func:`format_pairs`; each conversation is in one pair.

    Conversations of one opening are paired within runs of BUCKET ids, what a run leaves over within runs of
    BUCKET runs and so on, until at most one of each opening is left: no task sees more than BUCKET of an opening
    at once however common it is. The last one is paired with itself, cut before its last assistant turn. Only ids and digests
    of openings go through the rounds. Rows without a conversation id are left out; a null role or text is
    empty; repeated rows are repeated turns; an empty table gives no pairs.
    """
    talks = gather_turns(conversations, conv_col, turn_col, role_col, text_col)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("t"))
    # head: the lower id of the pair a conversation is in; null while it has none.
    state = first.select("conv_id", F.sha2(F.concat(F.length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")), 256).alias("opening"), F.lit(None).cast("long").alias("head"))
    span = rows.agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).first()
    for shift in _run_shifts(span.low or 0, span.high or 0):
        waits = F.col("head").isNull()
        run = F.lit(0).cast("long") if shift is None else F.shiftright("conv_id", shift)
        state = state.select("*", F.when(waits, F.col("opening")).alias("key"), F.when(waits, run).otherwise(F.col("conv_id")).alias("run"))
        w = Window.partitionBy("key", "run").orderBy("conv_id")
        state = state.select("conv_id", "opening", "head", F.row_number().over(w).alias("rank"), F.lead("conv_id").over(w).alias("after"), F.lag("conv_id").over(w).alias("before"))
        state = state.select("conv_id", "opening", F.when(~waits, F.col("head")).when(F.col("rank") % 2 == 0, F.col("before")).when(F.col("after").isNotNull(), F.col("conv_id")).alias("head"))
    both = talks.join(state.select("conv_id", F.coalesce("head", "conv_id").alias("head")), "conv_id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("conv_id", "turns"))).alias("two"))
    pairs = both.select(F.col("head").alias("chosen_id"), F.col("two")[0]["turns"].alias("turns"), F.try_element_at("two", F.lit(2)).alias("other"))
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    keep = F.coalesce(F.try_element_at(replies, F.lit(-1)), F.size("turns"))
    alone = F.slice("turns", 1, keep)
    return pairs.select("chosen_id", F.coalesce("other.conv_id", "chosen_id").alias("rejected_id"), F.col("turns").alias("chosen_turns"), F.coalesce("other.turns", alone).alias("rejected_turns"))


#: Conversations of one opening are paired within runs of so many ids, a power of two; then within runs of so many runs.
BUCKET = 64
