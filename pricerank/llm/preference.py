"""Chat formatting of preference pairs.

A pair has a chosen and a rejected conversation. Their turns are joined by number, the least number at which they differ ends the longest common prefix, the prefix is
rendered once as the prompt and each rest as a completion, in which only the assistant's turns are trained on. All of it is
joins and grouped sums. A pair is one row, however many turns it has and however they are numbered; who has pairs too long for a row sets most_turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricerank.llm.common import stored


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _sides(turns: DataFrame, side: str) -> DataFrame:
    """One row per pair and turn number; rows that share a number are taken in order of role and text, whole repeats once."""
    said = F.array_sort(F.collect_set(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return turns.where("pair_id IS NOT NULL AND turn IS NOT NULL").groupBy("pair_id", "turn").agg(said.alias(side))


def format_pairs(chosen: DataFrame, rejected: DataFrame, most_turns: int | None = None) -> DataFrame:
    """pair_id, chunk, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans of turns (pair_id, turn, role, text).

    n_prompt_turns counts the common turns of the whole pair. Spans (start, end in characters of the completion) are what is trained on. Null roles and texts count as empty; rows without pair or
    turn number are left out. A pair with only one side has no prompt and an empty other completion; equal sides are all prompt. Empty tables give no rows. chunk is 0;
    with most_turns a pair has a row for each so many of its turns in order, chunk counting them, and its prompt and completions are those of its rows, joined in order of chunk. Extra columns are not read.
    """
    both = _sides(chosen, "chosen").join(_sides(rejected, "rejected"), ["pair_id", "turn"], "full")
    both = stored(both.select("*", F.coalesce(F.size("chosen"), F.lit(0)).alias("n"), (~F.col("chosen").eqNullSafe(F.col("rejected"))).alias("differs")))
    ends = both.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("end"))
    common = (F.col("turn") < F.col("end")) | F.col("end").isNull()
    counted = both.select("pair_id", "turn", "n").join(ends, "pair_id").groupBy("pair_id", "end").agg(F.sum(F.when(common, F.col("n")).otherwise(0)).alias("n_prompt_turns"))
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("turn")) - 1
    chunk = F.lit(0) if most_turns is None else F.floor(number / most_turns)
    placed = both.join(counted, "pair_id").withColumn("chunk", chunk.cast("long"))
    listed = lambda when, side: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(when & F.col(side).isNotNull(), F.struct("turn", F.col(side).alias("said"))))), lambda x: x["said"]))
    rows = placed.groupBy("pair_id", "chunk").agg(F.first("n_prompt_turns").alias("n_prompt_turns"), listed(common, "chosen").alias("p"), listed(~common, "chosen").alias("c"), listed(~common, "rejected").alias("r"))
    text = lambda said: F.array_join(F.transform(said, lambda x: rendered(x["role"], x["text"])), "")
    return rows.select("pair_id", "chunk", "n_prompt_turns", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), _trained("c").alias("chosen_spans"), _trained("r").alias("rejected_spans"))


def _trained(said: str) -> Column:
    """Where the assistant's turns stand in the rendered text, without the role's mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        end = done["at"] + F.char_length(rendered(x["role"], x["text"]))
        span = F.struct((done["at"] + F.char_length(x["role"]) + 5).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(said, start, step, lambda done: done["spans"])


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs out of plain conversations: chosen is each conversation up to its last assistant turn, rejected the same with that turn's text
    replaced by the last assistant turn of the conversation whose id differs in the lowest bit. Conversations without such a
    turn, or whose partner has none, make no pair."""
    turns = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    last = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    partner = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    ends = last.select("conv_id", F.col("last.turn").alias("end")).join(partner, "conv_id")
    cut = turns.join(ends, "conv_id").where("turn <= end")
    chosen = cut.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    reply = (F.col("turn") == F.col("end")) & (F.col("role") == "assistant")
    return chosen, cut.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(reply, F.col("other")).otherwise(F.col("text")).alias("text"))


def report(conversations: DataFrame) -> DataFrame:
    """The pairs of swapped_replies(), formatted, with the texts as sha256 and the number of characters trained on."""
    chars = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return format_pairs(*swapped_replies(conversations)).select("pair_id", "chunk", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), sha("prompt"), sha("chosen"), sha("rejected"), chars("chosen_spans").alias("chosen_trained"), chars("rejected_spans").alias("rejected_trained"))
