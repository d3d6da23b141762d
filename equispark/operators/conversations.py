"""Conversation turns: histories, windows, token budgets and context.

A single conversation may hold a large share of all turns, so no operator here
brings a whole conversation into one task: "last N" goes through rank limits
that prune on the map side, heads and counts through partial aggregates, and
running sums through two levels of chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.functions.text import words

# Metric words looked for in a conversation.
METRIC_WORDS = (
    "revenue",
    "net income",
    "eps",
    "cash flow",
    "margin",
    "ebitda",
    "debt",
    "free cash flow",
    "growth",
    "opex",
    "operating income",
    "gross profit",
)
CHUNK_TURNS = 1024


def _newest(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation with their place from the end."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("from_end", F.row_number().over(order)).filter(F.col("from_end") <= n)


def _heads(turns: DataFrame) -> DataFrame:
    """First turn, its role and the number of turns of each conversation."""
    return turns.groupBy("conv_id").agg(
        F.min("turn").alias("first_turn"),
        F.min_by("role", "turn").alias("first_role"),
        F.count("*").alias("n_turns"),
    )


def conversation_history(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each conversation, oldest first."""
    return _newest(turns, n).select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


def conversation_window(turns: DataFrame, n: int) -> DataFrame:
    """A leading system turn plus the last n; histories of up to n + 1 turns stay whole."""
    heads = _heads(turns)
    recent = _newest(turns, n + 1).join(heads, "conv_id")
    kept = recent.filter((F.col("from_end") <= n) | (F.col("n_turns") <= n + 1))
    opening = heads.filter((F.col("first_role") == "system") & (F.col("n_turns") > n + 1)).select(
        "conv_id", F.col("first_turn").alias("turn")
    )
    columns = ["conv_id", "turn", "role", "text"]
    return kept.select(*columns).unionByName(turns.join(opening, ["conv_id", "turn"], "left_semi").select(*columns))


def conversation_token_budget(turns: DataFrame, max_tokens: int = 4000, preserve: int = 5) -> DataFrame:
    """Turns that fit a token budget (four characters each).

    A leading system turn and the last `preserve` turns always stay; older turns
    are added newest first until the first that does not fit. Costs are never
    negative, so "until the first misfit" means: the sum from a turn to the end,
    plus the system turn, is within the budget.

    Lengths are read twice, for the chunks and for the turns of those that may
    hold a kept one; texts are read once, for what stays.
    """
    tokens = F.floor(F.length("text") / 4).cast("bigint")
    chunk = F.floor(F.col("turn") / CHUNK_TURNS).cast("bigint")
    costed = turns.select("conv_id", "turn", "role", tokens.alias("tokens"), chunk.alias("chunk"))

    # Level one: what stands behind each chunk, and the cost of a leading system turn.
    sums = costed.groupBy("conv_id", "chunk").agg(
        F.sum("tokens").alias("chunk_tokens"), F.count("*").alias("chunk_turns"), F.min_by(F.struct("turn", "role", "tokens"), "turn").alias("first")
    )
    later = W.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
    opening = F.min_by("first", "chunk").over(W.partitionBy("conv_id"))
    chunks = sums.select(
        "conv_id",
        "chunk",
        F.coalesce(F.sum("chunk_tokens").over(later), F.lit(0)).alias("tail"),
        F.coalesce(F.sum("chunk_turns").over(later), F.lit(0)).alias("behind"),
        opening.alias("opening"),
    )
    chunks = chunks.select(
        "conv_id", "chunk", "tail", "behind", F.when(F.col("opening.role") == "system", F.col("opening")).alias("opening")
    )
    left = max_tokens - F.coalesce("opening.tokens", F.lit(0))
    first_chunk = F.floor(F.col("opening.turn") / CHUNK_TURNS).cast("bigint")
    chunks = chunks.filter((F.col("tail") <= left) | (F.col("behind") < preserve) | (F.col("chunk") == first_chunk))

    # Level two: what stands behind each turn of these chunks.
    to_end = W.partitionBy("conv_id", "chunk").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    placed = (
        costed.join(chunks, ["conv_id", "chunk"])
        .withColumn("to_end", F.col("tail") + F.sum("tokens").over(to_end))
        .withColumn("from_end", F.col("behind") + F.count("*").over(to_end))
    )
    kept = placed.filter((F.col("to_end") <= left) | (F.col("from_end") <= preserve) | (F.col("turn") == F.col("opening.turn")))
    return turns.join(kept.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "role", "text")


def conversation_context(turns: DataFrame, n_questions: int = 5) -> DataFrame:
    """What a conversation refers to, in long form.

    One row per distinct symbol (1-5 letters in the upper-cased text), per
    metric word, and per one of the last user turns. Long rows instead of one
    array per conversation keep any conversation spread over tasks.
    """
    upper = turns.select("conv_id", F.explode(F.array_distinct(words(F.upper("text")))).alias("item"))
    symbols = upper.filter(F.col("item").rlike("^[A-Z]{1,5}$")).distinct()
    lowered = F.lower("text")
    named = F.array_compact(F.array(*[F.when(lowered.contains(m), m) for m in METRIC_WORDS]))
    metrics = turns.select("conv_id", F.explode(named).alias("item")).distinct()
    questions = _newest(turns.filter("role = 'user'"), n_questions)

    def tagged(frame, kind, place):
        return frame.select("conv_id", F.lit(kind).alias("kind"), "item", place.cast("bigint").alias("turn"))

    none = F.lit(None)
    return (
        tagged(symbols, "symbol", none)
        .unionByName(tagged(metrics, "metric", none))
        .unionByName(tagged(questions.withColumn("item", F.col("text")), "question", F.col("turn")))
    )
