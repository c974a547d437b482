r"""Chat formatting in budgeted, turn-aligned windows, in DataFrame expressions only.

A conversation is its rows in turn order (ties by role and text).  Prefix sums of turn tokens cut
it into spans of whole turns: with a stride of half the room that system turn and history leave, a
turn belongs to the span of the tokens before it, and a turn longer than the stride is a span of its
own.  A window is a span with the conversation's first system turn before it and with the turns
just before the span that fit the history budget.  Repeated turns are never targets: the loss mask
covers the text of every assistant turn once, in the window that has it as new.  A window has at
most ``budget`` tokens, unless a single turn alone is longer.

Template of a turn: ``<turn>role``, line feed, ``<text>``, line feed, text, line feed, ``</turn>``, line
feed.  Backslashes and the three control strings are escaped with a backslash inside roles and
texts, so a control string after a line feed is always the template's, and reading back is exact.

Prefix sums go through blocks of turn numbers, windows are grouped by conversation and span: a conversation
with a third of all rows is spread over many tasks (its number of blocks, not of turns, meets in
one).  Only the digest of ``digests`` has to bring a conversation's text together, as its definition asks.

Null roles and texts are empty texts, null turns come first, a null ``conv_id`` is one more conversation.
Repeated rows are turns of their own.  Empty texts are turns.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
TURN_COST = 4
BLOCK_TURNS = 64
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"

_CONTROL = r"(\\|</?turn>|<text>)"
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_OPEN, _MIDDLE, _CLOSE = "<turn>", "\n<text>\n", "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _CONTROL, "$1")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their position, tokens and the tokens before them in the conversation."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "tokens", F.regexp_count("text", F.lit(_TOKEN)) + F.lit(TURN_COST)).withColumn(
        "block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = (Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = (Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    own = rows.select("*", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t_in"),
                      F.count("*").over(inside).alias("n_in"))
    return own.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv"))
                    & F.col("block").eqNullSafe(F.col("b_block"))).select(
        "conv_id", (F.col("n_before") + F.col("n_in")).alias("pos"), "role", "text",
        F.col("tokens").cast("bigint").alias("tokens"), (F.col("t_before") + F.col("t_in")).alias("at"))


def _rendered(turns: Column) -> list[Column]:
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(_OPEN), escape(t["role"]), F.lit(_MIDDLE)).alias("head"), escape(t["text"]).alias("body"),
        ((t["kind"] == 2) & (t["role"] == TARGET_ROLE)).alias("target")))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans"))

    def step(so_far: Column, p: Column) -> Column:
        body_at = so_far["at"] + F.length(p["head"])
        span = F.struct(body_at.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((body_at + F.length(p["body"]) + len(_CLOSE)).alias("at"),
                        F.when(p["target"], F.concat(so_far["spans"], F.array(span)))
                        .otherwise(so_far["spans"]).alias("spans"))

    return [
        F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), "").alias("formatted"),
        F.size(turns).alias("n_turns"),
        F.size(F.filter(turns, lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.aggregate(turns, F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("tokens"),
        F.aggregate(pieces, start, step, lambda a: a["spans"]).alias("loss"),
    ]


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window.

    ``conv_id``, ``window`` (order within the conversation), ``formatted``, ``n_turns``, ``n_repeated`` (turns
    at the front that are no targets), ``tokens``, ``loss`` (spans of characters of ``formatted``).
    """
    turns = _turns(conversations)
    system = turns.where(F.col("role") == SYSTEM_ROLE).groupBy(F.col("conv_id").alias("s_conv")).agg(
        F.min(F.struct("pos", "role", "text", "tokens")).alias("system"))
    reserve = system.select("s_conv", F.col("system.pos").alias("s_pos"), F.col("system.tokens").alias("s_tokens"))
    room = F.greatest(F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0)), F.lit(budget // 4))
    placed = (
        turns.join(reserve, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
        .withColumn("stride", F.floor(room / 2))
        .withColumn("span", 2 * F.floor(F.col("at") / F.col("stride"))
                    + (F.col("tokens") > F.col("stride")).cast("int")))
    turn = F.struct("kind", "pos", "role", "text", "tokens").alias("t")
    new = placed.withColumn("kind", F.lit(2)).select("conv_id", F.col("span").alias("window"), turn)
    spans = placed.groupBy(F.col("conv_id").alias("w_conv"), F.col("span").alias("window")).agg(
        F.min("at").alias("from"), F.min("pos").alias("first"))

    # A turn can be history only of spans that start within the history budget after it.
    since = F.floor((F.col("at") + F.col("tokens")) / F.col("stride"))
    until = F.floor((F.col("at") + history) / F.col("stride"))
    candidates = (
        placed.where((until >= since) & (F.col("tokens") <= history) & ~F.col("pos").eqNullSafe(F.col("s_pos")))
        .withColumn("k", F.explode(F.sequence(since, until)))
        .withColumn("later", F.explode(F.array(2 * F.col("k"), 2 * F.col("k") + 1))))
    repeated = (
        candidates.join(spans, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("later") == F.col("window")))
        .where((F.col("at") + F.col("tokens") <= F.col("from")) & (F.col("at") >= F.col("from") - history))
        .withColumn("kind", F.lit(1)).select("conv_id", "window", turn))
    kept = (
        spans.join(system, F.col("w_conv").eqNullSafe(F.col("s_conv"))).where(F.col("system.pos") < F.col("first"))
        .select(F.col("w_conv").alias("conv_id"), "window", F.lit(0).alias("kind"), "system.*")
        .select("conv_id", "window", turn))
    return (
        new.unionByName(repeated).unionByName(kept).groupBy("conv_id", "window")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select("conv_id", "window", *_rendered(F.col("turns"))))


def read_back(formatted: DataFrame) -> DataFrame:
    """The new turns of each window and the texts under its mask, from the output columns alone."""
    parts = F.split("formatted", _CLOSE)
    own = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    turns = F.transform(own, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(_OPEN) + 1)), _MIDDLE, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, _MIDDLE) + len(_MIDDLE))).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_texts"),
                            F.length("formatted").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its windows alone."""
    back = read_back(formatted).select(
        "conv_id", "window", F.size("turns").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("loss_texts", "").alias("loss"))
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    loss = F.array_join("w.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
