"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after each turn. Rolling hashes of turn prefixes (an exclusive or of hashes
of role, text and place, in two lanes of 64 bits) tell which logged conversations are prefixes of longer ones; an
anti-join drops those, of equal ones the least conv_id stays, and what is left is rendered as one text each.

Edge cases: turns are ordered by (turn, role, text), nulls first; rows repeated in all four columns count once; a null
role is rendered as `unknown` and a null text as empty, though neither equals a role or text so written; `<|` within a
turn is escaped; null conv_ids make one conversation; a conversation is one row, so it must fit into one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, k, a, b): each turn with its place and the hashes of the prefix up to it."""
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    placed = rows.withColumn("k", F.row_number().over(order))
    content = (F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")), F.col("k"))
    hashed = placed.withColumns({"x": F.xxhash64(F.lit(1), *content), "y": F.xxhash64(F.lit(2), *content)})
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv_id", "turn", "role", "text", "k", F.bit_xor("x").over(rolling).alias("a"), F.bit_xor("y").over(rolling).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with; of equal ones, the least id."""
    slim = turns.select("conv_id", "k", "a", "b")
    whole = slim.groupBy("conv_id").agg(F.max(F.struct("k", "a", "b")).alias("w")).select("conv_id", "w.k", "w.a", "w.b")
    longest = whole.select(F.col("conv_id").alias("c"), F.col("k").alias("n"))
    proper = slim.join(longest, slim["conv_id"].eqNullSafe(longest["c"])).where("k < n").select("k", "a", "b").distinct()
    # of equal conversations one is left before the join, so that a common one is no hot key in it
    least = whole.groupBy("k", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id")).alias("c"))
    left = least.join(proper, ["k", "a", "b"], "left_anti")
    return left.select(F.col("c.conv_id").alias("conv_id"), F.col("k").cast("long").alias("n_turns"))


def plain(text):
    """`<|` as `<\\|`, with one backslash more if there are some, so that no turn can forge another's beginning."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations."""
    turns = prefixes(conversations)
    kept = maximal(turns)
    line = F.concat(F.lit("<|"), plain(F.coalesce("role", F.lit("unknown"))), F.lit("|>\n"), plain(F.coalesce("text", F.lit(""))), F.lit("\n"))
    texts = turns.select(F.col("conv_id").alias("c"), "k", line.alias("line"))
    own = texts.join(kept, texts["c"].eqNullSafe(kept["conv_id"]))
    parts = own.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("parts"))
    return parts.select("conv_id", "n_turns", F.array_join("parts.line", "").alias("rendered"))
