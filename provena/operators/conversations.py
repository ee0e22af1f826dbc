"""Conversations and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def listing(headers: DataFrame, messages: DataFrame, username: str, library: str | None = None, limit: int = 50) -> DataFrame:
    """A user's conversations (conversation_id, title, updated_at) with their number of messages (0 without any), the one changed last first."""
    own = headers.where(F.col("username") == username)
    own = own if library is None else own.where(F.col("library") == library)
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("n"))
    return own.join(counts, "conversation_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("updated_at"), "conversation_id").limit(max(limit, 1))


def search(headers: DataFrame, messages: DataFrame, username: str, text: str, library: str | None = None, limit: int = 50) -> DataFrame:
    """A user's conversations whose title or any message holds ``text`` in either case, each once, the one changed last first; conversations without messages are found by their title."""
    own = headers.where(F.col("username") == username)
    own = own if library is None else own.where(F.col("library") == library)
    wanted = F.lit(text.strip().lower())
    holding = messages.where(F.contains(F.lower("text"), wanted)).select("conversation_id", F.lit(True).alias("said")).distinct()
    found = own.join(holding, "conversation_id", "left").where(F.contains(F.lower("title"), wanted) | F.coalesce("said", F.lit(False))).drop("said")
    return found.orderBy(F.desc("updated_at"), "conversation_id").limit(max(limit, 1))


def last_turns(messages: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` messages of each conversation, for the context of its next question."""
    order = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    return messages.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def opened(headers: DataFrame, messages: DataFrame, username: str) -> DataFrame:
    """(conversation_id, title, turns): a user's conversations with their messages in order; citations and feedback kept as JSON are left to the reader."""
    turns = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return headers.where(F.col("username") == username).join(turns, "conversation_id", "left").select("conversation_id", "title", "turns")
