"""Conversation tables (M1-M10) and turn appends.

messages: conv_id, pos (from 0, order of a conversation), role, content, created_at; conversations: conv_id, user_id, title, summary,
summarized_through_turn, updated_at. System rows are left out before positions are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.sources.ledger import Ledger


def list_conversations(conversations: DataFrame) -> DataFrame:
    """M1 for all users: rank 1 is a user's newest."""
    order = W.partitionBy("user_id").orderBy(F.desc("updated_at"), "conv_id")
    return conversations.withColumn("rank", F.row_number().over(order))


def owned(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """M2: requests (user_id, conv_id) for conversations that their user owns."""
    return requests.join(conversations.select("user_id", "conv_id"), ["user_id", "conv_id"], "left_semi")


def not_found(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """M2: the others; foreign and missing look alike."""
    return requests.join(conversations.select("user_id", "conv_id"), ["user_id", "conv_id"], "left_anti")


def owned_by_trace(requests: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """M3: requests (trace_id, user_id) with the message of that trace in a conversation of that user."""
    of_user = messages.where("trace_id is not null").join(conversations.select("conv_id", "user_id"), "conv_id")
    return requests.join(of_user, ["trace_id", "user_id"])


def load(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """M4: each conversation with its messages in order and its summary."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    return conversations.join(messages.groupBy("conv_id").agg(ordered.alias("messages")), "conv_id", "left")


def working_memory(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """M5: messages from position 2 x summarized_through_turn on."""
    joined = messages.join(conversations.select("conv_id", "summarized_through_turn"), "conv_id")
    return joined.where(F.col("pos") >= 2 * F.col("summarized_through_turn")).drop("summarized_through_turn")


def compaction(messages: DataFrame, conversations: DataFrame, trigger: int = 12, batch: int = 6) -> DataFrame:
    """M6: conv_id, turns, first, last (positions, last excluded), new_summarized of conversations whose next batch is due."""
    turns = messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"))
    joined = turns.join(conversations.select("conv_id", F.col("summarized_through_turn").alias("s")), "conv_id")
    due = joined.where((F.col("turns") >= trigger) & (F.col("turns") - F.col("s") >= trigger))
    return due.select("conv_id", "turns", (2 * F.col("s")).alias("first"), (2 * (F.col("s") + batch)).alias("last"), (F.col("s") + batch).alias("new_summarized"))


def summarized_after(turns, trigger: int = 12, batch: int = 6):
    """Where repeated calls, one a turn, have come to after so many turns."""
    first = F.floor((turns - trigger) / batch) + 1
    return F.when(turns < trigger, F.lit(0)).otherwise(first * batch).cast("long")


def render(messages: DataFrame) -> DataFrame:
    """M7: conv_id, text: "speaker: content" lines in order."""
    speaker = F.when(F.col("role") == "user", "المستخدم").otherwise("المساعد")
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat(speaker, F.lit(": "), "content").alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def history(messages: DataFrame) -> DataFrame:
    """M8: user turns are human, all others assistant."""
    return messages.withColumn("kind", F.when(F.col("role") == "user", "human").otherwise("assistant"))


def cascade_delete(users: DataFrame, conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M9: the three tables without the users in `gone` (user_id) and all that hangs on them."""
    kept_users = users.join(gone, "user_id", "left_anti")
    kept = conversations.join(gone, "user_id", "left_anti")
    return kept_users, kept, messages.join(kept.select("conv_id"), "conv_id", "left_semi")


def detail(messages: DataFrame) -> DataFrame:
    """retrieved_context hidden; empty citations are null."""
    return messages.drop("retrieved_context").withColumn("citations", F.when(F.size("citations") > 0, F.col("citations")))


def append_turns(turns: DataFrame) -> DataFrame:
    """Two message rows for each turn (conv_id, turn, question, answer, citations, created_at); empty lists are null."""
    empty = F.lit(None).cast(turns.schema["citations"].dataType)
    cited = F.when(F.size("citations") > 0, F.col("citations")).otherwise(empty)
    pair = F.array(
        F.struct((2 * F.col("turn")).alias("pos"), F.lit("user").alias("role"), F.col("question").alias("content"), empty.alias("citations")),
        F.struct((2 * F.col("turn") + 1).alias("pos"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), cited.alias("citations")),
    )
    return turns.select("conv_id", F.explode(pair).alias("m"), "created_at").select("conv_id", "m.*", "created_at")


def bumped(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """updated_at follows the newest message."""
    newest = messages.groupBy("conv_id").agg(F.max("created_at").alias("_at"))
    return conversations.join(newest, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")


def commit_turns(ledger: Ledger, turns: DataFrame, conversations: DataFrame, source: str | None = None, batch: int | None = None, **options) -> int | None:
    """A batch of turns enters the tables `messages` and `conversations` of a ledger by one commit: its message rows, keyed by
    conversation and position, and the touched conversations with updated_at moved on. Readers see both or neither."""
    messages = append_turns(turns).withColumn("message_id", F.concat_ws("-", "conv_id", F.lpad(F.col("pos").cast("string"), 10, "0")))
    touched = conversations.join(turns.select("conv_id").distinct(), "conv_id", "left_semi")
    return ledger.upsert({"messages": (messages, "message_id", "created_at"), "conversations": (bumped(touched, messages), "conv_id", "updated_at")}, source, batch, **options)
