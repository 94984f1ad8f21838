"""Conversations as the service shows and summarises them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions.text import conversation_title
from docspark.operators.ingest import numbered_within


def conversation_list(messages: DataFrame, limit: int | None = 50) -> DataFrame:
    """(session_id, title, last_message, messages): the first question as title, newest first."""
    first = F.min_by("user_message", F.struct(F.col("timestamp").isNull(), "timestamp", "message_id"))
    rolled = (
        messages.where("session_id is not null")
        .groupBy("session_id")
        .agg(conversation_title(first).alias("title"), F.max("timestamp").alias("last_message"), F.count("*").alias("messages"))
    )
    return rolled if limit is None else rolled.orderBy(F.col("last_message").desc_nulls_last(), "session_id").limit(limit)


def session_page(messages: DataFrame, limit: int = 20, newest: bool = False) -> DataFrame:
    """Of each session its oldest (or newest) rows, numbered in time: the message list of one conversation, for all."""
    time = F.col("timestamp").desc_nulls_last() if newest else F.col("timestamp").asc_nulls_last()
    order = Window.partitionBy("session_id").orderBy(time, "message_id", F.col("user_message").asc_nulls_first(), F.col("assistant_message").asc_nulls_first())
    kept = messages.where("session_id is not null").withColumn("nth", F.row_number().over(order))
    return kept.where(F.col("nth") <= limit).select("session_id", "nth", "message_id", "timestamp")


def message_explode(messages: DataFrame) -> DataFrame:
    """(id, role, content, timestamp): two rows for each exchange with both texts."""
    both = F.array(
        F.struct(F.concat("message_id", F.lit("_user")).alias("id"), F.lit("user").alias("role"), F.col("user_message").alias("content")),
        F.struct(F.col("message_id").alias("id"), F.lit("assistant").alias("role"), F.col("assistant_message").alias("content")),
    )
    return messages.select(F.explode(both).alias("x"), "timestamp").where("x.content is not null").select("x.*", "timestamp")


def summary_triggers(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(session_id, message_id, message_count, last_questions): at every sixth message of a session, its last six
    questions in order. These are the messages whose numbers make a full block of six."""
    every = settings.summary_every
    one = messages.where("session_id is not null").groupBy("session_id", "message_id").agg(F.min("timestamp").alias("timestamp"), F.min("user_message").alias("q"))
    rows = numbered_within(one, "session_id", "timestamp", ["message_id"]).withColumn("block", F.floor((F.col("n") - 1) / every))
    six = F.array_sort(F.collect_list(F.struct("n", F.coalesce("q", F.lit("")).alias("q"), "message_id")))
    full = rows.groupBy("session_id", "block").agg(six.alias("six")).where(F.size("six") == every)
    return full.select(
        "session_id", F.element_at("six", -1)["message_id"].alias("message_id"), F.element_at("six", -1)["n"].cast("int").alias("message_count"),
        F.array_join(F.transform("six", lambda x: x["q"]), " | ").alias("last_questions"),
    )


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    """(day-free) counts of feedback by user, with what is outside 0 and 1 counted apart; repeated rows count once."""
    good = feedback.distinct()
    return good.groupBy("user_id").agg(
        F.count_if(F.col("feedback") == 1).alias("up"), F.count_if(F.col("feedback") == 0).alias("down"),
        F.count_if(~F.coalesce(F.col("feedback").isin(0, 1), F.lit(False))).alias("rejected"),
    )


def feedback_context(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """(message_id, feedback, question, previous_question): what feedback is about, with the question asked before it. Only
    messages with feedback are joined with those before them."""
    one = messages.where("session_id is not null").groupBy("session_id", "message_id").agg(F.min("timestamp").alias("ts"), F.max("user_message").alias("q"))
    rows = numbered_within(one, "session_id", "ts", ["message_id"])
    valid = feedback.where(F.col("feedback").isin(0, 1)).select("message_id", "feedback").distinct()
    asked = valid.join(rows.select("message_id", "session_id", "n", F.col("q").alias("question")), "message_id").withColumn("n", F.col("n") - 1)
    before = rows.select("session_id", "n", F.col("q").alias("previous_question"))
    return asked.join(before, ["session_id", "n"], "left").select("message_id", "feedback", "question", "previous_question")


def latest_answers(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """(session_id, message_id, sources): the last exchange of each session and how many sources it cites."""
    last = messages.where("session_id is not null and timestamp is not null").groupBy("session_id").agg(F.max(F.struct("timestamp", "message_id")).alias("x"))
    counted = sources.groupBy("message_id").agg(F.count("*").alias("sources"))
    return last.select("session_id", F.col("x.message_id").alias("message_id")).join(counted, "message_id", "left").select("session_id", "message_id", F.coalesce("sources", F.lit(0)).alias("sources"))
