"""Conversations as a stream.

A micro-batch goes through the running values of the batch operator, which cut a hot thread
into chunks. Between micro-batches a thread is one row, its phase and the command it is about.
That row enters the next batch as the first of its thread, a move to that phase, so all the
moves of a batch are one transition of the state before it. States are small tables in
one folder per batch, written last; older folders are removed. A batch that is run again after
a crash overwrites what was left half written.

A thread is forgotten when its last message is ``forget`` older than the newest of all; if
it speaks again it starts anew. Across micro-batches, messages of a thread must come in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.chat import STATE, Command, conversations, settled_conversations, thread_states, with_replies
from tidewatch.plans.ordered import HOT_ROWS
from tidewatch.session import cut
from tidewatch.streaming.jobs import is_complete, remove_folder, run_once

FORGET = "30 days"


def _with_states(batch: DataFrame, known: DataFrame | None, thread: list[str]) -> DataFrame:
    """The messages of a batch, and before them the states of their threads."""
    messages = batch.withColumns({"__turn": F.lit(1), "__state": F.lit(None).cast(STATE)})
    if known is None:
        return messages
    speaking = batch.select(*thread).distinct()
    same = [known[t].eqNullSafe(speaking[t]) for t in thread]
    states = known.join(speaking, same, "left_semi").select(*thread, F.lit(0).alias("__turn"), "__state")
    return messages.unionByName(states, allowMissingColumns=True)


def stream_conversations(
    messages: DataFrame,
    commands: list[Command],
    state: str,
    *,
    thread: list[str],
    order: list[str],
    self_id: str = "",
    text: str = "text",
    forget: str = FORGET,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Run the stream over all messages that are there and return all that was handled so far,
    as ``conversations`` does. ``order`` begins with the time. ``state`` is a shared folder;
    calling again goes on from it."""
    columns, places = messages.columns, ["__turn", *order]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_complete(spark, f"{state}/threads/batch={batch_id}"):
            return
        before = f"{state}/threads/batch={batch_id - 1}"
        known = spark.read.parquet(before) if is_complete(spark, before) else None
        rows = _with_states(batch, known, thread)
        settled = cut(settled_conversations(rows, commands, thread=thread, order=places, self_id=self_id, text=text, limit=limit))
        with_replies(settled.filter("__turn = 1"), commands, columns).write.mode("overwrite").parquet(f"{state}/handled/batch={batch_id}")
        now = thread_states(settled, thread, places).withColumn("__time", F.col("__last")[order[0]]).drop("__last")
        if known is not None:  # threads that did not speak stay as they are
            same = [known[t].eqNullSafe(now[t]) for t in thread]
            now = now.unionByName(known.join(now, same, "left_anti"))
        now = cut(now)
        newest = now.agg(F.max("__time")).first()[0]
        if newest is not None:
            now = now.filter(F.col("__time") >= F.lit(newest) - F.expr(f"INTERVAL {forget}"))
        now.write.mode("overwrite").parquet(f"{state}/threads/batch={batch_id}")
        remove_folder(spark, f"{state}/threads/batch={batch_id - 2}")

    run_once(messages.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint"))
    spark = messages.sparkSession
    empty = conversations(spark.createDataFrame([], messages.schema), commands, thread=thread, order=order, self_id=self_id, text=text)
    if not is_complete(spark, f"{state}/handled/batch=0"):
        return empty
    return spark.read.schema(empty.schema).parquet(f"{state}/handled").select(*empty.columns)
