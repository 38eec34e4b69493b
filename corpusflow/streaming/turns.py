"""B5 + B6 + H3 + I4: conversation turns as a stream, each batch committed once.

A batch of requests gets its conversations (new ones where none is named, with ids
from the ledger), every turn its prompt from the conversation's last messages and
its retrieved context, and conversation, user message and answer are written
together. A batch may hold several turns of a conversation: they are answered in
rounds, the k-th round taking every conversation's k-th turn, so a prompt holds the
answers before it. The number of rounds is the longest backlog of one conversation
in a batch, which a model that answers turn by turn has to go through anyway; a
round is one job over all conversations.

History is read from committed batches and this batch's earlier rounds, never from
what a failed attempt left. A replayed batch writes nothing. Message ids follow the
order of (batch, round, request, user before assistant). A failed generation leaves
the user's message without an answer, and the answer's id unused. Null or blank
queries are no turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT, Settings
from corpusflow.functions.sequence import seq_within
from corpusflow.operators import history, prompt
from corpusflow.session import materialize, ship_package
from corpusflow.streaming import ledger

CONVERSATIONS = "conversation_id long, created_by long"
MESSAGES = "id long, conversation_id long, role string, content string, query_id long, prompt string"


def answer_batch(requests: DataFrame, root: str, batch: int, context: Callable[[DataFrame], DataFrame], generator,
                 settings: Settings = DEFAULT) -> bool:
    """Answer and store one batch of ``query_id, conversation_id, query`` (distinct query ids); False where it is stored.

    ``context`` maps ``query_id, query`` rows to ``query_id, context``.
    """
    spark = requests.sparkSession
    if batch in ledger.committed(spark, root):
        return False
    asked = requests.select(F.col("query_id").cast("long").alias("query_id"), F.col("conversation_id").cast("long").alias("conversation_id"),
                            "query").where("trim(query) <> ''")
    asked = materialize(asked)
    fresh = asked.where("conversation_id is null")
    after = ledger.reserve(spark, f"{root}/_conversation_ids", batch, fresh.count())
    named = history.new_conversations(asked, after, ["query_id"]).select("query_id", "conversation_id", "query")
    turns = materialize(seq_within(named, "conversation_id", ["query_id"], "round"))
    opened = fresh.select("query_id").join(turns, "query_id").select("conversation_id", F.col("query_id").alias("created_by"))
    first_message = ledger.reserve(spark, f"{root}/_message_ids", batch, 2 * turns.count())  # a failed answer leaves a gap
    said = ledger.read_table(spark, root, "messages", MESSAGES, before=batch)
    # a conversation's last messages are all that later prompts need
    active = turns.select("conversation_id").distinct()
    memory = materialize(history.memory(said.join(active, "conversation_id", "left_semi"), "conversation_id", "id", settings.memory_limit))
    found = turns.select("query_id", "query").join(context(turns.select("query_id", "query")), "query_id", "left").select("query_id", "context")
    found = materialize(found)
    new = None
    for k in range(turns.agg(F.coalesce(F.max("round"), F.lit(-1))).first()[0] + 1):
        now = history.dense_ids(turns.where(F.col("round") == k), ["query_id"], 0, "no").join(found, "query_id")
        line = F.concat("role", F.lit(": "), "content")
        told = memory.groupBy("conversation_id").agg(prompt.ordered_join(F.col("id"), line, "\n").alias("history"))
        now = now.join(told, "conversation_id", "left")
        now = materialize(now.withColumn("prompt", prompt.conversation_prompt(F.col("query"), F.col("context"), F.col("history"), settings)))
        answers = prompt.generate(now, generator, "query_id", "prompt", settings)
        rows = history.message_rows(now, answers).join(now.select("query_id", "no", "prompt"), "query_id")
        rows = materialize(rows.select(
            (F.lit(first_message) + 2 * F.col("no") - 1 + F.col("step")).cast("long").alias("id"), "conversation_id", "role", "content",
            "query_id", F.when(F.col("step") == 0, F.col("prompt")).alias("prompt")))
        first_message += 2 * now.count()
        new = rows if new is None else new.unionByName(rows)
        memory = materialize(history.memory(memory.unionByName(rows.select(memory.columns)), "conversation_id", "id", settings.memory_limit))
    if new is None:
        new = spark.createDataFrame([], MESSAGES)
    return ledger.write_batch(spark, root, batch, {"conversations": opened, "messages": new})


def start_turns(requests_stream: DataFrame, root: str, checkpoint_location: str, context: Callable[[DataFrame], DataFrame], generator,
                available_now: bool = True, settings: Settings = DEFAULT):
    """Stream of ``query_id, conversation_id, query``: every micro-batch is answered and committed once."""
    ship_package(requests_stream.sparkSession)

    def sink(batch: DataFrame, batch_id: int) -> None:
        answer_batch(batch, root, batch_id, context, generator, settings)

    w = requests_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
