"""Conversations answered in batch: memory, screening, retrieval, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import SETTINGS, VOCABULARY, Settings, Vocabulary
from docloom.functions import guardrails as gr
from docloom.operators import answer, memory, retrieve
from docloom.operators.embed import Embedder


def respond_turns(
    turns: DataFrame,
    index: DataFrame,
    embedder: Embedder,
    generator: answer.Generator | None = None,
    settings: Settings = SETTINGS,
    vocabulary: Vocabulary = VOCABULARY,
    triggers: gr.Triggers | None = None,
) -> DataFrame:
    """Envelopes of all user turns of ``turns`` (``conv_id, turn, role, text``), by ``conv_id`` and ``turn``.

    The question as asked is screened; only factual ones are rewritten with
    their subject, embedded and searched for.
    """
    asked = memory.rewritten_turns(turns, vocabulary, settings.memory_max_messages).where("role = 'user'")
    keyed = asked.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "turn", "text", "standalone")
    screened = gr.screen(keyed, "text", triggers)
    factual = screened.where("verdict = 'FACTUAL'").select("query_id", F.col("standalone").alias("question"))
    hits = retrieve.retrieve(factual, index, embedder, settings, vocabulary)
    # Refusals answer the question as it was asked, the others the one that was searched for.
    refused = screened.where("verdict <> 'FACTUAL'").select("query_id", F.col("text").alias("question"))
    answered = answer.respond(factual.unionByName(refused), hits, generator, settings, triggers)
    return answered.join(keyed.select("query_id", "conv_id", "turn"), "query_id")
