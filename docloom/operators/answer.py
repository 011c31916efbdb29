"""Grounded answers in batch: context, generation, citation, verification, templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import SETTINGS, VOCABULARY, Settings, Vocabulary
from docloom.functions import guardrails as gr
from docloom.functions import text as tx

#: Answers with fixed wording, by template id; a factual answer is its own text.
TEMPLATES = {
    "REFUSE_ADVICE": "This service states facts and gives no advice. Please ask a registered adviser.",
    "REFUSE_PERFORMANCE": "Returns are neither calculated nor compared here. The official factsheet states them.",
    "NOT_FOUND": "The sources in use do not state that.",
    "NO_RETRIEVAL": "Nothing in the sources in use is about that.",
    "PII_BLOCKED": "Personal identifiers cannot be processed. Please leave them out and ask again.",
}
SENTINELS = {"NOT_FOUND": "NOT_FOUND", "NO_PERF": "REFUSE_PERFORMANCE"}


class Generator(Protocol):
    """Replies to a question from its context; ``NOT_FOUND`` or ``NO_PERF`` decline."""

    def reply(self, question: str, context: str) -> str: ...


class ExtractiveGenerator:
    """Replies with the context's sentence that shares most content words with the question."""

    def reply(self, question: str, context: str) -> str:
        words = lambda s: {w for w in re.findall(r"[a-z0-9]+", s.lower()) if len(w) > 2}
        asked = words(question)
        lines = [s.strip() for line in context.split("\n") if not line.startswith("[") for s in re.split(r"(?<=[.!?])\s+", line) if s.strip()]
        best = max(lines, key=lambda s: len(asked & words(s)), default="")
        return best if asked & words(best) else "NOT_FOUND"


def render(template_id: Column, answer: Column) -> Column:
    """Text of an answer; an unknown template raises."""
    known = F.create_map(*(F.lit(x) for pair in TEMPLATES.items() for x in pair))
    fixed = F.coalesce(F.try_element_at(known, template_id), F.raise_error(F.concat(F.lit("unknown template "), template_id)))
    return F.when(template_id == "FACTUAL", tx.strip(tx.text_of(answer))).otherwise(fixed)


def within_budget(hits: DataFrame, length: Column, cap: int, *by: str, order: str = "rank") -> DataFrame:
    """Hits, best first, while their lengths' running sum is within ``cap``; the first always stays."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = hits.withColumn("used", F.sum(length).over(upto)).withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return summed.where((F.col("used") <= cap) | (F.col("_place") == 1)).drop("_place")


def contexts(hits: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``query_id, context``: numbered, labelled hits in rank order."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    label = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] SOURCE  "), F.coalesce("source_title", "source_id", F.lit("")),
        F.lit("  (scheme="), show("scheme"), F.lit(", plan="), show("plan"), F.lit(", doc_type="), show("doc_type"), F.lit(", page="), show("page_num"), F.lit(")"),
    )
    blocks = hits.withColumn("block", F.concat_ws("\n", label, "document"))
    kept = within_budget(blocks, F.length("block"), settings.max_context_chars, "query_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda h: h["block"])
    return kept.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"))


def pick_citation(hits: Column, floor: float) -> Column:
    """First hit (struct with ``score`` and ``source_url``, best first) with a URL and a score at the floor, else with a URL."""
    linked = F.filter(hits, lambda h: F.coalesce(h["source_url"], F.lit("")) != "")
    return F.coalesce(F.get(F.filter(linked, lambda h: h["score"] >= floor), F.lit(0)), F.get(linked, F.lit(0)))


def month_number(date: Column) -> Column:
    """Months since year 0 of a date such as ``July 2026``; null if it is none."""
    parsed = F.try_to_timestamp(F.concat(F.lit("1 "), date), F.lit("d MMMM yyyy"))
    return F.year(parsed) * 12 + F.month(parsed)


def last_updated(dates: Column) -> Column:
    """Line on the latest of the dates cited, by the calendar; never an invented one."""
    known = F.filter(dates, lambda d: d.isNotNull() & (d != ""))
    dated = F.transform(known, lambda d: F.struct(F.coalesce(month_number(d), F.lit(-1)).alias("m"), d.alias("d")))
    return F.concat(F.lit("Last updated from sources: "), F.coalesce(F.array_max(dated)["d"], F.lit("date not stated on page")))


def generate(df: DataFrame, generator: Generator) -> DataFrame:
    """``df`` (``question, context``) with ``raw_reply``; a generator runs once per row, in Arrow batches."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, given in parts:
            yield pd.Series([generator.reply(q, c) for q, c in zip(questions, given, strict=True)], dtype=object)

    return df.withColumn("raw_reply", run("question", "context"))


def respond(questions: DataFrame, hits: DataFrame, generator: Generator | None = None, settings: Settings = SETTINGS, triggers: gr.Triggers | None = None) -> DataFrame:
    """Envelopes for ``questions`` (``query_id, question``), given all hits of those that are factual.

    Screened questions and those without hits are answered by template and never
    reach the generator: the plan is split before it, and joined after.
    """
    screened = gr.screen(questions.select("query_id", "question"), "question", triggers)
    refused = screened.where("verdict <> 'FACTUAL'").withColumn("template_id", gr.template_for(F.col("verdict")))
    asked = screened.where("verdict = 'FACTUAL'")
    fields = ("rank", "score", "chunk_id", "document", "source_url", "source_title", "source_date")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))
    grounded = asked.join(listed, "query_id").join(contexts(hits, settings), "query_id")
    silent = asked.join(listed, "query_id", "left_anti").withColumn("template_id", F.lit("NO_RETRIEVAL"))
    replied = generate(grounded, generator or ExtractiveGenerator())
    declined = F.coalesce(*(F.when(tx.strip(F.col("raw_reply")).startswith(s), F.lit(t)) for s, t in SENTINELS.items()))
    body = tx.cap_length(tx.cap_sentences(F.col("raw_reply"), settings.max_sentences), settings.max_answer_chars)
    drafted = replied.withColumns({"declined": declined, "body": body, "cited": pick_citation(F.col("hits"), settings.citation_score_floor)})
    urls = F.transform("hits", lambda h: h["source_url"])
    texts = F.transform("hits", lambda h: h["document"])
    # A reply that states its link or date line itself is judged by its own words.
    own = gr.without_suffixes(F.col("body"), last_updated(F.array(F.col("cited")["source_date"])), F.col("cited")["source_url"])
    checked = drafted.withColumn(
        "verified", gr.verify(own, texts, F.lit("FACTUAL"), F.col("cited")["source_url"], urls, settings.max_sentences)
    )
    template = F.coalesce("declined", F.when(~F.col("verified")["ok"], F.get(F.col("verified")["violations"], F.lit(0))), F.lit("FACTUAL"))
    final = checked.withColumn("template_id", template)
    factual = F.col("template_id") == "FACTUAL"
    answered = final.select(
        "query_id", "question", "verdict", "template_id",
        render(F.col("template_id"), F.col("body")).alias("answer"),
        F.when(factual, F.col("cited")["source_url"]).alias("citation_url"),
        F.when(factual, F.col("cited")["source_title"]).alias("source_title"),
        F.when(factual, F.col("cited")["chunk_id"]).alias("chunk_id"),
        F.when(factual, last_updated(F.array(F.col("cited")["source_date"]))).alias("last_updated"),
        F.col("verified")["violations"].alias("violations"),
    )
    others = refused.unionByName(silent).select("query_id", "question", "verdict", "template_id", render(F.col("template_id"), F.lit("")).alias("answer"))
    return answered.unionByName(others, allowMissingColumns=True)


def hit_projection(hits: DataFrame, excerpt: int = 280) -> DataFrame:
    """What a client sees of a hit."""
    return hits.select("query_id", "rank", "chunk_id", "score", "source_title", "source_url", "scheme", "plan", "doc_type", F.substring(F.trim("document"), 1, excerpt).alias("excerpt"))


def trace_rows(envelopes: DataFrame) -> DataFrame:
    """A JSON line per turn that follows a question by its hash and length, never by its text."""
    record = F.struct(
        F.length("question").alias("question_len"), tx.short_hash(F.col("question")).alias("question_hash"),
        "verdict", "template_id", "citation_url", "chunk_id",
    )
    return envelopes.select(F.to_json(record).alias("value"))


def pii_trace_rows(screened: DataFrame) -> DataFrame:
    """A JSON line per question refused for personal data: the pattern's name and the time, nothing of the question."""
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(F.lit(True).alias("pii_blocked"), F.col("pii_pattern").alias("pattern"), at.alias("at"))
    return screened.where("pii_pattern is not null").select(F.to_json(record).alias("value"))


def catalogue(vocabulary: Vocabulary = VOCABULARY) -> list[tuple[str, str]]:
    """Schemes and their display names, for clients that browse."""
    return list(vocabulary.scheme_titles.items())
