"""Rule-based screening of questions and verification of answers, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

# Personal-data patterns in the order of precedence. Bounds are written as
# ASCII classes, so engines agree next to accented letters.
PII_PATTERNS = {
    "pan": "(^|[^A-Za-z0-9_])[A-Z]{5}[0-9]{4}[A-Z]($|[^A-Za-z0-9_])",
    "email": "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+",
    "account": "(?i)(?:a/?c|account|folio)\\s*(?:no|number)?([^A-Za-z0-9_][^0-9\\n]{0,19})?[0-9]{9,18}",
    "otp": "(?i)(?:otp|verification code|pin)\\s*[:.#]?\\s*[0-9]{4,6}",
    "phone": "(?:\\+?91[\\s-]?)?[6-9](?:[\\s-]?[0-9]){9}",
    "aadhaar": "(^|[^A-Za-z0-9_])[0-9]{4}[\\s-]?[0-9]{4}[\\s-]?[0-9]{4}($|[^A-Za-z0-9_])",
}

# What makes a question ask for advice or performance, and which of these are ambiguous.
ADVICE = (
    "should (?:i|we)", "is it (?:safe|worth|good|bad)", "worth investing", "which (?:is|one is) better", "recommend",
    "suitable for", "good time to", "(?:allocate|allocation)", "portfolio should", "best (?:fund|scheme|option)",
    "should i (?:buy|sell|switch|exit|redeem)", "can i (?:buy|sell|invest)", "opinion", "tips?", "pros and cons",
)
PERFORMANCE = (
    "returns?", "cagr", "xirr", "nav", "aum", "performance", "best performing", "outperform\\w*", "profit",
    "how much (?:did|has|will) .* (?:grow|gained|earned)", "compare returns?", "expect(?:ed)? (?:return|growth)",
)
AMBIGUOUS_ADVICE = ("tips?", "opinion", "pros and cons")
AMBIGUOUS_PERFORMANCE = ("returns?", "nav", "aum", "profit")
ANSWER_ADVICE = (
    "you should", "i recommend", "i would suggest", "suitable for you", "consider investing", "i advise",
    "we recommend", "is a good option for you",
)
ANSWER_PERFORMANCE = ("returns?", "cagr", "xirr", "outperform\\w*", "expected (?:return|growth)", "will grow to", "profit")


@dataclass(frozen=True)
class Triggers:
    """Trigger phrases (regular expressions) of a screen."""

    advice: Sequence[str] = ADVICE
    performance: Sequence[str] = PERFORMANCE
    ambiguous_advice: Sequence[str] = AMBIGUOUS_ADVICE
    ambiguous_performance: Sequence[str] = AMBIGUOUS_PERFORMANCE


#: Forms for Spark of the patterns that would begin anew at every character of a run.
_RUN_BOUND = {"email": "(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]++@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+"}
#: What a text must hold for a pattern to be worth a search.
_WORTH = {"email": "@", "account": "[0-9]{9}", "phone": "[0-9](?:[\\s-]?[0-9]){9}"}


def any_of(phrases: Sequence[str]) -> str:
    """One case-insensitive pattern for all phrases, bounded by anything but ASCII word characters."""
    return "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(f"(?:{p})" for p in phrases) + ")(?![A-Za-z0-9_])"


def find_pii(column: Column) -> Column:
    """Name of the first pattern, in order of precedence, that a text holds; else null."""
    value = tx.text_of(column)
    worth = lambda name: value.contains("@") if name == "email" else value.rlike(_WORTH.get(name, "[0-9]{4}"))
    found = [F.when(worth(name) & value.rlike(_RUN_BOUND.get(name, pattern)), F.lit(name)) for name, pattern in PII_PATTERNS.items()]
    return F.coalesce(*found)


def screen(df: DataFrame, column: str, triggers: Triggers | None = None) -> DataFrame:
    """``df`` with ``pii_pattern``, ``verdict``, ``matched`` and ``escalated``.

    Personal data comes first, then advice, then performance; the rest is
    factual. ``matched`` is the first trigger found, lower-cased, and never set
    for personal data.
    """
    t = triggers or Triggers()
    value = tx.text_of(column)
    found = df.withColumns(
        {
            "pii_pattern": find_pii(F.col(column)),
            "_advice": F.regexp_substr(value, F.lit(any_of(t.advice))),
            "_performance": F.regexp_substr(value, F.lit(any_of(t.performance))),
        }
    )
    verdict = (
        F.when(F.col("pii_pattern").isNotNull(), "PII")
        .when(F.col("_advice").isNotNull(), "ADVICE")
        .when(F.col("_performance").isNotNull(), "PERFORMANCE")
        .otherwise("FACTUAL")
    )
    judged = found.withColumn("verdict", verdict)
    matched = F.lower(F.when(F.col("verdict") == "ADVICE", F.col("_advice")).when(F.col("verdict") == "PERFORMANCE", F.col("_performance")))
    starts = lambda phrases: "^(?:" + "|".join(phrases) + ")(?![A-Za-z0-9_])"
    escalated = (
        F.when(F.col("verdict") == "ADVICE", F.col("matched").rlike(starts(t.ambiguous_advice)))
        .when(F.col("verdict") == "PERFORMANCE", F.col("matched").rlike(starts(t.ambiguous_performance)))
        .otherwise(False)
    )
    return judged.withColumn("matched", matched).withColumn("escalated", escalated).drop("_advice", "_performance")


def template_for(verdict: Column) -> Column:
    """Template that a verdict must be answered with; null for factual questions."""
    return F.when(verdict == "ADVICE", "REFUSE_ADVICE").when(verdict == "PERFORMANCE", "REFUSE_PERFORMANCE").when(verdict == "PII", "PII_BLOCKED")


def verify(body: Column, context: Column, template_id: Column, citation: Column, allowed_urls: Column, max_sentences: int = 3) -> Column:
    """Struct ``ok``, ``checks`` (by name) and ``violations`` (templates to answer with, in order, each once).

    ``context`` is the array of the hits' texts; every number of the body must
    be one of theirs, in whatever compatibility form either is written.
    """
    said = tx.strip(tx.text_of(body))
    numbers = lambda c: tx.numeric_tokens(tx.nfkc(c))
    advice = said.rlike(any_of(ANSWER_ADVICE))
    performance = said.rlike(any_of(ANSWER_PERFORMANCE))
    known = numbers(F.array_join(F.coalesce(context, F.array().cast("array<string>")), " ; "))
    checks = {
        "non_empty": (said != "", "NOT_FOUND"),
        "sentence_count": (tx.count_sentences(said) <= max_sentences, "NOT_FOUND"),
        "no_advice": (~advice, "REFUSE_ADVICE"),
        "no_performance": (~performance, "REFUSE_PERFORMANCE"),
        "numerics_grounded": (F.size(F.array_except(numbers(said), known)) == 0, "NOT_FOUND"),
        "citation_trusted": (citation.isNull() | F.coalesce(F.array_contains(allowed_urls, citation), F.lit(False)), "NOT_FOUND"),
        "refusal_not_advice": (~(F.coalesce(template_id.startswith("REFUSE_"), F.lit(False)) & advice), "REFUSE_ADVICE"),
    }
    failed = F.array_compact(F.array(*(F.when(~passed, F.lit(template)) for passed, template in checks.values())))
    named = F.create_map(*(x for name, (passed, _) in checks.items() for x in (F.lit(name), passed)))
    return F.struct((F.size(failed) == 0).alias("ok"), named.alias("checks"), F.array_distinct(failed).alias("violations"))


def without_suffixes(answer: Column, *suffixes: Column) -> Column:
    """An answer's own text, its appended citation and date line taken out."""
    body = tx.text_of(answer)
    for suffix in suffixes:
        body = F.when(F.coalesce(suffix, F.lit("")) == "", body).otherwise(F.replace(body, suffix, F.lit(" ")))
    return body
