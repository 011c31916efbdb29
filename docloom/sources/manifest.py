"""The manifest of sources: scan, validation, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import VOCABULARY, Vocabulary
from docloom.functions import text as tx
from docloom.functions import urls

REQUIRED = ("source_id", "scheme", "plan", "doc_type", "url", "enabled")


class ManifestError(ValueError):
    """A manifest that cannot be used; the message names the first bad line."""


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV manifest with a header, every field trimmed, and their line numbers.

    A manifest is small and its order matters for the first error, so it is one
    partition; nothing is inferred.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    lacking = sorted(set(REQUIRED) - set(raw.columns))
    if lacking:
        raise ManifestError(f"the manifest lacks columns: {', '.join(lacking)}")
    columns = [*REQUIRED, *(["notes"] if "notes" in raw.columns else [])]
    rows = raw.coalesce(1).select(*(F.trim(tx.text_of(c)).alias(c) for c in columns)).withColumn("line", F.monotonically_increasing_id() + 2)
    return rows if "notes" in columns else rows.withColumn("notes", F.lit(""))


def violations(rows: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """``rows`` with ``violations``, an array of what is wrong with each."""
    from pyspark.sql import Window

    blank = [F.when(F.col(c) == "", F.lit(f"{c} is blank")) for c in REQUIRED]
    among = {"scheme": [*vocabulary.scheme_titles], "plan": [*vocabulary.plan_titles], "doc_type": [*vocabulary.doc_types]}
    unknown = [F.when((F.col(c) != "") & ~F.col(c).isin(*names), F.concat(F.lit(f"unknown {c} "), F.col(c))) for c, names in among.items()]
    again = F.when(F.count("*").over(Window.partitionBy("source_id")) > 1, F.lit("source_id is repeated"))
    scheme = F.when((F.col("url") != "") & ~F.col("url").rlike("^https?://"), F.lit("url is not http or https"))
    flag = F.when((F.col("enabled") != "") & ~F.lower("enabled").isin("true", "false"), F.lit("enabled is neither true nor false"))
    return rows.withColumn("violations", F.array_compact(F.array(*blank, again, *unknown, scheme, flag)))


def load(spark: SparkSession, path: str, enabled_only: bool = False, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Validated sources with ``enabled`` as boolean, ``is_pdf`` and ``file_name``; the first bad line raises."""
    checked = violations(scan(spark, path), vocabulary)
    bad = checked.where(F.size("violations") > 0).orderBy("line").first()
    if bad is not None:
        raise ManifestError(f"line {bad['line']}: {'; '.join(bad['violations'])}")
    if checked.isEmpty():
        raise ManifestError("the manifest has no rows")
    rows = checked.drop("violations").withColumns(
        {
            "enabled": F.lower("enabled") == "true",
            "is_pdf": urls.is_pdf(F.col("url")),
            "file_name": urls.file_name(F.col("url"), F.col("source_id")),
        }
    )
    return rows.where("enabled") if enabled_only else rows


def excluded(sources: DataFrame) -> DataFrame:
    return sources.where(~F.col("enabled"))


def counts_by_scheme(sources: DataFrame) -> DataFrame:
    return sources.groupBy("scheme").agg(F.count("*").alias("n"))


def catalogue(spark: SparkSession, sources: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Schemes with what a client shows of them and the document types the manifest has of each.

    Returns ``scheme, title, category, icon, tagline, starters, doc_types``; a
    scheme without a card has nulls, one without sources no document types.
    """
    blank = (None, None, None)
    cards = [(s, title, *vocabulary.scheme_cards.get(s, blank), vocabulary.starters(s)) for s, title in vocabulary.scheme_titles.items()]
    names = spark.createDataFrame(cards, "scheme string, title string, category string, icon string, tagline string, starters array<string>")
    kinds = sources.where("enabled").groupBy("scheme").agg(F.sort_array(F.collect_set("doc_type")).alias("doc_types"))
    return names.join(kinds, "scheme", "left")
