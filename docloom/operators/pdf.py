"""Blocks of PDF pages from their text spans and tables.

Decoding PDF files is a pluggable reader; the logic runs on its spans
(``source_id, page_num, block_no, span_no, text, size``) and tables
(``source_id, page_num, table_no, table_rows``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.sources import pdf_reader

Reader = Callable[[bytes], list[pdf_reader.Page]]

NUMBERED = "^\\s*[0-9]+(?:\\.[0-9]+)*[.)]?\\s+\\S"
DEFAULT_SIZE, LARGER, MAX_HEADING = 10.0, 1.15, 120


def first_seen_mode(rows: DataFrame, by: list[str], value: str, place: Column) -> DataFrame:
    """``by`` and the most frequent ``value`` of each group; of equally frequent ones the first by ``place``."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(place).alias("_seen"))
    # Most frequent is least by the negated count, so both parts of the key rise.
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), "_seen")).alias(value))


def body_sizes(spans: DataFrame) -> DataFrame:
    """Most frequent span size of each page; of equally frequent ones the first seen."""
    full = spans.where(F.trim("text") != "").withColumn("body_size", F.round("size", 1))
    return first_seen_mode(full, ["source_id", "page_num"], "body_size", F.struct("block_no", "span_no"))


def _headed(spans: DataFrame) -> DataFrame:
    """Blocks of text of all pages with ``level``, null for prose, and the ``heading_path`` that holds."""
    full = spans.where(F.trim("text") != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"])
    merged = full.groupBy("source_id", "page_num", "block_no").agg(F.array_join(parts, "").alias("raw"), F.max("size").alias("font_size"))
    sized = merged.join(body_sizes(spans), ["source_id", "page_num"], "left").withColumn("text", tx.clean(F.col("raw")))
    sized = sized.where(tx.is_meaningful(F.col("text")))
    shouted = (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text")) & (F.length("text") > 3)
    level = (
        F.when(F.length("text") > MAX_HEADING, F.lit(None).cast("int"))
        .when(F.col("text").rlike(NUMBERED), 2)
        .when(F.col("font_size") >= F.coalesce("body_size", F.lit(DEFAULT_SIZE)) * LARGER, 1)
        .when(shouted, 2)
    )
    leveled = sized.withColumn("level", level)
    upto = Window.partitionBy("source_id", "page_num").orderBy("block_no")
    # A first-level heading stands alone in the path, a second-level one after the heading before it.
    head = lambda *more: F.when(F.col("level").isNotNull(), F.struct("text", "level", *more))
    earlier = leveled.withColumn("_before", F.last(head(), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))["text"])
    headed = earlier.withColumn("_last", F.last(head("_before"), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.col("_last")
    path = (
        F.when(last.isNull(), F.array().cast("array<string>"))
        .when((last["level"] == 1) | last["_before"].isNull(), F.array(last["text"]))
        .otherwise(F.array(last["_before"], last["text"]))
    )
    return headed.withColumn("heading_path", path).drop("_before", "_last")


def span_blocks(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Heading and text blocks of all pages, in order; a page's tables come after its text, under its last heading."""
    headed = _headed(spans)
    shape = lambda df, place, number, kind, text, rows: df.select(
        "source_id", "page_num", F.lit(place).alias("_place"), F.col(number).alias("_number"), kind.alias("kind"), text.alias("text"), "heading_path", rows.alias("table_rows")
    )
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("text")
    found = shape(headed, 0, "block_no", kind, F.col("text"), F.lit(None).cast("array<array<string>>"))
    if tables is not None:
        wide = F.array_max(F.transform("table_rows", F.size))
        padded = F.transform("table_rows", lambda r: F.concat(F.transform(r, tx.clean), F.array_repeat(F.lit(""), wide - F.size(r))))
        kept = tables.where((F.size("table_rows") > 1) & (wide > 1)).withColumns({"heading_path": F.lit(None).cast("array<string>"), "table_rows": padded})
        found = found.unionByName(shape(kept, 1, "table_no", F.lit("table"), F.lit(""), F.col("table_rows")))
        # Blocks are put in order once, so a table finds the path of the last block before it without a second reading of the spans.
        upto = Window.partitionBy("source_id", "page_num").orderBy("_place", "_number").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("heading_path", F.coalesce(F.last("heading_path", ignorenulls=True).over(upto), F.array().cast("array<string>")))
    order = Window.partitionBy("source_id").orderBy("page_num", "_place", "_number")
    return found.select(
        "source_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
        "kind",
        "text",
        "heading_path",
        F.col("page_num").cast("int").alias("page_num"),
        "table_rows",
    )


def read_files(files: DataFrame, reader: Reader = pdf_reader.read) -> DataFrame:
    """Spans, tables and errors of PDF files (``source_id, content``): rows whose ``text``, ``table_rows`` or ``error`` is set."""
    schema = "source_id string, page_num int, block_no int, span_no int, text string, size double, table_rows array<array<string>>, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(source_id: str, content: bytes | None) -> list[tuple]:
        try:
            pages = reader(bytes(content or b""))
        except Exception as e:  # an error is data: the file's row says so
            return [(source_id, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        spans = [(source_id, n, *span, None, None) for n, page in enumerate(pages, 1) for span in page.spans]
        return spans + [(source_id, n, k, None, None, None, table, None) for n, page in enumerate(pages, 1) for k, table in enumerate(page.tables)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source_id, content in zip(batch["source_id"], batch["content"], strict=True):
                frame = pd.DataFrame(rows(source_id, content), columns=names)
                yield frame.astype({"page_num": "Int32", "block_no": "Int32", "span_no": "Int32"})

    return files.select(F.col("source_id").cast("string").alias("source_id"), "content").mapInPandas(run, schema)


def file_blocks(read: DataFrame) -> DataFrame:
    """Blocks of files from what ``read_files`` gave, stored so that files are read once; one that could not be read is a row of kind ``error``."""
    spans = read.where("text is not null")
    tables = read.where("table_rows is not null").withColumnRenamed("block_no", "table_no")
    failed = read.where("error is not null").select(
        "source_id", F.lit(0).cast("bigint").alias("pos"), F.lit("error").alias("kind"), F.col("error").alias("text"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page_num"), "table_rows",
    )
    return span_blocks(spans, tables).unionByName(failed)
