"""Normalization: ordered, idempotent rules over the blocks of documents.

A block row is ``source_id, pos, kind, text, heading_path, page_num,
table_rows``. Every rule takes and returns such a DataFrame; positions carry the
order, so rules need no ordered partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

BLOCK = (
    "source_id string, pos bigint, kind string, text string, heading_path array<string>, page_num int,"
    " table_rows array<array<string>>"
)

# Phrases of page furniture, site chrome and calls to action.
FURNITURE = "(?i)page\\s*[0-9]+|www\\.|sid$|^[0-9]+$"
BOILERPLATE = (
    "(?i)(skip to main content|request call back|request a callback|click here|read more"
    "|cookie|consent banner|breadcrumb|share (this|on) (page|facebook|twitter|linkedin)"
    "|sign in|log ?in|register now|open account|disclaimer: this|all rights reserved"
    "|privacy policy|terms (and|&) conditions|do not sell my personal information"
    "|download (our|the) (mobile )?app|invest now)"
)
NAV_TABS = "^(?:[A-Z][A-Za-z0-9']{2,20}[ ]){3,}[A-Z][A-Za-z0-9']{2,20}$"
CHROME = (
    "(?i)^(show [0-9]* ?more|view all( [A-Za-z0-9_]+)?|loading pdf viewer|invest now|popular choice"
    "|similar funds|get in touch|apply now|html|updated as on:?|as on:?)\\s*\\.{0,3}$"
)
CALL_CELL = "(?i)\\s*invest\\s+now\\s*$"
ORPHAN = "^[0-9\\s.,:;/()\\[\\]%+\\-*#₹$€£]+$"
DOT_LEADER = "\\.{20,}"
LEAST_LEFT = 25


def furniture_pattern(brand: str | None = None) -> str:
    """Pattern of furniture lines, with a publisher's name if one is given."""
    return FURNITURE if not brand else f"(?i)\\Q{brand}\\E|" + FURNITURE[4:]


def _composed(values: pa.Array) -> pa.Array:
    """Nested lists of strings in NFC; a missing string is empty."""
    if not pa.types.is_list(values.type):
        return tx.normalized(pc.fill_null(values, ""), "NFC")
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, _composed(values.flatten()), mask=pc.is_null(values))


def unicode_rule(blocks: DataFrame) -> DataFrame:
    """NFC, no-break spaces as spaces, soft hyphens dropped; button labels cut off the ends of cells."""
    cells, headings = F.arrow_udf(_composed, "array<array<string>>"), F.arrow_udf(_composed, "array<string>")

    spaced = lambda c: F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("­"), F.lit(""))
    table = F.transform(cells("table_rows"), lambda r: F.transform(r, lambda c: F.regexp_replace(spaced(c), CALL_CELL, "")))
    path = F.transform(headings("heading_path"), lambda h: F.replace(h, F.lit(" "), F.lit(" ")))
    return blocks.withColumns({"text": spaced(tx.nfc(tx.text_of("text"))), "table_rows": table, "heading_path": path})


def dehyphenate_rule(blocks: DataFrame) -> DataFrame:
    """Text and list blocks of a page that follow one ending in a hyphen are joined to it, in chains."""
    order = Window.partitionBy("source_id").orderBy("pos")
    prose = F.col("kind").isin("text", "list")
    before = lambda c: F.lag(c).over(order)
    joins = (
        prose
        & F.coalesce(before("kind").isin("text", "list"), F.lit(False))
        & F.col("page_num").eqNullSafe(before("page_num"))
        & F.coalesce(before("text").endswith("-"), F.lit(False))
        & F.coalesce(F.col("text").rlike("^[\\p{L}\\p{N}]"), F.lit(False))
    )
    numbered = blocks.withColumn("_joins", joins).withColumn("_island", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(order))
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]
    )
    # Every part but the last gives up the hyphen it ends in.
    merged = F.concat(
        F.array_join(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.left(t, F.length(t) - 1)), ""),
        F.element_at(parts, -1),
    )
    others = [c for c in blocks.columns if c not in ("source_id", "pos", "text")]
    first = F.min_by(F.struct(*others), "pos").alias("_first")
    grouped = numbered.groupBy("source_id", "_island").agg(F.min("pos").alias("pos"), merged.alias("text"), first)
    return grouped.select("source_id", "pos", "text", "_first.*").select(*blocks.columns)


def collapse_whitespace(text: Column) -> Column:
    """Runs of spaces to one, runs of over two line feeds to two, none at the ends."""
    value = F.regexp_replace(tx.text_of(text), "[ \\t]+", " ")
    value = F.regexp_replace(value, "\\n{3,}", "\n\n")
    return F.regexp_replace(value, "^\\n+|\\n+$", "")


def whitespace_rule(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", collapse_whitespace(F.col("text")))


def furniture_key(line: Column) -> Column:
    """Page numbers stand for each other; other lines for themselves."""
    return (
        F.when(line.rlike("(?i)^page\\s*[0-9]+(\\s*(?:of|/)\\s*[0-9]+)?$"), "page 0")
        .when(line.rlike("^[0-9]+$"), "0")
        .otherwise(line)
    )


def repeated_lines(pages: DataFrame, share: float = 0.5, pattern: str | None = FURNITURE) -> DataFrame:
    """``source_id, key`` of lines on more than ``share`` of a source's pages (``source_id, page_num, text``).

    A source needs two pages at least; ``pattern`` limits keys to those that look like furniture.
    """
    paged = pages.where("page_num is not null")
    lines = paged.select("source_id", "page_num", F.explode(F.split(tx.text_of("text"), "\n")).alias("line"))
    keys = lines.select("source_id", "page_num", furniture_key(tx.strip(F.col("line"))).alias("key")).where("key <> ''")
    if pattern:
        keys = keys.where(F.col("key").rlike(pattern))
    counts = keys.distinct().groupBy("source_id", "key").agg(F.count("*").alias("n_pages"))
    totals = paged.groupBy("source_id").agg(F.count_distinct("page_num").alias("total"))
    return counts.join(totals, "source_id").where((F.col("total") >= 2) & (F.col("n_pages") > F.col("total") * share)).select("source_id", "key", "n_pages", "total")


def furniture_rule(blocks: DataFrame, share: float = 0.5, pattern: str = FURNITURE) -> DataFrame:
    """Blocks of pages whose whole text recurs as furniture are dropped."""
    doomed = repeated_lines(blocks.select("source_id", "page_num", "text"), share, pattern).select("source_id", F.col("key").alias("_key"))
    key = F.when(F.col("page_num").isNotNull() & (tx.strip(tx.text_of("text")) != ""), furniture_key(tx.strip(tx.text_of("text"))))
    keyed = blocks.withColumn("_key", key)
    return keyed.join(doomed, ["source_id", "_key"], "left_anti").select(*blocks.columns)


def drop_repeated_lines(pages: DataFrame, share: float = 0.5, pattern: str = FURNITURE, only: bool = False) -> DataFrame:
    """Line-level variant: pages (``source_id, page_num, text``) without their recurring furniture lines; ``only`` those of sources that have some.

    A source's keys are hashed, so that its pages pass by and are not sorted.
    """
    doomed = repeated_lines(pages, share, pattern).groupBy("source_id").agg(F.collect_set("key").alias("_doomed"))
    joined = pages.join(doomed.hint("shuffle_hash"), "source_id", "inner" if only else "left")
    lines = F.split(tx.text_of("text"), "\n")
    kept = F.filter(lines, lambda x: (tx.strip(x) != "") & ~F.array_contains(F.col("_doomed"), furniture_key(tx.strip(x))))
    return joined.withColumn("text", F.when(F.col("_doomed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_doomed")


def strip_boilerplate(text: Column) -> Column:
    """A text without its boilerplate lines and phrases; blank lines stay as structure."""

    def line(raw: Column) -> Column:
        bare = tx.strip(raw)
        residue = tx.strip(F.regexp_replace(F.regexp_replace(bare, DOT_LEADER, " "), "[\\s.]{2,}", " "))
        cut = F.regexp_replace(F.regexp_replace(bare, BOILERPLATE, " "), "\\s{2,}", " ")
        cut = F.regexp_replace(cut, "^[ \\-:|,]+|[ \\-:|,]+$", "")
        holds = bare.rlike(BOILERPLATE)
        return (
            F.when(bare == "", F.lit(""))
            .when(bare.rlike(DOT_LEADER), F.when(F.length(residue) >= LEAST_LEFT, residue))
            .when(holds & (F.length(bare) < LEAST_LEFT), F.lit(None))
            .when(holds, F.when(cut != "", cut))
            .otherwise(bare)
        )

    lines = F.array_compact(F.transform(F.split(tx.text_of(text), "\n"), line))
    return tx.strip(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"))


def boilerplate_rule(blocks: DataFrame) -> DataFrame:
    """Chrome blocks dropped, boilerplate cut out of the others; tables only go by their headings."""
    raw = tx.strip(tx.text_of("text"))
    marked = blocks.withColumns({"_raw": raw, "_left": strip_boilerplate(F.col("text"))})
    prose = F.col("kind").isin("heading", "text", "list")
    chrome = (F.col("_raw") != "") & (F.col("_raw").rlike(NAV_TABS) | F.col("_raw").rlike(CHROME))
    opener = (F.col("kind") == "text") & F.lower("_raw").startswith("popular choice")
    emptied = (F.col("_left") == "") & (F.col("_raw") != "")
    remnant = (F.length("_left") < LEAST_LEFT) & (F.col("_raw") != F.col("_left")) & tx.text_of("text").rlike(BOILERPLATE)
    heading = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " ").rlike(BOILERPLATE)
    kept = marked.where(~heading & ~(prose & (chrome | opener | emptied | remnant)))
    return kept.withColumn("text", F.when(prose, F.col("_left")).otherwise(F.col("text"))).select(*blocks.columns)


def is_orphan(text: Column) -> Column:
    """Only digits, punctuation and currency signs."""
    return tx.strip(tx.text_of(text)).rlike(ORPHAN)


def orphan_rule(blocks: DataFrame) -> DataFrame:
    return blocks.where(~is_orphan(F.col("text")))


def normalize_blocks(blocks: DataFrame, share: float = 0.5, pattern: str = FURNITURE) -> DataFrame:
    """All rules in order."""
    whole = whitespace_rule(dehyphenate_rule(unicode_rule(blocks)))
    return orphan_rule(boilerplate_rule(furniture_rule(whole, share, pattern)))


def before_and_after(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    """Blocks of each source before and after normalization; a source without any left counts 0."""
    before = raw.groupBy("source_id").agg(F.count("*").alias("blocks_before"))
    after = normalized.groupBy("source_id").agg(F.count("*").alias("blocks_after"))
    return before.join(after, "source_id", "left").select("source_id", "blocks_before", F.coalesce("blocks_after", F.lit(0)).alias("blocks_after"))
