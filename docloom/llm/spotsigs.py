"""SpotSigs: fingerprints from the content words that follow common words.

A signature is an anchor (one of a few very common words) with the chain of the
next content words after it, common words between them skipped. A text's
fingerprint is the set of its signatures; two texts are as alike as their sets
by Jaccard. Sets of sizes a < b reach at most a / b, so texts are partitioned
by the logarithm of their sets' sizes and a comparison is pruned by sizes
before the sets are met.

Only DataFrame and SQL operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored, text_or_empty

#: Anchors, and further common words that chains skip: frequent function words of four languages.
ANCHORS = ("the", "of", "to", "is", "der", "die", "und", "le", "les", "et", "el", "los", "que", "y")
SKIPPED = ("a", "and", "in", "be", "was", "for", "that", "das", "den", "ein", "von", "la", "de", "des", "un", "une", "en", "las", "por", "con")
CHAIN = 2
#: Common words in a row that a chain steps over: any number.
STEP = math.inf
THRESHOLD = 0.8


def _segment(anchors: tuple[str, ...], skipped: tuple[str, ...]) -> str:
    """Pattern of a run of common words, of any length, with the content word after it, if there is one."""
    common = "(?:" + "|".join(sorted({*anchors, *skipped}, key=lambda w: (-len(w), w))) + ")(?!\\p{L})"
    return f"(?<!\\p{{L}})(?:{common}\\P{{L}}++)*+(?:\\p{{L}}++|\\z)"


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, skipped: tuple[str, ...] = SKIPPED, chain: int = CHAIN) -> Column:
    """Set of a text's signatures as sorted 64-bit hashes.

    The text's start acts as an anchor for its first words, and a text without
    letters is one signature of its own, so only blank texts have none.
    """
    low = F.lower(text)
    # A common word at the text's end is followed by a blank too, so a segment's last word is common in no case.
    cut = F.regexp_extract_all(F.concat(low, F.lit(" ")), F.lit(_segment(anchors, skipped)), F.lit(0))
    wanted = F.array(*map(F.lit, anchors))

    def chains(segments: Column) -> Column:
        """Anchors of each segment's run with its content word and those of the segments after it."""

        def met(words: Column) -> Column:
            def of(segment: Column, k: Column) -> Column:
                # A segment that is its content word has no run; an index past the end gives null, which is no chain.
                runs = (F.length(segment) > F.length(F.get(words, k))) & (F.get(words, k + (chain - 1)) != "")
                found = F.array_intersect(F.regexp_extract_all(segment, F.lit("\\p{L}++"), F.lit(0)), wanted)
                ahead = [F.get(words, k + j) for j in range(chain)]
                return F.when(runs, F.transform(found, lambda a: F.xxhash64(F.concat_ws(" ", a, *ahead)))).otherwise(F.array().cast("array<bigint>"))

            return F.flatten(F.transform(segments, of))

        content = F.transform(segments, lambda s: F.regexp_extract(s, "\\p{L}++\\z", 0))
        return F.get(F.transform(F.array(content), met), F.lit(0))

    # An array of one binds the segments to a name, so they are cut once a text.
    spots = F.get(F.transform(F.array(cut), chains), F.lit(0))
    head = F.regexp_extract(low, "^\\P{L}*+(\\p{L}++(?:\\P{L}++\\p{L}++){0,2}+)", 1)
    bare = F.trim(F.regexp_replace(F.when(head == "", low).otherwise(F.lit("")), "\\s+", " "))
    start = F.when(head != "", F.array(F.xxhash64(F.lit("^"), F.regexp_replace(head, "\\P{L}++", " "))))
    alone = F.when(bare != "", F.array(F.xxhash64(F.lit("#"), bare)))
    return F.sort_array(F.array_distinct(F.concat(spots, F.coalesce(start, alone, F.array().cast("array<bigint>")))))


def fingerprint(signature_set: Column) -> Column:
    """A set as a string: equal sets, and so equal texts, have equal fingerprints."""
    return F.sha2(F.array_join(signature_set.cast("array<string>"), ","), 256)


def length_class(size: Column, threshold: float = THRESHOLD) -> Column:
    """Sets whose classes differ by more than one are less alike than ``threshold``."""
    return F.when(size > 0, F.floor(F.ln(size) / F.lit(-math.log(threshold))).cast("int")).otherwise(F.lit(-2))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets, 0 if sizes alone keep it under ``least``; two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    pruned = (small == 0) | (small < large * F.lit(least))
    return F.when(large == 0, F.lit(1.0)).when(pruned, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints, and the pairs of classes with likeness of at least ``threshold``.

    Returns ``members`` (``doc_id``, ``class_id``: the smallest doc_id of its
    fingerprint) and ``pairs`` (``a`` < ``b`` class ids, ``likeness``). Sets meet
    by the rarest of their signatures, as many as a partner must share one of,
    inside the same or neighbouring length classes. Blank texts pair with
    nothing; a null doc_id names no class.
    """
    sets = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), signatures(text_or_empty(text_col)).alias("sigs"))
    prints = stored(sets.withColumn("print", fingerprint(F.col("sigs"))), "spots")
    names = prints.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    members = prints.select("doc_id", "print").join(names, "print").select("doc_id", "class_id")
    own = prints.join(names, (prints["print"] == names["print"]) & (F.col("doc_id") == F.col("class_id")))
    classes = own.where(F.size("sigs") > 0).select("class_id", "sigs").dropDuplicates(["class_id"])
    spread = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = spread.groupBy("sig").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    prefix = spread.join(counts.where("df > 1"), "sig").withColumn("k", place)
    # Signatures of one text only are rarer than all others: they come first in the prefix and match nothing.
    lone = F.col("n") - F.max("k").over(Window.partitionBy("class_id"))
    keep = F.col("k") + lone <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = prefix.withColumn("keep", keep).where("keep").select("class_id", "n", "sig")
    left, right = prefix.alias("l"), prefix.alias("r")
    met = (
        left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.class_id") < F.col("r.class_id")))
        .where(F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * threshold - 1e-9)
        .where(F.abs(length_class(F.col("l.n"), threshold) - length_class(F.col("r.n"), threshold)) <= 1)
        .select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b"))
        .distinct()
    )
    sa = classes.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa"))
    sb = classes.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb"))
    pairs = met.join(sa, "a").join(sb, "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold - 1e-9).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold)


def _neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (``doc_id``, ``h``, ``n``) with the row before each in descending order: ``before_id``, ``before_h``, ``before_n``.

    The first row's predecessor is the last. Rows are sorted by ranges; inside a
    range a window looks back, and a range's first row takes the last of the
    range before it from a table of one row per range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ranged = keys.repartitionByRange(partitions_for(keys.sparkSession), *order).withColumn("pid", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    inside = Window.partitionBy("pid").orderBy(*order)
    me = F.struct("doc_id", "h", "n")
    looked = ranged.withColumn("before", F.lag(me).over(inside)).withColumn("after", F.lead(F.lit(True)).over(inside))
    looked = stored(looked, "looked")
    across, all_rows = Window.orderBy("pid"), Window.partitionBy()
    ends = looked.where("after is null").select("pid", me.alias("end"))
    ends = ends.select("pid", F.coalesce(F.lag("end").over(across), F.max_by("end", "pid").over(all_rows)).alias("end"))
    return looked.join(ends, "pid").select("doc_id", "h", F.coalesce("before", "end").alias("before")).select(
        "doc_id", "h", F.col("before.doc_id").alias("before_id"), F.col("before.h").alias("before_h"), F.col("before.n").alias("before_n")
    )


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's.

    Documents follow each other by descending doc_id, the first after the last.
    The edited text has the second half replaced by the start of the next
    document. Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``length_class``, ``next_is_near``.

    Null texts are empty, and two blank texts are alike. A null doc_id comes
    last; texts that share a doc_id follow each other in the order of a hash;
    rows repeated exactly count as one document and give one row. A document
    alone is its own next. An empty table gives an empty result; other columns
    are ignored.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    source = source.withColumns({"h": F.xxhash64("text"), "n": F.length("text").cast("bigint")})
    before = _neighbours(source.select("doc_id", "h", "n").distinct())
    # Keys of joins are never null.
    key = lambda doc_id, h: {"k": F.coalesce(doc_id, F.lit(0)), "none": doc_id.isNull(), "h": h}
    own = source.withColumn("sigs", signatures(F.col("text"))).withColumns(key(F.col("doc_id"), F.col("h")))
    own = own.select("k", "none", "h", "text", "n", "sigs")
    back = before.withColumns(key(F.col("doc_id"), F.col("h"))).drop("doc_id")
    nexts = own.join(back, ["k", "none", "h"]).select(
        F.coalesce("before_id", F.lit(0)).alias("k"),
        F.col("before_id").isNull().alias("none"),
        F.col("before_h").alias("h"),
        # Bounded by its own length too: both uses of ``own`` read the same columns, so its texts are shuffled once.
        F.expr("substring(text, 1, int(least(n, before_n div 2)))").alias("next_head"),
        F.col("sigs").alias("next_sigs"),
    )
    edited = F.concat(F.expr("substring(text, 1, int(n - n div 2))"), F.col("next_head"))
    pairs = own.join(nexts, ["k", "none", "h"]).withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    near_next = likeness(F.col("sigs"), F.col("next_sigs"))
    return (
        pairs.select(
            "k",
            "none",
            "h",
            F.col("n").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("sigs")).alias("fingerprint"),
            fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
            likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
            near_next.alias("near_next"),
            length_class(F.size("sigs"), threshold).alias("length_class"),
            (likeness(F.col("sigs"), F.col("next_sigs"), threshold) >= threshold).alias("next_is_near"),
        )
        .dropDuplicates(["k", "none", "h"])
        .withColumn("doc_id", F.when(~F.col("none"), F.col("k")))
        .drop("k", "none", "h")
    )
