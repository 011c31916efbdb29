"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Rates start from
one and stay between 0 and ``CAP``; among all rates under which every source's
words come to its target, balancing takes those of least relative entropy. The
convex dual has one multiplier per source, and its solution tilts rates
exponentially in the document's size:

    rate = CAP / (1 + (CAP - 1) * exp(-multiplier * size / mean size))

Newton's iterations solve for the multipliers. They run over counts by source
and size, so an iteration reads far fewer rows than there are documents, and
the multipliers are a table of their own that never comes to the driver.
Rates are then rounded to whole copies so that running sums of copies follow
running sums of rates in the order of sizes: a source's words miss its target by
at most half of its longest document.

Only DataFrame and SQL operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Copies of a document at most, and words of a source's target against its own at most.
CAP = 3
WEIGHTS = (5, 2, 1)
WORD = "[^\\x20\\x09-\\x0D]+"
#: A group of documents of one source and size is dealt over as many parts as the table has so many rows.
PART_ROWS = 250_000
ROUNDS, TOLERANCE = 60, 1e-6


def size_of(text: str = "text") -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with ``target``: shares of all sizes by weight, none above its cap.

    Weights repeat over sources by code point, null last. Let every source take
    ``level`` times its weight or its cap, whichever is less; the level at which
    all sizes are taken is found among sources in the order of cap by weight.
    There is one row per source, so the two unpartitioned windows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    numbered = sources.withColumn("k", (F.row_number().over(order) - 1) % len(weights))
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1).cast("double"))
    rise = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    below, rest = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum(F.col("source_size") * cap).over(below), F.lit(0))) / F.sum("weight").over(rest)
    # The first source whose cap is above the level ends the run of capped ones.
    leveled = weighed.withColumn("level", level).withColumn("open", F.col("source_size") * cap > F.col("level") * F.col("weight"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"]
    capped = (F.col("source_size") * cap).cast("double")
    return leveled.withColumn("final", final).select(
        "source", "source_size", F.least(capped, F.coalesce(F.col("final") * F.col("weight"), capped)).alias("target")
    )


def rate(size: Column, mean: Column, multiplier: Column, cap: int = CAP) -> Column:
    """Tilted rate of a document of ``size``; exponents are kept in range."""
    tilt = F.least(F.lit(600.0), F.greatest(F.lit(-600.0), -multiplier * size / mean))
    return cap / (1 + (cap - 1) * F.exp(tilt))


def exact_sum(terms: Column) -> Column:
    """Sum that does not depend on the order of its terms."""
    return F.sum(terms.cast("decimal(38,9)")).cast("double")


def multipliers(sizes: DataFrame, wanted: DataFrame, cap: int = CAP) -> DataFrame:
    """``source``, ``mean``, ``multiplier`` under which expected words of ``sizes`` (``source``, ``size``, ``n``) meet targets.

    The dual's gradient falls steadily in each multiplier, so each has a bracket
    that every iteration narrows; a Newton step that leaves it is replaced by
    its middle. Targets at the cap have no finite multiplier: the bracket's end
    gives them rates of ``cap``.
    """
    base = sizes.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean")
    )
    state = stored(
        base.join(wanted, base.source.eqNullSafe(wanted.source)).select(
            base.source,
            F.greatest("mean", F.lit(1e-9)).alias("mean"),
            "target",
            F.lit(0.0).alias("multiplier"),
            F.lit(-700.0).alias("low"),
            F.lit(700.0).alias("high"),
            F.lit(float("inf")).alias("gap"),
        ),
        "dual",
    )
    for _ in range(ROUNDS):
        given = sizes.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        r = rate(F.col("size"), F.col("mean"), F.col("multiplier"), cap)
        words = F.col("size") * F.col("n")
        slope = words * r * (1 - r / cap) * F.col("size") / F.col("mean")
        sums = given.groupBy("source", "mean", "target", "multiplier", "low", "high").agg(
            exact_sum(words * r).alias("words"), exact_sum(slope).alias("slope")
        )
        over = F.col("words") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("multiplier"))
        high = F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        narrowed = sums.select(
            "source",
            "mean",
            "target",
            "multiplier",
            low.alias("low"),
            high.alias("high"),
            (F.col("multiplier") + F.try_divide(F.col("target") - F.col("words"), F.col("slope"))).alias("newton"),
            (F.abs(F.col("words") - F.col("target")) / F.greatest("target", F.lit(1.0))).alias("gap"),
        )
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        done = F.col("gap") <= TOLERANCE
        step = F.when(done, F.col("multiplier")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(narrowed.select("source", "mean", "target", step.alias("multiplier"), "low", "high", "gap"), "dual")
        worst = state.where(F.col("high") - F.col("low") > 1e-9).agg(F.max("gap")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"multipliers did not settle in {ROUNDS} rounds: a source misses its target by {worst:.3g} of it")
    return state.select("source", "mean", "multiplier")


def copies(sizes: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """``sizes`` (``source``, ``size``, ``part``, ``n``) with ``each``, copies of every document, and ``more``, documents that get one more.

    Copies up to a row are the rates up to it rounded half up, in the order of
    size and part. A source has no more rows than it has sizes times parts.
    """
    rated = sizes.join(tilts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "expected", (F.col("n") * rate(F.col("size"), F.col("mean"), F.col("multiplier"), cap)).cast("decimal(28,9)")
    )
    # Sums inside a size over its parts, then over sizes: neither window holds documents.
    by_size = rated.groupBy("source", "size").agg(F.sum("expected").alias("whole"))
    upto = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.coalesce(F.sum("whole").over(upto), F.lit(0)).alias("base")
    )
    inner = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    summed = rated.join(by_size, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn(
        "end", F.col("base") + F.sum("expected").over(inner)
    )
    whole = lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")).cast("bigint")
    got = F.least(F.greatest(whole(F.col("end")) - whole(F.col("end") - F.col("expected")), F.lit(0)), F.col("n") * cap)
    return summed.withColumn("got", got).select(
        "source",
        "size",
        "part",
        F.floor(F.col("got") / F.col("n")).cast("bigint").alias("each"),
        (F.col("got") % F.col("n")).cast("bigint").alias("more"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Copies of every document in a mix whose sources come near their targets.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and
    ``copies`` (0 to ``cap``); words taken are copies times size. A null source
    is a source of its own, after all others. Null and empty texts have size 0
    and no copies. Each row is a document of its own; rows repeated with the
    same doc_id and size are interchangeable and share their group's copies,
    in the order of ``row_col``, a key of rows that is returned too if given. A
    source without words has target 0; an empty table gives an empty result;
    other columns are ignored. Reruns agree.
    """
    row = [row_col] if row_col else []
    # Rows without a doc_id are dealt too.
    deal = F.xxhash64(F.coalesce(F.col(id_col).cast("bigint"), F.col(row_col) if row_col else F.monotonically_increasing_id()))
    parts = 1 + docs.count() // PART_ROWS
    sized = stored(
        docs.select(
            *row,
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            size_of(text_col).alias("size"),
            F.pmod(deal, F.lit(parts)).alias("part"),
        ),
        "sizes",
    )
    grouped = stored(sized.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "grouped")
    per_size = grouped.groupBy("source", "size").agg(F.sum("n").alias("n"))
    wanted = stored(targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "targets")
    worded = per_size.where("size > 0")
    tilts = multipliers(worded, wanted, cap)
    given = copies(grouped.where("size > 0"), tilts, cap)
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", *row))
    ranked = sized.withColumn("rank", rank)
    g, w = given.alias("g"), wanted.alias("w")
    joined = ranked.alias("d").join(
        g,
        F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.size") == F.col("g.size")) & (F.col("d.part") == F.col("g.part")),
        "left",
    )
    # One row a source goes to every task: as many as the weights' vocabulary has names.
    return joined.join(w, F.col("d.source").eqNullSafe(F.col("w.source"))).select(
        *row,
        "d.doc_id",
        "d.source",
        "d.size",
        "w.source_size",
        "w.target",
        F.coalesce(F.col("g.each") + F.when(F.col("d.rank") <= F.col("g.more"), 1).otherwise(0), F.lit(0)).alias("copies"),
    )
