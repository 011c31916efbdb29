"""Evaluation of retrieval against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(hits: DataFrame, gold: DataFrame, k: int, query_id: str = "query_id", hit_id: str = "chunk_id") -> DataFrame:
    """Per probe of ``gold`` (``query_id, chunk_ids``): whether a gold chunk is among its ``k`` best, where and how alike.

    ``matched_score`` is 0 and ``first_rank`` null for a probe that is missed.
    """
    listed = gold.select(F.col(query_id), F.explode("chunk_ids").alias(hit_id)).distinct().withColumn("_gold", F.lit(True))
    marked = hits.join(listed, [query_id, hit_id], "left")
    return found_gold(marked, gold.select(query_id), k, F.coalesce("_gold", F.lit(False)), query_id)


def found_gold(hits: DataFrame, probes: DataFrame, k: int, gold: Column, query_id: str = "query_id") -> DataFrame:
    """``recall`` where ``gold``, a condition on a hit, says what is gold: nothing is listed by probe."""
    near = hits.where((F.col("rank") <= k) & gold)
    best = near.groupBy(query_id).agg(F.min("rank").alias("first_rank"), F.min_by("score", "rank").alias("matched_score"))
    return probes.select(query_id).join(best, query_id, "left").select(
        query_id, F.col("first_rank").isNotNull().alias("found"), "first_rank", F.coalesce("matched_score", F.lit(0.0)).alias("matched_score")
    )


def misses(result: DataFrame) -> DataFrame:
    """Probes whose gold was not found."""
    return result.where(~F.col("found"))


def summary(result: DataFrame) -> DataFrame:
    """Recall and mean reciprocal rank over probes."""
    return result.agg(
        F.count("*").alias("probes"),
        F.round(F.avg(F.col("found").cast("double")), 4).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 4).alias("mrr"),
    )


def calibrate(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Threshold half way between the lowest score of found probes and the highest of off-topic ones.

    Without the one the lowest is 0, without the other the highest is 1.
    """
    low = positive.where("found").agg(F.coalesce(F.min("matched_score"), F.lit(0.0)).alias("lowest_positive"))
    high = negative.where(F.col("rank") == 1).agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("highest_negative"))
    # One row each.
    joined = low.crossJoin(high)
    return joined.withColumn("threshold", F.round((F.col("lowest_positive") + F.col("highest_negative")) / 2, 4)).withColumn(
        "separable", F.col("lowest_positive") > F.col("highest_negative")
    )
