"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the
last return the columns of ``docs``. Each row is a document of its own: stages
give rows keys while they work and filter and copy by these. ``doc_id`` only
says which row of a group stays; a row without one stays if no other row of its
group has one. Of rows that share a doc_id a hash of text and source decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, language, mixing, packing, simhash
from docloom.llm.common import scratch_root, stored


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of every row, and the key's name, which no column of ``docs`` has.

    A row of a file is told by its file's number and its place there, however
    the file is split, so texts need no copy. Other rows are written once with
    their keys before anything is decided by them.
    """
    key = f"_row_{uuid.uuid4().hex}"
    file, place = f"{key}_file", f"{key}_place"
    try:
        located = docs.select(*([] if "_metadata" in docs.columns else ["*"]), F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # the rows are not those of files
        located = None
    if located is None or len(located.columns) == 2:
        return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key
    # A row a file: few enough to be put in one order.
    number = (F.row_number().over(Window.orderBy(file)) - 1).cast("bigint")
    files = stored(located.select(file).distinct().withColumn(key, F.shiftleft(number, 40)), "files")
    return located.join(files, file).withColumn(key, F.col(key) + F.col(place)).drop(file, place), key


def _only(rows: DataFrame, key: str, groups: DataFrame, largest: bool) -> DataFrame:
    """Of every group of ``groups`` (``row``, ``group``) the row with the largest or smallest doc_id, null ones last.

    Keys are hashed, so texts are not sorted.
    """
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text", "source").alias("tie"))
    place = F.struct(F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull(), "doc_id", "tie", "row")
    best = (F.max if largest else F.min)(place)
    kept = groups.join(ids, "row").groupBy("group").agg(best.alias("best")).select(F.col("best.row").alias(key))
    return rows.join(kept.hint("shuffle_hash"), key, "left_semi").drop(key)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and texts unlike any language go."""
    model = language.fit(docs)
    return language.identify(docs, model).where("not rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id."""
    rows, key = _keyed(docs)
    found = exact_dedup.exact_duplicates(rows, id_col=key)
    return _only(rows, key, found.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), largest=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest doc_id."""
    rows, key = _keyed(docs)
    found = simhash.near_duplicates(rows, id_col=key)
    return _only(rows, key, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), largest=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most ``mixing.CAP`` times."""
    rows, key = _keyed(docs)
    times = f"_times_{uuid.uuid4().hex}"  # a name that no column of docs has
    copies = mixing.mix(rows, row_col=key).where("copies > 0").select(key, F.col("copies").cast("int").alias(times))
    taken = rows.join(copies.hint("shuffle_hash"), key)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 4096 tokens."""
    return packing.best_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Fingerprints, tilted rates and tokenizers are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/docloom-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
