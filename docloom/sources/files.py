"""Scans and sinks of the engine's own artifacts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/") if root else "file://" + tempfile.mkdtemp(prefix="docloom-")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with ``source_id`` (their folder), ``file_name``, ``length`` and ``content_hash``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("source_id"), F.element_at(parts, -1).alias("file_name"), "length", F.sha2("content", 256).alias("content_hash"), "content"
    )


def content_hash(content: "F.Column") -> "F.Column":
    """SHA-256 of bytes, empty where there are none."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet; an empty corpus is refused."""
    if chunks.isEmpty():
        raise RuntimeError("there are no chunks to write")
    chunks.write.mode("overwrite").parquet(path)


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """A readable block of lines per chunk, in order."""
    rule = F.lit("-" * 72)
    head = F.concat_ws(" | ", "chunk_id", "section_path", F.concat(F.col("char_len").cast("string"), F.lit(" chars")))
    return chunks.orderBy("source_id", "chunk_index").select(F.concat_ws("\n", rule, head, rule, "text", F.lit("")).alias("value"))


def write_chunk_text(chunks: DataFrame, path: str) -> None:
    chunk_lines(chunks).write.mode("overwrite").text(path)


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Gold probes of a JSON-lines file; blank lines are skipped."""
    schema = "id string, question string, chunk_ids array<string>, expected string, note string"
    return spark.read.schema(schema).json(path).where("id is not null")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, empty where there is none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_traces(rows: DataFrame, path: str) -> None:
    """JSON lines appended to a trace folder."""
    rows.write.mode("append").text(path)


def report(rows: DataFrame) -> DataFrame:
    """Sources by flag with their share, and how many need attention."""
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return rows.groupBy("flag").agg(F.count("*").alias("n"), total.alias("total")).select(
        "flag", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("pct"), (F.col("flag") != "ok").alias("needs_attention")
    )


def report_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Markdown table rows; bars inside values are escaped."""
    cells = [F.replace(tx.text_of(F.col(c).cast("string")), F.lit("|"), F.lit("\\|")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def replace_section(document: str, title: str, body: str) -> str:
    """A Markdown document with the section ``## title`` replaced, or added at the end; other sections stay."""
    parts = document.split("\n## ")
    own = [k for k, p in enumerate(parts) if (p.split("\n", 1)[0].strip() == title and k) or (not k and p.startswith(f"## {title}\n"))]
    fresh = f"{title}\n{body.rstrip()}\n"
    if own and own[0]:
        parts[own[0]] = fresh
        return "\n## ".join(parts)
    if own:
        parts[0] = "## " + fresh
        return "\n## ".join(parts)
    return document.rstrip("\n") + ("\n\n" if document.strip() else "") + "## " + fresh
