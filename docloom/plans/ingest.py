"""The offline build: manifest, fetch, extraction, normalization, chunks, index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import SETTINGS, VOCABULARY, Settings, Vocabulary
from docloom.operators import chunk, embed, embedded, extract_html, index, normalize, pdf
from docloom.sources import fetch, files, manifest, pdf_reader


def extract(pages: DataFrame, sources: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Blocks of fetched pages (``source_id, html``): embedded JSON first, then the page, stripped text where both are silent.

    ``sources`` tells the scheme, plan and document type of each.
    """
    walked = extract_html.page_blocks(pages, "source_id")
    found = embedded.merge_stages(embedded.embedded_blocks(pages, sources, "source_id", vocabulary=vocabulary), walked)
    return extract_html.fallback_blocks(pages, found, "source_id")


def preferred(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """Normalized blocks, raw ones of sources that have no normalized block."""
    return normalized.unionByName(raw.join(normalized.select("source_id").distinct(), "source_id", "left_anti"))


def build(
    spark: SparkSession,
    manifest_path: str,
    root: str,
    transport: fetch.Transport = fetch.http,
    embedder: embed.Embedder | None = None,
    settings: Settings = SETTINGS,
    vocabulary: Vocabulary = VOCABULARY,
    only_fetch: bool = False,
    only_embed: bool = False,
    force: bool = False,
    prune: bool = True,
    wait=None,
    pdf_reader: pdf.Reader = pdf_reader.read,
) -> index.Ingested | None:
    """Bring everything under ``root`` up to the manifest; each stage is a table, so a stopped run goes on where it was.

    ``only_fetch`` stops after fetching, ``only_embed`` starts from the chunks
    that are there, ``force`` embeds all again. PDF files go through
    ``pdf_reader``; pages and files that cannot be read are rows of kind
    ``error`` in the blocks' table.
    """
    root = root.rstrip("/")
    sources = manifest.load(spark, manifest_path, vocabulary=vocabulary)
    enabled = sources.where("enabled")
    if not only_embed:
        known = files.read_state(spark, f"{root}/raw", fetch.RESULT)
        options = {} if wait is None else {"wait": wait}
        fresh = fetch.fetch_all(enabled, transport, None if force else known.where("status = 'ok'"), settings, **options)
        fresh.write.mode("append").parquet(f"{root}/raw")
        if only_fetch:
            return None
        # Of several fetches of a source the last good one counts.
        latest = spark.read.parquet(f"{root}/raw").where("status = 'ok'").groupBy("source_id").agg(
            F.max_by(F.struct("content", "content_hash"), "fetched_at").alias("last"), F.max("fetched_at").alias("fetched_at")
        )
        pages = latest.join(enabled.select("source_id", "doc_type", "is_pdf"), "source_id").select(
            "source_id", F.col("last.content").alias("content"), F.col("last.content_hash").alias("content_hash"), "fetched_at", "doc_type"
        )
        kind = extract_html.dispatch(F.col("content"), F.col("doc_type"))
        html = pages.where(kind == "html").select("source_id", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
        printed = pages.where(kind == "pdf").select("source_id", "content")
        files.write_blocks(pdf.read_files(printed, pdf_reader), f"{root}/spans")
        files.write_blocks(extract(html, enabled, vocabulary).unionByName(pdf.file_blocks(spark.read.parquet(f"{root}/spans"))), f"{root}/blocks")
        # What could not be read stays in the blocks' table and goes no further.
        raw = spark.read.parquet(f"{root}/blocks").where("kind <> 'error'")
        files.write_blocks(normalize.normalize_blocks(raw), f"{root}/normalized")
        blocks = preferred(spark.read.parquet(f"{root}/normalized"), raw)
        info = enabled.join(pages.select("source_id", "fetched_at"), "source_id", "left")
        files.write_chunks(chunk.chunk_documents(blocks, info, settings, vocabulary), f"{root}/chunks")
        pages.select("source_id", F.col("content_hash").alias("file_hash")).write.mode("overwrite").parquet(f"{root}/hashes")
    chunks, hashes = spark.read.parquet(f"{root}/chunks"), spark.read.parquet(f"{root}/hashes")
    store = index.VectorIndex(spark, f"{root}/index")
    return store.ingest(chunks, embedder or embed.HashingEmbedder(settings.embed_dim), enabled, hashes, force, prune)
