"""A vector index kept as a Parquet table partitioned by source, maintained by differences.

State is a table of its own, a row per source: ``source_id, file_hash,
chunks_digest, chunk_count, fingerprint, embedded_at``. The digest is made of
sums, so it does not depend on the order of chunks and no source's chunks are
gathered in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import Embedder, embed, embedding_text

STATE = (
    "source_id string, file_hash string, chunks_digest string, chunk_count bigint, fingerprint string,"
    " embedded_at string"
)


def state_of(chunks: DataFrame, file_hashes: DataFrame | None = None) -> DataFrame:
    """Hashes that a source's state is made of, from ``chunks`` (``source_id, chunk_id, content_hash``)."""
    total = lambda *of: F.sum(F.xxhash64(*of).cast("decimal(38,0)")).cast("string")
    digest = F.concat_ws(":", total("chunk_id", "content_hash"), total(F.lit("again"), "content_hash", "chunk_id"))
    state = chunks.groupBy("source_id").agg(digest.alias("chunks_digest"), F.count("*").alias("chunk_count"))
    if file_hashes is None:
        return state.withColumn("file_hash", F.lit(""))
    return state.join(file_hashes, "source_id", "left").withColumn("file_hash", F.coalesce("file_hash", F.lit("")))


def difference(new: DataFrame, old: DataFrame, fingerprint: str, force: bool = False) -> DataFrame:
    """``source_id, change``: added, changed, unchanged or removed.

    A source is unchanged if its file, its chunks and the encoder are what they were.
    """
    n, o = new.alias("n"), old.alias("o")
    joined = n.join(o, F.col("n.source_id") == F.col("o.source_id"), "full_outer")
    same = (
        F.lit(not force)
        & (F.col("o.fingerprint") == fingerprint)
        & F.col("n.file_hash").eqNullSafe(F.col("o.file_hash"))
        & F.col("n.chunk_count").eqNullSafe(F.col("o.chunk_count"))
        & F.col("n.chunks_digest").eqNullSafe(F.col("o.chunks_digest"))
    )
    change = (
        F.when(F.col("o.source_id").isNull(), "added")
        .when(F.col("n.source_id").isNull(), "removed")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return joined.select(F.coalesce("n.source_id", "o.source_id").alias("source_id"), change.alias("change"))


def scalar_metadata(df: DataFrame) -> DataFrame:
    """``df`` with complex columns as JSON; nulls stay null."""
    complex_kinds = ("array", "map", "struct")
    return df.select(*(F.to_json(c).alias(c) if kind.startswith(complex_kinds) else F.col(c) for c, kind in df.dtypes))


def orphans(stored_ids: DataFrame, chunk_ids: DataFrame, enabled: DataFrame) -> DataFrame:
    """Stored rows (``chunk_id, source_id``) that are in no chunk and whose source is not enabled."""
    return stored_ids.join(chunk_ids.select("chunk_id"), "chunk_id", "left_anti").join(enabled.select("source_id"), "source_id", "left_anti")


@dataclass(frozen=True)
class Ingested:
    """What a run did."""

    added: int
    changed: int
    unchanged: int
    removed: int
    upserted: int
    pruned: int
    rebuilt: bool


class VectorIndex:
    """Open an index folder: ``vectors`` and ``state`` are versions of tables, named by ``current``.

    A write makes new versions from the old ones and then names them, so a
    reader, or a run that fails half way, sees the old version whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("version="))

    @property
    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def vectors(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(f"{self.path}/vectors/{self.version}")

    def state(self) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.parquet(f"{self.path}/state/{self.version}")

    def fingerprint(self) -> str | None:
        row = self.state().select("fingerprint").first()
        return row[0] if row else None

    def check(self, embedder: Embedder) -> None:
        """Refuse an encoder that the index was not built by."""
        built = self.fingerprint()
        if built and built != embedder.fingerprint:
            raise RuntimeError(f"the index was built by {built!r}, not {embedder.fingerprint!r}: rebuild it with force")

    def ingest(self, chunks: DataFrame, embedder: Embedder, enabled: DataFrame | None = None, file_hashes: DataFrame | None = None, force: bool = False, prune: bool = True) -> Ingested:
        """Bring the index to ``chunks``: embed what was added or changed, keep the rest, prune disabled sources.

        An empty corpus is refused. With another encoder everything is rebuilt.
        A run that changes nothing writes nothing.
        """
        if chunks.isEmpty():
            raise RuntimeError("the corpus has no chunks")
        old_state, old = self.state(), self.vectors()
        built = self.fingerprint()
        rebuilt = bool(built) and built != embedder.fingerprint
        fresh = state_of(chunks, file_hashes)
        changes = difference(fresh, old_state, embedder.fingerprint, force or rebuilt)
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # four rows at most
        todo = changes.where(F.col("change").isin("added", "changed")).select("source_id")
        gone = None
        pruned = 0
        if prune and enabled is not None and old is not None:
            gone = orphans(old.select("chunk_id", "source_id"), chunks, enabled).select("chunk_id")
            pruned = gone.count()
        n_todo = counts.get("added", 0) + counts.get("changed", 0)
        result = Ingested(counts.get("added", 0), counts.get("changed", 0), counts.get("unchanged", 0), counts.get("removed", 0), 0, pruned, rebuilt)
        if not n_todo and not pruned:
            return result
        work = chunks.join(todo, "source_id", "left_semi").withColumn("document", embedding_text(F.col("text"), F.col("section_path")))
        vectors = embed(work, "document", embedder)
        if old is not None:
            kept = old.join(todo, "source_id", "left_anti")
            if gone is not None:
                kept = kept.join(gone, "chunk_id", "left_anti")
            vectors = kept.unionByName(vectors, allowMissingColumns=True)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        stamped = fresh.select("source_id", "file_hash", "chunks_digest", "chunk_count", F.lit(embedder.fingerprint).alias("fingerprint"), now.alias("embedded_at"))
        done = old_state.join(changes.where(F.col("change").isin("unchanged", "removed")).select("source_id"), "source_id", "left_semi")
        state = stamped.join(todo, "source_id", "left_semi").unionByName(done)
        number = (self.version or 0) + 1
        # Sorted by source inside files, so a source's rows are found by row-group statistics; no folder per source.
        vectors.repartitionByRange("source_id", "chunk_id").sortWithinPartitions("source_id", "chunk_id").write.mode("overwrite").parquet(f"{self.path}/vectors/{number}")
        state.write.mode("overwrite").parquet(f"{self.path}/state/{number}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/current/version={number}")
        upserted = chunks.join(todo, "source_id", "left_semi").count()
        return Ingested(**{**result.__dict__, "upserted": upserted})
