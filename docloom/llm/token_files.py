"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A data set is three tables in one folder:

* ``dictionary``: the dictionary's bytes and their SHA-256, one row;
* ``shards``: blobs of about ``SHARD_BYTES``, each with a header (magic,
  version, the dictionary's hash, number of documents) and the frames of its
  documents in ascending doc_id order; beside each blob, in columns of their
  own, its offset index: for each document the frame's place and length and its
  number of ids, so one short document is read by one slice of one blob;
* ``bases``: ids before each range of documents, from which places follow.

Ids are serialized as 16 bits where the tokenizer's vocabulary allows, else 32. Blobs are
written by Spark, so the folder may lie in any store that Spark writes to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, scratch_root, text_or_empty, texts
from .tokens import default_path, serializer

MAGIC = b"DLTK"
HEADER = "<4sHH32sI"  # magic, version, bytes an id, dictionary hash, documents
SHARD_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: About so many slices of texts train the dictionary, each of so many characters at most: the bound of its sample.
SAMPLE_SLICES, SLICE_CHARS = 2000, 4 << 10


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary for frames like ``samples``; empty, with a warning, if they are too few or too small to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError as e:
        if samples:
            warnings.warn(f"frames have no dictionary: none could be trained on {len(samples)} samples ({e})", stacklevel=2)
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def width_of(tokenizer: str, end_id: int = 0) -> int:
    """Bytes that hold every id of the tokenizer file ``tokenizer``, and ``end_id``: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def sample_of(source: DataFrame, tokenizer: str, end: bytes, kind: str) -> list[bytes]:
    """Serialized ids of about ``SAMPLE_SLICES`` slices, dealt over all slices of all texts alike, so long texts count by their length."""
    slices = F.greatest(F.ceil(F.length("text") / SLICE_CHARS), F.lit(1)).cast("int")
    sized = source.select("doc_id", "text", slices.alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 1
    chance = lambda k: F.shiftrightunsigned(F.xxhash64("doc_id", "n", k), 11) / F.lit(float(1 << 53))
    chosen = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: chance(k) < min(1.0, SAMPLE_SLICES / total))
    cut = sized.withColumn("k", F.explode(chosen)).select(F.expr(f"substring(text, k * {SLICE_CHARS} + 1, {SLICE_CHARS})").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = serializer(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(encode(x) + end, "<u4").astype(kind).tobytes() for x in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return sorted(bytes(r[0]) for r in cut.mapInArrow(run, "ids binary").toLocalIterator())


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    level: int = 3,
    id_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write ``docs`` to ``path`` in ascending doc_id order (nulls first, texts of one doc_id in the order of a hash).

    ``id_bytes`` is taken from the vocabulary; fewer than it needs is an error.
    """
    least = width_of(tokenizer, end_id)
    id_bytes = id_bytes or least
    if id_bytes < least:
        raise ValueError(f"ids of {tokenizer} need {least} bytes, not {id_bytes}")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    end = end_id.to_bytes(4, "little")
    trained = train_dictionary(sample_of(source, tokenizer, end, kind))
    trained_hash = hashlib.sha256(trained).digest()
    spark.createDataFrame([(bytearray(trained), trained_hash.hex())], "data binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of = serializer(tokenizer)
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained), write_content_size=True, write_dict_id=False)
        number, before = 0, 0
        doc_ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, size
            blob = struct.pack(HEADER, MAGIC, 1, id_bytes, trained_hash, len(frames)) + b"".join(frames)
            ends = struct.calcsize(HEADER) + np.cumsum([len(f) for f in frames], dtype=np.int64)
            lengths = np.array([len(f) for f in frames], np.int64)
            total = sum(counts)
            known = [x for x in doc_ids if x is not None]
            as_list = lambda values, t: pa.array([values], pa.list_(t))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([total], pa.int64()),
                    pa.array([min(known, default=None)], pa.int64()),
                    pa.array([max(known, default=None)], pa.int64()),
                    pa.array([blob], pa.binary()),
                    as_list(list(doc_ids), pa.int64()),
                    as_list((ends - lengths).tolist(), pa.int64()),
                    as_list(lengths.tolist(), pa.int32()),
                    as_list(list(counts), pa.int64()),
                ],
                ["part", "shard", "before", "n_ids", "low", "high", "blob", "doc_ids", "offsets", "lengths", "counts"],
            )
            number, before, size = number + 1, before + total, 0
            doc_ids.clear(), counts.clear(), frames.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.frombuffer(ids_of(text) + end, "<u4")
                frame = press.compress(ids.astype(kind).tobytes())
                doc_ids.append(doc_id)
                counts.append(len(ids))
                frames.append(frame)
                size += len(frame)
                if size >= SHARD_BYTES:
                    yield flush()
        if frames:
            yield flush()

    # A hash and the row's number part the rows of one doc_id, so they are no single range.
    order = ["doc_id", "h", "row"]
    keyed = source.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = (
        "part int, shard bigint, before bigint, n_ids bigint, low bigint, high bigint, blob binary, doc_ids array<bigint>, offsets array<bigint>,"
        " lengths array<int>, counts array<bigint>"
    )
    dealt.mapInArrow(shards, schema).write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(f"{path}/shards")
    # Ids before each range of documents: one row a partition, summed in the order of the ranges.
    made = spark.read.parquet(f"{path}/shards")
    totals = sorted(made.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).collect())
    bases, ids = [], 0
    for part, n in totals:
        bases.append((part, ids))
        ids += n
    spark.createDataFrame(bases, "part int, base bigint").coalesce(1).write.parquet(f"{path}/bases")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of ``path`` from its files: ``doc_id``, ``start``, ``n_tokens``, ``ids`` as little-endian 32-bit bytes."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data, told = bytes(row["data"]), row["sha256"]
    if hashlib.sha256(data).hexdigest() != told:
        raise ValueError("the dictionary's bytes do not have its hash")

    def open_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for k in range(batch.num_rows):
                blob = batch.column("blob")[k].as_py()
                magic, version, id_bytes, digest, n = struct.unpack_from(HEADER, blob)
                if magic != MAGIC or version != 1 or digest.hex() != told:
                    raise ValueError("not a shard of this dictionary")
                ids, counts, at = [], [], batch.column("base")[k].as_py() + batch.column("before")[k].as_py()
                offsets, lengths = batch.column("offsets")[k].as_py(), batch.column("lengths")[k].as_py()
                for place, length in zip(offsets, lengths, strict=True):
                    raw = np.frombuffer(expand.decompress(blob[place : place + length]), f"<u{id_bytes}").astype("<u4")
                    ids.append(raw.tobytes())
                    counts.append(len(raw))
                if n != len(ids):
                    raise ValueError("a shard's header and index disagree")
                starts = at + np.concatenate(([0], np.cumsum(counts)[:-1]))
                for first in range(0, n, 512):
                    last = min(n, first + 512)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_ids")[k].values.slice(first, last - first),
                            pa.array(starts[first:last], pa.int64()),
                            pa.array(counts[first:last], pa.int64()),
                            pa.array([zlib.crc32(x) for x in ids[first:last]], pa.int64()),
                            pa.array(ids[first:last], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    shards = spark.read.parquet(f"{path}/shards").select("part", "before", "blob", "doc_ids", "offsets", "lengths")
    bases = spark.read.parquet(f"{path}/bases")
    return shards.join(bases, "part").mapInArrow(open_shards, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document, by its index row and one slice of its shard; of repeated doc_ids the first.

    The least and greatest doc_id of each shard keep the scan from other shards.
    """
    import zstandard

    at = F.array_position("doc_ids", F.lit(doc_id).cast("bigint")).cast("int")
    row = (
        spark.read.parquet(f"{path}/shards")
        .where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
        .withColumn("at", at)
        .where("at > 0")
        .orderBy("part", "shard")
        .select(
            F.expr("substring(blob, int(element_at(offsets, at)) + 1, element_at(lengths, at))").alias("frame"),
            F.expr(f"substring(blob, 1, {struct.calcsize(HEADER)})").alias("head"),
        )
        .first()
    )
    if row is None:
        return None
    data = bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])
    id_bytes = struct.unpack(HEADER, bytes(row["head"]))[2]
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress(bytes(row["frame"])), f"<u{id_bytes}")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a folder in the shared place and report what reading it back gives.

    Returns ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``
    (with the end id), ``ids_crc32``. Null and empty texts hold the end id alone;
    repeated rows are documents of their own, in the order of a hash of their texts; null
    doc_ids come first; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/docloom-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer or default_path("byte_bpe_50k.json"), end_id)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
