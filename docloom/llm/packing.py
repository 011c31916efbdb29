"""Best-fit packing of token pieces into sequences of bounded length.

Pieces are dealt over partitions by a hash and packed there online: each is
placed for good as it comes, into a fixed number of open sequences. A bitset over
free space finds the fullest open sequence that a piece still fits in; when none
fits and all are open, the fullest closes. A partition gets so many tokens
(``PART_TOKENS``) whatever the session's partitions are, so what its last open
sequences leave free is a small share of it. Sequences that end loosely filled
are taken apart and packed again, over fewer partitions, as long as that needs
fewer sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, rows_in_arrow, stored, text_or_empty, texts
from .tokens import default_path, serializer

#: Tokens of one partition: thousands of sequences, and rows of a few bytes.
PART_TOKENS = 1 << 24
#: A sequence filled less than this is packed again.
LOOSE = 15 / 16


class OpenBins:
    """Bounded-space best fit: at most ``limit`` open bins of ``capacity``."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = 0  # bit k is set if an open bin has k free
        self.bins: dict[int, list[tuple[int, int]]] = {}
        self.open = self.made = 0

    def _take(self, space: int) -> tuple[int, int]:
        kept = self.bins[space]
        found = kept.pop()
        if not kept:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def _put(self, space: int, item: tuple[int, int]) -> None:
        if space:  # a full bin is closed
            self.bins.setdefault(space, []).append(item)
            self.free |= 1 << space
            self.open += 1

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fits = self.free >> length
        if fits:
            space = length + ((fits & -fits).bit_length() - 1)
            number, used = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            number, used, space = self.made, 0, self.capacity
            self.made += 1
        self._put(space - length, (number, used + length))
        return number, used


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its end id included."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = serializer(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = encode(text) + end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows_in_arrow(source, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", SLICE, (f"ids:{tokenizer}",))


_PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint, sequence_id bigint, offset bigint"


def _one_pass(cut: DataFrame, capacity: int, open_bins: int, tokens: int, number: int, *order) -> DataFrame:
    """``cut`` packed in the order of ``order``; ``number`` keeps the sequences of different passes apart."""
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    parts = -(-max(1, tokens) // PART_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(capacity, open_bins), (number << 56) | (TaskContext.get().partitionId() << 32)
        for batch in batches:
            placed = [bins.add(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*kept, "sequence_id", "offset"],
            )

    # Rows are dealt by their own numbers, so neither a hot document nor many equal ones are one task's.
    dealt = cut.repartition(parts, F.xxhash64("row")).sortWithinPartitions(*order, F.xxhash64("row")).select(*kept)
    return rows_in_arrow(dealt, run, _PLACED)


def pack(cut: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """``cut`` (``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``row``) with ``sequence_id`` and ``offset``."""
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    placed = stored(_one_pass(cut, capacity, open_bins, tokens, 0), "packed")
    settled, number = [], 0
    while True:
        fills = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        loose = stored(fills.where(F.col("fill") < LOOSE * capacity), "loose")
        count, held = loose.agg(F.count("*"), F.coalesce(F.sum("fill"), F.lit(0))).first()
        if -(-held // capacity) >= count:  # as few as they can be
            break
        number += 1
        again = placed.join(loose, "sequence_id", "left_semi")
        packed = stored(_one_pass(again, capacity, open_bins, held, number, F.desc("length")), "packed")
        if packed.select("sequence_id").distinct().count() >= count:
            break
        settled.append(placed.join(loose, "sequence_id", "left_anti"))
        placed = packed
    for part in settled:
        placed = placed.unionByName(part)
    return placed.drop("row")


def best_fit(
    docs: DataFrame,
    capacity: int = 4096,
    tokenizer: str | None = None,
    end_id: int = 1,
    open_bins: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A document's ids end with ``end_id``; only documents longer than a sequence
    are cut. Returns a row per piece: ``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32`` (unsigned, of the ids as little-endian unsigned 32
    bits), ``sequence_id`` and ``offset``; places in a sequence have no gaps.
    Null and empty texts are one piece of the end id. Each row is a document of
    its own, repeated rows and null doc_ids included; ties in length go by a hash
    of the row's place. An empty table gives an empty result; other columns are
    ignored. Reruns over the same files agree, whatever the number of shuffle
    partitions.
    """
    cut = pieces(docs, tokenizer or default_path("word_bpe_49k.json"), capacity, end_id, id_col, text_col)
    return pack(stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity, open_bins)
