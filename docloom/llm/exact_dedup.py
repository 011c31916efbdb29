"""Exact deduplication against a minimal perfect hash of the digests seen so far.

The index is three small facts about each distinct digest, held as tables:

* its bucket, a few digests that share leading bits, in a block of about
  ``BUCKETS`` times as many;
* the bucket's ``seed``, found by trial in order of falling bucket size, under
  which its digests take places among the block's 0..m-1 that no other bucket
  of the block takes, and the block's ``base``, the number of digests in earlier
  blocks, so that ``base + place`` numbers all digests 0..n-1;
* the slot of that number, which holds the whole digest and the winner.

A lookup joins on the bucket, computes the slot and compares all bytes of the
digest stored there: a member is a repeat and is counted to the slot's winner;
digests that fail the comparison were never seen and are grouped among
themselves. Both arriving groups and history are reduced to distinct digests
before they are shuffled by digest, so a text that a third of all rows share is
one row there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, partitions_for, rows_in_arrow, stored, text_or_empty, texts

#: Digests in a bucket on average; larger ones make smaller indexes and slower builds.
BUCKET_LOAD = 4
#: Buckets in a block, as a power of two.
BUCKETS = 10
#: Seeds tried at once.
TRIALS = 64
#: Without a history of its own, one of so many rows, by a hash of its doc_id, is history and the others arrive.
HISTORY = 2


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` (SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(x.encode("utf-8", "surrogatepass").lower()).digest() for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows_in_arrow(source, run, "doc_id bigint, digest binary", SLICE)


def _places(words: np.ndarray, seed: np.ndarray, m: np.ndarray | np.uint64) -> np.ndarray:
    """Places of digests (by their second and third 8 bytes) among m under seeds; a column of seeds gives a row each."""
    with np.errstate(over="ignore"):
        x = words[:, 1] ^ (words[:, 2] + seed * np.uint64(0x9E3779B97F4A7C15))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)) % m


def _words(column: pa.Array) -> np.ndarray:
    """Digests as rows of four unsigned 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)


def build_index(winners: DataFrame, bucket_load: int = BUCKET_LOAD) -> tuple[DataFrame, DataFrame]:
    """Minimal perfect hash over ``winners`` (``digest``, ``winner``, ``copies``; digests distinct).

    Returns ``seeds`` (``bucket``, ``seed``, ``base``, ``m``) and ``slots``
    (``slot``, ``slot_digest``, ``winner``, ``copies``). Slots are 0..n-1, none
    empty. A bucket too large for trial is cut at further bits of its digests
    until each part has a seed, so the build ends for any input.
    """
    spark = winners.sparkSession
    n = winners.count()
    bits = max(0, min(40, int(np.ceil(np.log2(max(1, n) / bucket_load)))))
    coarse_bits = max(0, bits - BUCKETS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seeds of whole blocks: rows come sorted by digest, so blocks come in one piece."""
        held: list[pa.RecordBatch] = []

        def heads(words: np.ndarray, kept_bits: int) -> np.ndarray:
            return words[:, 0] >> np.uint64(64 - kept_bits) if kept_bits else np.zeros(len(words), np.uint64)

        def seeds_of(words: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Seed and place of each digest of one block."""
            m = len(words)
            _, first, size = np.unique(bucket, return_index=True, return_counts=True)
            free = np.ones(m, bool)
            seed, at = np.empty(m, np.int64), np.empty(m, np.int64)
            tried = np.arange(TRIALS, dtype=np.uint64)[:, None]
            for k in np.argsort(-size, kind="stable").tolist():
                rows = slice(first[k], first[k] + size[k])
                own, start = words[rows], 0
                while True:
                    spots = _places(own, tried + np.uint64(start), np.uint64(m)).astype(np.int64)
                    good = free[spots].all(axis=1)
                    if size[k] > 1 and good.any():
                        ordered = np.sort(spots, axis=1)
                        good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                    if good.any():
                        hit = int(good.argmax())
                        seed[rows], at[rows] = start + hit, spots[hit]
                        free[spots[hit]] = False
                        break
                    start += TRIALS
                    if start > 1 << 31:
                        raise RuntimeError("a bucket has no seed: equal digests in the index")
            return seed, at

        def seeded(table: pa.Table) -> pa.RecordBatch:
            words = _words(table.column("digest").combine_chunks())
            bucket, block = heads(words, bits), heads(words, coarse_bits)
            edges = [0, *(np.nonzero(block[1:] != block[:-1])[0] + 1).tolist(), len(words)]
            parts = [seeds_of(words[a:b], bucket[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            m = np.repeat(np.diff(edges), np.diff(edges))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket.astype(np.int64)),
                    pa.array(np.concatenate([x[0] for x in parts])),
                    pa.array(m.astype(np.int64)),
                    pa.array(np.concatenate([x[1] for x in parts])),
                    table.column("digest").combine_chunks(),
                    table.column("winner").combine_chunks(),
                    table.column("copies").combine_chunks(),
                ],
                ["bucket", "seed", "m", "place", "digest", "winner", "copies"],
            )

        def last_block(batch: pa.RecordBatch) -> int:
            """First row of the batch's last block."""
            block = heads(_words(batch.column("digest")), coarse_bits)
            return int(np.searchsorted(block, block[-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            cut = last_block(whole)
            if cut:
                yield seeded(pa.Table.from_batches([whole.slice(0, cut)]))
            held = [whole.slice(cut)]
        if held and held[0].num_rows:
            yield seeded(pa.Table.from_batches(held))

    # A digest's leading bits keep a block in one partition.
    coarse = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("bigint")
    dealt = winners.withColumn("coarse", F.shiftright(coarse, 48 - coarse_bits) if coarse_bits else F.lit(0))
    placed = (
        dealt.repartition(partitions_for(spark), "coarse")
        .sortWithinPartitions("digest")
        .select("digest", "winner", "copies")
        .mapInArrow(
            place,
            "bucket bigint, seed bigint, m bigint, place bigint, digest binary, winner bigint, copies bigint",
        )
    )
    placed = stored(placed, "placed")
    each = placed.groupBy("bucket").agg(F.first("seed").alias("seed"), F.first("m").alias("m"))
    # Bases: digests before a block, first over groups of 1,024 blocks, then inside each group.
    each = each.withColumn("block", F.shiftright("bucket", bits - coarse_bits))
    blocks = each.groupBy("block").agg(F.first("m").alias("m")).withColumn("part", F.shiftright("block", 10))
    parts = blocks.groupBy("part").agg(F.sum("m").alias("part_m")).withColumn("wide", F.shiftright("part", 10))
    wides = parts.groupBy("wide").agg(F.sum("part_m").alias("wide_m"))
    before = lambda column, *by: Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    wides = wides.select("wide", F.coalesce(F.sum("wide_m").over(before("wide")), F.lit(0)).alias("wide_base"))
    parts = parts.join(wides, "wide").select(
        "part", (F.col("wide_base") + F.coalesce(F.sum("part_m").over(before("part", "wide")), F.lit(0))).alias("part_base")
    )
    bases = blocks.join(parts, "part").select(
        "block", (F.col("part_base") + F.coalesce(F.sum("m").over(before("block", "part")), F.lit(0))).alias("base")
    )
    seeds = stored(each.join(bases, "block").select("bucket", "seed", "m", "base"), "seeds")
    slots = placed.join(seeds.select("bucket", "base"), "bucket").select(
        (F.col("base") + F.col("place")).alias("slot"), F.col("digest").alias("slot_digest"), "winner", "copies"
    )
    seeds = seeds.withColumn("bits", F.lit(bits))
    return seeds, stored(slots, "slots")


def look_up(groups: DataFrame, seeds: DataFrame, slots: DataFrame) -> DataFrame:
    """``groups`` (``digest``, ``latest``, ``more``) with ``slot``, ``winner`` and ``copies`` of the equal digest in the index, else null."""
    first = seeds.select("bits").first()
    bits = int(first[0]) if first else 0

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(batch.column("digest"))
            seed = np.nan_to_num(batch.column("seed").to_numpy(zero_copy_only=False), nan=0).astype(np.uint64)
            m = np.nan_to_num(batch.column("m").to_numpy(zero_copy_only=False), nan=1).astype(np.uint64)
            at = pa.array(_places(words, seed, np.maximum(m, np.uint64(1))).astype(np.int64))
            slot = pa.compute.add(batch.column("base"), at)
            kept = ["digest", "latest", "more"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), slot], [*kept, "at"])

    head = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("bigint")
    keyed = groups.withColumn("bucket", F.shiftright(head, 48 - bits) if bits else F.lit(0).cast("bigint"))
    addressed = (
        keyed.join(seeds.select("bucket", "seed", "base", "m"), "bucket", "left")
        .select("digest", "latest", "more", "seed", "base", "m")
        .mapInArrow(address, "digest binary, latest bigint, more bigint, at bigint")
    )
    same = F.col("slot_digest") == F.col("digest")
    return addressed.join(slots, addressed["at"] == slots["slot"], "left").select(
        "digest", "latest", "more", *(F.when(same, F.col(c)).alias(c) for c in ("slot", "winner", "copies"))
    )


def index_of(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index of all digests in ``prints``; of equal ones the largest doc_id wins (a null doc_id never does)."""
    winners = prints.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("copies"))
    return build_index(stored(winners, "winners"))


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the row that stays of its group of equal texts.

    The index is built over ``history``. Arriving digests that it holds are
    repeats; the others are grouped among themselves. A row of ``docs`` that
    equals a historical text is not kept. Without a history of its own, one row
    of ``docs`` in ``HISTORY``, by a hash of its doc_id, is history and the
    others arrive; then the row that stays is the largest doc_id of both.

    Returns ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    Null texts equal empty ones. Rows repeated with the same doc_id all count in
    ``group_size`` and are all kept if their doc_id wins. A null doc_id never
    wins while its group has another; in a group of null doc_ids keep_id is null
    and no row is kept. An empty table gives an empty result; other columns are
    ignored.
    """
    prints = stored(digests(docs, id_col, text_col), "digests")
    if history is None:
        seen = F.pmod(F.xxhash64("doc_id"), F.lit(HISTORY)) == 0
        old, new = prints.where(seen), prints.where(~seen)
    else:
        old, new = stored(digests(history, id_col, text_col), "digests"), prints
    seeds, slots = index_of(old)
    arriving = new.groupBy("digest").agg(F.max("doc_id").alias("latest"), F.count("*").alias("more"))
    found = stored(look_up(arriving, seeds, slots), "looked-up")
    repeats = found.where("slot is not null")
    if history is None:
        # The history's rows are rows of the result too: a slot's group is its own copies and the repeats.
        grown = slots.join(repeats.select("slot", "latest", "more"), "slot", "left")
        known = grown.select(
            F.col("slot_digest").alias("digest"),
            F.greatest("winner", "latest").alias("keep_id"),
            (F.col("copies") + F.coalesce("more", F.lit(0))).alias("group_size"),
            F.lit(True).alias("stays"),
        )
    else:
        known = repeats.select("digest", F.col("winner").alias("keep_id"), (F.col("copies") + F.col("more")).alias("group_size"), F.lit(False).alias("stays"))
    fresh = found.where("slot is null").select("digest", F.col("latest").alias("keep_id"), F.col("more").alias("group_size"), F.lit(True).alias("stays"))
    return prints.join(known.unionByName(fresh), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("stays") & (F.col("doc_id") == F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
