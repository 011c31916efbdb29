"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints
differ in three bits at most, they differ in one bit at most in one of the
segments, so it is enough to look up the Hamming ball of radius one around each
segment in that segment's table and to verify the whole distance of what is
found. A ball's members are enumerated from the side whose differing bit is 0,
so every pair of segments is met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, partitions_for, rows_in_arrow, stored, texts
from .components import connected_components

MAX_DISTANCE = 3
#: Members of one table entry above which pairs are looked for by equal bytes of the other segment.
DENSE = 1024


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of one text: a bit is 1 if set in over half of the shingles' hashes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return digest(b" ".join(words), 42)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    hashes = np.empty(n, np.uint64)
    cut = zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    hashes[:] = [digest(whole[a:b], 42) for a, b in cut]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # long texts in blocks of bounded memory
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows_in_arrow(source, run, "doc_id bigint, fp bigint", SLICE)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over pairs (a, b) among n items."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _close(own: np.ndarray, other: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in own, j in other) within ``distance``, in blocks of bounded memory."""
    found_i, found_j = [], []
    step = max(1, (1 << 20) // max(1, len(other)))
    for k in range(0, len(own), step):
        i, j = np.nonzero(_popcount(own[k : k + step, None] ^ other[None, :]) <= distance)
        found_i.append(i + k)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def linked(members: np.ndarray, probes: np.ndarray, shift: int, distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among an entry's members and the probes that met it.

    Every pair (member, member) and (member, probe) is verified, but only links
    that join parts not joined yet are returned: at most one fewer than items.
    In a dense entry, pairs are met through an equal byte of the other segment,
    which three differing bits in four bytes leave at least one of.
    """
    items = np.concatenate([members, probes])
    m, n = len(members), len(items)
    sources, targets = [], []

    def meet(rows: np.ndarray) -> None:
        own = rows[rows < m]
        if len(own):
            i, j = _close(items[own], items[rows], distance)
            sources.append(own[i])
            targets.append(rows[j])

    if n <= DENSE:
        meet(np.arange(n))
    else:
        for byte in range(4):
            part = (items >> np.uint64(shift + 8 * byte)) & np.uint64(255)
            order = np.argsort(part, kind="stable")
            for rows in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
                if len(rows) > 1:
                    meet(rows)
    if not sources:
        return items[:0], items[:0]
    root = _roots(np.concatenate(sources), np.concatenate(targets), n)
    moved = root != np.arange(n)
    return items[moved], items[root[moved]]


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all pairs of distinct ``fp`` within three bits."""
    spark = fps.sparkSession

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 4096):
                part = fp[k : k + 4096]
                keys, owners, probe = [], [], []
                for segment in (0, 1):
                    value = (part >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
                    row, which = np.nonzero((value[:, None] & bit[None, :]) == 0)
                    tag = np.uint64(segment) << np.uint64(32)
                    keys += [value | tag, value[row] | bit[which] | tag]
                    owners += [part, part[row]]
                    probe += [np.zeros(len(part), bool), np.ones(len(row), bool)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(probe)),
                        pa.array(np.concatenate(owners).view(np.int64)),
                    ],
                    ["entry", "probe", "fp"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def settle(entry: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edges = np.nonzero(np.diff(entry))[0] + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(entry)]))
            # Rows are sorted by entry with members first: an entry matters if it has a member and anything else.
            worth = (ends - starts > 1) & ~probe[starts]
            out_a, out_b = [], []
            for s, e in zip(starts[worth].tolist(), ends[worth].tolist(), strict=True):
                m = s + int(np.searchsorted(probe[s:e], True))
                a, b = linked(fp[s:m], fp[m:e], 0 if int(entry[s]) >> 32 else 32)
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
            a = np.concatenate(out_a) if out_a else fp[:0]
            b = np.concatenate(out_b) if out_b else fp[:0]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [
                batch.column(0).to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64),
            ]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last entry may go on in the next batch
            rest = [x[cut:] for x in columns]
            if cut:
                yield settle(*(x[:cut] for x in columns))
        if rest is not None and len(rest[0]):
            yield settle(*rest)

    looked_up = fps.select("fp").mapInArrow(entries, "entry bigint, probe boolean, fp bigint")
    dealt = looked_up.repartition(partitions_for(spark), "entry").sortWithinPartitions("entry", "probe", "fp")
    return dealt.mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document under links of at most three differing fingerprint bits.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest doc_id reachable. Null and empty texts have
    fingerprint zero and are linked like any other; equal texts share a
    fingerprint and so a component; an empty table gives an empty result; a null
    doc_id keeps its row and never names a component unless it is alone; other
    columns are ignored. Each row gives one row, repeated rows included.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    reached = connected_components(near_links(classes))
    roots = classes.join(reached, classes.fp == reached.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
