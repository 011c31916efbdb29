"""Removal of repeated passages by suffix arrays.

A byte is removed if some string of ``LENGTH`` bytes that covers it starts
earlier too. Equal strings are found as neighbours in the order of suffixes,
which the difference-cover algorithm builds: sort the sampled suffixes (those
at two of three places) by triples, name the triples, recurse on the names
where they are not all different, sort the remaining suffixes by their first
byte and the rank of the next, and merge. Then prefixes of neighbours are
compared.

What is sorted together is dealt out by content. Every string of ``LENGTH``
bytes has an anchor, the piece of ``GRAM`` bytes in it whose hash is smallest,
so equal strings have equal anchors, and suffixes need comparing only with
suffixes of the same anchor. Neighbouring strings with the same anchor make a
run; runs are collapsed before anything is sorted:

1. A run whose bytes are those of an earlier run is removed as a whole; a task
   reads its anchors' runs in order and holds one of them.
2. A string holds the ``SIDE`` bytes before its anchor or those after it. Equal
   strings have the same side, so the strings of a run that hold a side which no
   other kind of run of the anchor has cannot repeat, nor can those of a run whose
   anchor no other kind has. Sides are compared by 24 bits of a hash: strings that
   collide are sorted in vain, none is lost.
3. The runs that are left, first of their kind and cut to the strings with a
   shared side, are dealt out by anchor, and suffix arrays of a bounded number of
   bytes are built over whole anchors' runs. An anchor of very many runs is dealt out once
   more, string by string, and equal strings are told apart from their first as
   they pass, so no group of them is held.

All three steps are exact but for collisions of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, stored, text_or_empty

LENGTH, GRAM = 100, 24
#: Bytes before or after an anchor that a string holds at least on one of its sides.
SIDE = (LENGTH - GRAM) // 2
#: Kinds of runs of one anchor that a task holds to compare their sides; of more all go on.
HELD = 1 << 17
#: Bytes of documents that anchors are found in at once, and bytes of runs that one suffix array covers.
BLOCK, CHUNK = 1 << 19, 1 << 19
#: Runs of one anchor above which its strings are dealt out one by one, by their hashes.
HOT = 1024
#: Bits of an anchor's place inside a block.
_LOW = 22


# -- the difference-cover algorithm on one array ---------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (positive integers) in ascending order."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = text
    base = int(s.max()) + 1
    # A place of the first kind past the end is sampled too if it makes the kinds' names end apart.
    ones, twos, rest = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([ones, twos])
    padded = np.concatenate([s, np.zeros(2, np.int64)])
    triples = (padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2]
    kinds, names = np.unique(triples, return_inverse=True)
    rank = np.zeros(n + 4, np.int64)  # of sampled suffixes, from 1; 0 past the end
    if len(kinds) == len(sample):
        rank[sample] = names + 1
    else:
        rank[sample[suffix_order(names + 1)]] = np.arange(1, len(sample) + 1)
    reach = len(sample) + 2
    by_one = lambda i: padded[i] * reach + rank[i + 1]
    by_two = lambda i: (padded[i] * base + padded[i + 1]) * reach + rank[i + 2]
    rest = rest[np.argsort(by_one(rest), kind="stable")]
    inside = sample[sample < n]
    inside = inside[np.argsort(rank[inside], kind="stable")]
    kind_one = inside % 3 == 1
    fewer = np.empty(len(inside), np.int64)
    fewer[kind_one] = np.searchsorted(by_one(rest), by_one(inside[kind_one]))
    fewer[~kind_one] = np.searchsorted(by_two(rest), by_two(inside[~kind_one]))
    order = np.full(n, -1, np.int64)
    order[np.arange(len(inside)) + fewer] = inside
    order[order < 0] = rest
    return order


def repeats(runs: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each run the starts of its strings of ``length`` bytes that an earlier run, or the run itself earlier, has too."""
    sizes = np.array([len(r) for r in runs], np.int64)
    text = np.frombuffer(b"\n".join(runs) + b"\n", np.uint8)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    symbols = text.astype(np.int64) + 2
    symbols[ends - 1] = 1
    whole = np.zeros(len(text), bool)  # a string of full length starts here
    for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        whole[b : b + max(0, n - length + 1)] = True
    order = suffix_order(symbols)
    order = order[whole[order]]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(order), bool)
    for k in range(1, len(order), 1 << 16):
        a, b = order[k : k + (1 << 16)], order[k - 1 : k - 1 + (1 << 16)][: len(order[k : k + (1 << 16)])]
        same[k : k + len(a)] = (windows[a] == windows[b]).all(axis=1)
    group = np.cumsum(~same) - 1
    first = np.full(int(group[-1]) + 1 if len(group) else 0, len(text), np.int64)
    np.minimum.at(first, group, order)
    later = np.sort(order[order != first[group]])
    return [later[np.searchsorted(later, b) : np.searchsorted(later, e)] - b for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


# -- anchors and runs --------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def anchored_runs(block: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, anchor hash and sides of each run in ``block``, documents (ending at ``ends``) put end to end.

    Sides are 24 bits of the hash before the anchor, 24 of the one after it, and
    the number of strings that hold the bytes before it, which come first.
    """
    none = np.zeros(0, np.int64)
    if len(block) < LENGTH:
        return none, none, none.astype(np.uint64), none
    step = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        power, size, power_of, sums = step, 1, {1: step}, {1: block.astype(np.uint64) + np.uint64(1)}
        while size * 2 <= GRAM:
            last = sums[size]
            sums[2 * size] = last[:-size] * np.uint64(power) + last[size:]
            size, power = 2 * size, power * power % (1 << 64)
            power_of[size] = power
        h, have = sums[size], size
        while have < GRAM:  # the binary digits of GRAM that are left
            size = 1 << ((GRAM - have).bit_length() - 1)
            n = len(block) - have - size + 1
            h = h[:n] * np.uint64(power_of[size]) + sums[size][have : have + n]
            have += size
        h = _mixed(h)
    mask = np.uint64((1 << _LOW) - 1)
    low = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last place wins
    reach, size = LENGTH - GRAM + 1, 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    whole = np.ones(len(low), bool)
    for e in ends.tolist():
        whole[max(0, e - LENGTH + 1) : e] = False
    change = np.concatenate(([True], low[1:] != low[:-1]))
    opens = (change | np.concatenate(([True], ~whole[:-1]))) & whole
    starts = np.nonzero(opens)[0]
    stops = np.nonzero(np.concatenate((change | ~whole, [True])))[0]
    until = stops[np.searchsorted(stops, starts, side="right")]
    place = (mask - (low[starts] & mask)).astype(np.int64)
    before = np.clip(place - SIDE - starts + 1, 0, until - starts)

    def side(at: np.ndarray) -> np.ndarray:
        """24 bits of the hash of ``SIDE`` bytes; of no meaning where the block ends before."""
        found, left = np.zeros(len(at), np.uint64), SIDE
        while left:
            size = min(1 << (left.bit_length() - 1), max(sums))
            with np.errstate(over="ignore"):
                found = found * np.uint64(power_of[size]) + sums[size][np.clip(at, 0, len(sums[size]) - 1)]
            at, left = at + size, left - size
        with np.errstate(over="ignore"):
            return (_mixed(found) >> np.uint64(40)).astype(np.int64)

    sides = side(place - SIDE) << 40 | side(place + GRAM) << 16 | before
    return starts, until - starts, h[place], sides


def _blocks(keys: list[int], raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Whole documents end to end, in blocks of about ``BLOCK`` bytes; longer ones in parts that overlap by a string.

    Gives keys, offsets in their documents, bytes and ends.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for key, raw in zip(keys, raws, strict=True):
        for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK):
            part = raw[at : at + BLOCK + LENGTH - 1]
            if held and size + len(part) > BLOCK + LENGTH:
                yield np.array([x[0] for x in held]), np.array([x[1] for x in held]), b"".join(x[2] for x in held), np.cumsum([len(x[2]) for x in held])
                held, size = [], 0
            held.append((key, at, part))
            size += len(part)
    if held:
        yield np.array([x[0] for x in held]), np.array([x[1] for x in held]), b"".join(x[2] for x in held), np.cumsum([len(x[2]) for x in held])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


_MARK = "key bigint, start bigint, n int"


def _runs(packed: DataFrame) -> DataFrame:
    """Runs of all documents: ``anchor``, ``bytes_hash``, ``key``, ``start``, ``n`` (strings), ``sides``.

    Of equal runs of a batch only the first is compared with other batches; the
    others are later ones already and have no anchor.
    """
    names = ["anchor", "bytes_hash", "key", "start", "n", "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        expand, digest = zstandard.ZstdDecompressor(), xxhash.xxh3_64_intdigest
        for batch in batches:
            raws = (expand.decompress(x.as_py()) for x in batch.column(1))  # one at a time
            found = []
            for keys, offsets, raw, ends in _blocks(batch.column(0).to_pylist(), raws):
                starts, n, anchor, sides = anchored_runs(np.frombuffer(raw, np.uint8), ends)
                if not len(starts):
                    continue
                hashes = [digest(raw[a:b]) for a, b in zip(starts.tolist(), (starts + n + LENGTH - 1).tolist(), strict=True)]
                doc = np.searchsorted(ends, starts, side="right")
                begin = np.concatenate(([0], ends))[doc]
                found.append((anchor, np.array(hashes, np.uint64), keys[doc], starts - begin + offsets[doc], n, sides))
            if not found:
                continue
            anchor, hashes, key, start, n, sides = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, key, hashes, anchor))
            anchor, hashes, key, start, n, sides = (x[order] for x in (anchor, hashes, key, start, n, sides))
            later = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & (hashes[1:] == hashes[:-1])))
            first = ~later
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor[first]), _signed(hashes[first]), *(pa.array(x[first]) for x in (key, start, n.astype(np.int32), sides))],
                names,
            )
            key, start, n = joined_up(key[later], start[later], n[later])
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(start), pa.array(n.astype(np.int32)), none], names)

    return packed.mapInArrow(run, "anchor bigint, bytes_hash bigint, key bigint, start bigint, n int, sides bigint")


def joined_up(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks with those that follow on from each other made one."""
    order = np.lexsort((start, key))
    key, start, n = key[order], start[order], n[order]
    opens = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + n[:-1])))[: len(key)]
    at = np.nonzero(opens)[0]
    return key[at], start[at], np.add.reduceat(n, at) if len(at) else n


def shared_strings(anchor: np.ndarray, start: np.ndarray, n: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of kinds of runs, sorted by anchor and no anchor cut short, those with a side that another kind of the anchor has: places, starts and numbers of the strings that hold it."""
    fresh = np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(anchor)]
    at = np.nonzero(~(fresh & np.concatenate((fresh[1:], [True]))[: len(anchor)]))[0]
    group, start, n, sides = np.cumsum(fresh)[at], start[at], n[at].astype(np.int64), sides[at]
    before = sides & 0xFFFF

    def twice(hashed: np.ndarray, has: np.ndarray) -> np.ndarray:
        found = np.zeros(len(at), bool)
        which = np.nonzero(has)[0]
        value = group[which] << 24 | hashed[which] & 0xFFFFFF
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        found[which[order[1:][same]]] = found[which[order[:-1][same]]] = True
        return found

    first, second = twice(sides >> 40, before > 0), twice(sides >> 16, before < n)
    begin, end = np.where(first, 0, before), np.where(second, n, before)
    kept = first | second
    return at[kept], (start + begin)[kept], (end - begin)[kept]


def _collapse(runs: DataFrame) -> DataFrame:
    """``key``, ``start``, ``n`` of runs that repeat an earlier one (``anchor`` null), and of the strings of first ones that may repeat (``anchor``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor, bytes, key and start. What is held between batches is the last anchor's kinds, up to ``HELD``."""
        names = ["key", "start", "n", "anchor"]
        last: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, ...]] = []  # kinds of the last anchor
        many: int | None = None  # the last anchor, if it has more kinds than are held

        def settled(kinds: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            if kinds:
                anchor, key, start, n, sides = (np.concatenate(x) for x in zip(*kinds, strict=True))
                at, start, n = shared_strings(anchor, start, n, sides)
                yield rows(key[at], start, n, pa.array(anchor[at]))

        def rows(key, start, n, anchor) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(start), pa.array(n.astype(np.int32)), anchor], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            marked = batch.filter(batch.column("anchor").is_null())
            if marked.num_rows:
                yield pa.RecordBatch.from_arrays([marked.column(k) for k in (2, 3, 4, 0)], names)
                batch = batch.filter(batch.column("anchor").is_valid())
                if not batch.num_rows:
                    continue
            anchor, hashes, key, start, n, sides = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            kind = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (hashes[1:] != hashes[:-1])))
            if last is not None:
                kind[0] = (anchor[0], hashes[0]) != last
            last = (anchor[-1], hashes[-1])
            if not kind.all():
                yield rows(key[~kind], start[~kind], n[~kind], pa.nulls(int((~kind).sum()), pa.int64()))
            kinds = tuple(x[kind] for x in (anchor, key, start, n, sides))
            if many is not None:
                on = kinds[0] == many
                yield rows(*(x[on] for x in kinds[1:4]), pa.array(kinds[0][on]))
                kinds = tuple(x[~on] for x in kinds)
                if anchor[-1] == many:
                    continue
                many = None
            if not len(kinds[0]):
                continue
            cut = int(np.searchsorted(kinds[0], anchor[-1]))  # where the last anchor's kinds begin
            if cut or held and held[-1][0][-1] != anchor[-1]:
                yield from settled([*held, tuple(x[:cut] for x in kinds)])
                held = []
            held.append(tuple(x[cut:] for x in kinds))
            if sum(len(x[0]) for x in held) > HELD:
                for part in held:
                    yield rows(*part[1:4], pa.array(part[0]))
                held, many = [], anchor[-1]
        yield from settled(held)

    spark = runs.sparkSession
    deal = F.coalesce("anchor", F.xxhash64("key", "start"))
    dealt = runs.repartition(partitions_for(spark), deal).sortWithinPartitions("anchor", "bytes_hash", "key", "start")
    return dealt.mapInArrow(run, _MARK + ", anchor bigint")


def _texts_of(packed: DataFrame, shared: DataFrame) -> DataFrame:
    """Bytes of the shared runs: ``deal``, ``anchor``, ``key``, ``start``, ``bytes``; a hot anchor's runs string by string.

    A string without bytes is one that repeats an earlier one of its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        expand, digest = zstandard.ZstdDecompressor(), xxhash.xxh3_64_intdigest
        for batch in batches:
            deal, anchors, keys, starts, cut = [], [], [], [], []
            for at in range(batch.num_rows):
                key, data, runs = (batch.column(k)[at].as_py() for k in range(3))
                raw = expand.decompress(data)
                for r in sorted(runs, key=lambda x: x["start"]):
                    a, n, anchor = r["start"], r["n"], r["anchor"]
                    spans = [(a + k, a + k + LENGTH) for k in range(n)] if r["hot"] else [(a, a + n + LENGTH - 1)]
                    for s, e in spans:
                        part = raw[s:e]
                        deal.append((digest(part) >> 1) | 1 if r["hot"] else 0)
                        anchors.append(anchor)
                        keys.append(key)
                        starts.append(s)
                        cut.append(part)
                if len(keys) >= 4096:
                    yield flush(deal, anchors, keys, starts, cut)
                    deal, anchors, keys, starts, cut = [], [], [], [], []
            if keys:
                yield flush(deal, anchors, keys, starts, cut)

    def flush(deal, anchors, keys, starts, cut) -> pa.RecordBatch:
        # Of equal strings of a hot anchor the first of the batch goes on, the others are repeats already.
        first: dict[bytes, int] = {}
        for k, (d, part) in enumerate(zip(deal, cut, strict=True)):
            if d:
                held = first.setdefault(part, k)
                if (keys[k], starts[k]) < (keys[held], starts[held]):
                    first[part] = k
        cut = [part if not d or first[part] == k else None for k, (d, part) in enumerate(zip(deal, cut, strict=True))]
        return pa.RecordBatch.from_arrays(
            [pa.array(deal, pa.int64()), pa.array(anchors, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(cut, pa.binary())],
            ["deal", "anchor", "key", "start", "bytes"],
        )

    told = shared.select("key", F.struct("start", "n", "anchor", "hot").alias("run"))
    lists = told.groupBy("key").agg(F.collect_list("run").alias("runs"))
    joined = packed.join(lists, "key").select("key", "packed", "runs")
    return joined.mapInArrow(run, "deal bigint, anchor bigint, key bigint, start bigint, bytes binary")


def _sorted_repeats(strings: DataFrame) -> DataFrame:
    """Strings that repeat an earlier one, from suffix arrays over whole anchors' runs: ``key``, ``start``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups
        group: list[tuple] = []  # the group that is being read
        size = group_size = 0
        name = None

        def settle() -> pa.RecordBatch:
            held.sort()
            keys, starts, ns = [], [], []
            for (key, start, _), found in zip(held, repeats([r[2] for r in held]), strict=True):
                if len(found):
                    breaks = np.nonzero(np.diff(found) != 1)[0] + 1
                    for part in np.split(found, breaks):
                        keys.append(key)
                        starts.append(start + int(part[0]))
                        ns.append(len(part))
            return marks(keys, starts, ns)

        def marks(keys: list, starts: list, ns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int32())], ["key", "start", "n"])

        for batch in batches:
            keys, starts, ns = [], [], []
            for deal, anchor, key, start, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if data is None:
                    keys.append(key)
                    starts.append(start)
                    ns.append(1)
                    continue
                if (anchor, deal) != name:
                    if size and size + group_size > CHUNK:
                        yield settle()
                        held, size = [], 0
                    held += group
                    size += group_size
                    group, group_size, name = [], 0, (anchor, deal)
                elif deal and group[-1][2] == data:  # only the first of equal strings needs sorting, or holding
                    keys.append(key)
                    starts.append(start)
                    ns.append(len(data) - LENGTH + 1)
                    continue
                group.append((key, start, data))
                group_size += len(data) + 1
            if keys:
                yield marks(keys, starts, ns)
        held += group
        if held:
            yield settle()

    spark = strings.sparkSession
    # Equal strings come one after the other, the first first. Repeats of a batch only pass through; they go where
    # their first goes, so a task that is run again after a loss is read whole or not at all.
    dealt = strings.repartition(partitions_for(spark), "anchor", "deal").sortWithinPartitions("anchor", "deal", "bytes", "key", "start")
    return dealt.mapInArrow(run, _MARK)


def _cut(packed: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents without the bytes of their marked strings: ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans``, ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                yield cut(whole.slice(first, 512), expand)

    def cut(batch: pa.RecordBatch, expand) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for key, data, marked in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            raw, spans = expand.decompress(data), []
            for start, n in sorted((m["start"], m["n"]) for m in marked or ()):
                end = start + n + LENGTH - 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            row = (key, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        )

    lists = marks.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marked"))
    joined = packed.join(lists, "key", "left").select("key", "packed", "marked")
    return joined.mapInArrow(
        run,
        "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string,"
        " spans array<struct<start: bigint, end: bigint>>, kept binary",
    )


def _packed(source: DataFrame) -> DataFrame:
    """``key`` and compressed bytes of every text: what is shuffled of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [press.compress((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["key", "packed"])

    return source.select("key", "text").mapInArrow(run, "key bigint, packed binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes covered by a string of 100 bytes that also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start.
    Strings never cross documents and are judged on the input. Returns
    ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``,
    ``spans`` (removed ranges of bytes) and ``kept`` (the remaining bytes).

    Null texts are empty. Null doc_ids come after all others, texts that share a
    doc_id in the order of a hash; rows repeated exactly count as one document
    and give one row. An empty table gives an empty result; other columns are
    ignored.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total, filled, different = source.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    names = None
    if total == filled == different:
        keyed = source.select(F.col("doc_id").alias("key"), "text")
    else:
        once = source.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
        ordered = once.orderBy(F.col("doc_id").asc_nulls_last(), "h").withColumn("key", F.monotonically_increasing_id())
        keyed = stored(ordered.select("key", "doc_id", "text"), "keyed")
        names = keyed.select("key", "doc_id")
    packed = _packed(keyed)
    runs = _runs(packed)
    collapsed = stored(_collapse(runs), "collapsed")
    shared = collapsed.where("anchor is not null")
    hot = shared.groupBy("anchor").agg(F.count("*").alias("many")).where(F.col("many") > HOT).select("anchor", F.lit(True).alias("hot"))
    told = shared.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    found = _sorted_repeats(_texts_of(packed, told))
    marks = collapsed.where("anchor is null").select("key", "start", "n").union(found)
    cut = _cut(packed, marks)
    if names is None:
        return cut.withColumnRenamed("key", "doc_id")
    return cut.join(names, "key").select("doc_id", *(c for c in cut.columns if c != "key"))
