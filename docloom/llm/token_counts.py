"""Token counts of documents from the piece counts of their distinct pre-tokens.

Texts are read in blocks of documents. A block lists its distinct pre-tokens,
each with the documents that hold it and how often, so the shuffle carries each
pre-token once a block instead of once a word; lists travel in rows of many
pre-tokens, dealt into buckets by their hashes. A bucket's rows come one after
the other; the distinct pre-tokens of a bucket are counted once each, and the
counts are joined to the rows' frequencies; products are added up by document
and return to the block. No ids are made of whole texts.

Buckets grow with the input, so the counts that a task holds, those of one
bucket, do not. A bucket of a pre-token that very many documents hold may be
split over tasks (``rebalance``): each counts the pre-token once.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, text_or_empty, texts, worker_cache
from .tokens import default_path

#: Sentencepiece's mark of a space.
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}{SPACE}|\n")
_CUT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")

#: Buckets that pre-tokens are dealt into for every so many bytes of texts.
BUCKETS, BUCKETS_FOR = 4096, 1 << 40


def pre_tokens(text: str) -> list[str]:
    """Stretches that no piece crosses: each run of spaces with the word after it, and each line's first word.

    The library puts a space before the text; a space is written as its mark,
    and pieces hold that mark only at their start and the line feed never
    (``model_of`` makes sure of both).
    """
    if not text:
        return []
    whole = SPACE + text.replace(" ", SPACE)
    if _RUNS.search(whole):
        return _CUT.findall(whole)
    return [SPACE + x for x in whole[1:].split(SPACE)]


def model_of(path: str):
    """The library's model, checked for what ``pre_tokens`` relies on; one per worker."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if SPACE in piece.lstrip(SPACE) or (len(piece) > 1 and "\n" in piece):
                raise ValueError(f"{path}: piece {piece!r} crosses a pre-token's bounds")
        if model.encode("  a ", out_type=str)[-1] != SPACE or model.encode("a") != model.encode("a", add_bos=False):
            raise ValueError(f"{path}: spaces are not kept as they are")
        return model

    return worker_cache(f"pieces:{path}", load)


def pieces_of(model, stretches: list[str]) -> list[int]:
    """Pieces of each pre-token where it stands."""
    asked = [x[1:].replace(SPACE, " ") if x[0] == SPACE else x for x in stretches]
    counts = [len(ids) for ids in model.encode(asked, num_threads=1)]
    # A lone space has a piece of its own unless it is all there is; a line's start is asked with a space too many.
    return [1 if x == SPACE else n if x[0] == SPACE else n - 1 for x, n in zip(stretches, counts, strict=True)]


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text as the library counts them, without begin or end tokens.

    Returns ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``. Null
    and empty texts have none. Every row gives one row, repeated rows and null
    doc_ids included; an empty table gives an empty result; other columns are
    ignored.
    """
    path = model_path or default_path("piece_bpe_32k.model")
    whole = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = BUCKETS * (1 + whole // BUCKETS_FOR)
    packed = "bucket int, block bigint, head boolean, words binary, ends binary, counts binary, held binary"
    partial_schema = "block bigint, head boolean, docs binary, sums binary, ids binary"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def rows(*columns: list) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4)
            names = [c.split()[0] for c in packed.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            block = (part << 32) | number
            number += 1
            codes_of: dict[str, int] = defaultdict()
            codes_of.default_factory = codes_of.__len__
            codes, ends, sizes = [], [], []
            for text in texts(batch.column(1)):
                words = pre_tokens(text)
                codes.append(np.fromiter(map(codes_of.__getitem__, words), np.int64, len(words)))
                ends.append(len(words))
                sizes.append(len(text.encode()))
            n = batch.num_rows
            # The block's documents ride along in a row of their own.
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            yield rows([block % buckets], [block], [True], [values.tobytes()], [known.astype(np.uint8).tobytes()], [np.array(sizes, "<i8").tobytes()], [b""])
            words = [w.encode() for w in codes_of]
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            key = place[np.concatenate(codes)] * n + np.repeat(np.arange(n), ends)
            del codes, codes_of
            key, times = np.unique(key, return_counts=True)
            while (times > 255).any():  # eight bits a frequency; more are further entries
                more = times > 255
                key = np.concatenate([key, key[more]])
                times = np.concatenate([np.where(more, 255, times), times[more] - 255])
                again = np.argsort(key, kind="stable")
                key, times = key[again], times[again]
            code, doc = np.divmod(key, n)
            held = ((doc << 8) | times).astype("<i4").tobytes()
            counts = np.bincount(code, minlength=len(words)).astype("<i4")
            words = [words[k] for k in order.tolist()]
            lengths = np.fromiter(map(len, words), "<i4", len(words))
            filled, first = np.unique(bucket[order], return_index=True)
            last = np.append(first, len(words))[1:]
            upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            cut = list(zip(filled.tolist(), first.tolist(), last.tolist(), strict=True))
            for k in range(0, len(cut), 512):
                some = cut[k : k + 512]
                yield rows(
                    [b for b, _, _ in some],
                    [block] * len(some),
                    [False] * len(some),
                    [b"".join(words[i:j]) for _, i, j in some],
                    [lengths[i:j].tobytes() for _, i, j in some],
                    [counts[i:j].tobytes() for _, i, j in some],
                    [held[4 * upto[i] : 4 * upto[j]] for _, i, j in some],
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        bucket: int | None = None
        known: dict[bytes, int] = {}  # distinct pre-tokens of the last bucket, which may go on, each with its pieces

        def pieces(some: list[tuple[int, list[bytes]]]) -> np.ndarray:
            """Pieces of all words of ``some``, which come in the order of their buckets: the library is asked for each distinct one."""
            nonlocal bucket, known
            new = [x for x in dict.fromkeys(x for _, words in some for x in words) if x not in known]
            found = known | dict(zip(new, pieces_of(model, [x.decode() for x in new]), strict=True))
            last = some[-1][0]
            kept = known if last == bucket else {}
            kept.update((x, found[x]) for b, words in some if b == last for x in words)
            bucket, known = last, kept
            return np.fromiter([found[x] for _, words in some for x in words], np.int64)

        def rows(*columns: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            names = [c.split()[0] for c in partial_schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        # Sums of a block are gathered over a batch's buckets before they leave.
        for batch in batches:
            keys, counts, times, some = [], [], [], []
            blocks: dict[int, int] = {}
            for row in batch.to_pylist():
                if row["head"]:
                    yield rows([row["block"]], [True], [row["ends"]], [row["counts"]], [row["words"]])
                    continue
                ends = np.cumsum(np.frombuffer(row["ends"], "<i4"))
                text = row["words"]
                some.append((row["bucket"], [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]))
                held = np.frombuffer(row["held"], "<i4").astype(np.int64)
                keys.append((blocks.setdefault(row["block"], len(blocks)) << 32) | (held >> 8))
                counts.append(np.frombuffer(row["counts"], "<i4"))
                times.append(held & 255)
            if not keys:
                continue
            sums = np.repeat(pieces(some), np.concatenate(counts)) * np.concatenate(times)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, sums).astype("<i8")
            doc = (key & 0xFFFFFFFF).astype("<i4")
            at = np.searchsorted(key >> 32, np.arange(len(blocks) + 1)).tolist()
            cut = list(zip(at, at[1:], strict=False))
            yield rows(list(blocks), [False] * len(cut), [doc[a:b].tobytes() for a, b in cut], [total[a:b].tobytes() for a, b in cut], [b""] * len(cut))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the block's documents first."""
        ids, sizes, total = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["head"]:
                    if ids is not None:
                        yield done()
                    ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["docs"], np.uint8) == 0)
                    sizes = pa.array(np.frombuffer(row["sums"], "<i8"))
                    total = np.zeros(len(ids), np.int64)
                else:
                    total[np.frombuffer(row["docs"], "<i4")] += np.frombuffer(row["sums"], "<i8")
        if ids is not None:
            yield done()

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    lists = source.mapInArrow(frequencies, packed)
    partial = lists.hint("rebalance", "bucket").sortWithinPartitions("bucket").mapInArrow(counted, partial_schema)
    back = partial.repartition(partitions_for(spark), "block").sortWithinPartitions("block", F.desc("head"))
    return back.mapInArrow(summed, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
