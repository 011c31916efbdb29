"""Embedding behind a small protocol, with a deterministic hashing encoder as the default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Encodes texts to unit vectors; the fingerprint names the encoder and all that changes its output."""

    fingerprint: str

    def encode(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed feature hashing of lower-case words and word pairs, L2-normalised."""

    def __init__(self, dim: int = 384):
        self.dim = dim
        self.fingerprint = f"hashing@1:{dim}:True"

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t or "") for t in texts]

    def _one(self, text: str) -> list[float]:
        words = re.findall(r"[^\W_]+", text.lower())
        vector = [0.0] * self.dim
        for feature in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            vector[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in vector) ** 0.5
        return [x / norm for x in vector] if norm else vector


def embedding_text(text: Column, section_path: Column) -> Column:
    """Breadcrumb, a line for each part, in front of the text unless it is there already."""
    crumb = F.array_join(F.split(section_path, " > "), "\n")
    bare = F.coalesce(section_path, F.lit("")) == ""
    return F.when(bare | text.startswith(crumb), text).otherwise(F.concat_ws("\n", crumb, text))


def embed(df: DataFrame, text_col: str, embedder: Embedder, batch: int = 32, out: str = "embedding") -> DataFrame:
    """``df`` with an ``array<float>`` column of embeddings; the encoder travels once to each worker."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float32())
        for part in parts:
            vectors = [pa.array(embedder.encode(part.slice(k, batch).to_pylist()), kind) for k in range(0, len(part), batch)]
            yield pa.concat_arrays(vectors) if vectors else pa.array([], kind)

    return df.withColumn(out, run(F.col(text_col)))


def fingerprint_column(embedder: Embedder) -> Column:
    return F.lit(embedder.fingerprint)
