"""Language identification by the nearest of several centroids per language.

A text is a vector of byte n-gram counts in a hashed space, weighted by inverse
document frequency and normalised. Each language has a few centroids, clustered
from a bounded sample of labelled texts; a text takes the language of the most
similar centroid. Texts further from every centroid than nearly all texts the
centroids were made of are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, forget, give_back, rows_in_arrow, texts

DIMS = 1 << 13
ORDERS = (1, 2, 3)
#: Labelled texts per language, give or take chance, that centroids are clustered from: the bound of the sample.
SAMPLE_PER_LANG = 1500
#: Centroids per language and rounds of clustering.
CENTROIDS, ROUNDS = 4, 8
#: Rejection: similarity under this share of the sample's median similarity in the text's size class.
REJECT_SHARE = 0.25

_OTHER = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    """Lower-cased letters with one space for all between, and one at either end; empty if there is no letter."""
    kept = _OTHER.sub(" ", text.lower()).strip()
    return f" {kept} ".encode() if kept else b""


def grams(data: bytes, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and counts of the n-grams of one text; long texts in blocks of bounded memory."""
    total = np.zeros(dims, np.int64)
    for k in range(0, len(data), 1 << 20):
        part = np.frombuffer(data[k : k + (1 << 20) + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        last = k + (1 << 20) >= len(data)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            code = code[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(1)
            if n in ORDERS:
                own = code if last else code[: 1 << 20]
                mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                total += np.bincount((mixed >> np.uint32(17)) % np.uint32(dims), minlength=dims)
    at = np.nonzero(total)[0]
    return at, total[at]


@dataclass
class Centroids:
    """A fitted model: ``matrix`` has a row per centroid, ``of`` the place of its language in ``langs``."""

    langs: list[str]
    idf: np.ndarray
    matrix: np.ndarray
    of: np.ndarray
    floors: list[float]

    def vector(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, count = grams(data, len(self.idf))
        weight = (1 + np.log(count)) * self.idf[at]
        norm = np.sqrt((weight * weight).sum())
        return at, weight / norm if norm else weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, similarity in 0..1, and whether the text is rejected."""
        data = letters_only(text or "")
        if not data or not self.langs:
            return "und", 0.0, not data
        at, weight = self.vector(data)
        like = self.by_dim[at].T @ weight if len(at) else np.zeros(len(self.of))
        best = int(like.argmax())
        score = float(min(1.0, max(0.0, like[best])))
        return self.langs[self.of[best]], score, score < self.floors[size_class(data)]

    @property
    def by_dim(self) -> np.ndarray:
        if "_by_dim" not in self.__dict__:
            self.__dict__["_by_dim"] = np.ascontiguousarray(self.matrix.T)
        return self.__dict__["_by_dim"]


def size_class(data: bytes) -> int:
    """Short texts are less like anything: similarity is judged among texts of about the same length."""
    return min(7, max(0, len(data).bit_length() - 4))


def _clusters(vectors: np.ndarray, count: int, rounds: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; empty clusters fall away."""
    means = vectors[np.linspace(0, len(vectors) - 1, min(count, len(vectors))).astype(int)]
    for _ in range(rounds):
        own = (vectors @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1)
        means = sums[norms > 0] / norms[norms > 0, None]
    return means


def fit(
    labelled: DataFrame,
    per_lang: int = SAMPLE_PER_LANG,
    centroids: int = CENTROIDS,
    dims: int = DIMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Centroids:
    """Fit to ``labelled`` (rows with null text or language, or without a letter, teach nothing).

    Document frequencies are taken over all of its rows; centroids over about
    ``per_lang`` texts of each language, chosen by their hashes and clustered a
    language a task.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                data = letters_only(text)
                if data:
                    seen[grams(data, dims)[0]] += 1
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate(([n], seen)))], ["dim", "n"])

    counts = rows_in_arrow(rows.select("text"), frequencies, "dim bigint, n bigint", SLICE).groupBy("dim").agg(F.sum("n").alias("n"))
    seen = np.zeros(dims + 1, np.int64)
    for dim, n in counts.collect():  # as many rows as dimensions
        seen[dim + 1] = n
    idf = np.log((1 + seen[0]) / (1 + seen[1:])) + 1.0

    # Rows whose hash falls under the wanted share of their language: no sort, and alike at every size.
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    share = F.lit(0.0)
    for lang, n in totals:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ats, weights, sizes = [], [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                data = letters_only(text)
                if data:
                    at, count = grams(data, dims)
                    langs.append(lang)
                    ats.append(at.astype(np.int32))
                    weights.append(count.astype(np.int32))
                    sizes.append(size_class(data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(ats, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.int32())), pa.array(sizes, pa.int32())],
                ["lang", "at", "n", "size"],
            )

    def clustered(group: pa.Table) -> pa.Table:
        """Centroids of one language's sample, a row each; the first row also has the sample's sizes and similarities."""
        forget()

        def packed(column: str) -> list[bytes]:
            """Lists as big-endian bytes, which sort as the lists do and take a tenth of the memory."""
            return [x.values.to_numpy().astype(">i4").tobytes() for chunk in group.column(column).chunks for x in chunk]

        own = sorted(zip(group.column("size").to_pylist(), packed("at"), packed("n"), strict=True))  # an order that does not depend on how rows arrive
        dense = np.zeros((len(own), dims), np.float32)
        for row, (_, ats, counts) in enumerate(own):
            at = np.frombuffer(ats, ">i4")
            dense[row, at] = (1 + np.log(np.frombuffer(counts, ">i4").astype(np.int64))) * idf[at]
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        means = _clusters(dense, centroids, ROUNDS)
        like = (dense @ means.T).max(axis=1).astype(np.float64).tolist()
        blank = [[]] * (len(means) - 1)
        del dense
        give_back()
        return pa.table(
            {
                "lang": pa.array([group.column("lang")[0].as_py()] * len(means), pa.string()),
                "centroid": pa.array([m.astype("<f4").tobytes() for m in means], pa.binary()),
                "sizes": pa.array([[x[0] for x in own], *blank], pa.list_(pa.int32())),
                "likes": pa.array([like, *blank], pa.list_(pa.float64())),
            }
        )

    sampled = rows_in_arrow(rows.where(chance < share).select("lang", "text"), vectors, "lang string, at array<int>, n array<int>, size int", SLICE)
    # A group is one language's sample, bounded by per_lang; the driver gets centroids and a number a sampled text.
    made = sampled.groupBy("lang").applyInArrow(clustered, "lang string, centroid binary, sizes array<int>, likes array<double>").collect()
    made = sorted(made, key=lambda r: (r.lang, not r.sizes))
    langs = sorted({r.lang for r in made})
    matrix = np.array([np.frombuffer(r.centroid, "<f4") for r in made], np.float64).reshape(len(made), dims)
    of = np.array([langs.index(r.lang) for r in made], int)
    size = np.array([x for r in made for x in r.sizes], int)
    like = np.array([x for r in made for x in r.likes], float)
    middle = [np.median(like[size == c]) if (size == c).any() else np.nan for c in range(8)]
    # A class without examples takes the floor of the next larger that has some, else of the smaller.
    known = [c for c in range(8) if not np.isnan(middle[c])]
    floors = [REJECT_SHARE * middle[min(known, key=lambda x: (x < c, abs(x - c)))] if known else 0.0 for c in range(8)]
    return Centroids(langs, idf, matrix, of, floors)


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    Texts that are null or have no letter are ``und``, with score 0, and
    rejected; a model without languages calls all texts ``und`` and rejects no
    other. Equal texts get equal results; ties go to the language that sorts
    first; an empty table gives an empty result; columns of ``docs`` with those
    three names are replaced, others pass unchanged.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    source = docs.select(*kept, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.bool_()),
                ],
                [*kept, "lang_pred", "score", "rejected"],
            )

    from pyspark.sql import types as T

    schema = T.StructType(docs.select(*kept).schema.fields[:])
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())):
        schema.add(name, kind)
    return rows_in_arrow(source, run, schema, SLICE)


def held_out(id_col: str = "doc_id") -> "F.Column":
    """True for the third of documents that nothing is learned from (a null id is learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, **fit_options) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected`` of every row, learned from the rows not held out."""
    model = fit(docs.where(~held_out()), **fit_options)
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(marked, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
