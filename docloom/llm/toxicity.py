"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the words of
a text and their beginnings; each model also reads the probabilities that the
chain gave the categories before it. While it is trained those probabilities
are out-of-fold: of a model that has not seen the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_or_empty, texts

#: Labelled documents, give or take chance, that the models are fitted to: the bound of the sample.
SAMPLE = 10_000
#: Features a category adds at most, the least documents one is met in, and the least chi-square.
FEATURES, LEAST_DOCS, LEAST_CHI2 = 400, 5, 20.0
FOLDS, RIDGE, STEPS = 5, 0.05, 200
#: Characters of a word's beginnings.
BEGINNINGS = (4, 5)

_WORD = re.compile(r"[^\W\d_]+")


def probability(logit):
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def features(text: str) -> set[str]:
    """Words of a whole text, and with a caret the beginnings of the longer ones."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in BEGINNINGS:
        found.update(["^" + w[:n] for w in words if len(w) >= n])
    return found


@dataclass
class Linear:
    """Logistic model: ``weights`` by feature place, ``before`` by earlier category; from ``cut`` on a text has the category."""

    bias: float
    weights: np.ndarray
    before: np.ndarray
    cut: float = 0.5


@dataclass
class Chain:
    """Models by category, in the chain's order, over one list of features."""

    categories: list[str]
    places: dict[str, int]
    models: list[Linear]

    def met(self, text: str) -> list[int]:
        """Places of the chain's features that a whole text has."""
        words = set(_WORD.findall(text.lower()))
        found = words & self.names[0]
        for n, known in zip(BEGINNINGS, self.names[1:], strict=True):
            found.update(["^" + x for x in {w[:n] for w in words} & known])
        return [self.places[x] for x in found]

    @property
    def names(self) -> list[frozenset[str]]:
        """Features by kind: whole words, then beginnings of each length."""
        if "_names" not in self.__dict__:
            starts = [x[1:] for x in self.places if x[0] == "^"]
            words = frozenset(x for x in self.places if x[0] != "^")
            self.__dict__["_names"] = [words, *(frozenset(x for x in starts if len(x) == n) for n in BEGINNINGS)]
        return self.__dict__["_names"]

    def predict(self, text: str) -> list[float]:
        at = self.met(text)
        found: list[float] = []
        for model in self.models:
            found.append(float(probability(model.bias + model.weights[at].sum() + model.before @ np.array(found, float))))
        return found


@dataclass
class Rows:
    """Training rows: places of the features each has, as one list with the row of each, and dense columns."""

    row: np.ndarray
    at: np.ndarray
    dense: np.ndarray
    width: int

    def where(self, kept: np.ndarray) -> "Rows":
        own = kept[self.row]
        return Rows((np.cumsum(kept) - 1)[self.row[own]], self.at[own], self.dense[kept], self.width)

    def times(self, w: np.ndarray) -> np.ndarray:
        k = self.dense.shape[1]
        return np.bincount(self.row, w[k:][self.at], len(self.dense)) + self.dense @ w[:k]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([self.dense.T @ r, np.bincount(self.at, r[self.row], self.width)])


def fit_linear(rows: Rows, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Logistic regression with a ridge on all but the first column, by accelerated gradients."""
    d = rows.dense.shape[1] + rows.width
    # A bound of the curvature from a few power iterations.
    v = np.ones(d) / np.sqrt(d)
    for _ in range(8):
        v = rows.back(rows.times(v))
        v /= np.linalg.norm(v) or 1.0
    reach = 0.25 * float(np.linalg.norm(rows.times(v)) ** 2) * 1.1 + ridge
    penalty = np.full(d, ridge)
    penalty[0] = 1e-3
    w, ahead, t = np.zeros(d), np.zeros(d), 1.0
    for _ in range(steps):
        p = probability(rows.times(ahead))
        new = ahead - (rows.back(p - y) + penalty * ahead) / reach
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (last - 1) / t * (new - w)
        w = new
    return w


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Probability that parts the categories with the best F1, half way to the next below it; a half if one is empty."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    ends = np.append(p[1:] != p[:-1], True)  # equal probabilities stay together
    f1 = np.where(ends, 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def fit_chain(found: Sequence[Sequence[int]], labels: np.ndarray, categories: Sequence[str], places: dict[str, int], folds: np.ndarray) -> Chain:
    """Chain over rows of the features ``found``; ``labels`` are 0, 1 or nan for unknown."""
    n = len(found)
    row = np.repeat(np.arange(n), [len(x) for x in found])
    at = np.concatenate([np.asarray(x, np.int64) for x in found]) if n else np.zeros(0, np.int64)
    models: list[Linear] = []
    earlier = np.zeros((n, 0))
    for k in range(len(categories)):
        data = Rows(row, at, np.concatenate([np.ones((n, 1)), earlier], axis=1), len(places))
        known = ~np.isnan(labels[:, k])
        y = np.nan_to_num(labels[:, k])
        unseen = np.full(n, 0.5)
        for fold in range(FOLDS):
            train, rest = known & (folds != fold), folds == fold
            if rest.any() and train.any():
                unseen[rest] = probability(data.where(rest).times(fit_linear(data.where(train), y[train])))
        w = fit_linear(data.where(known), y[known]) if known.any() else np.zeros(1 + k + len(places))
        cut = best_cut(unseen[known], y[known])
        models.append(Linear(float(w[0]), w[1 + k :], w[1 : 1 + k], cut))
        earlier = np.concatenate([earlier, unseen[:, None]], axis=1)
    return Chain(list(categories), places, models)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit a chain over ``categories``, 0/1 columns of ``labels`` (``doc_id`` and one row per document).

    About ``sample`` labelled documents are used, chosen by a hash of their ids.
    Features are those of the sample that depend most on a category by
    chi-square. Without labelled documents every probability is a half.
    """
    names = list(categories)
    usable = labels.where(F.col(id_col).isNotNull())
    n = usable.count()
    chance = F.shiftrightunsigned(F.xxhash64(id_col), 11) / F.lit(float(1 << 53))
    chosen = usable.where(chance < min(1.0, sample / max(1, n))).select(
        F.col(id_col).alias("of"), *(F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(names))
    )
    # A sample of so few rows is small enough for every task; a larger one is joined as the planner sees fit.
    rows = docs.join(F.broadcast(chosen) if sample <= 100_000 else chosen, F.col(id_col) == F.col("of")).select(
        F.col("of").alias("doc_id"), text_or_empty(text_col).alias("text"), *(f"y{k}" for k in range(len(names)))
    )
    rows = stored(rows, "labelled")
    width = len(names)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(width + 1)]
        for batch in batches:
            ys = [batch.column(f"y{k}").to_pylist() for k in range(width)]
            for i, text in enumerate(texts(batch.column("text"))):
                found = features(text)
                seen[width].update(found)
                for k in range(width):
                    if ys[k][i]:
                        seen[k].update(found)
        words = list(seen[width])
        columns = [pa.array([c[w] for w in words], pa.int64()) for c in seen]
        for k in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[k : k + 50_000], pa.string()), *(c.slice(k, 50_000) for c in columns)],
                ["feature", *(f"n{j}" for j in range(width)), "n"],
            )

    schema = "feature string, " + ", ".join(f"n{k} bigint" for k in range(width)) + ", n bigint"
    counts = rows.mapInArrow(tally, schema).groupBy("feature").agg(*(F.sum(c).alias(c) for c in [*(f"n{k}" for k in range(width)), "n"]))
    counts = stored(counts.where(F.col("n") >= LEAST_DOCS), "tally")
    total = rows.agg(F.count("*"), *(F.sum(F.coalesce(F.col(f"y{k}"), F.lit(0.0))) for k in range(width))).first()
    chosen_features: set[str] = set()
    for k in range(width):
        whole, positive = float(total[0]), float(total[k + 1] or 0)
        if not 0 < positive < whole:
            continue
        a, n_all = F.col(f"n{k}").cast("double"), F.col("n").cast("double")
        gap = a * whole - n_all * positive
        chi2 = gap * gap * whole / (n_all * (whole - n_all + 1e-9) * positive * (whole - positive))
        best = counts.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "feature").limit(FEATURES)
        chosen_features |= {r[0] for r in best.select("feature").collect()}
    places = {w: k for k, w in enumerate(sorted(chosen_features))}

    blank = Chain(names, places, [])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blank.met(t) for t in texts(batch.column("text"))]
            kept = [batch.column("doc_id"), *(batch.column(f"y{k}") for k in range(width))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int32()))], ["doc_id", *(f"y{k}" for k in range(width)), "at"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("at", T.ArrayType(T.IntegerType()))
    found = rows.mapInArrow(placed, schema).toArrow()
    ids = np.array(found.column("doc_id").to_pylist(), np.int64)
    order = np.argsort(ids, kind="stable")
    ats = found.column("at").to_pylist()
    y = np.array([found.column(f"y{k}").to_pylist() for k in range(width)], float).T.reshape(len(ids), width)[order]
    folds = (ids[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    return fit_chain([sorted(ats[i]) for i in order.tolist()], y, names, places, folds)


def classify(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` for every category of the chain.

    Null texts count as empty; equal texts get equal probabilities; an empty
    table gives an empty result; columns that have these names are replaced,
    others pass unchanged.
    """
    added = [f"p_{c}" for c in chain.categories]
    kept = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chain.predict(x) for x in texts(batch.column("__text"))]
            columns = [pa.array([p[k] for p in found], pa.float64()) for k in range(len(added))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *added])

    schema = T.StructType(docs.select(*kept).schema.fields[:])
    for name in added:
        schema.add(name, T.DoubleType())
    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float | None = None, **fit_options) -> DataFrame:
    """``doc_id``, ``p_low_quality``, ``p_toxic`` and ``toxic`` (at or above ``threshold``) of every document.

    The chain's categories are low quality, then toxic; without a threshold of
    its own, toxic is cut where out-of-fold predictions part best. Rows of ``labels``
    without a doc_id, and labels that are null, teach nothing.
    """
    marked = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = fit(docs, marked, ("low_quality", "toxic"), **fit_options)
    scored = classify(docs.select("doc_id", "text"), chain)
    cut = chain.models[-1].cut if threshold is None else threshold
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= cut).alias("toxic"))
