"""Batch retrieval: alias filters, exact top-k cosine search, threshold, lexical re-ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.config import SETTINGS, VOCABULARY, Settings, Vocabulary
from docloom.functions import text as tx

from .embed import Embedder, embed

#: Bytes of queries that are sent to every task at once.
BROADCAST_BYTES = 32 << 20


def resolve_alias(column: Column, aliases: dict[str, str]) -> Column:
    """Target of the longest alias that a text names, bounded by anything but letters; null if none."""
    low = F.lower(tx.text_of(column))
    ordered = sorted(aliases, key=lambda a: -len(a))
    return F.coalesce(*(F.when(low.rlike(f"(?<![a-z]){re.escape(a)}(?![a-z])"), F.lit(aliases[a])) for a in ordered))


def resolve(questions: DataFrame, column: str = "question", vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """``questions`` with ``want_scheme`` and ``want_plan``."""
    return questions.withColumns(
        {"want_scheme": resolve_alias(F.col(column), vocabulary.scheme_aliases), "want_plan": resolve_alias(F.col(column), vocabulary.plan_aliases)}
    )


@dataclass(frozen=True)
class Match:
    """A pair is admitted if the query states nothing, or the vector's value is what it states or is for all; or, turned, if it is not."""

    query_col: str
    vector_col: str
    for_all: tuple = ()
    differs: bool = False

    def column(self) -> Column:
        want, own = F.col(self.query_col), F.col(self.vector_col)
        if self.differs:
            return want != own
        return want.isNull() | own.isin(*self.for_all) | (own == want) if self.for_all else want.isNull() | (own == want)

    def mask(self, want: Sequence, own: Sequence) -> np.ndarray:
        """Admitted pairs, a row for each query."""
        names: dict = {}
        codes = lambda values: np.array([-1 if v is None else names.setdefault(v, len(names)) for v in values], np.int64)
        w, o = codes(want)[:, None], codes(own)[None, :]
        if self.differs:
            return (w != o) & (w >= 0) & (o >= 0)
        everywhere = np.array([v is not None and v in self.for_all for v in own])[None, :]
        return (w < 0) | everywhere | ((w == o) & (o >= 0))


#: Metadata filter: the scheme named, and the plan named or documents of no plan; nothing named, no filter.
ADMITS = (Match("want_scheme", "scheme"), Match("want_plan", "plan", ("n_a",)))


def admits(matches: Sequence[Match] = ADMITS) -> Column:
    """The filter as a condition on a pair's columns."""
    return reduce(lambda a, b: a & b, (m.column() for m in matches))


def _unit(rows: list, dim: int) -> np.ndarray:
    """Rows scaled to length 1; a zero or missing vector stays zero."""
    dense = np.array([r if r is not None and len(r) == dim else [0.0] * dim for r in rows], np.float64).reshape(len(rows), dim)
    length = np.linalg.norm(dense, axis=1, keepdims=True)
    return np.divide(dense, length, out=np.zeros_like(dense), where=length > 0)


class _Best:
    """The ``k`` best vectors of each query so far, best first; equal scores go by the vector's id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, None
        self.found: list[list[tuple[float, object, int]]] = [[] for _ in range(queries)]

    def add(self, batch: pa.RecordBatch, ids: list, scores: np.ndarray, mask: np.ndarray | None) -> None:
        base = self.rows.num_rows if self.rows is not None else 0
        taken: dict[int, int] = {}
        for q, own in enumerate(self.found):
            value = scores[q] if mask is None else np.where(mask[q], scores[q], -np.inf)
            floor = own[-1][0] if len(own) == self.k else -np.inf
            at = np.nonzero((value >= floor) & (value > -np.inf))[0]
            if len(at) > self.k:
                # Everything as good as the k-th: ties are settled by ids below.
                at = at[value[at] >= np.partition(value[at], len(at) - self.k)[len(at) - self.k]]
            new = [(float(value[i]), ids[i], base + taken.setdefault(int(i), len(taken))) for i in at.tolist()]
            self.found[q] = sorted(own + new, key=lambda x: (-x[0], x[1]))[: self.k]
        if taken:
            some = pa.Table.from_batches([batch]).take(list(taken))
            self.rows = some if self.rows is None else pa.concat_tables([self.rows, some])
            kept = sorted({place for own in self.found for _, _, place in own})
            moved = {place: n for n, place in enumerate(kept)}
            self.rows = self.rows.take(kept).combine_chunks()
            self.found = [[(x, i, moved[place]) for x, i, place in own] for own in self.found]


def _scan(vectors: DataFrame, asked: pa.Table, k: int, query_vector: str, vector_id: str, vector: str, matches: Sequence[Match]) -> DataFrame:
    """The best ``k`` of each partition of ``vectors`` for the queries ``asked``, which go to every task."""
    spark = vectors.sparkSession
    given = asked.column(query_vector).to_pylist()
    dim = max((len(v) for v in given if v is not None), default=0)
    told = asked.drop_columns([query_vector])
    shared = spark.sparkContext.broadcast((_unit(given, dim), told))
    kept = [c for c in vectors.columns if c != vector]
    schema = T.StructType([f for f in from_arrow_schema(told.schema)] + [f for f in vectors.schema.fields if f.name != vector]).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, queries = shared.value
        best = _Best(len(wanted), k)
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                # Rounded, so that equal vectors have equal scores wherever they stand in a block.
                scores = np.round(wanted @ _unit(batch.column(vector).to_pylist(), dim).T, 12)
                masks = [m.mask(queries.column(m.query_col).to_pylist(), batch.column(m.vector_col).to_pylist()) for m in matches]
                best.add(batch.select(kept), batch.column(vector_id).to_pylist(), scores, reduce(np.logical_and, masks) if masks else None)
        if best.rows is not None:
            pairs = [(q, place, score) for q, own in enumerate(best.found) for score, _, place in own]
            who, rows = queries.take([q for q, _, _ in pairs]), best.rows.take([p for _, p, _ in pairs])
            table = pa.table([*who.columns, *rows.columns, pa.array([s for *_, s in pairs], pa.float64())], [*who.column_names, *kept, "score"])
            yield from table.combine_chunks().to_batches()

    return vectors.mapInArrow(run, schema)


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    vector_id: str = "vec_id",
    vector: str = "embedding",
    matches: Sequence[Match] = (),
) -> DataFrame:
    """The ``k`` nearest vectors of each query by cosine, exactly: the queries' and vectors' other columns, ``score`` and ``rank``.

    Queries are a stated set that meets all vectors in blocks: a block of
    vectors times the queries is one product of matrices where the vectors lie,
    and only the best ``k`` per query leave a task. ``matches`` limit the pairs
    before the best are taken. Queries beyond ``BROADCAST_BYTES`` are dealt by a
    hash into sets under that size; each makes a pass over the vectors, so no
    more of them are in memory at once. A zero vector is like nothing.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = queries.drop(*(c for c in queries.columns if c in vectors.columns))
    dim = asked.agg(F.count("*"), F.max(F.size(query_vector))).first()
    passes = 1 + dim[0] * (8 * max(dim[1] or 0, 1) + 256) // BROADCAST_BYTES
    found = None
    for number in range(passes):
        own = asked if passes == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == number)
        part = _scan(vectors, own.toArrow(), k, query_vector, vector_id, vector, matches)
        part = part if passes == 1 else part.checkpoint()
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(vector_id)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Cells of one block of documents times queries.
BLOCK_CELLS = 1 << 22


def _shared_words(words: pa.Array, terms: pa.Array, starts: np.ndarray, owners: np.ndarray, queries: int) -> np.ndarray:
    """Terms that each query (a row) shares with each document (a column) of a block.

    ``owners[starts[t]:starts[t + 1]]`` are the queries that hold term ``t``.
    """
    code = pc.index_in(words.flatten(), value_set=terms)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    term = code.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)[known].astype(np.int64)
    counts = np.zeros(queries * len(words), np.int32)
    each = starts[term + 1] - starts[term]
    upto = np.cumsum(each)
    first = 0
    while first < len(term):  # a term of many queries is met in parts of bounded memory
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BLOCK_CELLS)))
        n = each[first:last]
        place = np.repeat(starts[term[first:last]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cells = owners[place] * len(words) + np.repeat(row[first:last], n)
        counts += np.bincount(cells, minlength=len(counts)).astype(np.int32)
        first = last
    return counts.reshape(queries, len(words))


def _scan_words(docs: DataFrame, asked: pa.Table, k: int, query_id: str, doc_id: str, body: str) -> DataFrame:
    """The ``k`` documents of each partition that share most words with each query of ``asked``, which go to every task."""
    lists = asked.column("_terms").combine_chunks()
    terms = pc.unique(lists.flatten())
    held = pc.index_in(lists.flatten(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(held, kind="stable")
    owners = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[order].astype(np.int64)
    starts = np.searchsorted(held[order], np.arange(len(terms) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((terms, starts, owners, asked.column(query_id).combine_chunks()))
    fields = [*from_arrow_schema(asked.select([query_id]).schema).fields, docs.schema[doc_id], T.StructField("n_shared", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, starts, owners, names = shared.value
        best = _Best(len(names), k)
        rows = max(1, BLOCK_CELLS // max(1, len(names)))
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                block = whole.slice(first, rows)
                counts = _shared_words(block.column(1), terms, starts, owners, len(names))
                best.add(block.select([doc_id]), block.column(0).to_pylist(), counts.astype(np.float64), counts > 0)
        if best.rows is not None:
            pairs = [(q, place, int(score)) for q, own in enumerate(best.found) for score, _, place in own]
            found = best.rows.take([p for _, p, _ in pairs]).column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array([q for q, _, _ in pairs])), found, pa.array([n for *_, n in pairs], pa.int64())], [query_id, doc_id, "n_shared"])

    return docs.select(doc_id, tx.words_of(F.col(body)).alias("_words")).mapInArrow(run, T.StructType(fields))


def lexical_top_k(questions: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", question: str = "question", doc_id: str = "doc_id", body: str = "body") -> DataFrame:
    """``query_id, doc_id, n_shared, n_terms, score, rank``: the ``k`` documents that hold most of a question's content words.

    Questions are a stated set that meets all documents where they lie, through
    a table from word to questions; only the best ``k`` per question leave a
    task, so no word's documents are gathered. Questions beyond
    ``BROADCAST_BYTES`` make passes as in ``top_k``. Equal counts go by doc_id;
    documents that share no word, and questions without words, give no row.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = questions.select(query_id, tx.question_terms(F.col(question)).alias("_terms")).where(F.size("_terms") > 0)
    size = asked.agg(F.sum(F.length(F.array_join("_terms", " ")) + 24 * F.size("_terms") + 64)).first()[0] or 0
    passes, found = 1 + size // BROADCAST_BYTES, None
    for number in range(passes):
        own = asked if passes == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == number)
        part = _scan_words(docs, own.toArrow(), k, query_id, doc_id, body)
        part = part if passes == 1 else part.checkpoint()
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("n_shared"), F.asc(doc_id)))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select(query_id, F.size("_terms").alias("n_terms")), query_id).select(
        query_id, doc_id, "n_shared", "n_terms", (F.col("n_shared").cast("double") / F.col("n_terms")).alias("score"), "rank"
    )


def above(hits: DataFrame, floor: float) -> DataFrame:
    """Hits at or above the floor; scores are rounded only afterwards."""
    return hits.where(F.col("score") >= floor).withColumn("score", F.round("score", 4))


def lexical_scores(hits: DataFrame, question: str, body: str, query_id: str, hit_id: str) -> DataFrame:
    """``query_id, hit_id, lexical``: share of a question's weight that a hit's words hold.

    Words weigh by their rarity among the question's own hits.
    """
    base = hits.select(query_id, hit_id, tx.question_terms(F.col(question)).alias("_terms"), tx.words_of(F.col(body)).alias("_words"))
    each = base.select(query_id, hit_id, F.explode("_terms").alias("_term"), "_words")
    has = each.withColumn("_has", F.array_contains("_words", F.col("_term")).cast("int"))
    by_term = Window.partitionBy(query_id, "_term")
    weighed = has.withColumn("_idf", F.log(1 + F.count("*").over(by_term) / (1 + F.sum("_has").over(by_term))))
    sums = weighed.groupBy(query_id, hit_id).agg((F.sum(F.col("_has") * F.col("_idf")) / F.sum("_idf")).alias("lexical"))
    return base.select(query_id, hit_id).join(sums, [query_id, hit_id], "left").select(query_id, hit_id, F.coalesce("lexical", F.lit(0.0)).alias("lexical"))


def rerank(hits: DataFrame, question: str, body: str, query_id: str, hit_id: str, weight: float = SETTINGS.lexical_rerank_weight) -> DataFrame:
    """``hits`` (with ``score`` and ``rank``) with ``lexical``, ``blended`` and the new ``rank``; ties keep their order."""
    lex = lexical_scores(hits, question, body, query_id, hit_id)
    blended = hits.join(lex, [query_id, hit_id]).withColumn("blended", F.col("score") + weight * F.col("lexical"))
    # Sums in another order differ in their last bits: what agrees to nine digits is a tie.
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("blended", 9)), F.desc(F.round("score", 9)), F.asc("_before"))
    return blended.withColumnRenamed("rank", "_before").withColumn("rank", F.row_number().over(order)).drop("_before")


def _once(df: DataFrame) -> DataFrame:
    """``df`` computed here, once, and kept in the checkpoint folder; on this machine alone in the session if there is none.

    On a cluster without that folder it stays as it is, computed wherever it is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return df.checkpoint()
    return df.localCheckpoint() if context.master.startswith("local[") or context.master == "local" else df


def retrieve(questions: DataFrame, index: DataFrame, embedder: Embedder, settings: Settings = SETTINGS, vocabulary: Vocabulary = VOCABULARY, threshold: float | None = None) -> DataFrame:
    """Hits for ``questions`` (``query_id, question``) from an index's vectors, best first by ``rank``.

    They are used several times, here and in answers; the vectors are read, or made, once.
    """
    asked = embed(resolve(questions.select("query_id", "question"), vocabulary=vocabulary), "question", embedder, out="query_vector")
    found = _once(top_k(asked, index, settings.top_k, vector_id="chunk_id", matches=ADMITS))
    kept = above(found, settings.similarity_threshold if threshold is None else threshold)
    return rerank(kept, "question", "document", "query_id", "chunk_id", settings.lexical_rerank_weight)
