"""The pipeline against its stages done plainly."""

import collections
import random

import corpus_pipeline
import pytest
from docloom.llm import queries

from ..oracle import compare, duck
from .conftest import DOCS
from .test_operators import WORD, plain_components, plain_fingerprint


def test_stages(spark, documents, rows, sf_dir):
    columns = documents.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    docs = steps["language_id"](spark, documents, sf_dir)
    texts = {r.doc_id: r.text for r in rows}
    ids = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and len(ids) > 0.97 * len(rows)
    exact = steps["exact_dedup"](spark, docs, sf_dir)
    groups = collections.defaultdict(list)
    for i in ids:
        groups[texts[i].encode().lower()].append(i)
    kept = {max(g) for g in groups.values()}
    assert {r.doc_id for r in exact.collect()} == kept and exact.columns == columns
    near = steps["simhash_near_dedup"](spark, exact, sf_dir)
    links = plain_components({i: plain_fingerprint(texts[i]) for i in kept})
    left = set(links.values())
    assert sorted(r.doc_id for r in near.collect()) == sorted(left)
    mixed = steps["mixing"](spark, near, sf_dir)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(times) <= left and max(times.values()) <= 3
    words = lambda counts: sum(n * len(WORD.findall(texts[i])) for i, n in counts.items())
    assert abs(words(times) / words(dict.fromkeys(left, 1)) - 1) < 0.15
    packed = steps["best_fit_packing"](spark, mixed, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == times


def test_run(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


def test_odd_tables(spark, odd, none, sf_dir):
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_rows_count_without_and_with_repeated_ids(spark, sf_dir):
    """Each row is a document: nulls stay, repeats of a row go, and copies are not multiplied."""
    rng = random.Random(22)
    a, b, c, d, e, g = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(6))
    data = [(None, a), (None, a.upper()), (None, b), *[(7, c)] * 4, (8, d), (8, e), (9, d), (None, g), (5, g.replace(" ", "  "))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], DOCS).repartition(3)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir)
    found = lambda df: collections.Counter((r.doc_id, r.text.lower()) for r in df.collect())
    left = [(None, a), (None, b), (7, c), (8, e), (9, d), (5, g.replace(" ", "  "))]
    assert found(exact) == collections.Counter([*left, (None, g)])
    near = corpus_pipeline.drop_near_copies(spark, exact, sf_dir)
    assert found(near) == collections.Counter(left)
    # One source is taken as it is: every row once, repeated rows too.
    assert found(corpus_pipeline.mix_sources(spark, near, sf_dir)) == collections.Counter(left)
    assert found(corpus_pipeline.mix_sources(spark, docs, sf_dir)) == collections.Counter((i, t.lower()) for i, t in data)


def test_rows_taken_twice(spark, documents, sf_dir, tmp_path):
    """Sixty rows, each twice, in memory and in files: copies go, one row of each text stays, and no row has over three copies."""
    sixty = documents.orderBy("doc_id").limit(60).cache()
    twice = sixty.unionByName(sixty)
    twice.repartition(5).write.parquet(str(tmp_path / "twice"))
    different = {(r.text or "").encode().lower() for r in sixty.collect()}
    for docs in (twice, spark.read.parquet(str(tmp_path / "twice"))):
        exact = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir)
        assert exact.columns == documents.columns
        assert sorted((r.text or "").encode().lower() for r in exact.collect()) == sorted(different)
        mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect())
        assert mixed and max(mixed.values()) <= 6
        near = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()]
        assert len(near) == len(set(near)) <= len(different)


def test_keys_are_stable_and_all_different(spark, documents, tmp_path):
    documents.repartition(6).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    rows, key = corpus_pipeline._keyed(read)
    first = {(r.doc_id, r[key]) for r in rows.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        again = {(r.doc_id, r[key]) for r in rows.where("length(text) >= 0 or text is null").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == again and len({k for _, k in first}) == read.count() and rows.columns == [*read.columns, key]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    compare(spark, duck(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_registered():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in entry.queries()
