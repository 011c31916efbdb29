"""Python on executors works on a few rows at a time."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import arrow
from docloom.functions import text as tx
from docloom.operators import chunk, embed, extract_html, normalize


def test_few_objects_at_once(spark):
    """No function is given more rows than ``ROWS``, however many a batch has."""
    seen = arrow.map_rows(spark.range(1000, numPartitions=1), lambda rows: [(len(rows),)], "n int").collect()
    assert sum(r.n for r in seen) == 1000 and max(r.n for r in seen) <= arrow.ROWS


def test_each_over_slices():
    values = pa.array([str(k) if k % 7 else None for k in range(1000)])
    assert arrow.each(values.slice(5), lambda x: x and int(x), pa.int64()).to_pylist() == [k if k % 7 else None for k in range(5, 1000)]
    assert len(arrow.each(values.slice(0, 0), len, pa.int64())) == 0


def test_normal_forms(spark):
    words = ["plain", "é", "é", "１①", "ẛ̣", None, ""] * 60
    for form, make in (("NFC", tx.nfc), ("NFKC", tx.nfkc)):
        got = spark.createDataFrame([(w,) for w in words], "v string").coalesce(1).select(make(F.col("v")).alias("x")).collect()
        assert [r.x for r in got] == [w if w is None else unicodedata.normalize(form, w) for w in words]


def test_cells_and_headings_are_composed(spark):
    rows = [("a", k, "table", "", ["é", None], None, [["é", None], [], ["b"]] if k % 3 else None) for k in range(7)]
    found = normalize.unicode_rule(spark.createDataFrame(rows, normalize.BLOCK).coalesce(1)).where("pos > 1").orderBy("pos").collect()
    assert [r.table_rows for r in found] == [None if r.pos % 3 == 0 else [["é", ""], [], ["b"]] for r in found]
    assert {tuple(r.heading_path) for r in found} == {("é", "")}


def test_filter_splits_once(spark):
    cut = spark.createDataFrame([("a b",)], "v string").select(chunk.split_column(F.col("v"), 2, 0).alias("w")).where(F.size("w") > 1)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("run(") == 1
    assert cut.first().w == ["a ", "b"]


def test_many_long_pages(spark):
    html = F.concat(F.lit("<h1>Top</h1><p>"), F.repeat(F.lit("word "), 700), F.col("id"), F.lit("</p>"))
    found = extract_html.page_blocks(spark.range(300, numPartitions=1).select(F.col("id").alias("page_id"), html.alias("html")))
    assert found.groupBy("source_id").count().where("count = 2").count() == 300
    assert embed.embed(found.select("text"), "text", embed.HashingEmbedder(8)).where("size(embedding) = 8").count() == 600
