"""Work is dealt over tasks, and done once."""

from pyspark.sql import functions as F

from docloom.operators import embed, pdf, retrieve
from docloom.plans import catalog


def test_rows_of_one_file_go_to_all_tasks(spark, sf_dir):
    """Pages made of a short table of one file are not all read by one task."""
    pages = catalog.queries()["embedded_blocks"](spark, sf_dir)
    assert pages.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_spans_are_joined_once(spark):
    spans = spark.createDataFrame([("a", 1, b, 0, t, s) for b, (t, s) in enumerate([("Top", 20.0), ("prose", 10.0), ("1. Part", 10.0), ("more", 10.0)])], "source_id string, page_num int, block_no int, span_no int, text string, size double")
    rows = [["x", "y"], ["1"]]
    tables = spark.createDataFrame([("a", 1, 0, rows), ("a", 1, 1, rows), ("a", 2, 0, rows)], "source_id string, page_num int, table_no int, table_rows array<array<string>>")
    found = pdf.span_blocks(spans, tables)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    got = [(r.pos, r.kind, r.heading_path) for r in found.orderBy("pos").collect()]
    path = ["Top", "1. Part"]
    assert got == [(0, "heading", ["Top"]), (1, "text", ["Top"]), (2, "heading", path), (3, "text", path), (4, "table", path), (5, "table", path), (6, "table", [])]


def test_pages_are_not_sorted_by_source(spark, sf_dir):
    """Texts of a source, however many, pass by its furniture's keys, which are found once."""
    plan = catalog.queries()["lines_without_furniture"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    last = plan.split("Join", 1)
    assert last[0].rstrip().endswith("ShuffledHash") and "Inner" in last[1].split("\n")[0]
    assert plan.count("partial_collect_set(") == 1 and plan.count("Generate explode(") == 1


def test_vectors_are_read_once(spark):
    """Hits are kept: nothing that uses them comes back to the vectors."""
    encoder = embed.HashingEmbedder(8)
    rows = [(f"c{k}", f"word{k} and more", "s", "n_a") for k in range(9)]
    index = embed.embed(spark.createDataFrame(rows, "chunk_id string, document string, scheme string, plan string"), "document", encoder)
    asked = spark.createDataFrame([(1, "what is word3 and more")], "query_id long, question string")
    hits = retrieve.retrieve(asked, index, encoder, threshold=-1.0)
    assert "MapInArrow" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert hits.orderBy("rank").first().chunk_id == "c3"
