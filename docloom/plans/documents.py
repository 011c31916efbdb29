"""The document operators bound to inputs made of the driver's tables: payloads, tables, splits, PDF spans, answers.

The tables hold no payloads, cell matrices or spans, so these queries build
some of every row of a table; the SQL says what must come out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions import guardrails as gr
from docloom.functions import text as tx
from docloom.operators import answer, chunk, embed, embedded, extract_html, index, memory, pdf, tables

from .catalog import query
from .queries import _NUMBERS, _SENTENCES, table

# -- payloads --------------------------------------------------------------------------------------


def _pushed(payload: Column) -> Column:
    """A script that pushes a payload as a row of a stream."""
    row = F.to_json(F.array(F.concat(F.lit("1:"), F.to_json(payload))))
    return F.concat(F.lit("<script>self.__next_f.push([1,"), F.substring(row, 2, 1 << 30), F.lit(")</script>"))


@query("""
    WITH c AS (SELECT *, c_custkey AS k, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS scheme,
                      CASE c_custkey % 3 WHEN 1 THEN 'Direct' WHEN 2 THEN 'Regular' ELSE 'All plans' END AS plan FROM customer),
    b AS (
        SELECT k, 0 AS stage, 0 AS n, 'table' AS kind, '' AS text, [scheme || ' - ' || plan, 'Key facts'] AS path,
               list_filter([[scheme || ' (' || plan || ' plan) - key facts', ''], ['Lump sum', c_nationkey::VARCHAR], ['Scheme name', c_name],
                CASE WHEN k % 2 = 0 THEN ['Plan type', 'Direct'] END, ['Expense ratio', k::VARCHAR], ['Exit load', c_mktsegment || ' | Nil'],
                ['Risk profile', 'a | b'], ['Minimum SIP', '7']], lambda x: x IS NOT NULL) AS rows FROM c
        UNION ALL SELECT k, 1, 0, 'table', '', [scheme || ' - ' || plan, 'Tax implications'], [['T ' || c_mktsegment, 'd ' || k]] FROM c WHERE k % 3 = 0
        UNION ALL SELECT k, 2, 0, 'text', c_name || ': By mail Link: /s/' || k, [scheme || ' - ' || plan, 'Services and downloads', c_name], NULL FROM c WHERE k % 2 = 0
        UNION ALL SELECT k, 2, 1, 'text', 'Other: By phone', [scheme || ' - ' || plan, 'Services and downloads', 'Other'], NULL FROM c WHERE k % 2 = 0
        UNION ALL SELECT k, 3, 0, 'text', 'FAQ: What | is ' || k || '? It is ' || c_name || '.', [scheme || ' - ' || plan, 'Frequently asked questions'], NULL FROM c)
    SELECT k::VARCHAR AS source_id, row_number() OVER (PARTITION BY k ORDER BY stage, n) - 1 AS pos, kind, text,
           to_json(path)::VARCHAR AS heading_path, to_json(rows)::VARCHAR AS table_rows FROM b""")
def embedded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, tax rows, cards and questions of payloads, a page per customer."""
    # Pages are some fifty times as long as the rows that they are made of: those of one file make work for all tasks.
    c = table(spark, sf_dir, "customer").withColumn("source_id", F.col("c_custkey").cast("string")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_id")
    k, text = F.col("c_custkey"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    card = lambda title, description, **more: F.struct(title.alias("title"), F.lit(description).alias("description"), *(v.alias(n) for n, v in more.items()))
    entry = lambda title, description: F.struct(title.alias("title"), description.alias("description"))
    inner = F.struct(
        F.lit(99).alias("expenseRatio"), F.struct(F.lit(" a |b ").alias("riskDescription"), F.lit("null").alias("benchmark")).alias("riskometerDetails"), F.lit(7).alias("sip")
    )
    taxes = F.array(entry(F.lit(""), F.lit("untitled")), entry(text("T ", F.col("c_mktsegment")), text("<b>d", " ", k.cast("string"), "</b>")))
    payload = F.struct(
        F.col("c_name").alias("schemeName"),
        F.when(k % 2 == 0, "Direct").otherwise("N/A").alias("planType"),
        k.alias("expenseRatio"),
        text("<ul><li>", F.col("c_mktsegment"), "</li><li>Nil</li></ul>").alias("exitLoad"),
        F.struct(F.col("c_nationkey").alias("lumpsum"), F.lit("-").alias("sip")).alias("minimumInvestment"),
        F.array(inner).alias("plans"),
        F.when(k % 3 == 0, taxes).alias("taxImplication"),
        F.array(F.struct(F.array().cast("array<string>").alias("taxImplication"))).alias("later"),
    )
    link = text("/s/", k.cast("string"))
    cards = F.struct(
        F.array(card(F.col("c_name"), "By mail", link=link), card(F.col("c_name"), "By mail", link=F.lit("/again"))).alias("services"),
        F.array(card(F.lit("Other"), "By phone", mobileEnabled=F.lit(True))).alias("more"),
        F.array(card(F.lit("No card"), "Lacks a context")).alias("team"),
    )
    ask = F.struct(text("<i>What</i>is ", k.cast("string"), "?").alias("name"), F.struct(text("It is ", F.col("c_name"), ".").alias("text")).alias("acceptedAnswer"))
    nothing = F.struct(F.lit("").alias("name"), F.struct(F.lit("no question").alias("text")).alias("acceptedAnswer"))
    faq = text('<script id="json-ld-faqsSchema" type="application/ld+json">', F.to_json(F.struct(F.array(nothing, ask).alias("mainEntity"))), "</script>")
    html = text("<html><script>expenseRatio(broken</script>", _pushed(payload), _pushed(cards), faq, "</html>")
    plan = F.when(k % 3 == 1, "direct").when(k % 3 == 2, "regular").otherwise("n_a")
    sources = c.select("source_id", F.col("c_mktsegment").alias("scheme"), plan.alias("plan"), F.when(k % 2 == 0, "downloads").otherwise("sid").alias("doc_type"))
    found = embedded.embedded_blocks(c.select("source_id", html.alias("html")), sources, "source_id")
    return found.select("source_id", "pos", "kind", "text", F.to_json("heading_path").alias("heading_path"), F.to_json("table_rows").alias("table_rows"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS kind FROM pages")
def dispatch_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pages begin like PDF files, a fifth are of a type that is one."""
    p = table(spark, sf_dir, "pages")
    content = F.encode(F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-").otherwise(""), tx.text_of("html")), "UTF-8")
    kind = extract_html.dispatch(content, F.when(F.col("page_id") % 5 == 0, "factsheet").otherwise("third_party"))
    return p.select("page_id", kind.alias("kind"))


@query(r"""
    SELECT page_id::VARCHAR AS source_id, 'text' AS kind, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text
    FROM pages WHERE page_id % 2 = 0 AND trim(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)) <> ''""")
def fallback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which no block came, but an error, give their bare text."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '(?s)<div class="ad">(.*?)</div>', 1).alias("html"))
    kind = F.when(F.col("page_id") % 2 == 0, "error").otherwise("text")
    blocks = p.select(
        F.col("page_id").cast("string").alias("source_id"), F.lit(0).cast("bigint").alias("pos"), kind.alias("kind"), F.lit("x").alias("text"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page_num"), F.lit(None).cast("array<array<string>>").alias("table_rows"),
    )
    return extract_html.fallback_blocks(p, blocks).where("text <> 'x'").select("source_id", "kind", "text")


@query("""
    WITH s AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'BIG HEAD ' WHEN o_orderkey % 7 = 0 THEN '' ELSE 'prose ' END
                      || CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN o_orderkey || '. Part' ELSE o_orderpriority END AS text,
                      CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 2 END AS level FROM orders),
    h AS (SELECT *, list(text) FILTER (level IS NOT NULL) OVER w AS heads, last_value(level IGNORE NULLS) OVER w AS last_level FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY k ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, CASE WHEN heads IS NULL OR len(heads) = 0 THEN [] WHEN last_level = 1 OR len(heads) = 1 THEN [heads[-1]] ELSE heads[-2:] END AS path FROM h),
    t AS (SELECT o_custkey, arg_max(path, k) AS path, min(k) AS least, count(*) AS n FROM p GROUP BY 1)
    SELECT o_custkey::VARCHAR AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS pos, CASE WHEN level IS NULL THEN 'text' ELSE 'heading' END AS kind, text,
           to_json(path)::VARCHAR AS heading_path, NULL::VARCHAR AS table_rows FROM p
    UNION ALL SELECT o_custkey::VARCHAR, n, 'table', '', to_json(path)::VARCHAR, to_json([['first', ''], [least::VARCHAR, 'x y']])::VARCHAR FROM t""")
def pdf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer with a block per order, in two spans, and a table after them."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    by = o.select(F.col("o_custkey").cast("string").alias("source_id"), F.lit(1).alias("page_num"), k.alias("block_no"), k.alias("k"), "o_orderpriority")
    # Each row becomes seven spans: pages are put together while rows are rows, and spans stay where they are.
    by = by.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_id")
    front = F.when(k % 5 == 0, "BIG HEAD ").when(k % 7 == 0, "").otherwise("prose ")
    end = F.when((k % 7 == 0) & (k % 5 != 0), F.concat(k.cast("string"), F.lit(". Part"))).otherwise(F.col("o_orderpriority"))
    size = F.when((k % 5 == 0) & (k % 2 == 0), 14.0).otherwise(10.0)
    parts = F.explode(F.array(F.struct(F.lit(0).alias("span_no"), front.alias("text")), F.struct(F.lit(1).alias("span_no"), end.alias("text"))))
    # A page's small spans are more than its large ones: sizes of ten are added beside each block.
    spans = by.withColumnRenamed("k", "o_orderkey").select("source_id", "page_num", "block_no", parts.alias("p"), size.alias("size")).select("source_id", "page_num", "block_no", "p.*", "size")
    body = F.array(F.array(F.lit("first")), F.array(F.min("block_no").cast("string"), F.lit("x  y")))
    made = by.groupBy("source_id", "page_num").agg(body.alias("table_rows")).withColumn("table_no", F.lit(0))
    small = by.select("source_id", "page_num", "block_no", F.explode(F.array_repeat(F.lit("."), 5)).alias("text")).withColumns({"span_no": F.lit(9), "size": F.lit(10.0)})
    padded = spans.unionByName(small.withColumn("block_no", -1 - F.col("block_no")))
    found = pdf.span_blocks(padded, made)
    return found.select("source_id", "pos", "kind", "text", F.to_json("heading_path").alias("heading_path"), F.to_json("table_rows").alias("table_rows"))


# -- tables and chunks -----------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, c_name, c_custkey % 100 || '.5%' AS amount, c_custkey % 7 AS v FROM customer),
    l AS (SELECT n, k, 0 AS j, c_name || ' (Balance): ' || k * 3 AS line FROM c
          UNION ALL SELECT n, k, 1, c_name || ' - Amount (local): ' || amount FROM c WHERE k % 4 <> 0
          UNION ALL SELECT n, k, 2, c_name || ' (other values): ' || v FROM c WHERE k % 5 <> 0)
    SELECT 'wide ' || n AS matrix, 'Nation ' || n || chr(10) || string_agg(line, chr(10) ORDER BY k, j) || chr(10) || 'Total of | all | customers' AS text FROM l GROUP BY n
    UNION ALL SELECT 'pairs ' || c_mktsegment, string_agg(c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ': ' || c_custkey END, chr(10) ORDER BY c_custkey) FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'bare ' || s_nationkey, 'S' || chr(10) || string_agg(s_name || ': ' || s_suppkey || ' | ' || (s_suppkey + 1), chr(10) ORDER BY s_suppkey) FROM supplier GROUP BY s_nationkey""")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices with headers, of pairs, and without headers, as lines."""
    c, s, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), F.col("c_custkey")
    rows = lambda key, *cells: F.transform(F.array_sort(F.collect_list(F.struct(key, F.array(*cells).alias("cells")))), lambda r: r["cells"])
    row = lambda *cells: F.array(*map(F.lit, cells))
    amount = F.when(k % 4 == 0, " - ").otherwise(F.concat((k % 100).cast("string"), F.lit(".5%")))
    value = F.when(k % 5 == 0, "").otherwise((k % 7).cast("string"))
    wide = c.groupBy("c_nationkey").agg(rows(k, F.concat(F.lit("  "), "c_name"), (k * 3).cast("string"), amount, value).alias("rows"))
    head, foot = row("Customer", "Balance", "Amount  (local)", "Value"), row("Total of", "all", "", "customers")
    wide = wide.select(F.concat(F.lit("wide "), "c_nationkey").alias("matrix"), F.concat(F.lit("Nation "), "c_nationkey").alias("title"), F.concat(F.array(head, row("", " ", "", "")), "rows", F.array(foot)).alias("rows"))
    pair = F.when(k % 3 == 0, ":").otherwise(k.cast("string"))
    pairs = c.groupBy("c_mktsegment").agg(rows(k, F.col("c_name"), pair).alias("rows")).select(F.concat(F.lit("pairs "), "c_mktsegment").alias("matrix"), F.lit("").alias("title"), "rows")
    n = F.col("s_suppkey")
    bare = s.groupBy("s_nationkey").agg(rows(n, F.col("s_name"), F.lit(":"), n.cast("string"), (n + 1).cast("string")).alias("rows"))
    bare = bare.select(F.concat(F.lit("bare "), "s_nationkey").alias("matrix"), F.lit("S").alias("title"), "rows")
    return wide.unionByName(pairs).unionByName(bare).select("matrix", tables.flatten_column(F.col("rows"), F.col("title")).alias("text"))


@query("""
    WITH c AS (SELECT c_nationkey AS n, c_name || ': ' || lpad(c_custkey::VARCHAR, 7, '0') AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i,
                      'ELSS Tax Saver Fund - Direct plan' || chr(10) || 'Nation ' || c_nationkey AS head FROM customer),
    g AS (SELECT *, (900 - length(head) - 1 + 1) // (length(line) + 1) AS per FROM c),
    p AS (SELECT n, head, i // per AS part, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY 1, 2, 3)
    SELECT n::VARCHAR AS source_id, format('{}-c{:03d}', n, part) AS chunk_id, part::INT AS chunk_index, (part + 1)::INT AS table_part, (count(*) OVER (PARTITION BY n))::INT AS table_parts,
           head || chr(10) || body AS text, sha256(head || chr(10) || body) AS content_hash, replace(head, chr(10), ' > ') AS section_path FROM p""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a nation's customers in parts of whole rows."""
    c = table(spark, sf_dir, "customer")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: F.array(r["c_name"], F.lpad(r["c_custkey"].cast("string"), 7, "0")))
    blocks = c.groupBy("c_nationkey").agg(rows.alias("table_rows")).select(
        F.col("c_nationkey").cast("string").alias("source_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("table").alias("kind"), F.lit("").alias("text"),
        F.array(F.concat(F.lit("Nation "), "c_nationkey")).alias("heading_path"), F.lit(None).cast("int").alias("page_num"), "table_rows",
    )
    sources = blocks.select("source_id", F.lit("https://example.com/t").alias("url"), F.lit("sid").alias("doc_type"), F.lit("elss").alias("scheme"), F.lit("direct").alias("plan"))
    found = chunk.chunk_documents(blocks, sources)
    return found.select("source_id", "chunk_id", "chunk_index", "table_part", "table_parts", "text", "content_hash", "section_path")


@query(r"""
    WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
    s AS (SELECT doc_id, source, pos, CASE WHEN pos % 3 = 2 THEN '- ' ELSE '' END || trim(regexp_replace(line, '\s+', ' ', 'g')) AS part, trim(regexp_replace(line, '\s+', ' ', 'g')) AS bare FROM l),
    b AS (SELECT doc_id, upper(left(source, 1)) || lower(substr(source, 2)) AS title, string_agg(part, chr(10) || chr(10) ORDER BY pos) AS body FROM s WHERE bare <> '' AND lower(bare) NOT IN ('sid', 'sai', 'side') GROUP BY 1, 2)
    SELECT doc_id::VARCHAR AS source_id, doc_id || '-c000' AS chunk_id, sha256(title || chr(10) || body) AS content_hash, (length(title) + 1 + length(body))::INT AS char_len, title AS section_path, 1 AS page_num,
           (['January', 'March', 'May', 'December'])[1 + doc_id % 4] || ' 2026' AS source_date FROM b""")
def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents small enough for one chunk, every third line being an item."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(tx.text_of("text"), "\n")).alias("pos", "text"))
    blocks = lines.select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("pos").cast("bigint").alias("pos"), F.when(F.col("pos") % 3 == 2, "list").otherwise("text").alias("kind"), "text",
        F.array().cast("array<string>").alias("heading_path"), F.lit(1).alias("page_num"), F.lit(None).cast("array<array<string>>").alias("table_rows"),
    )
    month = F.element_at(F.array(*map(F.lit, ("january", "MARCH", "May", "December"))), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://example.com/Sheet_"), month, F.lit("_2026.pdf"))
    sources = docs.select(F.col("doc_id").cast("string").alias("source_id"), url.alias("url"), F.lit("sid").alias("doc_type"), F.col("source").alias("scheme"), F.lit("n_a").alias("plan"))
    found = chunk.chunk_documents(blocks, sources, Settings(max_chunk_chars=1 << 40, min_chunk_chars=0))
    return found.select("source_id", "chunk_id", "content_hash", "char_len", "section_path", "page_num", "source_date")


@query(r"""
    WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[.!?;]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
    w(doc_id, t, n, low, high) AS (
        SELECT doc_id, t, 0, 0, CASE WHEN length(t) <= 900 THEN length(t) ELSE 900 - strpos(reverse(left(t, 901)), ' ') + 2 END FROM d WHERE t <> ''
        UNION ALL
        SELECT doc_id, t, n + 1, high, CASE WHEN length(t) - high <= 900 THEN length(t) ELSE high + 900 - strpos(reverse(substr(t, high + 1, 901)), ' ') + 2 END FROM w WHERE high < length(t))
    SELECT doc_id, n, sha256(substr(t, low + 1, high - low)) AS h, high - low AS n_chars FROM w""")
def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without marks, cut at spaces into windows of 900 characters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(tx.text_of("text"), "[.!?;]", ""), "\\s+", " "))
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.split_column(bare, 900, 0)).alias("n", "w"))
    return cut.select("doc_id", "n", tx.hashed(F.col("w")).alias("h"), F.length("w").cast("bigint").alias("n_chars"))


@query(r"""
    WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[.!?;]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
    s AS (SELECT *, 900 - strpos(reverse(left(t, 901)), ' ') + 2 AS a FROM d WHERE length(t) > 900),
    b AS (SELECT *, CASE WHEN length(t) - a <= 900 THEN length(t) ELSE a + 900 - strpos(reverse(substr(t, a + 1, 901)), ' ') + 2 END AS high FROM s),
    -- The first window's end is a space, so its last mark leaves nothing and the border stays.
    c AS (SELECT doc_id, t, a, high FROM b)
    SELECT doc_id, sha256(substr(t, 1, a)) AS first, sha256(substr(t, a + 1, high - a)) AS second FROM c""")
def shared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an overlap, a border after a whole word stays where it is."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(tx.text_of("text"), "[.!?;]", ""), "\\s+", " "))
    cut = table(spark, sf_dir, "documents").select("doc_id", chunk.split_column(bare, 900, 150).alias("w")).where(F.size("w") > 1)
    return cut.select("doc_id", tx.hashed(F.get("w", F.lit(0))).alias("first"), tx.hashed(F.get("w", F.lit(1))).alias("second"))


@query("""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, repeat(chr(97 + (turn % 26)::INT), (20 + (conv_id * 7 + turn * 13) % 200)::INT) AS body FROM conversations),
    p AS (SELECT conv_id, i, 'Conversation' || chr(10) || 'H' || i || chr(10) || body AS text FROM t),
    -- Two sections a document: a short second one joins the first, else a short first one is joined by the second.
    a AS (SELECT x.conv_id, x.text AS a, y.text AS b FROM p x LEFT JOIN p y ON y.conv_id = x.conv_id AND y.i = 1 WHERE x.i = 0),
    m AS (SELECT *, b IS NOT NULL AND (length(b) < 120 OR length(a) < 120) AND length(a) + length(b) <= 300 AS joined FROM a)
    SELECT conv_id::VARCHAR AS source_id, conv_id || '-c000' AS chunk_id, 0 AS chunk_index, CASE WHEN joined THEN a || chr(10) || chr(10) || b ELSE a END AS text FROM m
    UNION ALL SELECT conv_id::VARCHAR, conv_id || '-c001', 1, b FROM m WHERE b IS NOT NULL AND NOT joined""")
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two turns of a conversation as sections; short ones join their neighbours, and ids are not renumbered."""
    turns = table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).where("i < 2")
    body = F.expr("repeat(char(97 + turn % 26), int(20 + (conv_id * 7 + turn * 13) % 200))")
    blocks = turns.select(
        F.col("conv_id").cast("string").alias("source_id"), F.col("i"), F.concat(F.lit("H"), "i").alias("head"),
        F.explode(F.array(F.struct(F.lit("heading").alias("kind"), F.concat(F.lit("H"), "i").alias("text")), F.struct(F.lit("text").alias("kind"), body.alias("text")))).alias("b"),
    )
    blocks = blocks.select(
        "source_id", (F.col("i") * 2 + (F.col("b.kind") == "text").cast("int")).cast("bigint").alias("pos"), "b.kind", "b.text", F.array("head").alias("heading_path"),
        F.lit(None).cast("int").alias("page_num"), F.lit(None).cast("array<array<string>>").alias("table_rows"),
    )
    sources = blocks.select("source_id", F.lit("https://example.com/c").alias("url"), F.lit("sid").alias("doc_type"), F.lit("conversation").alias("scheme"), F.lit("n_a").alias("plan")).distinct()
    return chunk.chunk_documents(blocks, sources, Settings(max_chunk_chars=300)).select("source_id", "chunk_id", "chunk_index", "text")


# -- index, answers, sessions ----------------------------------------------------------------------


@query("""
    SELECT doc_id, sha256(CASE WHEN source IS NULL OR starts_with(coalesce(text, ''), source || chr(10) || lang) THEN coalesce(text, '') ELSE source || chr(10) || lang || chr(10) || coalesce(text, '') END) AS h,
           to_json([source, lang])::VARCHAR AS path, 'hashing@1:8:True' AS fingerprint FROM documents""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of a document, its metadata as scalars, and the encoder's name."""
    docs = table(spark, sf_dir, "documents").withColumn("crumb", F.concat_ws(" > ", "source", "lang"))
    made = docs.select("doc_id", tx.hashed(embed.embedding_text(tx.text_of("text"), F.col("crumb"))).alias("h"), F.array("source", "lang").alias("path"), embed.fingerprint_column(embed.HashingEmbedder(8)).alias("fingerprint"))
    return index.scalar_metadata(made)


@query("""
    SELECT o_custkey, 'Last updated from sources: ' || CASE WHEN o_custkey % 4 = 0 THEN 'date not stated on page' ELSE strftime(max(o_orderdate), '%B %Y') END AS line FROM orders GROUP BY 1""")
def last_updated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of a customer's order months by the calendar, or none."""
    dated = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_custkey") % 4 != 0, F.date_format("o_orderdate", "MMMM yyyy")).alias("d")).distinct()
    return dated.groupBy("o_custkey").agg(answer.last_updated(F.collect_list("d")).alias("line"))


@query(f"""
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') WHEN 1 THEN '{answer.TEMPLATES["NOT_FOUND"]}' ELSE '{answer.TEMPLATES["PII_BLOCKED"]}' END AS answer
    FROM conversations""")
def rendered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: factual answers as they are, others by template."""
    template = F.when(F.col("turn") % 3 == 0, "FACTUAL").when(F.col("turn") % 3 == 1, "NOT_FOUND").otherwise("PII_BLOCKED")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.render(template, F.col("text")).alias("answer"))


def _bounded(phrases: tuple[str, ...]) -> str:
    return "(?i)(^|[^A-Za-z0-9_])(?:" + "|".join(f"(?:{p})" for p in phrases).replace("\\w", "[A-Za-z0-9_]") + ")([^A-Za-z0-9_]|$)"


@query(rf"""
    WITH b AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), source, ' ') ELSE coalesce(text, '') END, '^\s+|\s+$', '', 'g') AS said, left(coalesce(text, ''), 200) AS ctx FROM documents),
    c AS (SELECT doc_id, said <> '' AS full_, len({_SENTENCES.format(c="said")}) <= 3 AS few, NOT regexp_matches(said, '{_bounded(gr.ANSWER_ADVICE)}') AS no_advice,
                 NOT regexp_matches(said, '{_bounded(gr.ANSWER_PERFORMANCE)}') AS no_performance,
                 len(list_filter({_NUMBERS.format(c="nfc_normalize(said)")}, lambda x: NOT list_contains({_NUMBERS.format(c="nfc_normalize(ctx)")}, x))) = 0 AS grounded, doc_id % 3 <> 0 AS trusted FROM b)
    SELECT doc_id, full_ AND few AND no_advice AND no_performance AND grounded AND trusted AS ok, few AS sentence_count, grounded AS numerics_grounded, trusted AS citation_trusted,
           coalesce(array_to_string(list_distinct(list_filter([CASE WHEN NOT (full_ AND few AND grounded AND trusted) THEN 'NOT_FOUND' END, CASE WHEN NOT no_advice THEN 'REFUSE_ADVICE' END, CASE WHEN NOT no_performance THEN 'REFUSE_PERFORMANCE' END], lambda x: x IS NOT NULL).list_sort()), ' '), '') AS violations
    FROM c""".replace("list_distinct(list_filter(", "list_sort(list_filter(").replace(".list_sort())", ")"))
def verified_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers grounded in their first 200 characters; every third cites what it may not, every other is judged without its source's name."""
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, gr.without_suffixes(F.col("text"), F.col("source"))).otherwise(tx.text_of("text"))
    told = gr.verify(body, F.array(F.substring(tx.text_of("text"), 1, 200)), F.lit("FACTUAL"), F.lit("u"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("v"))).otherwise(F.array(F.lit("u"))))
    judged = docs.select("doc_id", told.alias("v"))
    checks = [F.col("v.checks")[name].alias(name) for name in ("sentence_count", "numerics_grounded", "citation_trusted")]
    return judged.select("doc_id", "v.ok", *checks, F.array_join(F.array_sort("v.violations"), " ").alias("violations"))


@query("SELECT conv_id, count(*) || '/10 messages' AS said, md5(conv_id::VARCHAR) AS session_id, true AS valid, false AS upper_valid FROM conversations GROUP BY conv_id")
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, M9: a conversation's size in words, and ids that are and are not a session's."""
    sized = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("session_id", F.md5(F.col("conv_id").cast("string")))
    upper = memory.valid_session(F.concat(F.lit("X"), F.substring("session_id", 2, 31)))
    return sized.select("conv_id", memory.describe(F.col("n")).alias("said"), "session_id", memory.valid_session(F.col("session_id")).alias("valid"), upper.alias("upper_valid"))
