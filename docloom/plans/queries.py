"""The engine's operators bound to the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import Settings, Vocabulary
from docloom.functions import guardrails as gr
from docloom.functions import text as tx
from docloom.functions import urls
from docloom.operators import answer, chunk, embed, embedded, evaluate, extract_html, index, memory, normalize, pdf, retrieve, tables
from docloom.sources import files, manifest
from docloom.streaming import sessions

from .catalog import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- retrieval -------------------------------------------------------------------------------------

_PAIRS = """
    WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT query_id, q_label, vec_id, label, list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]) AS s
          FROM q JOIN embeddings ON {on}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
"""


def _vector_queries(vectors: DataFrame) -> DataFrame:
    """The stated query set of a search: rows whose id is divisible by 50."""
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("q_label"))


@query(_PAIRS.format(on="true") + "SELECT query_id, vec_id, round(s, 4) AS score, rank FROM r WHERE rank <= 12")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 12 by cosine."""
    v = table(spark, sf_dir, "embeddings")
    return retrieve.top_k(_vector_queries(v), v, 12).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(_PAIRS.format(on="q_label = label") + "SELECT query_id, vec_id, round(s, 4) AS score, rank FROM r WHERE rank <= 12")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata filter comes before the search."""
    v = table(spark, sf_dir, "embeddings")
    hits = retrieve.top_k(_vector_queries(v), v, 12, matches=(retrieve.Match("q_label", "label"),))
    return hits.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(_PAIRS.format(on="true") + "SELECT query_id, vec_id, round(s, 4) AS score, rank FROM r WHERE rank <= 12 AND s >= 0.3")
def threshold_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor applies to unrounded scores of the top 12."""
    v = table(spark, sf_dir, "embeddings")
    return retrieve.above(retrieve.top_k(_vector_queries(v), v, 12), 0.3).select("query_id", "vec_id", "score", "rank")


_TERMS = """
    WITH stop AS (SELECT unnest(string_split('{stop}', ' ')) AS t),
    q AS (SELECT DISTINCT item_id AS query_id, t FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM benchmark)
          WHERE length(t) > 2 AND t NOT IN (SELECT t FROM stop)),
    d AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents)),
    n AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY 1),
    o AS (SELECT query_id, doc_id, count(*) AS n_shared FROM q JOIN d USING (t) GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_shared DESC, doc_id) AS place FROM o),
    h AS (SELECT query_id, doc_id, n_shared * 1.0::DOUBLE / n_terms AS score, place FROM c JOIN n USING (query_id) WHERE place <= 12),
""".format(stop=" ".join(Vocabulary().stopwords))


def _lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark question, the twelve documents that share most of its content words."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    best = retrieve.lexical_top_k(asked, docs, 12)
    return best.join(docs, "doc_id").join(asked, "query_id")


@query(
    _TERMS
    + """
    w AS (SELECT query_id, q.t, count(*) FILTER (d.doc_id IS NOT NULL) AS df, ln(1 + count(*) / (1 + count(*) FILTER (d.doc_id IS NOT NULL))) AS idf
          FROM h JOIN q USING (query_id) LEFT JOIN d ON d.doc_id = h.doc_id AND d.t = q.t GROUP BY 1, 2),
    l AS (SELECT h.query_id, h.doc_id, h.score, h.place,
                 sum(CASE WHEN d.doc_id IS NOT NULL THEN idf ELSE 0 END) / sum(idf) AS lexical
          FROM h JOIN w USING (query_id) LEFT JOIN d ON d.doc_id = h.doc_id AND d.t = w.t GROUP BY 1, 2, 3, 4)
    SELECT query_id, doc_id, round(score, 4) AS score, round(lexical, 4) AS lexical,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.15 * lexical, 9) DESC, round(score, 9) DESC, place) AS rank
    FROM l
    """
)
def lexical_idf_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking by words that are rare among a question's own hits."""
    hits = _lexical_hits(spark, sf_dir)
    ranked = retrieve.rerank(hits, "question", "body", "query_id", "doc_id", 0.15)
    return ranked.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.round("lexical", 4).alias("lexical"), "rank")


@query(_TERMS + "z AS (SELECT 1) SELECT query_id, doc_id, round(score, 4) AS overlap FROM h")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a question's content words in a hit."""
    hits = _lexical_hits(spark, sf_dir)
    return hits.select("query_id", "doc_id", F.round(tx.lexical_overlap(F.col("question"), F.col("body")), 4).alias("overlap"))


_GOLD = _PAIRS.format(on="query_id <> vec_id") + """,
    f AS (SELECT query_id, min(rank) AS first_rank, arg_min(s, rank) AS matched FROM r WHERE rank <= 5 AND q_label = label GROUP BY 1),
    e AS (SELECT q.query_id, f.first_rank IS NOT NULL AS found, f.first_rank, coalesce(matched, 0.0) AS matched_score FROM q LEFT JOIN f USING (query_id))
"""


def _probe_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    asked = _vector_queries(v)
    hits = retrieve.top_k(asked, v, 5, matches=(retrieve.Match("query_id", "vec_id", differs=True),))
    return evaluate.found_gold(hits, asked, 5, F.col("q_label") == F.col("label")), hits


@query(_GOLD + "SELECT query_id, found, first_rank, round(matched_score, 4) AS matched_score FROM e")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: per probe whether, where and how alike its gold was found."""
    result, _ = _probe_results(spark, sf_dir)
    return result.withColumn("matched_score", F.round("matched_score", 4))


@query(_GOLD + "SELECT count(*) AS probes, round(avg(found::INT), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 4) AS mrr FROM e")
def recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V6: recall and mean reciprocal rank."""
    return evaluate.summary(_probe_results(spark, sf_dir)[0])


@query(_GOLD + "SELECT query_id FROM e WHERE NOT found")
def recall_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: probes without a gold hit."""
    return evaluate.misses(_probe_results(spark, sf_dir)[0]).select("query_id")


@query(
    _GOLD
    + """, lo AS (SELECT coalesce(min(matched_score), 0.0) AS a FROM e WHERE found),
    hi AS (SELECT coalesce(max(s), 1.0) AS b FROM r WHERE rank = 1 AND q_label <> label)
    SELECT round(a, 4) AS lowest_positive, round(b, 4) AS highest_negative, round((a + b) / 2, 4) AS threshold, a > b AS separable FROM lo, hi"""
)
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4: between the lowest positive and the highest negative."""
    result, hits = _probe_results(spark, sf_dir)
    off = hits.where("q_label <> label")
    return evaluate.calibrate(result, off).withColumns({"lowest_positive": F.round("lowest_positive", 4), "highest_negative": F.round("highest_negative", 4)})


# -- manifest, scans, extraction -------------------------------------------------------------------


@query(r"""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT *, regexp_replace(trim(url_decode(string_split(path, '/')[-1])), '[^\p{L}\p{N}._-]', '_', 'g') AS safe,
                 string_split(lower(url), '?')[1] LIKE '%.pdf' AS is_pdf FROM p)
    SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, is_pdf,
           CASE WHEN safe = '' THEN page_id::VARCHAR || (CASE WHEN is_pdf THEN '.pdf' ELSE '.html' END)
                WHEN lower(safe) LIKE ('%' || (CASE WHEN is_pdf THEN '.pdf' ELSE '.html' END)) THEN safe
                ELSE safe || (CASE WHEN is_pdf THEN '.pdf' ELSE '.html' END) END AS file_name
    FROM s""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a URL says of its file."""
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", urls.host(u).alias("host"), urls.is_pdf(u).alias("is_pdf"), urls.file_name(u, F.col("page_id").cast("string")).alias("file_name"))


@query("""
    SELECT page_id, sha256(coalesce(html, '')) AS content_hash, length(coalesce(html, '')) AS n_chars,
           trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and title of raw pages."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", files.content_hash(tx.text_of("html")).alias("content_hash"), F.length(tx.text_of("html")).alias("n_chars"), extract_html.title_of_page(F.col("html")).alias("title"))


def _page_sources(pages: DataFrame) -> DataFrame:
    """What a manifest would say of the pages."""
    return pages.select(F.col("page_id").cast("string").alias("source_id"), F.lit("elss").alias("scheme"), F.lit("n_a").alias("plan"), F.lit("third_party").alias("doc_type"))


#: Text of a piece of markup: its tags cut it into pieces, which are stripped and joined; entities of these pages are few.
_PLAIN = r"""trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace({c}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x:
    regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' '), '[ \t]+', ' ', 'g'))"""


@query(r"""
    WITH RECURSIVE a AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
                      regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article FROM pages),
    t AS (SELECT *, {article} AS whole, regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM a),
    parts AS (SELECT page_id, 0 AS place, 0 AS n, 'text' AS kind, {title} AS text FROM t
        UNION ALL SELECT page_id, 1, 0, 'text', {ad} FROM t
        UNION ALL SELECT page_id, 2, 0, 'text', whole FROM t WHERE length(whole) <= 4000
        UNION ALL SELECT page_id, 2, 0, CASE WHEN length({h1}) <= 120 THEN 'heading' ELSE 'text' END, {h1} FROM t WHERE length(whole) > 4000
        UNION ALL SELECT page_id, 3, n, 'text', {p} FROM (SELECT page_id, whole, unnest(string_split(article, '<p>')) AS p, generate_subscripts(string_split(article, '<p>'), 1) AS n FROM t) WHERE length(whole) > 4000 AND n > 1),
    -- A text too long for a block is cut after the last sentence that fits, or else the last word.
    cut(page_id, place, n, kind, k, text, rest) AS (
        SELECT page_id, place, n, kind, 0, NULL::VARCHAR, text FROM parts
        UNION ALL
        SELECT page_id, place, n, kind, k + 1, left(rest, upto), CASE WHEN upto < length(rest) THEN ltrim(substr(rest, upto + 1)) END FROM (
            SELECT *, CASE WHEN length(rest) <= 4000 THEN length(rest) WHEN regexp_matches(left(rest, 4001), '(?s)[.!?] ') THEN length(regexp_extract(left(rest, 4001), '(?s)^(.*[.!?]) ', 1))
                      ELSE length(regexp_extract(left(rest, 4001), '(?s)^(.*) ', 1)) END AS upto FROM cut WHERE rest IS NOT NULL)),
    said AS (SELECT * FROM cut WHERE k > 0 AND length(text) >= 2 AND regexp_matches(text, '[A-Za-z0-9]')),
    h AS (SELECT page_id, max(text) FILTER (kind = 'heading') AS heading FROM said GROUP BY 1)
    SELECT s.page_id::VARCHAR AS source_id, 4294967296 + row_number() OVER (PARTITION BY s.page_id ORDER BY place, n, k) - 1 AS pos, kind, text,
           CASE WHEN heading IS NOT NULL AND place >= 2 THEN to_json([heading])::VARCHAR ELSE '[]' END AS heading_path, NULL::VARCHAR AS table_rows
    FROM said s JOIN h USING (page_id)""".replace("{article}", _PLAIN.format(c="article")).replace("{title}", _PLAIN.format(c="title")).replace("{ad}", _PLAIN.format(c="ad"))
    .replace("{h1}", _PLAIN.format(c="h1")).replace("{p}", _PLAIN.format(c="p")))
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all pages, those embedded as JSON first."""
    p = table(spark, sf_dir, "pages")
    found = embedded.merge_stages(embedded.embedded_blocks(p, _page_sources(p)), extract_html.page_blocks(p))
    return found.select("source_id", "pos", "kind", "text", F.to_json("heading_path").alias("heading_path"), F.to_json("table_rows").alias("table_rows"))


@query()
def page_blocks_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each page before and after normalization."""
    raw = extract_html.page_blocks(table(spark, sf_dir, "pages"))
    return normalize.before_and_after(raw, normalize.normalize_blocks(raw))


@query()
def page_extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag of each page from its blocks."""
    p = table(spark, sf_dir, "pages")
    sources = p.select(F.col("page_id").cast("string").alias("source_id"), F.lit("third_party").alias("doc_type"), F.lit("ok").alias("fetch_status"))
    return extract_html.extraction_report(sources, extract_html.page_blocks(p), least=500)


_CLASSIFIED = """
    WITH t AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>|\\s+', ' ', 'g'))) AS txt,
                      len(regexp_extract_all(html, '(?i)<table')) AS n_tables FROM pages),
    c AS (SELECT page_id, n_tables, length(txt) AS n_chars, contains(txt, 'the ') AS facts FROM t)
    SELECT page_id, n_tables, n_chars, CASE WHEN n_chars = 0 THEN 'extract_failed' WHEN facts THEN 'ok'
           WHEN n_tables = 0 AND n_chars < 2000 THEN 'suspected_client_rendered' ELSE 'ok' END AS flag FROM c"""


@query(_CLASSIFIED)
def extract_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's chain over tag-stripped pages, with a marker this corpus has."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.lower(F.trim(F.regexp_replace(bare, "<[^>]+>|\\s+", " ")))
    t = p.select("page_id", text.alias("txt"), F.regexp_count("html", F.lit("(?i)<table")).cast("bigint").alias("n_tables"))
    n = F.length("txt").cast("bigint")
    flag = extract_html.classify(F.lit("ok"), n, extract_html.has_facts(F.col("txt"), ("the ",)), F.col("n_tables"), n, F.lit("third_party"))
    return t.select("page_id", "n_tables", n.alias("n_chars"), flag.alias("flag"))


@query(f"SELECT flag, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct, flag <> 'ok' AS needs_attention FROM ({_CLASSIFIED}) GROUP BY flag")
def extraction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of flags."""
    return files.report(extract_classify(spark, sf_dir))


@query("""
    SELECT page_id, list_filter([CASE WHEN coalesce(url, '') = '' THEN 'url is blank' END,
           CASE WHEN count(*) OVER (PARTITION BY url) > 1 THEN 'source_id is repeated' END,
           CASE WHEN url <> '' AND NOT regexp_matches(url, '^https?://') THEN 'url is not http or https' END], lambda x: x IS NOT NULL)::VARCHAR[] AS v
    FROM pages""".replace("SELECT page_id, list_filter", "SELECT page_id, array_to_string(list_filter").replace("::VARCHAR[] AS v", ", '; ') AS violations"))
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken as a manifest, URLs as ids."""
    p = table(spark, sf_dir, "pages")
    rows = p.select(
        "page_id", tx.text_of("url").alias("source_id"), F.lit("elss").alias("scheme"), F.lit("direct").alias("plan"),
        F.lit("sid").alias("doc_type"), tx.text_of("url").alias("url"), F.lit("true").alias("enabled"),
    )
    told = F.filter("violations", lambda x: x != "source_id is blank")
    return manifest.violations(rows).select("page_id", F.array_join(told, "; ").alias("violations"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group counts, a source being a scheme."""
    return manifest.counts_by_scheme(table(spark, sf_dir, "documents").withColumnRenamed("source", "scheme")).withColumnRenamed("scheme", "source")


@query("""
    SELECT source, count(*) AS block_count, sum(length(coalesce(text, ''))) AS char_count, count(*) FILTER (doc_id % 7 = 0) AS table_count,
           max(coalesce(doc_id % 5, 0)) AS page_count, bool_or(contains(lower(coalesce(text, '')), 'benchmark') OR contains(lower(coalesce(text, '')), 'lock in')
           OR contains(lower(coalesce(text, '')), 'exit load') OR doc_id % 7 = 0 AND doc_id % 49 = 0) AS facts
    FROM documents GROUP BY 1""")
def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of each source's documents taken as blocks; every seventh is a table, some of which state a fact."""
    docs = table(spark, sf_dir, "documents")
    cells = F.array(F.array(F.lit("Riskometer"), F.when(F.col("doc_id") % 49 == 0, "high").otherwise("")))
    rows = F.when(F.col("doc_id") % 7 == 0, F.when(F.col("doc_id") % 49 == 0, cells).otherwise(F.array(F.array(F.lit("a"), F.lit("b")))))
    blocks = docs.select(
        F.col("source").alias("source_id"), F.when(F.col("doc_id") % 7 == 0, "table").otherwise("text").alias("kind"), "text",
        (F.col("doc_id") % 5).alias("page_num"), rows.alias("table_rows"),
    )
    return extract_html.profile(blocks).withColumnRenamed("source_id", "source")


@query("SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN (CASE WHEN length(coalesce(d.text, '')) > 0 THEN 'ok' ELSE 'fetch_failed' END) WHEN l.quality = 1 THEN 'ok' ELSE 'fetch_failed' END AS fetch_status FROM documents d LEFT JOIN labels l USING (doc_id)")
def fetch_state_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded status, else one from the content."""
    from docloom.sources import fetch

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    told = labels.select(F.col("doc_id").alias("source_id"), F.when(F.col("quality") == 1, "ok").otherwise("fetch_failed").alias("status"))
    there = docs.select(F.col("doc_id").alias("source_id"), F.length(tx.text_of("text")).alias("length"))
    found = fetch.fetch_state(docs.select(F.col("doc_id").alias("source_id")), told, there)
    return found.select(F.col("source_id").alias("doc_id"), "fetch_status")


@query("SELECT quality = 1 AS enabled, count(*) AS n, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def enabled_and_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected sources and their complement."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("enabled", F.col("quality") == 1)
    both = rows.where("enabled").unionByName(manifest.excluded(rows))
    return both.groupBy("enabled").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2)
    SELECT user_id, event_type AS mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1""")
def first_seen_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode of each group, the first seen of equally frequent values."""
    return pdf.first_seen_mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("event_id")).withColumnRenamed("event_type", "mode")


# -- normalization ---------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of one line each."""
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.posexplode(F.split(tx.text_of("text"), "\n")).alias("pos", "text"))
    return each.select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("pos").cast("bigint").alias("pos"), F.lit("text").alias("kind"), "text",
        F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page_num"), F.lit(None).cast("array<array<string>>").alias("table_rows"),
    )


_DUCK_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents"


@query(r"""
    WITH l AS (SELECT DISTINCT source, doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS key
               FROM (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
    k AS (SELECT DISTINCT source, doc_id, CASE WHEN regexp_matches(key, '(?i)^page\s*[0-9]+(\s*(?:of|/)\s*[0-9]+)?$') THEN 'page 0' WHEN regexp_matches(key, '^[0-9]+$') THEN '0' ELSE key END AS key FROM l WHERE key <> ''),
    t AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1)
    SELECT source, key, count(*) AS n_pages, any_value(total) AS total FROM k JOIN t USING (source) GROUP BY 1, 2 HAVING any_value(total) >= 2 AND count(*) > any_value(total) * 0.05""")
def line_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on over a twentieth of a source's pages, a document being a page."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("source_id"), F.col("doc_id").alias("page_num"), "text")
    return normalize.repeated_lines(pages, 0.05, None).withColumnRenamed("source_id", "source")


@query(r"""
    WITH l AS (SELECT source, doc_id, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
    k AS (SELECT *, CASE WHEN regexp_matches(bare, '(?i)^page\s*[0-9]+(\s*(?:of|/)\s*[0-9]+)?$') THEN 'page 0' WHEN regexp_matches(bare, '^[0-9]+$') THEN '0' ELSE bare END AS key FROM l),
    t AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1),
    doomed AS (SELECT source, key FROM k JOIN t USING (source) WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > any_value(total) * 0.05 AND any_value(total) >= 2)
    SELECT doc_id, count(*) FILTER (bare <> '' AND d.key IS NULL) AS n_lines, coalesce(sum(length(line)) FILTER (bare <> '' AND d.key IS NULL), 0)::BIGINT AS n_chars
    FROM k LEFT JOIN doomed d ON k.source = d.source AND k.key = d.key WHERE k.source IN (SELECT source FROM doomed) GROUP BY 1""")
def lines_without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of sources that have furniture, without it."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("page_num"), "text")
    cleaned = normalize.drop_repeated_lines(docs, 0.05, ".", only=True)
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    return cleaned.select(F.col("page_num").alias("doc_id"), F.size(lines).cast("bigint").alias("n_lines"), total.alias("n_chars"))


@query(r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS h FROM documents""")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.hashed(normalize.collapse_whitespace(F.col("text"))).alias("h"))


@query("SELECT doc_id, sha256(replace(replace(nfc_normalize(coalesce(text, '')), chr(160), ' '), chr(173), '')) AS h FROM documents")
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1."""
    d = normalize.unicode_rule(table(spark, sf_dir, "documents").withColumns({"table_rows": F.lit(None).cast("array<array<string>>"), "heading_path": F.array().cast("array<string>")}))
    return d.select("doc_id", tx.hashed(F.col("text")).alias("h"))


@query(f"""
    WITH l AS (SELECT doc_id, pos, line, lag(line) OVER w AS before FROM ({_DUCK_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT *, sum(CASE WHEN coalesce(before LIKE '%-', false) AND regexp_matches(line, '^[\\p{{L}}\\p{{N}}]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l),
    e AS (SELECT *, pos = max(pos) OVER (PARTITION BY doc_id, island) AS last FROM f),
    m AS (SELECT doc_id, min(pos) AS pos, string_agg(CASE WHEN last THEN line ELSE left(line, length(line) - 1) END, '' ORDER BY pos) AS text FROM e GROUP BY doc_id, island)
    SELECT doc_id, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY pos)) AS h FROM m GROUP BY 1""")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that follow a hyphen are joined to it."""
    joined = normalize.dehyphenate_rule(_lines(spark, sf_dir))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"])
    return joined.groupBy(F.col("source_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_lines"), tx.hashed(F.array_join(ordered, "\n")).alias("h"))


@query(rf"""
    SELECT doc_id, pos, line FROM (SELECT doc_id, pos, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM ({_DUCK_LINES}))
    WHERE regexp_matches(bare, '^[0-9\s.,:;/()\[\]%+\-*#₹$€£]+$')""")
def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of digits and punctuation only."""
    return _lines(spark, sf_dir).where(normalize.is_orphan(F.col("text"))).select(F.col("source_id").cast("bigint").alias("doc_id"), "pos", F.col("text").alias("line"))


_BOILER = normalize.BOILERPLATE.replace("'", "''")


@query(rf"""
    WITH l AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM ({_DUCK_LINES})),
    c AS (SELECT *, regexp_matches(bare, '{_BOILER}') AS holds,
                 regexp_replace(regexp_replace(regexp_replace(bare, '{_BOILER}', ' ', 'g'), '\s{{2,}}', ' ', 'g'), '^[ \-:|,]+|[ \-:|,]+$', '', 'g') AS cut FROM l)
    SELECT doc_id, pos, bare AS line, CASE WHEN length(bare) < 25 THEN '' ELSE cut END AS kept FROM c WHERE holds""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with boilerplate, and what is kept of them."""
    lines = _lines(spark, sf_dir).withColumn("line", tx.strip(F.col("text"))).where(F.col("line").rlike(normalize.BOILERPLATE))
    return lines.select(F.col("source_id").cast("bigint").alias("doc_id"), "pos", "line", normalize.strip_boilerplate(F.col("line")).alias("kept"))


# -- chunking --------------------------------------------------------------------------------------

_WINDOWS = """SELECT doc_id, unnest(generate_series(0, greatest(length(coalesce(text, '')) - 1, 0), 750)) AS start FROM documents"""
_CUT = f"SELECT doc_id, start // 750 AS idx, substr(text, start + 1, 900) AS chunk FROM ({_WINDOWS}) JOIN documents USING (doc_id) WHERE trim(substr(coalesce(text, ''), start + 1, 900)) <> ''"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(chunk.fixed_windows(F.col("text"), 900, 150)).alias("idx", "chunk"))


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, length(chunk) AS char_len, sha256(chunk) AS content_hash, format('{{}}-c{{:03d}}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) AS chunk_id FROM ({_CUT})")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-stride windows with ids and hashes."""
    w = _windows(spark, sf_dir)
    return w.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.length("chunk").alias("char_len"), tx.hashed(F.col("chunk")).alias("content_hash"), F.format_string("%s-c%03d", "doc_id", "idx").alias("chunk_id"))


@query(f"SELECT count(*) AS chunks, round(median(length(chunk)), 2) AS median_len, min(length(chunk)) AS min_len, max(length(chunk)) AS max_len, round(100 * avg((length(chunk) BETWEEN 120 AND 900)::INT), 2) AS pct_in_band, round(100 * avg((length(chunk) BETWEEN 400 AND 900)::INT), 2) AS pct_in_core, 0::BIGINT AS tables, count(DISTINCT source) AS sources FROM ({_CUT}) JOIN documents USING (doc_id)")
def length_band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality summary of windows."""
    w = _windows(spark, sf_dir).select(F.length("chunk").alias("char_len"), F.lit(False).alias("is_table"), F.col("source").alias("source_id"))
    return chunk.quality_summary(w).withColumn("median_len", F.round("median_len", 2))


@query("SELECT length(coalesce(text, '')) // 100 * 100 AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of lengths."""
    bucket = (F.floor(F.length(tx.text_of("text")) / 100) * 100).cast("bigint")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, lines being blocks."""
    docs = table(spark, sf_dir, "documents")
    sources = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("https://example.com/"), F.col("doc_id")).alias("url"), F.lit("sid").alias("doc_type"), F.col("source").alias("scheme"), F.lit("n_a").alias("plan"))
    return chunk.chunk_documents(_lines(spark, sf_dir), sources)


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts, the first of each kind."""
    d = table(spark, sf_dir, "documents").groupBy(tx.hashed(tx.text_of("text")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return d.where("copies > 1")


@query("""
    SELECT conv_id, turn, sum((role IN ('user', 'system'))::INT) OVER w AS section,
           last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS section_heading
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def sections_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is a heading, a system's a table; both open a section."""
    kind = F.when(F.col("role") == "user", "heading").when(F.col("role") == "system", "table").otherwise("text")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), kind.alias("kind"), "text")
    return chunk.section_ids(turns).select(F.col("source_id").alias("conv_id"), F.col("pos").alias("turn"), "section", "section_heading")


@query("SELECT page_id, contains(lower(html), lower(regexp_extract(url, '^[^:/?#]+://([^/?#:.]*)', 1))) AS identifies FROM pages")
def page_identifies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page names the first part of its host, taken as its scheme."""
    host = F.lower(F.regexp_extract("url", "^[^:/?#]+://([^/?#:.]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", chunk.identifies(F.col("html"), host).alias("identifies"))


# -- text functions and guardrails -----------------------------------------------------------------

_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+', chr(92) || '1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_SENTENCES = _SENTENCES.replace("chr(92) || '1' || chr(1)", "'\\1' || chr(1)")


@query(f"SELECT doc_id, len({_SENTENCES.format(c='text')}) AS n_sentences FROM documents")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_sentences(F.col("text")).alias("n_sentences"))


@query(rf"""
    WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS bare, {_SENTENCES.format(c='text')} AS parts FROM documents),
    k AS (SELECT *, array_to_string(parts[1:3], ' ') AS kept FROM s)
    SELECT doc_id, CASE WHEN len(parts) <= 3 THEN bare WHEN regexp_matches(kept, '[.!?]$') THEN kept ELSE kept || '.' END AS capped FROM k""")
def cap_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: first three sentences."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.cap_sentences(F.col("text"), 3).alias("capped"))


_CUTS = " ".join(
    f"WHEN strpos(back, '{b[::-1]}') > 0 AND 420 - strpos(back, '{b[::-1]}') - 1 > 140 THEN 420 - strpos(back, '{b[::-1]}') - 1" for b in (". ", "? ", "! ", "; ", ", ")
)


@query(rf"""
    WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS bare FROM documents),
    w AS (SELECT *, left(bare, 420) AS win, reverse(left(bare, 420)) AS back FROM s),
    c AS (SELECT *, CASE {_CUTS} END AS cut FROM w)
    SELECT doc_id, CASE WHEN length(bare) <= 420 THEN bare WHEN cut IS NOT NULL THEN regexp_replace(left(win, (cut + 1)::BIGINT), '^\s+|\s+$', '', 'g')
           ELSE regexp_replace(regexp_replace(win, '^\s+|\s+$', '', 'g'), '[,;]+$', '') || '...' END AS capped FROM c""")
def cap_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: at most 420 characters, cut where a sentence or clause ends."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.cap_length(F.col("text"), 420).alias("capped"))


_DUCK_PII = {k: p.replace("(?![A-Za-z0-9_])[^0-9\\n]{0,20}", "([^A-Za-z0-9_][^0-9\\n]{0,19})?") for k, p in gr.PII_PATTERNS.items()}
_PII_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in _DUCK_PII.items()) + " END"


@query(f"SELECT doc_id, {_PII_CASE} AS pii FROM documents WHERE {_PII_CASE} IS NOT NULL")
def pii_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: documents with personal data, by the first pattern that matches."""
    return table(spark, sf_dir, "documents").select("doc_id", gr.find_pii(F.col("text")).alias("pii")).where("pii is not null")


@query(f"SELECT source, {_PII_CASE} AS pii, count(*) AS n FROM documents GROUP BY 1, 2")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: counts by source."""
    return table(spark, sf_dir, "documents").groupBy("source", gr.find_pii(F.col("text")).alias("pii")).agg(F.count("*").alias("n"))


#: Triggers that occur in the test conversations.
TRIGGERS = gr.Triggers(advice=("wh\\w*tion", "der (?:die|und)"), performance=("the of", "und", "les"), ambiguous_advice=("der die",), ambiguous_performance=("und",))


@query(r"""
    WITH m AS (SELECT conv_id, turn, {pii} AS pii_pattern,
        regexp_extract(coalesce(text, ''), '(?i)(?:^|[^A-Za-z0-9_])((?:wh[a-zA-Z0-9_]*tion)|(?:der (?:die|und)))(?:[^A-Za-z0-9_]|$)', 1) AS a,
        regexp_extract(coalesce(text, ''), '(?i)(?:^|[^A-Za-z0-9_])((?:the of)|(?:und)|(?:les))(?:[^A-Za-z0-9_]|$)', 1) AS p FROM conversations)
    SELECT conv_id, turn, CASE WHEN pii_pattern IS NOT NULL THEN 'PII' WHEN a <> '' THEN 'ADVICE' WHEN p <> '' THEN 'PERFORMANCE' ELSE 'FACTUAL' END AS verdict,
           CASE WHEN pii_pattern IS NOT NULL THEN NULL WHEN a <> '' THEN lower(a) WHEN p <> '' THEN lower(p) END AS matched,
           CASE WHEN pii_pattern IS NOT NULL THEN false WHEN a <> '' THEN lower(a) = 'der die' WHEN p <> '' THEN lower(p) = 'und' ELSE false END AS escalated,
           CASE WHEN pii_pattern IS NOT NULL THEN 'PII_BLOCKED' WHEN a <> '' THEN 'REFUSE_ADVICE' WHEN p <> '' THEN 'REFUSE_PERFORMANCE' END AS template_id
    FROM m""".replace("{pii}", _PII_CASE))
def screen_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all turns."""
    s = gr.screen(table(spark, sf_dir, "conversations"), "text", TRIGGERS)
    return s.select("conv_id", "turn", "verdict", "matched", "escalated", gr.template_for(F.col("verdict")).alias("template_id"))


_NUMBERS = r"""list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce({c}, ''), '[₹$€£]', ' ', 'g'), '[0-9][0-9,]*(?:\.[0-9]+)?%?'),
    lambda x: (CASE WHEN contains(regexp_replace(x, '[,%]', '', 'g'), '.') THEN regexp_replace(regexp_replace(regexp_replace(x, '[,%]', '', 'g'), '^0+([0-9])', '\1'), '\.?0+$', '') ELSE regexp_replace(regexp_replace(x, '[,%]', '', 'g'), '^0+([0-9])', '\1') END) || (CASE WHEN x LIKE '%\%' ESCAPE '\' THEN '%' ELSE '' END)))"""


@query(f"SELECT doc_id, array_to_string(list_sort({_NUMBERS.format(c='text')}), ' ') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical numbers of documents that have digits."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    return d.select("doc_id", F.array_join(F.array_sort(tx.numeric_tokens(F.col("text"))), " ").alias("numbers"))


@query(f"""
    WITH b AS (SELECT DISTINCT unnest({_NUMBERS.format(c='text')}) AS n FROM benchmark),
    d AS (SELECT doc_id, unnest({_NUMBERS.format(c='text')}) AS n FROM documents)
    SELECT doc_id, count(*) AS n_unsupported, min(n) AS first_unsupported FROM d WHERE n NOT IN (SELECT n FROM b) GROUP BY 1""")
def grounded_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that no benchmark item states."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.numeric_tokens(F.col("text"))).alias("n"))
    b = table(spark, sf_dir, "benchmark").select(F.explode(tx.numeric_tokens(F.col("text"))).alias("n")).distinct()
    return d.join(b, "n", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_unsupported"), F.min("n").alias("first_unsupported"))


@query("SELECT conv_id, turn, substr(sha256(coalesce(text, '')), 1, 12) AS question_hash, length(text) AS question_len FROM conversations WHERE role = 'user'")
def question_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trace keeps of a question."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", tx.short_hash(F.col("text")).alias("question_hash"), F.length("text").alias("question_len"))


# -- answers ---------------------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT source, doc_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
    s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY rank) AS used FROM r)
    SELECT source, doc_id, rank, used FROM s WHERE used <= 12000 OR rank = 1""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: documents of a source that fit the context, in order."""
    docs = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return answer.within_budget(docs, F.length(tx.text_of("text")), 12000, "source").select("source", "doc_id", "rank", "used")


@query(_PAIRS.format(on="true") + """
    , f AS (SELECT query_id, min(rank) FILTER (s >= 0.45 AND label < 5) AS a, min(rank) FILTER (label < 5) AS b FROM r WHERE rank <= 12 GROUP BY 1)
    SELECT f.query_id, r.vec_id AS cited FROM f LEFT JOIN r ON r.query_id = f.query_id AND r.rank = coalesce(a, b)""")
def citation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hit at the floor with a URL, else the first with one; labels under 5 have URLs here."""
    v = table(spark, sf_dir, "embeddings")
    hits = retrieve.top_k(_vector_queries(v), v, 12).withColumn("source_url", F.when(F.col("label") < 5, F.lit("u")))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id", "source_url"))).alias("hits"))
    return listed.select("query_id", answer.pick_citation(F.col("hits"), 0.45)["vec_id"].alias("cited"))


@query()
def respond_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items asked of an index of all documents' chunks."""
    chunks = document_chunks(spark, sf_dir)
    encoder = embed.HashingEmbedder(128)
    vectors = embed.embed(chunks.withColumn("document", embed.embedding_text(F.col("text"), F.col("section_path"))), "document", encoder)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    settings = Settings(similarity_threshold=0.2, citation_score_floor=0.3)
    hits = retrieve.retrieve(asked, vectors, encoder, settings)
    return answer.respond(asked, hits, settings=settings).drop("violations")


# -- memory and sessions ---------------------------------------------------------------------------

#: Subjects that occur in the test conversations.
SUBJECTS = Vocabulary(scheme_aliases={"the": "t", "und": "u", "les": "l"}, plan_aliases={"of": "o", "der": "d"}, scheme_titles={"t": "T", "u": "U", "l": "L"}, plan_titles={"o": "O", "d": ""})
_ALIAS = "regexp_matches(lower(text), '(^|[^a-z]){}([^a-z]|$)')"
_SCHEME = "CASE " + " ".join(f"WHEN {_ALIAS.format(a)} THEN '{t}'" for a, t in (("the", "T"), ("und", "U"), ("les", "L"))) + " END"
_PLAN = "CASE " + " ".join(f"WHEN {_ALIAS.format(a)} THEN '{t}'" for a, t in (("der", ""), ("of", "O"))) + " END"
_SUBJECT = f"CASE WHEN ({_PLAN}) <> '' THEN ({_SCHEME}) || ' (' || ({_PLAN}) || ')' ELSE ({_SCHEME}) END"
_SAID = rf"SELECT *, CASE WHEN role = 'user' THEN {_SUBJECT} END AS subject FROM conversations WHERE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> ''"


@query(f"SELECT conv_id, turn, subject, last_value(subject IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent_subject FROM ({_SAID})")
def last_known_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject that a turn can refer to."""
    return memory.rewritten_turns(table(spark, sf_dir, "conversations"), SUBJECTS).select("conv_id", "turn", "subject", "recent_subject")


@query(rf"""
    WITH s AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare, last_value(subject IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS about, ({_SCHEME}) IS NULL AS open FROM ({_SAID})),
    f AS (SELECT *, open AND (regexp_matches(bare, '(?i)(^|[^a-z0-9_])(its|it|it''s|this|that|these|those|they|them|their|theirs|he|she|her|his)([^a-z0-9_]|$)')
                 OR regexp_matches(bare, '(?i)^\s*(and\s+)?(what|how)\s+about([^a-z0-9_]|$)') OR regexp_matches(bare, '(?i)^\s*(and|also|so|okay\s+and|ok\s+and|and\s+then|then)([^a-z0-9_]|$)')) AS followup FROM s)
    SELECT conv_id, turn, followup, CASE WHEN followup AND about IS NOT NULL THEN about || ': ' || bare ELSE bare END AS standalone FROM f WHERE role = 'user'""")
def followup_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6: follow-ups with their subject in front."""
    turns = memory.rewritten_turns(table(spark, sf_dir, "conversations"), SUBJECTS)
    return turns.where("role = 'user'").select("conv_id", "turn", "followup", "standalone")


@query(r"""
    SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations
    WHERE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '') WHERE place <= 3""")
def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the last three messages of each conversation."""
    return memory.rolling_window(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "place")


_IDLE = "epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, user_id, sum((coalesce(idle, 1800000001) > 1800000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (SELECT *, {_IDLE} AS idle FROM events)")
def sessionize_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: sessions by idle time."""
    return memory.sessionize(table(spark, sf_dir, "events")).select("event_id", "user_id", "session_no")


@query("SELECT user_id, epoch_us(max(ts)) AS last_seen_us, count(*) AS n_events, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS lru_rank FROM events GROUP BY 1 QUALIFY lru_rank <= 64")
def lru_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the 64 users seen last."""
    live = memory.live_sessions(table(spark, sf_dir, "events"))
    return live.select("user_id", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_seen_us"), "n_events", "lru_rank")


@query(f"""
    WITH s AS (SELECT *, sum((coalesce(idle, 1800000000) >= 1800000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, {_IDLE} AS idle FROM events))
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k""")
def stream_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 on a stream: session windows of all events, by a stream run to its end."""
    found = sessions.sessions_of_folder(spark, sf_dir)
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events")


# -- index maintenance -----------------------------------------------------------------------------


@query("""
    WITH n AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE lang <> 'es'),
    o AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'old' ELSE sha256(coalesce(text, '')) END AS h FROM documents d JOIN labels l USING (doc_id))
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS change
    FROM n FULL OUTER JOIN o ON n.doc_id = o.doc_id""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are the old state, toxic ones with other content; Spanish ones are gone now."""
    docs = table(spark, sf_dir, "documents").withColumn("source_id", F.col("doc_id"))
    chunks = docs.select("source_id", F.lit("c").alias("chunk_id"), tx.hashed(tx.text_of("text")).alias("content_hash"), "lang", "doc_id")
    old = chunks.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("content_hash", F.when(F.col("toxic") == 1, "old").otherwise(F.col("content_hash")))
    state = index.state_of(old).withColumn("fingerprint", F.lit("f"))
    return index.difference(index.state_of(chunks.where("lang <> 'es'")), state, "f").withColumnRenamed("source_id", "doc_id")


@query("""
    SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
    AND d.source NOT IN (SELECT source FROM documents WHERE source IN ('src0', 'src1', 'src2'))""")
def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows in no chunk (English documents have some) and of no enabled source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), "lang")
    enabled = docs.where(F.col("source_id").isin("src0", "src1", "src2")).select("source_id").distinct()
    return index.orphans(docs.select("chunk_id", "source_id"), docs.where("lang = 'en'"), enabled).select(F.col("chunk_id").alias("doc_id"))


@query("SELECT source, count(*) AS labelled, sum(quality) AS good, sum(toxic) AS toxic, round(avg(length(text)), 2) AS mean_len FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 in kind: gold labels joined and averaged."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.round(F.avg(F.length("text")), 2).alias("mean_len"))
