import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions import guardrails as gr
from docloom.operators import answer, chunk, embed, embedded, evaluate, extract_html, index, memory, normalize, pdf, retrieve, tables


# -- tables and chunks -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "rows, heading, expected",
    [
        ([["", "Direct Growth", "Regular Growth"], ["Expense ratio", "0.95%", "1.95%"]], "Fees", ["Fees", "Expense ratio (Direct Growth): 0.95%", "Expense ratio (Regular Growth): 1.95%"]),
        ([["Exit load", "Nil"], ["Minimum SIP", "Rs. 500"]], "", ["Exit load: Nil", "Minimum SIP: Rs. 500"]),
        ([["Since Inception", "13.74%", "12.72%", "12.13%"], ["1 Year", "3.21%", "1.99%", "-0.35%"]], "Returns", ["Returns", "Since Inception: 13.74% | 12.72% | 12.13%", "1 Year: 3.21% | 1.99% | -0.35%"]),
        ([["Fund", "IDCW (Per Unit)", "NAV"], ["Big Large Cap", "1.97", "27.08"]], "IDCW", ["IDCW", "Big Large Cap - IDCW (Per Unit): 1.97", "Big Large Cap (NAV): 27.08"]),
        ([["", ""], ["", ""]], "Fees", ["Fees"]),
        ([["Name of Fund", ":", "Big Fund"]], "About", ["About", "Name of Fund: Big Fund"]),
        ([], "", [""]),
    ],
)
def test_flatten(rows, heading, expected):
    assert tables.flatten(rows, heading).split("\n") == expected


def test_flatten_two_header_rows():
    rows = [["Record Date", "Option", "Option"], ["", "Individuals/HUF", "Others"], ["2026-01-20", "Interest", "Dividend"]]
    assert "2026-01-20 (Option Others): Dividend" in tables.flatten(rows, "IDCW").split("\n")


def test_flatten_column(spark):
    df = spark.createDataFrame([([["a", "1"], ["b", "2"]], "H"), (None, None)], "r array<array<string>>, h string")
    assert [r[0] for r in df.select(tables.flatten_column(F.col("r"), F.col("h"))).collect()] == ["H\na: 1\nb: 2", ""]


@given(st.text(alphabet="ab .\n!", max_size=400), st.integers(10, 60))
@settings(max_examples=100, deadline=None)
def test_split_keeps_all_text(text, size):
    parts = chunk.split_text(text, size, 0)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_split_falls_back_to_hard_windows():
    assert [len(w) for w in chunk.split_text("x" * 1000, 900, 150)] == [900, 250]
    assert chunk.split_text("", 10, 2) == []


def test_carry_moves_text_and_loses_none():
    text = " ".join(f"Sentence number {k} is here." for k in range(30))
    parts = chunk.split_text(text, 100, 40)
    assert "".join("".join(parts).split()) == "".join(text.split())


def doc(kind, text="", rows=None, path=(), page=None):
    return {"kind": kind, "text": text, "table_rows": rows, "heading_path": list(path), "page_num": page}


def test_chunk_big_table_keeps_rows_whole_and_in_order():
    rows = [["Fund", "Load", "Ratio"], *([f"Fund {k}", f"{k}%", f"{k}.5%"] for k in range(400))]
    drafts = chunk.chunk_blocks([doc("table", rows=rows, path=["Fees"])], "Title")
    assert all(len(d.text) <= 900 and d.text.startswith("Title\nFees\n") for d in drafts)
    lines = [x for d in drafts for x in d.text.split("\n")[2:]]
    assert lines == tables.flatten(rows).split("\n")
    assert [d.table for d in drafts] == [(k + 1, len(drafts)) for k in range(len(drafts))]


def test_short_chunks_merge_but_not_into_tables():
    d = chunk.Draft
    out = chunk.merge_short([d("t" * 200, [], None, (1, 1)), d("tiny", [], None), d("p" * 200, [], None)], 120, 900)
    assert [x.text for x in out] == ["t" * 200, "tiny\n\n" + "p" * 200]


def test_chunk_documents(spark):
    blocks = spark.createDataFrame(
        [("s1", 0, "heading", "Load", ["Load"], 1, None), ("s1", 1, "text", "Nil after a year. " * 80, ["Load"], 2, None), ("s1", 2, "table", "", ["Load"], None, [["a", "1"], ["b", "2"]])],
        normalize.BLOCK,
    )
    sources = spark.createDataFrame([("s1", "https://x/Fact_Sheet_July_2026.pdf", "sid", "elss", "direct")], "source_id string, url string, doc_type string, scheme string, plan string")
    rows = chunk.chunk_documents(blocks, sources).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].is_table and rows[0].text.endswith("a: 1\nb: 2")
    assert rows[1].page_num == 2 and rows[1].source_date == "July 2026" and rows[1].section_path == "ELSS Tax Saver Fund - Direct plan > Load"
    assert all(r.char_len == len(r.text) <= 902 for r in rows)
    assert chunk.quality_summary(chunk.chunk_documents(blocks, sources)).first().sources == 1


# -- normalization ---------------------------------------------------------------------------------


def blocks(spark, *rows):
    full = [("s", k, *r) if len(r) == 5 else ("s", k, r[0], r[1], [], r[2] if len(r) > 2 else None, None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, normalize.BLOCK)


def texts(df):
    return [r.text for r in df.orderBy("pos").collect()]


def test_normalize_rules(spark):
    assert texts(normalize.whitespace_rule(blocks(spark, ("text", "a\n\n\n\n\nb"), ("text", "Ratio   x \t\t 0.9")))) == ["a\n\nb", "Ratio x 0.9"]
    assert texts(normalize.dehyphenate_rule(blocks(spark, ("text", "invest-"), ("text", "ment is long-"), ("text", "term"), ("text", "x-"), ("heading", "y")))) == ["investment is longterm", "x-", "y"]
    assert texts(normalize.orphan_rule(blocks(spark, *(("text", x) for x in ("12", "1,234", "3.5", "-", "()", "N/A for this scheme"))))) == ["N/A for this scheme"]
    kept = normalize.boilerplate_rule(blocks(spark, ("text", "Exit load NIL Tax implication Click here to view the tax."), ("text", "Read more"), ("text", "Big Midcap Fund " + "." * 30 + "(120) 14"), ("text", "Invest now")))
    assert texts(kept) == ["Exit load NIL Tax implication to view the tax."]


def test_furniture(spark):
    pages = [("text", t, p) for p in (1, 2, 3) for t in (f"Page {p} of 3", "www.example.com", "prose that recurs", f"own {p}")]
    assert texts(normalize.furniture_rule(blocks(spark, *pages))) == [t for p in (1, 2, 3) for t in ("prose that recurs", f"own {p}")]
    single = blocks(spark, ("text", "www.example.com", 1))
    assert texts(normalize.furniture_rule(single)) == ["www.example.com"]
    assert texts(normalize.furniture_rule(blocks(spark, *(("text", "Big Fund House", p) for p in (1, 2))), pattern=normalize.furniture_pattern("big fund house"))) == []


def test_normalize_is_idempotent(spark):
    raw = blocks(spark, ("text", "Café  ­x-"), ("text", "ray   day"), ("text", "Page 1", 1), ("text", "Page 2", 2), ("table", "", ["H"], None, [["a Invest Now", "b c"]]))
    once = normalize.normalize_blocks(raw)
    again = normalize.normalize_blocks(once)
    show = lambda df: [(r.pos, r.text, r.table_rows) for r in df.orderBy("pos").collect()]
    assert show(once) == show(again)
    assert show(once)[0][1] == "Café xray day" and show(once)[-1][2] == [["a", "b c"]]
    assert [(r.blocks_before, r.blocks_after) for r in normalize.before_and_after(raw, once).collect()] == [(5, 2)]


# -- extraction ------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>x</style></head><body><nav>menu items</nav><!-- ad -->
<h1>Large Cap</h1><h2>Fees</h2><table><tr><th>a</th><th>b</th></tr><tr><td>Load<td>1%</table>
<p>First para<p>Second <b>bold</b> para<ul><li>one item<li>two item</ul><div class="my-footer">no</div><footer>no</footer></body></html>"""


def test_html_blocks():
    found = [(b["kind"], b["text"], b["heading_path"]) for b in extract_html.blocks_of(PAGE)]
    assert ("heading", "Large Cap", ["Large Cap"]) in found and ("heading", "Fees", ["Large Cap", "Fees"]) in found
    assert ("text", "First para", ["Fees"]) in found and ("text", "Second bold para", ["Fees"]) in found
    assert [t for k, t, _ in found if k == "list"] == ["one item", "two item"]
    assert [b["table_rows"] for b in extract_html.blocks_of(PAGE) if b["kind"] == "table"] == [[["a", "b"], ["Load", "1%"]]]
    assert not any(w in t for _, t, _ in found for w in ("menu", "no", "ad"))
    assert extract_html.blocks_of(None) == [] and extract_html.blocks_of("<<<>>&&") is not None


def push(payload):
    return "<script>self.__next_f.push(" + json.dumps([1, "1:" + json.dumps(payload)]) + ")</script>"


FUND = {
    "schemeName": "Big Fund", "planType": "Direct", "expenseRatio": "0.92", "exitLoad": "No exit load after 1 week", "benchmark": "BROAD 100", "riskType": "Very High", "sip": "100.0",
    "schemeDescription": "A saving scheme with a statutory lock in of 3 years", "aum": "N/A",
    "minimumInvestment": {"lumpsum": 500, "sip": "500.0", "sipDaily": "500.0", "additionalInvestment": "-"},
    "riskometerDetails": {"riskDescription": "<ul><li>Growth over time.</li></ul>", "benchmark": "BROAD 500", "benchmarkRiskStatus": "Very High"},
}


def test_facts():
    facts = embedded.facts_of(push(FUND))
    assert facts == {
        "Lump sum": "500", "SIP": "500.0", "Daily SIP": "500.0", "Benchmark index": "BROAD 500", "Benchmark risk status": "Very High", "Risk profile": "Growth over time.",
        "Scheme name": "Big Fund", "Plan type": "Direct", "Expense ratio": "0.92", "Exit load": "No exit load after 1 week", "Benchmark": "BROAD 100", "Riskometer category": "Very High",
        "Minimum SIP": "100.0", "Scheme description": "A saving scheme with a statutory lock in of 3 years",
    }
    rows = embedded.fact_rows(facts, "Big Fund", "Direct")
    assert rows[0] == ["Big Fund (Direct plan) - key facts", ""] and ["Expense ratio", "0.92"] in rows and all(len(r) == 2 for r in rows)
    assert embedded.fact_rows({}, "x", "Direct") == []
    # Of flat facts the first stays, of grouped ones the last; a payload that names no ratio and no riskometer is not read.
    twice = embedded.facts_of(push({"expenseRatio": "1", "a": [{"expenseRatio": "2", "minimumInvestment": {"sip": "5"}}, {"minimumInvestment": {"sip": "6"}}]}))
    assert twice == {"Expense ratio": "1", "SIP": "6", "Minimum SIP": "5"}  # a group's keys are read as flat ones too
    assert embedded.facts_of(push({"exitLoad": "1%"})) == {}
    assert embedded.facts_of("<script>expenseRatio(broken</script>") == {} == embedded.facts_of("<p>nothing here</p>")


@pytest.mark.parametrize("value, told", [("<ul><li>alpha</li><li>beta</li></ul>", "alpha | beta"), ("plain  text", "plain text"), ("| a|b |", "a | b"), ("a || b", "a |  | b"), (7, "7"), (" | ", "")])
def test_plain(value, told):
    assert embedded.plain(value) == told


@pytest.mark.parametrize("value, said", [("0.92", True), (0, True), ("N/A", False), ("null", False), ("", False), ("   ", False), ({"a": 1}, False), ([1], False), (None, False)])
def test_usable(value, said):
    assert embedded.usable(value) is said


def test_faqs_tax_rows_and_cards():
    asked = {"mainEntity": [{"name": "What <b>is</b> it?", "acceptedAnswer": {"text": "A fund."}}, {"name": "", "acceptedAnswer": {"text": "x"}}, {"name": "No answer", "acceptedAnswer": "text"}, 5]}
    faq = '<script type="application/ld+json" id="json-ld-faqsSchema">' + json.dumps(asked) + "</script>"
    assert embedded.faqs_of(faq) == [("What | is | it?", "A fund.")] and embedded.faqs_of("<html>") == [] and embedded.faqs_of(faq.replace("{", "", 1)) == []
    taxed = {"expenseRatio": "1", "late": {"taxImplication": [{"title": "t", "description": "<i>d</i>"}, {"title": "t2"}]}, "later": {"taxImplication": []}, "last": {"taxImplication": [{"title": " ", "description": "blank"}]}}
    assert embedded.tax_rows(push(taxed)) == [["t", "d"]] and embedded.tax_rows(push(FUND)) == []
    card = {"title": "Card", "description": "Does <b>it</b>"}
    for key in ("link", "linkOne", "linkTwo", "postLogin", "webpIcon", "icon", "mobileEnabled"):
        assert len(embedded.cards_of(push({"deep": [{"er": card | {key: "/l"}}]}))) == 1
    for key in ("image", "ctaText", "name"):
        assert embedded.cards_of(push([card | {key: "/l"}])) == []
    assert embedded.cards_of(push({"a": [card | {"linkOne": "/1"}], "b": [card | {"link": "/2"}]})) == [("Card", "Does | it", "/1")]


def test_payloads_at_any_depth_and_unreadable_ones(spark):
    deep = push(["x"]).replace("x", "[" * 400 + "]" * 400)
    assert embedded.cards_of(push(json.loads("[" * 300 + json.dumps({"title": "t", "description": "d", "icon": ""}) + "]" * 300))) == [("t", "d", "")]
    hopeless = "<script>self.__next_f.push([1, " + json.dumps('1:{"expenseRatio": ' + "[" * 200_000 + "]" * 200_000 + "}") + "])</script>"
    assert embedded.facts_of(deep) == {}
    pages = spark.createDataFrame([(1, push({"expenseRatio": "1%"})), (2, None), (3, hopeless)], "page_id bigint, html string")
    sources = spark.createDataFrame([(k, "elss", "direct", "downloads") for k in "123"], "source_id string, scheme string, plan string, doc_type string")
    rows = embedded.embedded_blocks(pages, sources).collect()
    assert [(r.source_id, r.table_rows) for r in rows if r.kind == "table"] == [("1", [["ELSS Tax Saver Fund (Direct plan) - key facts", ""], ["Expense ratio", "1%"]])]
    assert {(r.source_id, r.kind) for r in rows if r.source_id != "1"} == {("3", "error")} and all("nested too deeply" in r.text for r in rows if r.kind == "error")


def test_long_texts_come_in_blocks():
    """Items, bare texts and paragraphs longer than a block lose nothing."""
    sentence = "Some words that go on for a while. "
    long = (sentence * 400).strip()
    for html, kind in ((f"<ul><li>{long}</li></ul>", "list"), (long, "text"), (f"<p>{long}</p>", "text"), (f"<div><span>{'x' * 9000}</span></div>", "text")):
        found = extract_html.blocks_of(html)
        whole = long if "x" * 9 not in html else "x" * 9000
        assert len(found) > 1 and {b["kind"] for b in found} == {kind} and all(len(b["text"]) <= extract_html.MAX_BLOCK for b in found)
        assert "".join("".join(b["text"] for b in found).split()) == "".join(whole.split())
    assert all(b["text"].endswith(".") for b in extract_html.blocks_of(long))


def test_pdf_spans(spark):
    spans = spark.createDataFrame(
        [("d", 1, 0, 0, "BIG TITLE", 18.0), ("d", 1, 1, 0, "4.1 Exit ", 10.0), ("d", 1, 1, 1, "load", 10.0), ("d", 1, 2, 0, "Nil after a year", 10.0), ("d", 2, 0, 0, "more prose here", 10.0), ("d", 2, 1, 0, " ", 10.0)],
        "source_id string, page_num int, block_no int, span_no int, text string, size double",
    )
    rows = pdf.span_blocks(spans).orderBy("pos").collect()
    assert [(r.kind, r.text, r.heading_path) for r in rows] == [
        ("heading", "BIG TITLE", ["BIG TITLE"]), ("heading", "4.1 Exit load", ["BIG TITLE", "4.1 Exit load"]),
        ("text", "Nil after a year", ["BIG TITLE", "4.1 Exit load"]), ("text", "more prose here", []),
    ]


def test_pdf_tables_follow_their_page(spark):
    spans = spark.createDataFrame([("d", 1, 0, 0, "BIG TITLE", 18.0), ("d", 1, 1, 0, "some prose", 10.0), ("d", 2, 0, 0, "more prose", 10.0)], "source_id string, page_num int, block_no int, span_no int, text string, size double")
    tables_ = spark.createDataFrame([("d", 1, 0, [["a ", "b"], ["1"]]), ("d", 1, 1, [["lone row", "x"]]), ("d", 3, 0, [["c", "d"], ["e", "f"]])], "source_id string, page_num int, table_no int, table_rows array<array<string>>")
    found = [(r.pos, r.kind, r.text, r.heading_path, r.page_num, r.table_rows) for r in pdf.span_blocks(spans, tables_).orderBy("pos").collect()]
    assert found == [
        (0, "heading", "BIG TITLE", ["BIG TITLE"], 1, None), (1, "text", "some prose", ["BIG TITLE"], 1, None), (2, "table", "", ["BIG TITLE"], 1, [["a", "b"], ["1", ""]]),
        (3, "text", "more prose", [], 2, None), (4, "table", "", [], 3, [["c", "d"], ["e", "f"]]),
    ]


def test_split_keeps_words_apart():
    """Where a long unit was cut at weaker separators, what follows it is not glued to it."""
    for size, overlap in ((30, 0), (30, 12), (60, 20)):
        text = "\n\n".join(f"Part {k} has words, then more. And {'some ' * (k % 9)}end." for k in range(20))
        assert " ".join(" ".join(chunk.split_text(text, size, overlap)).split()) == " ".join(text.split())


def test_top_k_of_many_queries_in_passes(spark, monkeypatch):
    """Ties by id, filters before the search, zero vectors, and more queries than one pass takes."""
    import random

    rng = random.Random(3)
    vectors = [(k, [float(rng.randint(-2, 2)) for _ in range(6)], f"s{k % 3}", "n_a" if k % 4 == 0 else f"p{k % 2}") for k in range(300)] + [(900, None, "s1", "p1")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, scheme string, plan string").repartition(7)
    asked = [(q, [float(rng.randint(-2, 2)) for _ in range(6)], [None, "s0", "s1"][q % 3], [None, "p0"][q % 2]) for q in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>, want_scheme string, want_plan string")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))

    def cosine(a, b):
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if b and dot(a, a) * dot(b, b) else 0.0

    want = set()
    for q, qv, scheme, plan in asked:
        fit = [(-round(cosine(qv, v), 12), k) for k, v, s, p in vectors if scheme in (None, s) and (plan is None or p in (plan, "n_a"))]
        want |= {(q, k, r) for r, (_, k) in enumerate(sorted(fit)[:5], 1)}
    for size in (32 << 20, 2000):
        monkeypatch.setattr(retrieve, "BROADCAST_BYTES", size)
        found = retrieve.top_k(queries, df, 5, matches=retrieve.ADMITS)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want
        joined = queries.join(df, retrieve.admits()).select("query_id", "vec_id").count()
        assert joined == retrieve.top_k(queries, df, 1000, matches=retrieve.ADMITS).count()
    assert retrieve.top_k(queries.limit(0), df, 5).count() == 0 == retrieve.top_k(queries, df.limit(0), 5).count()


def test_verify_reads_compatibility_forms_and_own_suffixes(spark):
    told = lambda body, context, **more: spark.range(1).select(gr.verify(F.lit(body), F.array(F.lit(context)), F.lit("FACTUAL"), F.lit(None).cast("string"), F.array().cast("array<string>"), **more).alias("v")).first().v
    assert told("It is \uff15\uff10\uff10.", "Rs. 500 at least").ok and told("It is 500.", "\uff15\uff10\uff10").ok
    assert told("It is 501.", "Rs. 500").violations == ["NOT_FOUND"]
    assert spark.range(1).select(gr.without_suffixes(F.lit("A. See https://x/9 now"), F.lit("https://x/9"), F.lit(None).cast("string"))).first()[0].split() == ["A.", "See", "now"]

    class Linking:
        def reply(self, question, context):
            return "The exit load is 1% within a year. https://x/77"

    e = embed.HashingEmbedder(64)
    rows = chunks(spark, ("77", 0, "The exit load is 1% within a year."))
    vectors = embed.embed(rows.withColumn("document", F.col("text")), "document", e)
    asked = spark.createDataFrame([(1, "What is the exit load within a year?")], "query_id bigint, question string")
    s = Settings(similarity_threshold=0.1, citation_score_floor=0.1)
    assert answer.respond(asked, retrieve.retrieve(asked, vectors, e, s), Linking(), s).first().template_id == "FACTUAL"


@pytest.mark.parametrize(
    "status, n, facts, tables_, chars, kind, flag",
    [
        ("fetch_failed", 3, True, 1, 9, "sid", "fetch_failed"), ("ok", 0, False, 0, 0, "sid", "extract_failed"), ("ok", 1, True, 0, 5, "scheme_page", "ok"),
        ("ok", 1, False, 0, 9000, "scheme_page", "suspected_client_rendered"), ("ok", 1, False, 0, 10, "sid", "suspected_client_rendered"),
        ("ok", 1, False, 1, 10, "sid", "ok"), ("ok", 1, False, 0, 9000, "sid", "ok"),
    ],
)
def test_classify(spark, status, n, facts, tables_, chars, kind, flag):
    row = spark.range(1).select(extract_html.classify(*map(F.lit, (status, n, facts, tables_, chars, kind))).alias("f")).first()
    assert row.f == flag


# -- index, retrieval, answers ---------------------------------------------------------------------


def chunks(spark, *rows):
    full = [(f"{s}-c{k:03d}", s, t, "", tuple_[0], tuple_[1]) for s, k, t, *tuple_ in (r if len(r) == 5 else (*r, "elss", "direct") for r in rows)]
    return spark.createDataFrame(full, "chunk_id string, source_id string, text string, section_path string, scheme string, plan string").withColumns(
        {"content_hash": F.sha2("text", 256), "source_url": F.concat(F.lit("https://x/"), "source_id"), "source_title": F.col("source_id"), "source_date": F.lit("July 2026"), "doc_type": F.lit("sid"), "page_num": F.lit(1)}
    )


def test_index_life_cycle(spark, tmp_path):
    store = index.VectorIndex(spark, str(tmp_path / "index"))
    e = embed.HashingEmbedder(16)
    first = chunks(spark, ("a", 0, "exit load is nil"), ("b", 0, "expense ratio is low"))
    got = store.ingest(first, e)
    assert (got.added, got.upserted) == (2, 2)
    assert store.ingest(first, e).upserted == 0 and store.version == 1
    second = chunks(spark, ("a", 0, "exit load is one per cent"), ("b", 0, "expense ratio is low"))
    got = store.ingest(second, e)
    assert (got.changed, got.unchanged, got.upserted) == (1, 1, 1) and store.vectors().count() == 2
    with pytest.raises(RuntimeError):
        store.check(embed.HashingEmbedder(8))
    other = embed.HashingEmbedder(8)
    got = store.ingest(second, other)
    assert got.rebuilt and got.upserted == 2 and store.fingerprint() == other.fingerprint
    only = second.where("source_id = 'a'")
    got = store.ingest(only, other, enabled=spark.createDataFrame([("a",)], "source_id string"))
    assert got.pruned == 1 and [r.source_id for r in store.vectors().collect()] == ["a"]
    with pytest.raises(RuntimeError):
        store.ingest(only.limit(0), other)


def test_embeddings_are_unit_and_stable():
    e = embed.HashingEmbedder(32)
    a, b, c = e.encode(["exit load", "exit load", ""])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(c)


def test_alias_and_filter(spark):
    df = spark.createDataFrame([("Flexi Cap Fund minimum SIP",), ("Direct plan exit load",), ("mid cap direct",), ("nothing",), ("indirect",), (None,)], "question string")
    assert [(r.want_scheme, r.want_plan) for r in retrieve.resolve(df).collect()] == [("flexi_cap", None), (None, "direct"), ("midcap", "direct"), (None, None), (None, None), (None, None)]


def test_retrieve_and_respond(spark):
    e = embed.HashingEmbedder(64)
    rows = chunks(spark, ("a", 0, "The exit load is 1% within a year."), ("b", 0, "The benchmark is broad."), ("c", 0, "Exit load regular is 2%.", "elss", "regular"))
    vectors = embed.embed(rows.withColumn("document", F.col("text")), "document", e)
    asked = spark.createDataFrame([(1, "What is the exit load within a year, direct?"), (2, "Should I buy?"), (3, "zzz qqq"), (4, "mail me at a@b.co")], "query_id bigint, question string")
    s = Settings(similarity_threshold=0.1, citation_score_floor=0.1)
    hits = retrieve.retrieve(asked, vectors, e, s)
    assert {r.plan for r in hits.where("query_id = 1").collect()} == {"direct"}
    out = {r.query_id: r for r in answer.respond(asked, hits, settings=s).collect()}
    assert out[1].template_id == "FACTUAL" and "1%" in out[1].answer and out[1].chunk_id == "a-c000" and out[1].citation_url == "https://x/a"
    assert out[1].last_updated == "Last updated from sources: July 2026"
    assert (out[2].template_id, out[3].template_id, out[4].template_id) == ("REFUSE_ADVICE", "NO_RETRIEVAL", "PII_BLOCKED")
    traces = [r.value for r in answer.trace_rows(answer.respond(asked, hits, settings=s)).collect()]
    assert len(traces) == 4 and not any("exit load" in t or "a@b" in t for t in traces)

    class Liar:
        def reply(self, question, context):
            return "The load is 7%."

    assert answer.respond(asked, hits, Liar(), s).where("query_id = 1").first().template_id == "NOT_FOUND"


def test_context_is_a_prefix(spark):
    hits = spark.createDataFrame([(1, k, "x" * n) for k, n in ((1, 50), (2, 30), (3, 30), (4, 1))], "q int, rank int, t string")
    assert [r.rank for r in answer.within_budget(hits, F.length("t"), 100, "q").orderBy("rank").collect()] == [1, 2]
    assert [r.rank for r in answer.within_budget(hits, F.length("t"), 10, "q").collect()] == [1]


def test_render_unknown_template(spark):
    with pytest.raises(Exception, match="unknown template"):
        spark.range(1).select(answer.render(F.lit("NOPE"), F.lit(""))).collect()


def test_last_updated_by_calendar(spark):
    dates = F.array(F.lit("July 2025"), F.lit("April 2026"), F.lit(None))
    assert spark.range(1).select(answer.last_updated(dates)).first()[0].endswith("April 2026")
    assert spark.range(1).select(answer.last_updated(F.array(F.lit(None).cast("string")))).first()[0].endswith("date not stated on page")


def test_evaluate(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "c", 0.7, 1)], "query_id int, chunk_id string, score double, rank int")
    gold = spark.createDataFrame([(1, ["b", "z"]), (2, ["x"])], "query_id int, chunk_ids array<string>")
    result = evaluate.recall(hits, gold, 5)
    assert {(r.query_id, r.found, r.matched_score) for r in result.collect()} == {(1, True, 0.8), (2, False, 0.0)}
    assert evaluate.summary(result).first().mrr == 0.25
    c = evaluate.calibrate(result, hits.where("query_id = 2")).first()
    assert (c.lowest_positive, c.highest_negative, c.threshold, c.separable) == (0.8, 0.7, 0.75, True)
    assert evaluate.calibrate(result.limit(0), hits.limit(0)).first().threshold == 0.5


# -- memory ----------------------------------------------------------------------------------------


def test_followups(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "What is the exit load on the Flexi Cap Direct plan?"), (1, 1, "assistant", "Nil."), (1, 2, "user", "thanks"), (1, 3, "user", " "), (1, 4, "user", "what about its fees?"), (2, 0, "user", "and the load?")],
        "conv_id int, turn int, role string, text string",
    )
    rows = {(r.conv_id, r.turn): r for r in memory.rewritten_turns(turns).collect()}
    assert rows[1, 4].standalone == "Flexi Cap Fund (Direct plan): what about its fees?"
    assert rows[1, 2].standalone == "thanks" and (1, 3) not in rows
    assert rows[2, 0].followup and rows[2, 0].standalone == "and the load?"
    assert spark.range(1).select(memory.is_followup(F.lit("is that eligible for 80C?"))).first()[0] is False
    assert [r.turn for r in memory.rolling_window(turns, 2).where("conv_id = 1").orderBy("place").collect()] == [4, 2]


def test_sessions(spark):
    rows = [(k, t, 7) for k, t in enumerate(("2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-01 01:00:01"))]
    events = spark.createDataFrame(rows, "event_id int, t string, user_id int").withColumn("ts", F.to_timestamp("t"))
    assert [r.session_no for r in memory.sessionize(events).orderBy("event_id").collect()] == [1, 1, 2]
    ok = spark.range(1).select(memory.valid_session(F.lit("0" * 32)), memory.valid_session(F.lit("X" * 32)), memory.valid_session(F.lit(None).cast("string"))).first()
    assert list(ok) == [True, False, False]


def test_triggers_are_parameters(spark):
    df = spark.createDataFrame([("zap it",)], "v string")
    assert gr.screen(df, "v", gr.Triggers(advice=("zap",))).first().verdict == "ADVICE"


def test_blocks_at_any_depth():
    """Nested below 200 and 3,000 levels of a page too long for one block."""
    for depth in (250, 3000):
        found = extract_html.blocks_of("<h2>Top</h2>" + "<p>" + "long text " * 450 + "<b>" * depth + "deep words" + "</b>" * depth + "<i>after</i></p>")
        assert [(b["text"], b["heading_path"]) for b in found][-2:] == [("deep words", ["Top"]), ("after", ["Top"])]


@pytest.mark.parametrize("cells, passes", [(1 << 22, 32 << 20), (7, 300)])
def test_lexical_top_k_is_the_brute_force(spark, monkeypatch, cells, passes):
    """Blocks of one document, several passes, ties, texts and questions without words."""
    monkeypatch.setattr(retrieve, "BLOCK_CELLS", cells)
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", passes)
    dice = random.Random(5)
    words = [f"word{k}" for k in range(30)]
    docs = [(k, " ".join(dice.choices(words, k=dice.randint(1, 12)))) for k in range(40)] + [(40, None), (41, ""), (42, "word1 " * 500)]
    asked = [(k, " ".join(dice.choices(words, k=4))) for k in range(9)] + [(9, ""), (10, None), (11, "nothing alike")]
    found = retrieve.lexical_top_k(
        spark.createDataFrame(asked, "query_id bigint, question string"), spark.createDataFrame(docs, "doc_id bigint, body string").repartition(3), 5
    ).collect()
    want = set()
    for q, question in asked:
        terms = set((question or "").split())
        alike = sorted((-len(terms & set((body or "").split())), d) for d, body in docs)
        want |= {(q, d, -n, len(terms), k + 1) for k, (n, d) in enumerate([x for x in alike if x[0]][:5])}
    assert {(r.query_id, r.doc_id, r.n_shared, r.n_terms, r["rank"]) for r in found} == want
    assert len(found) == len(want) and all(r.score == r.n_shared / r.n_terms for r in found)
    none = spark.createDataFrame([], "doc_id bigint, body string")
    assert retrieve.lexical_top_k(spark.createDataFrame(asked, "query_id bigint, question string"), none, 5).collect() == []


def test_references_end_in_semicolons():
    """An entity cut short is text, as the SQL of page_blocks has it."""
    found = extract_html.blocks_of("<h1>a &amp;&amp</h1><p>x &lt y &#x27 z &#39; &quot;q&quot; &amp;lt;</p><p>ends in &am")
    assert [b["text"] for b in found] == ["a &&amp", "x &lt y &#x27 z ' \"q\" &lt;", "ends in &am"]
