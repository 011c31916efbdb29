import pytest
from pyspark.sql import functions as F

from docloom import __main__ as cli
from docloom.config import Settings
from docloom.operators import embed, index
from docloom.plans import chat, ingest
from docloom.sources import fetch

HEAD = "source_id,scheme,plan,doc_type,url,enabled,notes"
PAGES = {
    "https://example.com/a": "<h1>Large Cap Fund</h1><p>The exit load of the large cap fund is 1% within a year.</p>",
    "https://example.com/b": "<p>The benchmark of the flexi cap fund is a broad index of shares.</p>",
    "https://example.com/c": "<span>x</span>",
}


def transport(url, timeout):
    return fetch.Response(200, "text/html", PAGES[url].encode()) if url in PAGES else fetch.Response(404, "", b"")


def test_build_and_chat(spark, tmp_path):
    path = tmp_path / "sources.csv"
    path.write_text("\n".join([HEAD, "a,large_cap,direct,third_party,https://example.com/a,true,", "b,flexi_cap,direct,third_party,https://example.com/b,true,", "d,elss,n_a,third_party,https://example.com/d,true,"]) + "\n")
    root, settings, encoder = str(tmp_path / "root"), Settings(similarity_threshold=0.05, citation_score_floor=0.05, http_delay_s=0.0), embed.HashingEmbedder(64)
    options = dict(transport=transport, embedder=encoder, settings=settings, wait=lambda s: None)
    first = ingest.build(spark, str(path), root, **options)
    assert (first.added, first.upserted) == (2, 2)
    again = ingest.build(spark, str(path), root, **options)
    assert (again.unchanged, again.upserted) == (2, 0)
    assert ingest.build(spark, str(path), root, only_embed=True, **options).upserted == 0
    assert ingest.build(spark, str(path), root, only_fetch=True, **options) is None
    path.write_text(path.read_text().replace("/b,true", "/b,false"))
    assert ingest.build(spark, str(path), root, **options).pruned == 1
    vectors = index.VectorIndex(spark, f"{root}/index").vectors()
    turns = spark.createDataFrame(
        [(1, 0, "user", "Tell me of the large cap direct plan"), (1, 1, "assistant", "Yes?"), (1, 2, "user", "what is its exit load within a year?"), (1, 3, "user", "should I buy it?")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    found = {r.turn: r for r in chat.respond_turns(turns, vectors, encoder, settings=settings).collect()}
    assert set(found) == {0, 2, 3}
    assert found[2].question == "Large Cap Fund (Direct plan): what is its exit load within a year?"
    assert found[2].template_id == "FACTUAL" and "1%" in found[2].answer and found[2].citation_url == "https://example.com/a"
    assert found[3].template_id == "REFUSE_ADVICE" and found[3].question == "should I buy it?"


def test_fallback_and_preference(spark):
    pages = spark.createDataFrame([("p", "<x"), ("q", "<table><tr><td>only 1 cell</td></tr></table>"), ("r", None)], "source_id string, html string")
    sources = pages.select("source_id", F.lit("elss").alias("scheme"), F.lit("n_a").alias("plan"), F.lit("third_party").alias("doc_type"))
    blocks = ingest.extract(pages, sources)
    assert {r.source_id for r in blocks.collect()} <= {"p", "q"}
    raw = blocks.where("source_id = 'q'")
    assert ingest.preferred(raw.limit(0), raw).count() == raw.count()
    assert ingest.preferred(raw, raw).count() == raw.count()


def test_build_reads_pdf_files_and_says_which_it_cannot(spark, tmp_path):
    from .test_sources import ONE, pdf_file

    bodies = {"https://example.com/kim.pdf": pdf_file(ONE), "https://example.com/bad.pdf": b"%PDF-1.7 broken", "https://example.com/a": PAGES["https://example.com/a"].encode() + b"<p>Latin \xe9 1</p>"}
    path = tmp_path / "sources.csv"
    path.write_text("\n".join([HEAD, "k,elss,n_a,kim,https://example.com/kim.pdf,true,", "x,elss,n_a,sid,https://example.com/bad.pdf,true,", "a,large_cap,direct,third_party,https://example.com/a,true,"]) + "\n")
    send = lambda url, timeout: fetch.Response(200, "application/pdf" if url.endswith("pdf") else "text/html", bodies[url])
    root = str(tmp_path / "root")
    done = ingest.build(spark, str(path), root, transport=send, embedder=embed.HashingEmbedder(16), settings=Settings(http_delay_s=0.0), wait=lambda s: None)
    assert done.added == 2
    kinds = {(r.source_id, r.kind) for r in spark.read.parquet(f"{root}/blocks").collect()}
    assert {("k", "heading"), ("k", "table"), ("k", "text"), ("x", "error")} <= kinds and ("x", "text") not in kinds
    texts = [r.text for r in spark.read.parquet(f"{root}/chunks").where("source_id = 'k'").collect()]
    assert "Latin \ufffd 1" in {r.text for r in spark.read.parquet(f"{root}/blocks").collect()}
    assert any("Fund: Load" in t or "Big: 1%" in t for t in texts)

    def other(data):
        raise ValueError("no reader here")

    ingest.build(spark, str(path), str(tmp_path / "again"), transport=send, embedder=embed.HashingEmbedder(16), settings=Settings(http_delay_s=0.0), wait=lambda s: None, pdf_reader=other)
    told = spark.read.parquet(str(tmp_path / "again/blocks")).where("kind = 'error'").collect()
    assert {r.source_id for r in told} == {"k", "x"} and all("no reader here" in r.text for r in told)


def test_command_line(spark, tmp_path, capsys):
    path, root = tmp_path / "sources.csv", str(tmp_path / "root")
    path.write_text("\n".join([HEAD, "a,large_cap,direct,third_party,https://example.com/a,true,", "b,flexi_cap,direct,third_party,https://example.com/b,true,"]) + "\n")
    settings = Settings(similarity_threshold=0.05, citation_score_floor=0.05, http_delay_s=0.0)
    ingest.build(spark, str(path), root, transport=transport, settings=settings, wait=lambda s: None)
    asked = "what is the exit load of the large cap direct plan within a year?"
    assert cli.main(["search", root, asked, "--threshold", "0.05", "--top-k", "1", "--full"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[:3] == ["verdict FACTUAL", "filter scheme=large_cap, plan=direct", "hits 1 at 0.05"] and "1% within a year" in "\n".join(lines[4:])
    assert cli.main(["search", root, "should I buy it?"]) == 0
    assert capsys.readouterr().out.splitlines() == ["verdict ADVICE by should i"]
    assert cli.main(["ask", root, asked, "--threshold", "0.05", "--no-chunks", "--trace"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[:2] == ["verdict FACTUAL", "template FACTUAL"] and "1%" in lines[2] and '"template_id":"FACTUAL"' in lines[-1] and "exit load" not in lines[-1]
    assert cli.main(["ask", root, "my mail is me@example.com", "--trace"]) == 0
    assert '{"pii_blocked":true,"pattern":"email","at":"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["ask", root])
    said, typed = [], iter(["tell me of the large cap direct plan", "", "what is its exit load within a year?", "/memory", "/reset", "/memory", "/quit"])
    cli.chat(cli.Session(spark, root, settings), False, False, lambda prompt: next(typed), said.append)
    assert "searched as: Large Cap Fund (Direct plan): what is its exit load within a year?" in said
    assert "4/10 messages" in said and said[-2:] == ["nothing is remembered", "0/10 messages"]
