import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.sources import fetch, files, health, manifest
from docloom.streaming import sessions

HEAD = "source_id,scheme,plan,doc_type,url,enabled,notes"
GOOD = "s01,large_cap,direct,scheme_page,https://example.com/a,true,note"


def write(tmp_path, *lines):
    path = tmp_path / "sources.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_manifest(spark, tmp_path):
    path = write(tmp_path, HEAD, GOOD, "s02,elss,n_a,sid, https://example.com/b.pdf ,FALSE,")
    rows = manifest.load(spark, path).orderBy("source_id").collect()
    assert [(r.source_id, r.enabled, r.is_pdf, r.file_name) for r in rows] == [("s01", True, False, "a.html"), ("s02", False, True, "b.pdf")]
    assert manifest.load(spark, path, enabled_only=True).count() == 1 and manifest.excluded(manifest.load(spark, path)).count() == 1
    assert {(r.scheme, r.n) for r in manifest.counts_by_scheme(manifest.load(spark, path)).collect()} == {("large_cap", 1), ("elss", 1)}
    assert manifest.catalogue(spark, manifest.load(spark, path)).where("scheme = 'large_cap'").first().doc_types == ["scheme_page"]
    cards = {r.scheme: r for r in manifest.catalogue(spark, manifest.load(spark, path)).collect()}
    assert len(cards) == 5 and cards["elss"].icon == "savings" and cards["elss"].category == "ELSS Tax Saver" and cards["elss"].tagline and cards["elss"].doc_types is None
    assert cards["midcap"].starters[0] == "What is the exit load of the Midcap Fund?" and [len(cards[s].starters) for s in ("midcap", "amc_wide")] == [4, 3]


@pytest.mark.parametrize(
    "row, message",
    [
        (GOOD, "repeated"), ("s02,huge,direct,sid,https://x,true,", "unknown scheme"), ("s02,elss,no,sid,https://x,true,", "unknown plan"),
        ("s02,elss,direct,book,https://x,true,", "unknown doc_type"), ("s02,elss,direct,sid,ftp://x,true,", "http"), ("s02,elss,direct,sid,https://x,maybe,", "enabled"),
        (" ,elss,direct,sid,https://x,true,", "blank"),
    ],
)
def test_bad_manifest(spark, tmp_path, row, message):
    with pytest.raises(manifest.ManifestError, match=message):
        manifest.load(spark, write(tmp_path, HEAD, GOOD, row))


def test_manifest_columns_and_rows(spark, tmp_path):
    with pytest.raises(manifest.ManifestError, match="lacks columns: enabled"):
        manifest.load(spark, write(tmp_path, "source_id,scheme,plan,doc_type,url", "a,elss,direct,sid,https://x"))
    with pytest.raises(manifest.ManifestError, match="no rows"):
        manifest.load(spark, write(tmp_path, HEAD))


def answers(*queue):
    left = list(queue)

    def transport(url, timeout):
        item = left.pop(0)
        if isinstance(item, Exception):
            raise item
        return fetch.Response(*item)

    return transport


@pytest.mark.parametrize(
    "queue, pdf, status, http, error",
    [
        ([(200, "text/html", b"x")], False, "ok", 200, None),
        ([(503, "", b""), (200, "text/html", b"x")], False, "ok", 200, None),
        ([OSError("down"), (200, "text/html", b"x")], False, "ok", 200, None),
        ([OSError("down")] * 3, False, "fetch_failed", None, "OSError: down"),
        ([(404, "", b"x")], False, "fetch_failed", 404, "HTTP 404"),
        ([(200, "text/html", b"")], False, "fetch_failed", 200, "empty body"),
        ([(200, "text/html", b"x")], True, "fetch_failed", 200, "not a PDF: text/html"),
    ],
)
def test_fetch_one(queue, pdf, status, http, error):
    waits = []
    row = fetch.fetch_one("s", "https://x", pdf, answers(*queue), wait=waits.append)
    assert (row[2], row[3], row[8]) == (status, http, error)
    assert waits == [1.0, 2.0][: len(queue) - 1]


def test_fetch_all_and_state(spark):
    sources = spark.createDataFrame([(f"s{k}", f"https://h{k % 2}/p{k}") for k in range(4)], "source_id string, url string")

    def transport(url, timeout):
        return fetch.Response(404 if url.endswith("p3") else 200, "text/html", b"<p>hi</p>")

    known = spark.createDataFrame([("s0", bytearray(b"old"))], "source_id string, content binary")
    rows = {r.source_id: r.status for r in fetch.fetch_all(sources, transport, known, Settings(http_delay_s=0.0), wait=lambda s: None).collect()}
    assert rows == {"s1": "ok", "s2": "ok", "s3": "fetch_failed"}
    told = spark.createDataFrame([("s1", "ok")], "source_id string, status string")
    there = spark.createDataFrame([("s0", 3), ("s2", 0)], "source_id string, length bigint")
    state = {r.source_id: r.fetch_status for r in fetch.fetch_state(sources, told, there).collect()}
    assert state == {"s0": "ok", "s1": "ok", "s2": "fetch_failed", "s3": "fetch_failed"}


def test_files(spark, tmp_path):
    (tmp_path / "raw/s1").mkdir(parents=True)
    (tmp_path / "raw/s1/a.html").write_bytes(b"abc")
    row = files.raw_files(spark, str(tmp_path / "raw")).first()
    assert (row.source_id, row.file_name, row.length) == ("s1", "a.html", 3) and row.content_hash.startswith("ba7816bf")
    (tmp_path / "gold.jsonl").write_text('{"id": "p1", "question": "q", "chunk_ids": ["a"]}\n\n')
    assert files.probes(spark, str(tmp_path / "gold.jsonl")).first().chunk_ids == ["a"]
    with pytest.raises(RuntimeError):
        files.write_chunks(spark.createDataFrame([], "a int"), str(tmp_path / "c"))
    assert files.read_state(spark, str(tmp_path / "none"), "a int").count() == 0
    flags = files.report(spark.createDataFrame([("ok",), ("ok",), ("fetch_failed",)], "flag string"))
    assert {(r.flag, r.n, r.needs_attention) for r in flags.collect()} == {("ok", 2, False), ("fetch_failed", 1, True)}
    assert files.report_lines(spark.createDataFrame([("a|b",)], "x string"), ["x"]).first()[0] == "| a\\|b |"


def test_replace_section():
    text = files.replace_section("# R\n\n## A\nold\n\n## B\nkept\n", "A", "new")
    assert "old" not in text and "## A\nnew" in text and "## B\nkept" in text
    assert files.replace_section("", "A", "x") == "## A\nx\n"


def test_settings_and_health(spark, tmp_path):
    assert Settings.from_env({"DOCLOOM_TOP_K": "5", "DOCLOOM_SIMILARITY_THRESHOLD": "0.2"}).top_k == 5
    with pytest.raises(ValueError):
        Settings.from_env({"DOCLOOM_TOP_K": "many"})
    assert (Settings().top_k, Settings().max_context_chars, Settings().similarity_threshold) == (12, 12000, 0.53)
    found = health.check(spark, write(tmp_path, HEAD, GOOD), {"here": str(tmp_path)})
    assert found["ok"] and found["by_scheme"] == {"large_cap": 1} and found["folders"] == {"here": True}
    assert not health.check(spark, str(tmp_path / "missing.csv"))["ok"]


def test_rolling_memory_stream(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(5)] + [(2, 0, "user", " ")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.rolling_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep=3)
    q = stream.writeStream.outputMode("update").format("memory").queryName("memory_test").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r.conv_id: r.messages for r in spark.table("memory_test").collect()}
    assert rows == {1: ["user\tt2", "user\tt3", "user\tt4"], 2: []}


@pytest.mark.parametrize("files", [1, 6])
def test_session_memory_stream(spark, tmp_path, files):
    """Sessions idle for over the limit begin anew, at the limit they do not; in one batch or several."""
    schema = "session_id string, turn bigint, ts timestamp, role string, text string"
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    gaps = {"a": [0, 10, 1810, 1820], "b": [0, 10, 1811, 1812], "c": [5, 5, 5, 5000], "d": [7, 8, 9, 10]}
    turns = sorted((at(s), name, n, "user", " " if (name, n) == ("d", 1) else f"{name}{n}") for name, times in gaps.items() for n, s in enumerate(times))
    for k in range(files):
        part = [(name, n, t, role, text) for j, (t, name, n, role, text) in enumerate(turns) if j * files // len(turns) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"session_memory_{files}"
    q = sessions.session_memory(read, keep=3, ttl_s=1800, late="1 day").writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table(name).orderBy("last_seen").collect():
        last[r.session_id] = (r.last_seen, [m.split("\t")[1] for m in r.messages])
    assert {s: m for s, (_, m) in last.items()} == {"a": ["a1", "a2", "a3"], "b": ["b2", "b3"], "c": ["c3"], "d": ["d0", "d2", "d3"]}
    assert {s: t for s, (t, _) in last.items()} == {s: at(times[-1]) for s, times in gaps.items()}


def test_window_stream(spark, sf_dir):
    counts = sessions.tumbling_counts(sessions.read_events(spark, sf_dir))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("tumbling_test").trigger(availableNow=True).start()
    q.awaitTermination()
    total = spark.table("tumbling_test").agg(F.sum("n_events")).first()[0]
    assert total == spark.read.parquet(f"{sf_dir}/events.parquet").count()


@pytest.mark.parametrize("parts", [1, 40])
def test_replayed_sessions_are_whole(spark, tmp_path, parts):
    """Files in reverse order of time, in a folder or as one file: no event is late."""
    rows = spark.range(0, 2000, 1, 1).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 10 * (1999 - id)) AS ts", "id % 7 AS user_id", "'a' AS event_type", "1.0D AS value", "'' AS props")
    path = tmp_path / "events.parquet"
    if parts == 1:
        rows.write.parquet(str(tmp_path / "w"))
        next((tmp_path / "w").glob("part-*")).rename(path)
    else:
        for k in range(parts):
            rows.where(f"event_id div 50 = {k}").coalesce(1).write.mode("append").parquet(str(path))
    found = sessions.sessions_of_folder(spark, str(tmp_path)).collect()
    # A user's events are 70 minutes apart: each is a session.
    assert (sum(r.n_events for r in found), len(found)) == (2000, 2000)


def pdf_file(*pages, objects=(), packed=True):
    """A PDF file with the given content streams, one a page."""
    import zlib

    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    parts = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()), (3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")]
    for k, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        flate = b"/Filter /FlateDecode " if packed else b""
        parts.append((10 + 2 * k, f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode()))
        parts.append((11 + 2 * k, b"<< " + flate + f"/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in [*parts, *objects]) + b"trailer << /Root 1 0 R >>\n%%EOF"


ONE = (
    b"BT /F1 18 Tf 72 720 Td (BIG \\(TITLE\\)) Tj ET BT /F1 10 Tf 72 690 Td (4.1 Exit ) Tj (load) Tj 0 -30 Td [(Nil aft) 10 (er a) -300 (year)] TJ 0 -12 Td (and more) Tj ET\n"
    b"BT /F1 10 Tf 1 0 0 1 72 600 Tm (Fund) Tj 1 0 0 1 200 600 Tm (Load) Tj 1 0 0 1 72 588 Tm (Big) Tj 1 0 0 1 200.5 588 Tm (1%) Tj ET"
)


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_reader(packed):
    from docloom.sources import pdf_reader

    cmap = b"<< /Length 99 >>\nstream\n1 beginbfrange <0041> <0043> <0078> endbfrange 1 beginbfchar <0044> <00e90021> endbfchar\nendstream"
    mapped = [(4, b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"), (5, cmap)]
    first, second = pdf_reader.read(pdf_file(ONE, b"BT /F2 10 Tf 72 700 Td <0041004200430044> Tj ET", objects=mapped, packed=packed))
    blocks = {}
    for block, _, text, size in first.spans:
        blocks.setdefault(block, [size, ""])[1] += text
    assert [blocks[k] for k in sorted(blocks)][:3] == [[18.0, "BIG (TITLE)"], [10.0, "4.1 Exit load"], [10.0, "Nil after a year and more"]]
    assert first.tables == [[["Fund", "Load"], ["Big", "1%"]]] and [s[2] for s in second.spans] == ["xyz\u00e9!"]
    for broken in (b"", b"%PDF-1.4 nothing", pdf_file(b""), pdf_file(ONE) + b"/Encrypt 9 0 R"):
        with pytest.raises(pdf_reader.UnreadablePdf):
            pdf_reader.read(broken)


def test_pdf_files_to_blocks(spark):
    from docloom.operators import pdf

    files_ = spark.createDataFrame([("a", bytearray(pdf_file(ONE))), ("b", bytearray(b"%PDF-broken")), ("c", None)], "source_id string, content binary")
    found = pdf.file_blocks(pdf.read_files(files_)).orderBy("source_id", "pos").collect()
    assert [(r.kind, r.text, r.heading_path) for r in found if r.source_id == "a"][:3] == [
        ("heading", "BIG (TITLE)", ["BIG (TITLE)"]), ("heading", "4.1 Exit load", ["BIG (TITLE)", "4.1 Exit load"]), ("text", "Nil after a year and more", ["BIG (TITLE)", "4.1 Exit load"]),
    ]
    assert [r.table_rows for r in found if r.kind == "table"] == [[["Fund", "Load"], ["Big", "1%"]]]
    assert [(r.source_id, r.kind) for r in found if r.source_id != "a"] == [("b", "error"), ("c", "error")]


def test_fetched_bodies_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fetch, "HELD_BYTES", 10)
    sources = spark.createDataFrame([(f"s{k}", f"https://h/p{k}") for k in range(7)], "source_id string, url string")
    rows = fetch.fetch_all(sources, lambda url, timeout: fetch.Response(200, "text/html", b"12345678"), settings=Settings(http_delay_s=0.0), wait=lambda s: None).collect()
    assert sorted((r.source_id, r.status, bytes(r.content)) for r in rows) == [(f"s{k}", "ok", b"12345678") for k in range(7)]


def test_appended_sessions(spark, tmp_path, sf_dir):
    """Sessions that the watermark closes are appended as Parquet; none is open for ever."""
    events = sessions.read_events(spark, sf_dir)
    query = sessions.append_sessions(events, str(tmp_path / "out"), str(tmp_path / "progress"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < closed.agg(F.sum("n_events")).first()[0] <= spark.read.parquet(f"{sf_dir}/events.parquet").count()
