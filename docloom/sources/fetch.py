"""Fetching of sources through a pluggable transport; failures are rows, not exceptions."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import SETTINGS, Settings
from docloom.functions import urls

#: Bytes of bodies that a task holds before it passes them on.
HELD_BYTES = 32 << 20
RETRY = {408, 425, 429, 500, 502, 503, 504}
RESULT = (
    "source_id string, url string, status string, http_status int, byte_size bigint, content_hash string,"
    " fetched_at string, content binary, error string"
)


@dataclass
class Response:
    status: int
    content_type: str
    body: bytes


Transport = Callable[[str, float], Response]


def http(url: str, timeout: float) -> Response:
    """Transport over HTTP; redirects are followed."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "docloom"}), timeout=timeout) as r:
            return Response(r.status, r.headers.get("Content-Type", ""), r.read())
    except urllib.error.HTTPError as e:
        return Response(e.code, e.headers.get("Content-Type", ""), b"")


def fetch_one(source_id: str, url: str, pdf: bool, transport: Transport, settings: Settings = SETTINGS, wait: Callable[[float], None] = time.sleep) -> tuple:
    """Row of one source: retried with growing waits, failed on errors, empty bodies and PDFs that are none."""
    error, status, body = "", None, b""
    for attempt in range(1, settings.http_retries + 1):
        try:
            answer = transport(url, settings.http_timeout_s)
            status, body, error = answer.status, answer.body, ""
        except Exception as e:  # a transport that fails is tried again
            answer, status, body, error = None, None, b"", f"{type(e).__name__}: {e}"
        if answer is not None and status not in RETRY:
            break
        if attempt < settings.http_retries:
            wait(settings.http_backoff_s * attempt)
    if not error and status is not None:
        if status >= 400:
            error = f"HTTP {status}"
        elif not body:
            error = "empty body"
        elif pdf and "pdf" not in answer.content_type.lower():
            error = f"not a PDF: {answer.content_type}"
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    if error:
        return source_id, url, "fetch_failed", status, 0, "", now, None, error
    return source_id, url, "ok", status, len(body), hashlib.sha256(body).hexdigest(), now, body, None


def fetch_all(sources: DataFrame, transport: Transport = http, known: DataFrame | None = None, settings: Settings = SETTINGS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Fetched rows of all sources that ``known`` (``source_id, content``, say from earlier runs) has no content of.

    A host's sources are in one partition, one after another, with a delay
    between them; hosts run side by side.
    """
    todo = sources
    if known is not None:
        todo = sources.join(known.where(F.length("content") > 0).select("source_id"), "source_id", "left_anti")
    asked = todo.select("source_id", "url", urls.is_pdf(F.col("url")).alias("pdf"), urls.host(F.col("url")).alias("host"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            rows, held = [], 0
            for r in batch.itertuples():
                if r.host == last:
                    wait(settings.http_delay_s)
                last = r.host
                rows.append(fetch_one(r.source_id, r.url, r.pdf, transport, settings, wait))
                held += rows[-1][4]
                if held >= HELD_BYTES:
                    yield framed(rows)
                    rows, held = [], 0
            if rows:
                yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"http_status": "Int32"})

    return asked.repartition("host").sortWithinPartitions("host", "source_id").mapInPandas(run, RESULT)


def fetch_state(sources: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """Status of every source: its last result's, else by whether a file (``source_id, length``) is there and not empty."""
    r = results.select("source_id", F.col("status").alias("_told"))
    f = files.select("source_id", F.col("length").alias("_length"))
    found = F.when(F.coalesce("_length", F.lit(0)) > 0, "ok").otherwise("fetch_failed")
    return sources.join(r, "source_id", "left").join(f, "source_id", "left").select(*sources.columns, F.coalesce("_told", found).alias("fetch_status"))
