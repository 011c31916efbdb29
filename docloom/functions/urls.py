"""URL functions of the manifest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_pdf(url: Column) -> Column:
    """Whether the URL's path, without its query, ends in .pdf."""
    return F.split_part(F.lower(url), F.lit("?"), F.lit(1)).endswith(".pdf")


def file_name(url: Column, source_id: Column) -> Column:
    """A safe file name: the decoded last segment with odd characters replaced and a suffix, else the id."""
    suffix = F.when(is_pdf(url), ".pdf").otherwise(".html")
    path = F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    # A plus sign in a path stands for itself.
    decoded = F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(last, "\\+", "%2B")), last))
    safe = F.regexp_replace(decoded, "[^\\p{L}\\p{N}._-]", "_")
    named = F.when(F.lower(safe).endswith(suffix), safe).otherwise(F.concat(safe, suffix))
    return F.when(safe == "", F.concat(source_id, suffix)).otherwise(named)


def host(url: Column) -> Column:
    """Host name in lower case."""
    return F.lower(F.regexp_extract(url, "^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
