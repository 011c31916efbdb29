"""Text predicates and scalar functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import STOPWORDS

from .arrow import each

#: Sentences end at a mark followed by white space.
SENTENCE_END = "(?<=[.!?])\\s+"


def text_of(column: Column | str) -> Column:
    """The column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip(column: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(column, "^\\s+|\\s+$", "")


def clean(column: Column) -> Column:
    """Spaces and tabs collapsed, ends stripped."""
    return strip(F.regexp_replace(text_of(column), "[ \\t]+", " "))


def short(column: Column) -> Column:
    """All white space collapsed, ends stripped."""
    return F.regexp_replace(strip(text_of(column)), "\\s+", " ")


def is_meaningful(column: Column) -> Column:
    """At least two characters and an ASCII letter or digit."""
    inner = strip(text_of(column))
    return (F.length(inner) >= 2) & inner.rlike("[A-Za-z0-9]")


def sentences(column: Column) -> Column:
    """Array of a text's sentences, none empty."""
    parts = F.split(strip(text_of(column)), SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def count_sentences(column: Column) -> Column:
    return F.size(sentences(column))


def cap_sentences(column: Column, limit: int) -> Column:
    """First ``limit`` sentences, closed by a mark if any were cut."""
    parts = sentences(column)
    kept = F.array_join(F.slice(parts, 1, limit), " ")
    closed = F.when(kept.rlike("[.!?]$"), kept).otherwise(F.concat(kept, F.lit(".")))
    return F.when(F.size(parts) <= limit, strip(text_of(column))).otherwise(closed)


def cap_length(column: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last boundary of the best kind past a third of them, else dotted."""
    text = strip(text_of(column))
    window = F.substring(text, 1, limit)
    back = F.reverse(window)
    cut = F.lit(None).cast("int")
    for boundary in (", ", "; ", "! ", "? ", ". "):  # the last that applies wins
        at = F.locate(boundary[::-1], back)
        start = limit - at - 1  # zero-based place of the boundary
        cut = F.when((at > 0) & (start > limit // 3), start).otherwise(cut)
    ended = strip(F.left(window, cut + 1))
    dotted = F.concat(F.regexp_replace(strip(window), "[,;]+$", ""), F.lit("..."))
    return F.when(F.length(text) <= limit, text).when(cut.isNotNull(), ended).otherwise(dotted)


def question_terms(column: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct content words: lower-case ASCII words of over two characters, function words left out."""
    words = F.regexp_extract_all(F.lower(text_of(column)), F.lit("([a-z0-9]+)"), F.lit(1))
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_distinct(F.array_except(long, F.array(*map(F.lit, stopwords))))


def words_of(column: Column) -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(column)), F.lit("([a-z0-9]+)"), F.lit(1)))


def lexical_overlap(question: Column, body: Column) -> Column:
    """Share of a question's content words that a text holds."""
    terms = question_terms(question)
    hit = F.size(F.array_intersect(terms, words_of(body)))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(hit / F.size(terms))


def numeric_tokens(column: Column) -> Column:
    """Canonical numbers of a text: no currency, separators or idle zeros; per cents keep their sign.

    Full-width and other compatibility forms are taken in by ``nfkc`` first.
    """
    bare = F.regexp_replace(text_of(column), "(?i)(?<![A-Za-z0-9_])(?:inr|rs\\.?|rupees)(?![A-Za-z0-9_])|[₹$€£]", " ")
    raw = F.regexp_extract_all(bare, F.lit("([0-9][0-9,]*(?:\\.[0-9]+)?%?)"), F.lit(1))

    def canonical(token: Column) -> Column:
        core = F.regexp_replace(token, "[,%]", "")
        core = F.regexp_replace(core, "^0+(?=[0-9])", "")
        core = F.when(core.contains("."), F.regexp_replace(core, "\\.?0+$", "")).otherwise(core)
        return F.when(token.endswith("%"), F.concat(core, F.lit("%"))).otherwise(core)

    return F.array_distinct(F.transform(raw, canonical))


def normalized(values: pa.Array, form: str) -> pa.Array:
    """Strings in a normal form; those of ASCII alone are in every form."""
    if pc.all(pc.string_is_ascii(values)).as_py() is not False:
        return values
    return each(values, lambda x: x if x is None else unicodedata.normalize(form, x), values.type)


def _normalized(form: str):
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return normalized(values, form)

    return run


def nfc(column: Column) -> Column:
    """Canonical composition; Spark has no function of its own for it."""
    return _normalized("NFC")(column)


def nfkc(column: Column) -> Column:
    """Compatibility composition."""
    return _normalized("NFKC")(column)


def hashed(column: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(column, 256)


def short_hash(column: Column) -> Column:
    """First twelve hex digits of the SHA-256: enough to follow a question without holding it."""
    return F.substring(hashed(text_of(column)), 1, 12)
