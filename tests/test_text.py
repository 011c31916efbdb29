import pytest
from pyspark.sql import functions as F

from docloom.functions import guardrails as gr
from docloom.functions import text as tx
from docloom.functions import urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Rs. 500", {"500"}), ("Rs 500", {"500"}), ("₹1,00,000", {"100000"}), ("Rs 100000", {"100000"}), ("1.00%", {"1%"}),
        ("1%", {"1%"}), ("1", {"1"}), ("as on 2026-06-30", {"2026", "6", "30"}), ("0.50 and 007", {"0.5", "7"}), ("0", {"0"}), ("0.0", {"0"}), (None, set()),
    ],
)
def test_numeric_tokens(spark, text, tokens):
    assert set(one(spark, text, tx.numeric_tokens)) == tokens


def test_nfkc_before_numbers(spark):
    assert one(spark, "１２％", lambda c: tx.numeric_tokens(tx.nfkc(c))) == ["12%"]


@pytest.mark.parametrize(
    "text, pattern",
    [
        ("My PAN is ABCDE1234F", "pan"), ("aadhaar 1234 5678 9012", "aadhaar"), ("a/c no 123456789012", "account"),
        ("my folio number is 9876543210", "account"), ("otp 483920 please", "otp"), ("write to sunil@example.com", "email"),
        ("call me on 9876543210", "phone"), ("+91 98765 43210", "phone"), ("minimum investment of Rs 5000", None),
        ("after 365 days", None), ("Nifty 100 TRI", None), (None, None), ("", None),
    ],
)
def test_pii(spark, text, pattern):
    assert one(spark, text, gr.find_pii) == pattern


@pytest.mark.parametrize(
    "text, verdict, matched, escalated",
    [
        ("Should I invest in the fund?", "ADVICE", "should i", False),
        ("Any tips for a beginner?", "ADVICE", "tips", True),
        ("Should I buy the fund that performed best?", "ADVICE", "should i", False),
        ("What is the NAV growth?", "PERFORMANCE", "nav", True),
        ("Should I buy? mail a@b.co", "PII", None, False),
        ("What is the exit load?", "FACTUAL", None, False),
        ("", "FACTUAL", None, False),
        (None, "FACTUAL", None, False),
    ],
)
def test_screen(spark, text, verdict, matched, escalated):
    row = gr.screen(spark.createDataFrame([(text,)], "v string"), "v").first()
    assert (row.verdict, row.matched, row.escalated) == (verdict, matched, escalated)


def verify(spark, body, context, citation=None, urls_=("u",), template="FACTUAL"):
    df = spark.createDataFrame([(body, list(context), citation, list(urls_), template)], "b string, c array<string>, u string, a array<string>, t string")
    return df.select(gr.verify(F.col("b"), F.col("c"), F.col("t"), F.col("u"), F.col("a")).alias("v")).first().v


def test_verify(spark):
    assert verify(spark, "The load is 1.00%.", ["exit load 1%"], "u").ok
    assert verify(spark, "The load is 2%.", ["exit load 1%"]).violations == ["NOT_FOUND"]
    assert verify(spark, "", []).violations == ["NOT_FOUND"]
    assert verify(spark, "a. b. c. d.", []).violations == ["NOT_FOUND"]
    assert verify(spark, "You should buy.", []).violations == ["REFUSE_ADVICE"]
    assert verify(spark, "Returns were high.", []).violations == ["REFUSE_PERFORMANCE"]
    assert verify(spark, "ok then", [], "elsewhere").violations == ["NOT_FOUND"]
    assert verify(spark, "We recommend it.", [], template="REFUSE_ADVICE").violations == ["REFUSE_ADVICE"]


@pytest.mark.parametrize(
    "text, limit, expected",
    [
        ("short", 20, "short"),
        ("One two three. Four five six seven", 20, "One two three."),
        ("aaaaaaaaaa, bbbbbbbbbbbbbb", 20, "aaaaaaaaaa,"),
        ("a" * 30, 20, "a" * 20 + "..."),
        (None, 20, ""),
    ],
)
def test_cap_length(spark, text, limit, expected):
    assert one(spark, text, lambda c: tx.cap_length(c, limit)) == expected


def test_cap_sentences(spark):
    assert one(spark, "A b. C d! E f? G h.", lambda c: tx.cap_sentences(c, 2)) == "A b. C d!"
    assert one(spark, "  A b.  ", lambda c: tx.cap_sentences(c, 2)) == "A b."
    assert one(spark, None, lambda c: tx.cap_sentences(c, 2)) == ""


def test_terms(spark):
    assert one(spark, "What is the Exit Load of the exit?", tx.question_terms) == ["exit", "load"]


@pytest.mark.parametrize(
    "url, name, pdf",
    [
        ("https://x.com/a/Big%20Bluechip%20Fund%20-%20SID.pdf", "Big_Bluechip_Fund_-_SID.pdf", True),
        ("https://x.com/a/b+c?x=1", "b_c.html", False),
        ("https://x.com/", "s1.html", False),
        ("https://x.com/f.PDF?y=2", "f.PDF", True),
    ],
)
def test_urls(spark, url, name, pdf):
    assert one(spark, url, lambda c: urls.file_name(c, F.lit("s1"))) == name
    assert one(spark, url, urls.is_pdf) is pdf


def test_without_suffixes(spark):
    assert one(spark, "It is 1%. http://u", lambda c: gr.without_suffixes(c, F.lit("http://u"), F.lit(None))).strip() == "It is 1%."


@pytest.mark.parametrize("text", ["hash 4454049ac802522025d5", "account\n123456789012", "folio number123456789", "A/C - 1234567890"])
def test_pii_account_digits(spark, text):
    """The SQL's pattern takes digits that follow at once, or on the next line, for an account's."""
    assert one(spark, text, gr.find_pii) == "account"


@pytest.mark.parametrize("text", ["accounts 123456789", "account 12345678", "account: \n123456789"])
def test_pii_account_without_digits(spark, text):
    assert one(spark, text, gr.find_pii) is None
