import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return documents.orderBy("doc_id").collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    base = "the cat and the dog went to the house of the king and sang a song of sixpence to all "
    long = base * 400
    data = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", None, len(long)), (5, long, "en", "b", len(long)),
        (6, base, "fr", "b", len(base)), (6, base, "fr", "b", len(base)), (None, base, "fr", "b", 1), (7, "12345 !!", None, "c", 8), (8, "Ünï çödé 日本 😀 " * 50, "de", "c", 5),
        (9, base + "x", "en", "a", 3), (10, base.upper(), "en", "a", 3), (11, "\0 nul <|endoftext|> <s> ▁▁ ", "en", "a", 3),
    ]
    names = "key long, start long, digest string, fp long, block long, copies long, target double, lang_pred string, score double, h long"
    df = spark.createDataFrame(data, DOCS)
    for column in names.split(", "):
        name, kind = column.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
