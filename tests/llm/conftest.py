import pytest
from pyspark.sql import functions as F

#: Columns whose names clash with those that operators make.
CLASHING = ("n_words", "n_tokens", "score", "lang_pred", "lang_score", "hit_words", "item_ids", "spans", "n_lines", "n_dropped", "toxic_score", "bands", "rep", "__h")

LONG = " ".join(f"word{i % 977} token{i % 31}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.\nSecond line here.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \n\t \x0b", "en"),
    (5, LONG, "en"),
    (6, "same text in two rows, more or less", "en"),
    (6, "same text in two rows, more or less", "en"),
    (7, "same text in two rows, more or less", "en"),
    (8, "größe straße über können, wäre schön 😀 日本語 a\x00b <|endoftext|> </s>", "de"),
    (9, "x", "de"),
    (10, "123 456 !!! ...", None),
    (None, "no id but a text of some length, with a few words", "en"),
    (11, "a  b   c \n\n d e ", "en"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty, blank, very long and repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
