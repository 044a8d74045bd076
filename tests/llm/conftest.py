import pytest

from tapeloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


LONG = " ".join(f"word{i % 997}x{i % 31} the and" for i in range(6000))
#: NULLs in every column, empty and blank and very long texts, ties, repeated rows, odd characters.
ODD_ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \t\n", "en", None, 3),
    (None, "a text without an id, password = abcdefghijklmnop", "en", "a", 5),
    (None, None, None, None, None),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, "same words here", "de", "b", 15),
    (6, "same words here", "de", "b", 15),
    (6, "another text under the same id", "de", "b", 30),
    (7, "Ångström \U0001f44d\U0001f3fd 中文 <|endoftext|> it's x", "xx", "é", 40),
    (8, "x" * 50_000, "en", "b", 50_000),
    (9, "word " * 3000, "en", "b", 15_000),
    (-3, "one", "en", "", 3),
]
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ["stats", "fp", "h", "rank", "size", "spans", "copies", "row", "key", "kept", "ids", "value", "mask", "signature"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"mine {name}").alias(name) for name in CLASHING])
