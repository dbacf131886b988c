import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


LONG = " ".join(f"word{i % 977} and the" for i in range(30_000))

DOCS = [
    (1, "The cat sat on the mat and the dog was by the door.", "en", "web"),
    (1, "The cat sat on the mat and the dog was by the door.", "en", "web"),
    (2, "The  cat sat on the mat\nand the dog was by the door.", "en", None),
    (None, "The cat sat on the mat and the dog was by the door.", "en", "web"),
    (3, None, "en", "web"),
    (4, "", None, None),
    (5, " \t\n\x0b\x0c\r ", "de", "books"),
    (6, "12345 !!! ... 678", None, "web"),
    (7, LONG, "en", "books"),
    (8, "der Hund und die Katze sind im Haus, und das ist gut so.", "de", "books"),
    (None, None, None, None),
    (9, "é 日本語 \x00   \x85 ñandú Straße", "es", "other"),
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with names used inside."""
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string")
    return df.select(
        "*",
        F.lit("x").alias("row"),
        F.lit(7).alias("words"),
        F.lit(None).cast("string").alias("fp"),
        F.lit(1).alias("size"),
        F.lit("y").alias("kept_row"),
        F.lit(2).alias("hash"),
        F.lit(3).alias("block"),
        F.lit(4).alias("found"),
    )


PAGES = [
    (1, "http://A.Example.NET/en/x?q", "<article><p>" + "The text of it. " * 20 + "</p></article>"),
    (2, "http://b.example.net/en/x", "<article><p>" + "The text of it. " * 20 + "</p></article>"),
    (2, "http://b.example.net/en/x", "<article><p>" + "The text of it. " * 20 + "</p></article>"),
    (3, None, None),
    (4, "no scheme here", ""),
    (None, "https://example.com/de/", "<p>small</p>"),
    (5, "https://example.com", "<p>small</p>"),
    (6, "https://sub.org/fr/POKER#x", "<p>" + "word " * 100_000),
    (None, "https://host.net?x=://y/", "<article><p>" + "The text of it. " * 20 + "</p></article>"),
]


@pytest.fixture(scope="session")
def odd_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return df.select(
        "*",
        F.lit("x").alias("host"),
        F.lit(1).alias("digest"),
        F.lit(None).cast("int").alias("first"),
        F.lit("z").alias("text"),
        F.lit(2).alias("found"),
    )
