"""A small table with every awkward case, and helpers written without the library."""

import re

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()), T.StructField("text_key", T.StringType())]
)
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
ROWS = [
    (1, BASE, "en", "a", None),
    (2, BASE, "en", None, "b"),
    (2, BASE, "en", None, "b"),
    (3, BASE.upper(), None, None, None),
    (4, None, "en", None, None),
    (5, "", "fr", None, None),
    (6, " \t\n ", "fr", None, None),
    (7, "!!! 123 ... 456", None, None, None),
    (None, "Élan vital, été français: à côté de la forêt, où naît l'œuvre", "fr", None, None),
    (None, None, None, None, None),
    (8, LONG, "en", None, None),
    (9, LONG + " tail", "en", None, None),
    (10, "two words", "en", None, None),
    (11, "TWO words", "en", None, None),
    (12, "don't we'll  stop here  now 　 <|endoftext|> 東京 タワー", "ja", None, None),
    (13, "a", "en", None, None),
    (14, "la forêt de la ville et le vent dans les arbres de la montagne", "fr", None, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
