"""Tables with everything that an operator must bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 20_000
SOLID = "x" * 300_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of it today. " * 6, "en", "a", 480),
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of it today. " * 6, "en", "a", 480),
    (2, "", "en", "a", 0),
    (3, None, "en", None, None),
    (None, "no id here", None, "b", 10),
    (4, LONG, "en", "b", len(LONG)),
    (5, SOLID, "de", "b", len(SOLID)),
    (6, "tie", "fr", "c", 3),
    (7, "tie", "fr", "c", 3),
    (8, " \n\t ", "fr", "c", 4),
    (9, "日本語 текст ελληνικά 123 \U0001f600", None, "c", -5),
]
#: Names that operators use within; here as further columns of the table.
CLASHES = (
    "id", "key", "keys", "size", "copy", "shard", "position", "mark", "token", "segment", "to", "y", "w", "c", "fold",
    "__gone", "__bad", "__block", "__rank", "__n", "__source", "__mark", "covered", "toxic", "spans", "block", "e",
)


def edge(spark: SparkSession, clashes: bool = True) -> DataFrame:
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}) if clashes else df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def docs(spark: SparkSession, texts: list[str | None], **columns: list) -> DataFrame:
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
