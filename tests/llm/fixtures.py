"""Awkward tables that every operator has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: doc_id, text, lang, source, n_chars and columns whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, hi string, root string, pos int, template string, terms string, id string, count int, host string, x string"
PROSE = "the quick brown fox jumps over the lazy dog while seven patient herons watch the river bend toward the old stone mill at dusk"


def docs(spark: SparkSession, *texts: str | None, first: int = 1) -> DataFrame:
    return rows(spark, [(first + i, t, "en", "web/a") for i, t in enumerate(texts)])


def rows(spark: SparkSession, some: list[tuple]) -> DataFrame:
    """Rows (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 7, "h", "r", 3, "t", "w", "i", 1, "o", "x") for i, t, la, s in some], DOCS)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows, a tie of ids."""
    long = " ".join(f"word{i % 5003} stays{i}" for i in range(60_000))
    some = rows(spark, [(1, PROSE, "en", "web/a"), (2, "", "en", "web/a"), (3, None, "en", None), (4, PROSE, None, "web/b"), (4, PROSE, None, "web/b"), (None, PROSE + " again", "de", "web/a"), (5, long, "en", "https://h.example/p/q"), (6, " \n\t .,;", "fr", "")])
    return some.unionByName(spark.createDataFrame([(None,) * 15], DOCS))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
