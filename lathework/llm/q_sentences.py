"""Queries on sentence units (problem 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.llm import sentences as op
from lathework.session import table


def p8_found(spark, sf_dir):
    found = op.sentences(table(spark, sf_dir, "documents"), key="doc_id", text="text")
    return found.select("doc_id", "start_char", "end_char")


def p8_lengths(spark, sf_dir):
    """Sentences and their lengths by language label."""
    docs = table(spark, sf_dir, "documents")
    found = op.sentences(docs, key="doc_id", text="text").join(docs.select("doc_id", "lang").distinct(), "doc_id")
    return found.groupBy("lang").agg(
        F.count("*").alias("n_sentences"),
        F.avg(F.col("end_char") - F.col("start_char") + 1).alias("avg_chars"),
        F.max(F.col("end_char") - F.col("start_char") + 1).alias("max_chars"),
    )


QUERIES = {"p8_found": p8_found, "p8_lengths": p8_lengths}
SQL: dict[str, str] = {}
