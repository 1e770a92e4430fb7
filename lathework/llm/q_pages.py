"""Queries on text from scanned pages (problem 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.llm import pages as op
from lathework.session import table

IDENTIFIERS = ["equipment_model", "alarm_code", "part_number"]


def _rows(spark, sf_dir):
    chunks, entries = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "fast_path")
    rows = chunks.select(F.lit("chunks").alias("tbl"), F.col("id").alias("row_key"), F.col("document_id").alias("document"), "title", "text").unionByName(
        entries.select(F.lit("fast_path").alias("tbl"), F.col("entry_id").alias("row_key"), F.col("document_id").alias("document"), "title", F.col("page_content").alias("text"))
    )
    names = [t.select(F.explode(F.array(*IDENTIFIERS)).alias("term")) for t in (chunks, entries)]
    return rows, names[0].unionByName(names[1])


def p2_found(spark, sf_dir):
    _, places = op.noisy_places(*_rows(spark, sf_dir))
    return op.noisy_lines(places)


def p2_repaired(spark, sf_dir):
    rows, places = op.noisy_places(*_rows(spark, sf_dir))
    return op.repaired(rows, places)


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL: dict[str, str] = {}
