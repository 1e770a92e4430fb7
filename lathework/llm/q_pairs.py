"""Queries on broken prompt and response pairs (problem 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.llm import pairs as op
from lathework.session import table


def _pairs(spark, sf_dir):
    """All fields judged: each answer and reference answer with its question."""
    jpkb, rag = table(spark, sf_dir, "jpkb"), table(spark, sf_dir, "rag_evaluate_data")
    parts = [(jpkb, "jpkb", "id", "answer"), (rag, "rag_evaluate_data", "sample_id", "answer"), (rag, "rag_evaluate_data", "sample_id", "ground_truth")]
    out = None
    for t, name, key, field in parts:
        row_key = F.struct(F.lit(name).alias("tbl"), F.col(key).cast("int").alias("row_id"), F.lit(field).alias("field_name"))
        part = t.select(row_key.alias("row_key"), "question", F.col(field).alias("answer"))
        out = part if out is None else out.unionByName(part)
    return out


def p1_found(spark, sf_dir):
    return op.one_defect(op.labelled(_pairs(spark, sf_dir))).select("row_key.tbl", "row_key.row_id", "row_key.field_name", "defect").distinct()


def p1_labels(spark, sf_dir):
    """Every defect above its cutoff, with its posterior."""
    found = op.labelled(_pairs(spark, sf_dir)).select("row_key.*", F.explode("labels").alias("l"))
    return found.select("tbl", "row_id", "field_name", "l.defect", F.round("l.posterior", 6).alias("posterior"))


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels}
SQL: dict[str, str] = {}
