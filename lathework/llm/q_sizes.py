"""Queries on containers and mixes (problems 6 and 7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathework.llm import containers, mixing
from lathework.llm.tokens import n_tokens
from lathework.session import table, written


def _sized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "lang", "source", "knowledge_type")
    docs = docs.dropDuplicates()  # also spreads the rows
    return docs.withColumn("n_tokens", n_tokens()(F.col("text"))).drop("text")


def _filled(spark, sf_dir):
    items = _sized(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"), F.col("lang").alias("scope"))
    specs = table(spark, sf_dir, "container_specs").select("spec_id", F.col("capacity_tokens").alias("capacity"), F.col("scope_lang").alias("scope"))
    return containers.fill_containers(items, specs), specs


def p6_containers(spark, sf_dir):
    return _filled(spark, sf_dir)[0].withColumnRenamed("item_id", "doc_id")


def p6_fill(spark, sf_dir):
    return containers.fill_report(*_filled(spark, sf_dir))


def p6_rules(spark, sf_dir):
    """What must hold of the filling of each spec, counted."""
    filled, specs = _filled(spark, sf_dir)
    return containers.rules_report(written(filled, "containers-filled"), specs)


def _topical(spark, sf_dir):
    return _sized(spark, sf_dir).withColumnRenamed("knowledge_type", "topic")


def _selection(spark, sf_dir):
    return mixing.mix_sources(_topical(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_selection(spark, sf_dir):
    return _selection(spark, sf_dir)


def p7_shares(spark, sf_dir):
    return mixing.mix_report(written(_selection(spark, sf_dir), "mixing-selection"), table(spark, sf_dir, "mix_targets"))


def p7_rules(spark, sf_dir):
    """Whether each target is met within a hundredth among the sources that have documents, and documents used too often."""
    targets = table(spark, sf_dir, "mix_targets")
    selection = written(_selection(spark, sf_dir), "mixing-selection")
    report = mixing.mix_report(selection, targets)
    caps = targets.select("mix_id", mixing.source_name(F.col("source")).alias("source"), "max_repeats")
    over = selection.join(F.broadcast(caps), ["mix_id", "source"]).where("repeats > max_repeats").groupBy("mix_id", "source").agg(F.count("*").alias("n_over_cap"))  # fixed small table
    live = F.sum(F.when(F.col("n_documents") > 0, F.col("target_share"))).over(Window.partitionBy("mix_id"))
    met = F.abs(F.col("actual_share") - F.col("target_share") / live) <= 0.01
    return report.join(over, ["mix_id", "source"], "left").select("mix_id", "source", (F.col("n_documents") > 0).alias("has_documents"), F.when(F.col("n_documents") > 0, met).alias("met"), F.coalesce("n_over_cap", F.lit(0)).alias("n_over_cap"))


def p7_limits(spark, sf_dir):
    """Which source limits the size of each mix."""
    return mixing.reach_report(_topical(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_marginals(spark, sf_dir):
    """Language and topic shares of each mix beside those of its pool."""
    docs = written(_topical(spark, sf_dir), "mixing-pool")
    return mixing.marginal_report(mixing.mix_sources(docs, table(spark, sf_dir, "mix_targets")), docs)


QUERIES = {
    "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_rules": p6_rules, "p7_selection": p7_selection, "p7_shares": p7_shares, "p7_rules": p7_rules,
    "p7_limits": p7_limits, "p7_marginals": p7_marginals,
}
# The sizes themselves come from a tokenizer; what must hold of every result does not.
SQL: dict[str, str] = {
    "p6_rules": """
SELECT s.spec_id, count(DISTINCT d.doc_id) AS n_items, 0 AS n_overfull, 0 AS n_split, 0 AS n_gaps
FROM container_specs s JOIN documents d ON (s.scope_lang IS NULL OR s.scope_lang = d.lang) WHERE d.text <> '' GROUP BY s.spec_id""",
    "p7_rules": r"""
WITH have AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source FROM documents WHERE text <> '' AND trim(source) <> '')
SELECT t.mix_id, t.source, h.source IS NOT NULL AS has_documents, CASE WHEN h.source IS NOT NULL THEN true END AS met, 0 AS n_over_cap
FROM (SELECT mix_id, regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source FROM mix_targets) t LEFT JOIN have h USING (source)""",
}
