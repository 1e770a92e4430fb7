"""From hits on children to ranked parents: fusion over query variants, aggregation, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions import text


def fuse_children(hits: DataFrame) -> DataFrame:
    """One row per query and child over all variants: best score, the variant and rank that gave it first, and all variants that found it.

    ``hits``: query_id, child_id, variant, rank, score. Order: score, then variant, rank, child id; ``fused_rank`` from 1.
    """
    best = F.max_by(F.struct("variant", "rank"), F.struct("score", -F.col("variant"), -F.col("rank")))
    fused = hits.where(text.finite(F.col("score"))).groupBy("query_id", "child_id").agg(F.max("score").alias("score"), best.alias("w"), F.array_sort(F.collect_set("variant")).alias("variants"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "variant", "rank", "child_id")
    return fused.select("query_id", "child_id", "score", "w.variant", "w.rank", "variants").withColumn("fused_rank", F.row_number().over(order))


def aggregate_parents(children: DataFrame, metadata: list[str] = ()) -> DataFrame:
    """Children of a query grouped by parent: ``query_id, parent_id, score, first_rank, n_hits, children, conflict, parent_rank``.

    ``children``: query_id, parent_id, child_id, score, rank and the ``metadata`` columns, which all
    children of a parent must share; ``conflict`` marks parents where they do not or where a child comes twice.
    Parents are ordered by best score, first rank, id.
    """
    differing = F.countDistinct(F.struct(*metadata)) > 1 if metadata else F.lit(False)
    grouped = children.groupBy("query_id", "parent_id").agg(
        F.max("score").alias("score"), F.min("rank").alias("first_rank"), F.count("*").alias("n_hits"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "child_id"))), lambda x: x["child_id"]).alias("children"),
        (differing | (F.countDistinct("child_id") < F.count("*"))).alias("conflict"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank", "parent_id")
    return grouped.withColumn("parent_rank", F.row_number().over(order))


def overlap_score(query: Column, passage: Column) -> Column:
    """A scorer without a model: the share of the query's distinct tokens that the passage has. Stands in where no scorer is given; says nothing about model quality."""
    asked = F.array_distinct(text.tokens(text.squeezed(query)))
    return F.round(F.coalesce(F.size(F.array_intersect(asked, text.tokens(text.squeezed(passage)))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0)), 6)


def rerank(parents: DataFrame, *, m: int = 2, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The ``m`` best parents per query by ``scorer(query_text, parent_text)``, then the order of aggregation; ``final_rank`` from 1. Parents with scores that are not finite are an error of the scorer and never ranked."""
    scored = parents.withColumn("rerank_score", scorer(F.col("query_text"), F.col("parent_text")).cast("double")).where(text.finite(F.col("rerank_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "first_rank", "parent_id")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= m)
