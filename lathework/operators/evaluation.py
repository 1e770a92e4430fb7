"""Ranking metrics, threshold sweeps, slices and run aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(judged: DataFrame, k: int) -> DataFrame:
    """Adds ``hit, recall, mrr, first_rank`` at cutoff ``k``.

    ``judged`` has ``ranking`` and ``relevant`` (arrays of ids); rankings lose repeats before the cut, first
    places kept. Rows without relevant ids get nulls. An empty ranking has hit, recall and mrr 0 and a null rank.
    """
    top = F.slice(F.array_distinct(F.coalesce("ranking", F.array().cast("array<string>"))), 1, k)
    relevant = F.array_distinct("relevant")
    places = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull())
    first = F.array_min(places)
    ok = F.size(relevant) > 0
    return judged.withColumns({
        "hit": F.when(ok, F.when(first.isNotNull(), 1.0).otherwise(0.0)),
        "recall": F.when(ok, F.size(F.array_intersect(top, relevant)) / F.size(relevant)),
        "mrr": F.when(ok, F.coalesce(1 / first, F.lit(0.0))),
        "first_rank": F.when(ok, first),
    })


def macro_metrics(judged: DataFrame, *by: str) -> DataFrame:
    """Means of hit, recall and mrr, over all rows or by columns; over no rows the count is 0 and the means are null."""
    return judged.groupBy(*by).agg(F.count("hit").alias("n_samples"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr")))


def sliced_metrics(judged: DataFrame, dimensions: list[str], tags: str | None = None) -> DataFrame:
    """Means overall and by each value of each dimension, and of a multi-valued column of tags: ``slice, value`` and the means. One pass by grouping sets, one over the tags."""
    sets = judged.groupingSets([[], *([d] for d in dimensions)], *dimensions).agg(
        F.grouping_id().alias("g"), F.count("hit").alias("n_samples"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr"))
    )
    bits = {(1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i)): d for i, d in enumerate(dimensions)}
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for b, d in bits.items():
        name, value = F.when(F.col("g") == b, d).otherwise(name), F.when(F.col("g") == b, F.col(d).cast("string")).otherwise(value)
    out = sets.select(name.alias("slice"), value.alias("value"), "n_samples", "hit", "recall", "mrr")
    if tags:
        by_tag = macro_metrics(judged.withColumn("value", F.explode(F.array_distinct(tags))), "value")
        out = out.unionByName(by_tag.select(F.lit(tags).alias("slice"), "value", "n_samples", "hit", "recall", "mrr"))
    return out


def threshold_sweep(observations: DataFrame, thresholds: list[float]) -> DataFrame:
    """Acceptance figures for each threshold: ``observations`` has score, matched, correct; a row is accepted with a match and score >= threshold. One aggregation, whatever the number of thresholds."""
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    o = observations.select("correct", "score", "matched", at).withColumn("accepted", (F.col("matched") > 0) & (F.col("score") >= F.col("threshold")))
    good = F.count_if(F.col("accepted") & F.col("correct"))
    accepted, n = F.count_if("accepted"), F.count("*")
    return o.groupBy("threshold").agg(
        n.alias("eligible"), accepted.alias("accepted"),
        F.round(good / F.nullif(accepted, F.lit(0)), 6).alias("precision"), F.round(accepted / n, 6).alias("coverage"),
        F.round(good / F.nullif(F.count_if("correct"), F.lit(0)), 6).alias("recall"), (accepted - good).alias("false_accepts"),
    )


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile of ``value``: ``n, mean, p95``; nulls do not count, a group of nulls has n 0.

    The rank is found by running counts over a group's distinct values in order, which can spill, not in one buffer.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    same = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    seen = F.sum("_n").over(same.orderBy(F.col("_v").asc_nulls_last()))
    reached = counts.withColumns({"_seen": seen, "_all": F.sum("_n").over(same)}).withColumn("_p", F.when((F.col("_n") > 0) & (F.col("_seen") >= F.ceil(F.col("_all") * 0.95)), F.col("_v")))
    return reached.groupBy(*by).agg(F.sum("_n").alias("n"), F.round(F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0)), 6).alias("mean"), F.min("_p").alias("p95"))


def confusion(labels: DataFrame, true: str, predicted: str) -> DataFrame:
    """``true_label, predicted_label, n, share``: how often, and in what share of the true label's rows, each prediction came."""
    counts = labels.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("true_label")), 6))


def classification_report(labels: DataFrame, true: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support`` of every label that occurs on either side, from the counts of the pairs only."""
    c = confusion(labels.where(F.col(true).isNotNull() & F.col(predicted).isNotNull()), true, predicted)
    sides = c.select(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).alias("claimed"), F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0).alias("hits")).unionByName(
        c.select(F.col("predicted_label").alias("label"), F.lit(0).alias("support"), F.col("n").alias("claimed"), F.lit(0).alias("hits"))
    )
    s = sides.groupBy("label").agg(*(F.sum(x).alias(x) for x in ("support", "claimed", "hits")))
    precision, recall = F.col("hits") / F.nullif("claimed", F.lit(0)), F.col("hits") / F.nullif("support", F.lit(0))
    f1 = 2 * F.col("hits") / F.nullif(F.col("claimed") + F.col("support"), F.lit(0))
    return s.select("label", *(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1))), "support")


def paired_delta(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """b - a of each value by key; null where either is missing."""
    x = a.select(key, *(F.col(v).alias(f"a_{v}") for v in values))
    y = b.select(key, *(F.col(v).alias(f"b_{v}") for v in values))
    return x.join(y, key, "full_outer").select(key, *((F.col(f"b_{v}") - F.col(f"a_{v}")).alias(f"delta_{v}") for v in values))
