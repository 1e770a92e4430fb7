"""Evaluation runs as relations: one row per sample, aggregated by layer, slice and channel; labels checked against the stored corpus; runs compared in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.operators.evaluation import ranking_metrics

LAYERS = ("child", "parent", "document")
# Identifiers a sample may expect, channels of the fast path, and reasons for which variants are refused.
HARD = ["equipment_model", "alarm_code", "part_number"]
CHANNELS = ["exact_alarm", "exact_faq", "bm25_faq"]
REFUSALS = ["hard_identifier_not_preserved", "new_identifier_token", "duplicate_query_variant", "invalid_query"]


def leaked(returned: str) -> Column:
    """How many of a sample's returned items (an array of structs with :data:`HARD`) differ from an identifier the sample expects (``expected_*``); a missing value is a leak."""
    differs = lambda x: F.greatest(*(F.col(f"expected_{h}").isNotNull() & ~x[h].eqNullSafe(F.col(f"expected_{h}")) for h in HARD))
    return F.size(F.filter(F.coalesce(returned, F.array()), differs))


def measured(samples: DataFrame, *, k: int, m: int) -> DataFrame:
    """Adds hit, recall, mrr and first rank of each layer (``child_hit`` ...), children cut at ``k`` and the others at ``m``.

    ``samples``: returned_<layer>_ids and expected_<layer>_ids. A layer with null returned ids (children of the fast path) has null metrics.
    """
    out = samples
    for layer in LAYERS:
        x = out.withColumns({"ranking": F.col(f"returned_{layer}_ids"), "relevant": F.col(f"expected_{layer}_ids")})
        x = ranking_metrics(x, k if layer == "child" else m)
        there = F.col("ranking").isNotNull()
        out = x.withColumns({f"{layer}_{c}": F.when(there, F.col(c)) for c in ("hit", "recall", "mrr", "first_rank")}).drop("ranking", "relevant", "hit", "recall", "mrr", "first_rank")
    return out


def _figures(have: set[str]) -> list[Column]:
    ok = F.col("error").isNull()
    hard = ok & F.greatest(*(F.col(f"expected_{h}").isNotNull() for h in HARD))
    leak = hard & (F.col("n_leaks") > 0)
    none = F.size(F.coalesce("returned_parent_ids", F.array().cast("array<string>"))) == 0
    rate = lambda part, whole: F.round(F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0)), 6)
    out = [
        F.count("*").alias("sample_count"), F.count_if(~ok).alias("error_count"), F.count_if(none).alias("zero_result_count"), rate(none, F.lit(True)).alias("zero_result_rate"),
        F.count_if(hard).alias("hard_count"), F.count_if(leak).alias("leak_count"), rate(leak, hard).alias("leak_rate"), F.coalesce(F.sum(F.when(hard, F.col("n_leaks"))), F.lit(0)).cast("long").alias("leaked_items"),
    ]
    out += [F.round(F.avg(f"{layer}_{c}"), 6).alias(f"{layer}_{c}") for layer in LAYERS for c in ("hit", "recall", "mrr")]
    if "strategy" in have:
        out += [F.count_if(ok & (F.col("strategy") == s)).alias(f"strategy_{s}") for s in ("direct", "rewrite", "subquery")]
        out += [F.count_if(ok & (F.col("decision_source") == "fallback")).alias("planner_fallbacks"), F.count_if(ok & F.col("fallback_reason").isin(REFUSALS)).alias("variant_refusals")]
    if "fast_status" in have:
        out += [F.count_if(ok & (F.col("fast_status") == s)).alias(f"fast_{s.lower()}") for s in ("ACCEPTED", "FALLBACK")]
    if "intent_match" in have:
        out.append(F.count_if(ok & ~F.col("intent_match")).alias("intent_mismatches"))
    if "n_identifier_mismatches" in have:
        out.append(F.count_if(ok & (F.col("n_identifier_mismatches") > 0)).alias("identifier_mismatches"))
    return out


def run_aggregate(samples: DataFrame, *by: str) -> DataFrame:
    """Figures of a run, overall or by columns: counts of samples, errors, empty results, leaks with their rates, and means of the layers' metrics.

    ``samples`` come from :func:`measured`, with expected_<identifier>, n_leaks and error (null: none); columns on strategy, fast
    path, intent and identifiers are counted where they exist. Failed samples stay in the count of samples; rates over nothing are null.
    """
    return samples.groupBy(*by).agg(*_figures(set(samples.columns)))


def channel_metrics(samples: DataFrame) -> DataFrame:
    """Figures of each channel of the fast path: ``channel, eligible, accepted, correct, incorrect, unlabelled, fallback, coverage, precision, fallback_rate``.

    ``samples``: fast_labels (channels that should answer), fast_status, match_type, correct. One row per channel even where nothing
    happened; rates over nothing are null.
    """
    each = samples.select("fast_labels", "correct", F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"), F.when(F.col("fast_status") == "ACCEPTED", F.col("match_type")).alias("took"))
    eligible, took = F.coalesce(F.array_contains("fast_labels", F.col("channel")), F.lit(False)), F.coalesce(F.col("took") == F.col("channel"), F.lit(False))
    n, a, both, right = F.count_if(eligible), F.count_if(took), F.count_if(eligible & took), F.count_if(took & F.coalesce("correct", F.lit(False)))
    share = lambda x, y: F.round(x / F.nullif(y, F.lit(0)), 6)
    return each.groupBy("channel").agg(
        n.alias("eligible"), a.alias("accepted"), right.alias("correct"), (a - right).alias("incorrect"), (a - both).alias("unlabelled"), (n - both).alias("fallback"),
        share(both, n).alias("coverage"), share(right, a).alias("precision"), share(n - both, n).alias("fallback_rate"),
    )


def label_errors(labels: DataFrame, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels that the active corpus does not bear out: ``sample_id, problem``.

    ``labels``: sample_id, expected_document_ids, expected_child_ids, expected_parent_ids (arrays); ``manifest``: document_id, child_ids;
    ``chunks``: child_id, parent_id. A document must be active, a child belong to an expected document, and the parents be exactly those
    of the children.
    """
    d = labels.select("sample_id", F.explode("expected_document_ids").alias("document_id"))
    lost = d.join(manifest.select("document_id"), "document_id", "left_anti").select("sample_id", F.lit("missing_document").alias("problem"))
    active = d.join(manifest, "document_id").select("sample_id", F.explode("child_ids").alias("child_id")).distinct()
    kids = labels.select("sample_id", F.explode("expected_child_ids").alias("child_id"))
    orphans = kids.join(active, ["sample_id", "child_id"], "left_anti").select("sample_id", F.lit("missing_child").alias("problem"))
    real = kids.join(chunks.select("child_id", "parent_id").distinct(), "child_id").groupBy("sample_id").agg(F.array_sort(F.collect_set("parent_id")).alias("real"))
    told = labels.select("sample_id", F.array_sort(F.array_distinct("expected_parent_ids")).alias("told")).join(real, "sample_id", "left")
    differ = told.where(~F.col("told").eqNullSafe(F.coalesce("real", F.array().cast("array<string>")))).select("sample_id", F.lit("parent_mismatch").alias("problem"))
    return lost.unionByName(orphans).unionByName(differ).distinct()


def document_counts(chunks: DataFrame) -> DataFrame:
    """``document_id, n_children, n_parents, one_version``: what an evaluation corpus would hold of each document."""
    c = chunks.where("document_id is not null")
    return c.groupBy("document_id").agg(F.count_distinct("child_id").alias("n_children"), F.count_distinct("parent_id").alias("n_parents"), (F.count_distinct("document_version") <= 1).alias("one_version"))


def paired(a: DataFrame, b: DataFrame, *, layer: str = "parent") -> DataFrame:
    """``sample_id, hit_delta, mrr_delta``: run ``b`` against run ``a`` of the same samples; ``only_in`` names the run of a sample that the other lacks, whose deltas are null."""
    x = a.select("sample_id", F.col(f"{layer}_hit").alias("ah"), F.col(f"{layer}_mrr").alias("am"), F.lit("a").alias("_a"))
    y = b.select("sample_id", F.col(f"{layer}_hit").alias("bh"), F.col(f"{layer}_mrr").alias("bm"), F.lit("b").alias("_b"))
    only = F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b")
    return x.join(y, "sample_id", "full_outer").select("sample_id", F.round(F.col("bh") - F.col("ah"), 6).alias("hit_delta"), F.round(F.col("bm") - F.col("am"), 6).alias("mrr_delta"), only.alias("only_in"))


def paired_macro(pairs: DataFrame) -> DataFrame:
    """``n_samples, better, worse, hit_delta, mrr_delta`` over the samples of both runs."""
    both = pairs.where("only_in is null")
    return both.agg(F.count("*").alias("n_samples"), F.count_if(F.col("mrr_delta") > 0).alias("better"), F.count_if(F.col("mrr_delta") < 0).alias("worse"), F.round(F.avg("hit_delta"), 6).alias("hit_delta"), F.round(F.avg("mrr_delta"), 6).alias("mrr_delta"))
