"""Mixing sources to target shares of all tokens, with capped repeats.

Documents are counted in cells of source, language and topic. Iterative
proportional fitting rakes the cells' weights until sources have their target
tokens and languages and topics keep the shares they have in the pool; a weight
is the expected number of uses of each document of the cell and never exceeds
the source's cap. Documents are then drawn systematically with those
probabilities, ordered by size, so tokens follow the weights closely.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.session import written


def source_name(c: Column) -> Column:
    """A source's name without outer space, in lower case, with _ for - and spaces."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_")


def rake(tokens: np.ndarray, labels: list[np.ndarray], targets: list[dict], caps: np.ndarray, *, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Weights by iterative proportional fitting.

    ``tokens`` per cell; ``labels`` one array per marginal, ``targets`` its tokens by label. The first
    marginal comes last in every round, and is met within ``tolerance`` wherever the caps allow it.
    """
    w = np.minimum(np.ones(len(tokens)), caps)
    order = [*range(1, len(labels)), 0]
    for _ in range(rounds):
        before = w.copy()
        for m in order:
            for label, target in targets[m].items():
                cells = labels[m] == label
                for _ in range(20 if m == 0 else 1):  # what a cap takes away goes to the other cells of the label
                    have = float((w[cells] * tokens[cells]).sum())
                    if have <= 0 or abs(have - target) <= tolerance * max(target, 1):
                        break
                    scaled = np.minimum(w[cells] * target / have, caps[cells])
                    moved = float(np.abs(scaled - w[cells]).max())
                    w[cells] = scaled
                    if moved <= tolerance:
                        break
        if np.abs(w - before).max() < tolerance:
            break
    return w


def fit_mix(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights of the cells of one mix. The total is the largest at which every source with documents reaches its share within its cap."""
    tokens = pdf["tokens"].to_numpy(dtype=float)
    source, lang, topic = (pdf[c].to_numpy() for c in ("source", "lang", "topic"))
    share = dict(zip(source, pdf["share"].astype(float)))
    cap = pdf["max_repeats"].to_numpy(dtype=float)
    have = {s: tokens[source == s].sum() for s in share}
    most = {s: float((tokens * cap)[source == s].sum()) for s in share}
    live = {s: share[s] for s in share if share[s] > 0 and have[s] > 0}
    scale = sum(live.values())
    total = min((most[s] * scale / live[s] for s in live), default=0.0)
    wanted = {s: live.get(s, 0.0) / scale * total if scale else 0.0 for s in share}
    keep = np.array([wanted[s] > 0 for s in source])
    pool = max(tokens[keep].sum(), 1.0)
    marginals = [{x: total * tokens[keep & (lab == x)].sum() / pool for x in set(lab[keep])} for lab in (lang, topic)]
    w = np.where(keep, rake(np.where(keep, tokens, 0.0), [source, lang, topic], [wanted, *marginals], np.where(keep, cap, 0.0)), 0.0)
    return pdf.assign(weight=w)[["mix_id", "source", "lang", "topic", "weight", "n"]]


def mix_sources(documents: DataFrame, targets: DataFrame, *, per_bucket: int = 50_000) -> DataFrame:
    """The selection for every mix: ``mix_id, doc_id, source, n_tokens, repeats`` (repeats >= 1).

    ``documents``: doc_id, source, lang, topic, n_tokens; rows without source or tokens are never chosen,
    repeated rows of a document count once. ``targets``: mix_id, source, target_share, max_repeats; shares need not add up
    to 1. No document is used more than max_repeats times. A mix none of whose sources has documents gives no rows.
    """
    docs = (
        documents.where("n_tokens > 0 and doc_id is not null")
        .withColumns({"source": source_name(F.col("source")), "lang": F.coalesce("lang", F.lit("und")), "topic": F.coalesce("topic", F.lit("unknown"))})
        .where("source <> ''")
        .groupBy("doc_id").agg(F.min(F.struct("source", "lang", "topic", "n_tokens")).alias("d")).select("doc_id", "d.*")
    )
    docs = written(docs, "mixing-documents")
    wanted = targets.where("target_share >= 0 and max_repeats >= 1").select("mix_id", source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), "max_repeats")
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    weights = cells.join(wanted, "source").groupBy("mix_id").applyInPandas(fit_mix, "mix_id int, source string, lang string, topic string, weight double, n long")  # one row per cell
    weights = weights.where("weight > 0").withColumn("buckets", F.ceil(F.col("n") / per_bucket).cast("int")).drop("n")
    keyed = docs.join(weights, ["source", "lang", "topic"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mix_id"), F.col("buckets")).cast("int"))
    cell = ["mix_id", "source", "lang", "topic", "bucket"]
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("n_tokens", F.xxhash64("doc_id", "mix_id"), "doc_id"))
    start = F.pmod(F.xxhash64(*cell), F.lit(1_000_003)) / 1_000_003.0
    uses = F.floor(F.col("weight") * F.col("r") + start) - F.floor(F.col("weight") * (F.col("r") - 1) + start)
    drawn = keyed.withColumn("r", rank).select("mix_id", "doc_id", "source", "n_tokens", "weight", "buckets", uses.cast("int").alias("repeats"))
    caps = wanted.select("mix_id", "source", F.col("max_repeats").cast("int").alias("cap"))
    return even_out(written(drawn.join(caps, ["mix_id", "source"]), "mixing-drawn")).where("repeats > 0").select("mix_id", "doc_id", "source", "n_tokens", "repeats")


def even_out(drawn: DataFrame) -> DataFrame:
    """Adds or takes back single uses so each source's tokens come as close to its calibrated total as whole documents allow.

    What the draw misses is little beside the source, unless few documents hold most of its tokens. In hash order,
    documents no larger than the gap get further uses within the cap (or lose uses) until the gap is filled; the
    running totals are kept by bucket.
    """
    keys = ["mix_id", "source"]
    gaps = drawn.groupBy(*keys).agg(F.floor(F.sum(F.col("n_tokens") * (F.col("weight") - F.col("repeats")))).alias("gap"), F.max("buckets").alias("n_buckets"))
    d = drawn.join(gaps, keys).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("n_buckets")).cast("int"))
    room = F.when(F.col("n_tokens") > F.abs("gap"), 0).otherwise(F.when(F.col("gap") > 0, F.col("cap") - F.col("repeats")).otherwise(F.col("repeats")))
    d = d.withColumn("room", room).withColumn("mass", F.col("room") * F.col("n_tokens"))
    by_bucket = d.groupBy(*keys, "bucket").agg(F.sum("mass").alias("m"))
    before = by_bucket.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    within = F.coalesce(F.sum("mass").over(Window.partitionBy(*keys, "bucket").orderBy(F.xxhash64("doc_id", "mix_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.abs("gap") - F.col("before") - F.col("within")
    change = F.least(F.greatest(F.floor(left / F.col("n_tokens")), F.lit(0)), F.col("room"))
    out = d.withColumn("within", within).join(before, [*keys, "bucket"])
    return out.withColumn("repeats", (F.col("repeats") + F.signum("gap") * change).cast("int"))


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares actually reached: ``mix_id, source, target_share`` (of a total of 1), ``actual_share, n_tokens, n_documents, most_repeats``; sources without documents have 0."""
    t = targets.where("target_share >= 0 and max_repeats >= 1").select("mix_id", source_name(F.col("source")).alias("source"), F.col("target_share").alias("given"))
    total = t.groupBy("mix_id").agg(F.sum("given").alias("all_given"))
    got = selection.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    out = t.join(total, "mix_id").join(got, ["mix_id", "source"], "left").fillna(0, ["n_tokens", "n_documents", "most_repeats"])
    whole = F.sum("n_tokens").over(Window.partitionBy("mix_id"))
    return out.select(
        "mix_id", "source", (F.col("given") / F.col("all_given")).alias("target_share"), F.coalesce(F.col("n_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        "n_tokens", "n_documents", "most_repeats",
    )


def reach_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """What limits each mix: ``mix_id, source, target_share, most_tokens, total_if_limit, limits``.

    ``most_tokens`` is what the source gives with every document used max_repeats times, ``total_if_limit`` the size of
    the whole mix at which that is its share; the source with the least of them ``limits`` the mix, and each of the
    others is left with tokens unused.
    """
    t = targets.where("target_share > 0 and max_repeats >= 1").select("mix_id", source_name(F.col("source")).alias("source"), F.col("target_share").alias("given"), "max_repeats")
    once = documents.where("n_tokens > 0 and doc_id is not null").withColumn("source", source_name(F.col("source"))).groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d"))
    have = once.groupBy("d.source").agg(F.sum("d.n_tokens").alias("n"))
    live = t.join(have, "source")
    by_mix = Window.partitionBy("mix_id")
    return live.select(
        "mix_id", "source", (F.col("given") / F.sum("given").over(by_mix)).alias("target_share"), (F.col("n") * F.col("max_repeats")).cast("long").alias("most_tokens")
    ).withColumn("total_if_limit", F.floor(F.col("most_tokens") / F.col("target_share"))).withColumn("limits", F.col("total_if_limit") == F.min("total_if_limit").over(by_mix))


def marginal_report(selection: DataFrame, documents: DataFrame) -> DataFrame:
    """Language and topic shares: ``mix_id, marginal, label, pool_share, actual_share, residual``; the pool are all documents of the mix's sources.

    The fit meets the sources last, so what caps and sources leave open shows here as ``residual``.
    """
    docs = documents.where("n_tokens > 0 and doc_id is not null").withColumns({"source": source_name(F.col("source")), "lang": F.coalesce("lang", F.lit("und")), "topic": F.coalesce("topic", F.lit("unknown"))})
    docs = docs.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "topic", "n_tokens")).alias("d")).select("doc_id", "d.*")
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("pool"))
    chosen = selection.select("mix_id", "doc_id", (F.col("n_tokens") * F.col("repeats")).alias("used")).join(docs.select("doc_id", "source", "lang", "topic"), "doc_id")
    used = chosen.groupBy("mix_id", "source", "lang", "topic").agg(F.sum("used").alias("used"))
    all_cells = used.select("mix_id", "source").distinct().join(cells, "source").join(used, ["mix_id", "source", "lang", "topic"], "left").fillna(0, ["used"])
    stacked = all_cells.select("mix_id", "pool", "used", F.explode(F.array(*(F.struct(F.lit(m).alias("marginal"), F.col(m).alias("label")) for m in ("lang", "topic")))).alias("m"))
    sums = stacked.groupBy("mix_id", "m.marginal", "m.label").agg(F.sum("pool").alias("pool"), F.sum("used").alias("used"))
    by = Window.partitionBy("mix_id", "marginal")
    return sums.select("mix_id", "marginal", "label", (F.col("pool") / F.sum("pool").over(by)).alias("pool_share"), (F.col("used") / F.sum("used").over(by)).alias("actual_share")).withColumn(
        "residual", F.col("actual_share") - F.col("pool_share")
    )
