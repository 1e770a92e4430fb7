"""The fast path: exact answers from an approved corpus, taken only where they are unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.functions.text import normal_question, tokens


def unique_matches(queries: DataFrame, entries: DataFrame, on: list[str]) -> DataFrame:
    """``query_id, entry_id, n_matches`` of queries that match an entry by all of ``on``; entry_id is null where several match. Nulls match nothing."""
    distinct = entries.groupBy(*on).agg(F.count_distinct("entry_id").alias("n_matches"), F.min("entry_id").alias("e"))
    return queries.join(distinct, on).select("query_id", F.when(F.col("n_matches") == 1, F.col("e")).alias("entry_id"), "n_matches")


def _in_scope(on: str, queries: DataFrame, entries: DataFrame, fields: list[str]) -> DataFrame:
    """``query_id, n, entry_id``: how many entries share ``on`` and every field that the query names. Entries are counted by key and fields first, so a common key meets few rows."""
    counted = entries.where(F.col(on).isNotNull()).groupBy(on, *fields).agg(F.count_distinct("entry_id").alias("n"), F.min("entry_id").alias("entry_id"))
    x = queries.join(counted.withColumnsRenamed({f: f"_e_{f}" for f in fields}), on)
    for f in fields:
        x = x.where(F.col(f"hard_{f}").isNull() | (F.col(f"hard_{f}") == F.col(f"_e_{f}")))
    return x.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("entry_id").alias("entry_id"))


def exact_answers(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """The route of each query: ``query_id, route, entry_id``.

    ``queries``: query_id, question, alarm_code, equipment_model; ``entries``: entry_id, question, alarm_code,
    equipment_model. A unique alarm (same code, and same model where the query names one) comes first, then a unique
    question in its normal form and the same hard scope; ambiguity at either step gives the fallback, never another step.
    """
    e = entries.select("entry_id", "alarm_code", "equipment_model", normal_question(F.col("question")).alias("nq")).where("entry_id is not null")
    q = queries.select("query_id", F.col("alarm_code").alias("hard_alarm_code"), F.col("equipment_model").alias("hard_equipment_model"), normal_question(F.col("question")).alias("nq"))
    by_alarm = _in_scope("alarm_code", q.withColumn("alarm_code", F.col("hard_alarm_code")), e, ["equipment_model"]).withColumnsRenamed({"n": "na", "entry_id": "alarm_entry"})
    by_question = _in_scope("nq", q, e, ["equipment_model", "alarm_code"]).withColumnsRenamed({"n": "nf", "entry_id": "faq_entry"})
    both = q.select("query_id").distinct().join(by_alarm, "query_id", "left").join(by_question, "query_id", "left")
    na, nf = F.coalesce("na", F.lit(0)), F.coalesce("nf", F.lit(0))
    route = F.when(na == 1, "exact_alarm").when(na > 1, "ambiguous_alarm").when(nf == 1, "exact_faq").when(nf > 1, "ambiguous_faq").otherwise("fallback")
    return both.select("query_id", route.alias("route"), F.when(na == 1, F.col("alarm_entry")).when((na == 0) & (nf == 1), F.col("faq_entry")).alias("entry_id"))


def probe(queries: DataFrame, entries: DataFrame, *, ranked: DataFrame | None = None, accept: float | None = None) -> DataFrame:
    """What the fast path makes of each query: ``query_id, status, match_type, reason, entry_id``.

    ``queries``: query_id, question, intent, ambiguous (array) and hard_equipment_model, hard_alarm_code, hard_part_number;
    ``entries``: entry_id, question, knowledge_type and the three identifiers. The steps, each of which ends the search where it
    decides: an ambiguous identifier; a known alarm code in the question that the analysis did not settle; alarms of
    the same code in scope (several: fallback; one of kind alarm, for questions of intent alarm_fault: accepted); questions
    equal in their normal form (several: fallback; one: accepted); and, with ``ranked`` (query_id, entry_id, score, matched, rank)
    and a threshold ``accept``, the best entry by BM25.
    """
    fields = ["equipment_model", "alarm_code", "part_number"]
    e = entries.select("entry_id", "knowledge_type", *fields, normal_question(F.col("question")).alias("nq")).where("entry_id is not null").distinct()
    q = queries.withColumn("nq", normal_question(F.col("question")))
    codes = e.where("alarm_code is not null").select(F.col("alarm_code").alias("code")).distinct()
    told = q.select("query_id", "hard_alarm_code", F.explode(F.array_distinct(tokens(F.col("nq")))).alias("code")).where(~F.col("code").eqNullSafe(F.col("hard_alarm_code")))
    unresolved = told.join(codes, "code", "left_semi").select("query_id").distinct().withColumn("_open", F.lit(True))
    alarms = _in_scope("alarm_code", q.withColumn("alarm_code", F.col("hard_alarm_code")), e, ["equipment_model", "part_number"]).withColumnsRenamed({"n": "na", "entry_id": "_alarm"})
    kind = e.groupBy(F.col("entry_id").alias("_alarm")).agg(F.min("knowledge_type").alias("_kind"))
    faqs = _in_scope("nq", q, e, fields).withColumnsRenamed({"n": "nf", "entry_id": "_faq"})
    x = q.select("query_id", "intent", F.size(F.coalesce("ambiguous", F.array().cast("array<string>"))).alias("_many")).distinct()
    x = x.join(unresolved, "query_id", "left").join(alarms.join(kind, "_alarm", "left"), "query_id", "left").join(faqs, "query_id", "left")
    best = F.lit(None).cast("string")
    took = F.lit(False)
    if ranked is not None:
        top = ranked.where("rank = 1 and matched > 0").select("query_id", F.col("entry_id").alias("_best"), F.col("score").alias("_score"))
        x = x.join(top, "query_id", "left")
        best, took = F.col("_best"), F.coalesce(F.col("_score") >= accept, F.lit(False)) if accept is not None else F.lit(False)
    na, nf, alarm_ok = F.coalesce("na", F.lit(0)), F.coalesce("nf", F.lit(0)), (F.col("intent") == "alarm_fault") & (F.col("_kind") == "alarm")
    reason = (
        F.when(F.col("_many") > 0, "ambiguous_hard_identifier").when(F.col("_open"), "unresolved_alarm_identifier").when(na > 1, "ambiguous_alarm_evidence")
        .when((na == 1) & alarm_ok, "exact_alarm").when(nf > 1, "ambiguous_exact_faq").when(nf == 1, "exact_faq").when(best.isNull(), "no_candidate").when(took, "bm25_faq")
        .otherwise("bm25_rejected" if accept is not None else "bm25_not_enabled")
    )
    x = x.withColumn("reason", reason)
    hit = F.col("reason").isin("exact_alarm", "exact_faq", "bm25_faq")
    entry = F.when(F.col("reason") == "exact_alarm", F.col("_alarm")).when(F.col("reason") == "exact_faq", F.col("_faq")).when(F.col("reason") == "bm25_faq", best)
    return x.select("query_id", F.when(hit, "ACCEPTED").otherwise("FALLBACK").alias("status"), F.when(hit, F.col("reason")).otherwise("fallback").alias("match_type"), "reason", entry.alias("entry_id"))


def otherwise(accepted: DataFrame, fallback: DataFrame) -> DataFrame:
    """Accepted rows, and fallback rows of the queries that have none."""
    return accepted.unionByName(fallback.join(accepted.select("query_id").distinct(), "query_id", "left_anti"))
