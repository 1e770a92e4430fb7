"""Evidence and claims: numbering, support checks, rendering and slicing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASCII_TOKEN = r"([A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*)"
NUMERIC_TOKEN = r"(?U)(?<![A-Za-z0-9_.\d])([-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?(?:%|[°℃])?)"
SUPPORT_FIELDS = ["page_content", "title", "equipment_model", "manufacturer", "alarm_code", "part_number", "effective_date"]


def number_evidence(hits: DataFrame, *, by: str = "query_id", content: str = "child_id", order: str = "rank", most: int = 128) -> DataFrame:
    """Evidence ids E1, E2, ... per query by first position of each distinct content; later repeats vanish, at most ``most`` remain."""
    first = hits.where(F.col(content).isNotNull()).groupBy(by, content).agg(F.min(order).alias(order))
    w = Window.partitionBy(by).orderBy(order, content)
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).withColumn("evidence_id", F.concat(F.lit("E"), F.col("n"))).drop("n")


def evidence_holds(records: DataFrame, fields: list[str], *, by: str = "query_id") -> DataFrame:
    """``<by>, ok``: whether every record of a query equals each of its confirmed identifiers ``hard_<field>``; a missing value is a leak."""
    leak = F.lit(False)
    for f in fields:
        leak = leak | (F.col(f"hard_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"hard_{f}")))
    return records.groupBy(by).agg((~F.bool_or(leak)).alias("ok"))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ASCII_TOKEN), 1)


def numeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMERIC_TOKEN), 1)


def check_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The verdict on each claim: ``query_id, claim_id, verdict, unsupported``.

    ``claims``: query_id, claim_id, query_text, text, evidence_ids; ``evidence``: query_id, evidence_id and some of
    :data:`SUPPORT_FIELDS`. Every cited id must exist, the text must hold no citation or list markup, and its
    identifiers and numbers must stand in the query or in the cited evidence; fields are never joined together.
    """
    fields = [f for f in SUPPORT_FIELDS if f in evidence.columns]
    own = evidence.select(
        "query_id", "evidence_id",
        F.flatten(F.array(*(ascii_tokens(F.col(f)) for f in fields))).alias("words"),
        F.flatten(F.array(*(numeric_tokens(F.col(f)) for f in fields))).alias("numbers"),
    )
    cited = claims.select("query_id", "claim_id", F.explode_outer("evidence_ids").alias("evidence_id")).join(own, ["query_id", "evidence_id"], "left")
    support = cited.groupBy("query_id", "claim_id").agg(
        F.bool_or(F.col("evidence_id").isNotNull() & F.col("words").isNull()).alias("unknown"),
        F.flatten(F.collect_list("words")).alias("words"), F.flatten(F.collect_list("numbers")).alias("numbers"),
    )
    c = claims.join(support, ["query_id", "claim_id"], "left")
    none = F.array().cast("array<string>")
    missing_w = F.array_except(ascii_tokens(F.col("text")), F.concat(F.coalesce("words", none), ascii_tokens(F.col("query_text"))))
    missing_n = F.array_except(numeric_tokens(F.col("text")), F.concat(F.coalesce("numbers", none), numeric_tokens(F.col("query_text"))))
    markup = F.col("text").rlike(r"\[E[0-9]+\]|^\s*\d+[.)、]")
    verdict = (
        F.when(F.coalesce("unknown", F.lit(False)), "unknown_citation").when(markup, "claim_contains_renderer_markup")
        .when(F.size(missing_w) > 0, "ungrounded_identifier_token").when(F.size(missing_n) > 0, "ungrounded_numeric_literal").otherwise("ok")
    )
    return c.select("query_id", "claim_id", verdict.alias("verdict"), F.array_sort(F.array_union(missing_w, missing_n)).alias("unsupported"))


def render(claims: DataFrame) -> DataFrame:
    """``query_id, answer``: claims in order, each with its citations in brackets, one per line."""
    line = F.concat(F.col("text"), F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("["), e, F.lit("]"))), ""))
    return claims.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))


def slices(df: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """Consecutive slices of ``size`` characters: ``<key>, seq, delta``; seq from 0. Null and empty texts give no rows."""
    n = F.ceil(F.length(text) / size).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col(text), i * size + 1, F.lit(size)))
    return df.where(F.length(text) > 0).select(key, F.posexplode(starts).alias("seq", "delta"))
