"""Query variants: what a planner may propose, what becomes of proposals that break the rules, and lists in model output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions.text import squeezed
from lathework.operators.analysis import FIELDS, stands_in

# Strategies, and most subqueries and characters of a query.
STRATEGIES = ["direct", "rewrite", "subquery"]
MOST_SUBQUERIES, MOST_CHARS = 4, 16384
ASCII_TOKEN = r"([A-Za-z0-9][A-Za-z0-9_.-]*)"
NONE = "array<string>"


def valid_query(c: Column) -> Column:
    """Whether a query is not blank and not too long; null is none."""
    return F.coalesce((squeezed(c) != "") & (F.length(c) <= MOST_CHARS), F.lit(False))


def keep_first(values: Column, key: Callable[[Column], Column]) -> Column:
    """``values`` without those whose ``key`` came before, in order."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def decision_errors(c: str = "") -> Column:
    """'' or what is wrong with a decision: strategy, rewritten_query, subqueries, reason_code, as columns or fields of the struct ``c``."""
    col = lambda n: F.col(f"{c}.{n}" if c else n)
    strategy, rewritten, n = col("strategy"), col("rewritten_query"), F.size(F.coalesce(col("subqueries"), F.array().cast(NONE)))
    bad = lambda x: ~valid_query(x)
    return (
        F.when(~F.coalesce(strategy.isin(STRATEGIES), F.lit(False)), "invalid_strategy").when(~F.coalesce(col("reason_code").rlike(r"^[a-z][a-z0-9_]{0,63}\z"), F.lit(False)), "invalid_reason_code")
        .when((strategy == "direct") & (rewritten.isNotNull() | (n > 0)), "direct_has_variants").when((strategy == "rewrite") & (rewritten.isNull() | (n > 0)), "rewrite_requires_one_query")
        .when((strategy == "rewrite") & ~valid_query(rewritten), "invalid_query").when((strategy == "subquery") & (rewritten.isNotNull() | ~n.between(1, MOST_SUBQUERIES)), "subquery_count")
        .when((strategy == "subquery") & F.exists(F.coalesce(col("subqueries"), F.array().cast(NONE)), bad), "invalid_query").otherwise("")
    )


def guarded(df: DataFrame, *, query: str, proposed: str, hard: list[str]) -> DataFrame:
    """Adds ``variants`` (the query itself first, then accepted proposals) and ``variant_error``.

    ``proposed`` is an array of queries, ``hard`` columns hold identifiers (null: none) that every proposal must keep as
    a token. A proposal with a token in Latin letters or digits that the query lacks is an error; if all proposals repeat the query
    or each other, that is one, too. With an error the query stands alone.
    """
    asked = F.regexp_extract_all(query, F.lit(ASCII_TOKEN), 1)
    p = F.coalesce(proposed, F.array().cast(NONE))
    lost = F.lit(False)
    for h in hard:
        lost = lost | (F.col(h).isNotNull() & F.exists(p, lambda v: ~stands_in(v, F.col(h))))  # noqa: B023
    new = F.exists(p, lambda v: F.size(F.array_except(F.regexp_extract_all(v, F.lit(ASCII_TOKEN), 1), asked)) > 0)
    kept = keep_first(F.concat(F.array(query), p), squeezed)
    error = (
        F.when(F.exists(p, lambda v: ~valid_query(v)), "invalid_query").when(lost, "hard_identifier_not_preserved").when(new, "new_identifier_token")
        .when((F.size(p) > 0) & (F.size(kept) == 1), "duplicate_query_variant").otherwise("")
    )
    return df.withColumn("variant_error", error).withColumn("variants", F.when(F.col("variant_error") == "", kept).otherwise(F.array(query)))


def planned(queries: DataFrame, plan: Callable[[Column], Column] | None, *, query: str) -> DataFrame:
    """The strategy of each query by a planner, a column function that gives JSON: adds ``strategy, decision_source, fallback_reason, variants``.

    Without a planner the strategy is direct. The planner's answer falls back to direct with a reason: null 'planner_error', the
    text timeout 'planner_timeout', other text that is no JSON object 'planner_invalid_json', a decision against its contract
    'planner_invalid_schema', or the error of its variants. ``queries`` has the identifier columns of the analysis.
    """
    if plan is None:
        return queries.withColumns({"strategy": F.lit("direct"), "decision_source": F.lit("default"), "fallback_reason": F.lit(None).cast("string"), "variants": F.array(query)})
    schema = "strategy string, rewritten_query string, subqueries array<string>, reason_code string"
    df = queries.withColumn("_raw", plan(F.col(query))).withColumn("_d", F.from_json("_raw", schema))
    object_ = F.coalesce(F.get_json_object("_raw", "$").startswith("{"), F.lit(False))
    contract = F.when(object_, decision_errors("_d")).otherwise("no_object")
    proposed = F.when(F.col("_d.strategy") == "rewrite", F.array("_d.rewritten_query")).when(F.col("_d.strategy") == "subquery", F.col("_d.subqueries")).otherwise(F.array().cast(NONE))
    df = df.withColumn("_proposed", F.when(contract == "", proposed).otherwise(F.array().cast(NONE))).withColumn("_contract", contract)
    df = guarded(df, query=query, proposed="_proposed", hard=[h for h in FIELDS if h in queries.columns])
    reason = (
        F.when(F.col("_raw").isNull(), "planner_error").when(F.lower("_raw") == "timeout", "planner_timeout").when(~object_, "planner_invalid_json")
        .when(F.col("_contract") != "", "planner_invalid_schema").when(F.col("variant_error") != "", F.col("variant_error"))
    )
    return df.withColumns({
        "fallback_reason": reason, "strategy": F.when(reason.isNull(), F.col("_d.strategy")).otherwise("direct"), "decision_source": F.when(reason.isNull(), "planner").otherwise("fallback"),
    }).drop("_raw", "_d", "_proposed", "_contract", "variant_error")


def lines(c: Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), squeezed_ends), lambda x: x != "")


def squeezed_ends(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def comma_list(c: Column) -> Column:
    """The items of a text separated by commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，]"), squeezed_ends), lambda x: x != "")


def json_output(c: Column, schema: str) -> Column:
    """The JSON object in a model's output, with or without a code fence around it, by ``schema``; null where there is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)^\s*(?:```(?:json)?\s*)?(\{.*\})\s*(?:```)?\s*\z", 1), schema)
