"""From evidence to answers: facts, prompts, rendering, the answer cache, and which route answers a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.text import json_text

# What an answer without evidence says, the heading of the sources, and greetings with the name of their reply.
INSUFFICIENT = "insufficient_evidence"
SOURCES = "来源："
GREETINGS = [("hello", r"你好|您好|hi|hello"), ("who", r"你是谁|您是谁|你叫什么|你的名字|who are you"), ("present", r"在吗|在不在|有人吗|在不"), ("doing", r"干嘛呢|你在干嘛|做什么")]
# Columns that steer retrieval and are no facts.
OBSERVED = ["best_retrieval_score", "rerank_score", "match_type", "fast_path_reason", "evidence_id"]
CITED = ["title", "document_id", "document_version", "source_file"]
MARKUP = r"\[E[0-9]+\]|^\s*\d+[.)、]"


def greeting(query: Column) -> Column:
    """The reply that a greeting asks for, by how the query begins; null for other queries."""
    return F.coalesce(*(F.when(F.regexp_replace(query, r"(?U)^\s+", "").rlike(f"(?i)^(?:{p})"), name) for name, p in GREETINGS), F.lit(None).cast("string"))


def facts(evidence: DataFrame) -> DataFrame:
    """Evidence without scores and routing, which support no claim."""
    return evidence.drop(*OBSERVED)


def conflicting_evidence(evidence: DataFrame, *, by: str = "query_id") -> DataFrame:
    """``<by>, conflict``: whether a parent comes with different facts, or a document in several versions."""
    own = [c for c in facts(evidence).columns if c not in {by, "rank"}]
    same_parent = evidence.groupBy(by, "parent_id").agg((F.count_distinct(F.xxhash64(*own)) > 1).alias("c")).groupBy(by).agg(F.bool_or("c").alias("parents"))
    versions = evidence.groupBy(by, "document_id").agg((F.count_distinct("document_version") > 1).alias("c")).groupBy(by).agg(F.bool_or("c").alias("versions"))
    return same_parent.join(versions, by).select(by, F.when(F.col("parents"), "conflicting_parent_evidence").when(F.col("versions"), "multiple_document_versions").otherwise("").alias("conflict"))


def messages(queries: DataFrame, evidence: DataFrame, *, instruction: str, most_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """``query_id, system, user, too_large``: the query, its analysis and its evidence as one JSON object, so none of them can pass for an instruction.

    ``queries``: query_id, original_query, query_analysis (struct or map); ``evidence``: query_id, evidence_id and its fields. A query
    without evidence has an empty list.
    """
    fields = [c for c in evidence.columns if c != "query_id"]
    number = F.regexp_extract("evidence_id", r"\d+", 0).cast("int")
    lists = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), F.struct(*fields).alias("e")))).alias("l"))
    x = queries.join(lists, "query_id", "left")
    none = F.array().cast(f"array<{evidence.select(F.struct(*fields).alias('e')).schema['e'].dataType.simpleString()}>")
    found = F.coalesce(F.transform("l", lambda e: e["e"]), none)
    user = F.to_json(F.struct("original_query", "query_analysis", found.alias("evidence")), {"ignoreNullFields": "false"})
    return x.select("query_id", F.lit(instruction).alias("system"), user.alias("user"), (F.octet_length(user) > most_bytes).alias("too_large"))


def context_text(passages: Column, most: int = 4096) -> Column:
    """Passages joined by empty lines, cut to ``most`` characters; nulls are left out."""
    return F.left(F.array_join(passages, "\n\n"), F.lit(most))


def attempt(df: DataFrame) -> DataFrame:
    """Adds ``attempt``: how a search was filtered and what came of it. ``df`` has mode, relaxed and n_hits."""
    return df.withColumn("attempt", F.struct(F.col("mode").alias("filter_mode"), F.coalesce("relaxed", F.lit(False)).alias("relaxed"), F.col("n_hits").alias("hit_count"), (F.col("n_hits") == 0).alias("zero_hits")))


def _source_line() -> Column:
    pair = lambda f: F.concat(F.lit(f'"{f}": '), F.coalesce(json_text(F.col(f)), F.lit("null")))
    parts = [x for f in CITED for x in (F.lit(", "), pair(f))][1:]
    return F.concat(F.lit("["), "evidence_id", F.lit("] {"), *parts, F.lit("}"))


def rendered(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, status, answer_text``: claims in order with their citations in brackets, then the cited sources in the order of the evidence.

    ``claims``: query_id, claim_id, text, evidence_ids; ``evidence``: query_id, evidence_id and :data:`CITED`. A query of
    ``claims`` whose texts are all null has status insufficient_evidence and no text of the model.
    """
    cite = F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("["), e, F.lit("]"))), "")
    line = F.struct("claim_id", F.concat("text", cite).alias("line"))
    body = claims.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), line))), lambda x: x["line"]), "\n\n").alias("body"))
    used = claims.where("text is not null").select("query_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    number = F.regexp_extract("evidence_id", r"\d+", 0).cast("int")
    sources = evidence.join(used, ["query_id", "evidence_id"], "left_semi").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(number.alias("n"), _source_line().alias("s")))), lambda x: x["s"]), "\n").alias("sources"))
    whole = F.concat("body", F.lit(f"\n\n{SOURCES}\n"), F.coalesce("sources", F.lit("")))
    x = body.join(sources, "query_id", "left")
    return x.select("query_id", F.when(F.col("body") != "", "answered").otherwise(INSUFFICIENT).alias("status"), F.when(F.col("body") != "", whole).otherwise("").alias("answer_text"))


def cached_errors(cached: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, cache_error``: '' for cached answers (query_id, status, answer_text) that their claims and evidence give again, letter by letter."""
    again = rendered(claims, evidence).select("query_id", F.col("answer_text").alias("_again"))
    cited = claims.select("query_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    lost = cited.join(evidence.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_anti").select("query_id").distinct().withColumn("_lost", F.lit(True))
    marked = claims.groupBy("query_id").agg(F.bool_or(F.col("text").rlike(MARKUP)).alias("_marked"), F.bool_or(F.size("evidence_ids") == 0).alias("_bare"))
    x = cached.join(again, "query_id", "left").join(lost, "query_id", "left").join(marked, "query_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    error = (
        F.when(~no(F.col("status") == "answered"), "only_answered_cache").when(F.col("_marked").isNull(), "no_claims").when(no("_lost") | no("_bare"), "invalid_cached_claim_links")
        .when(no("_marked"), "invalid_cached_claim_markup").when(~no(F.col("answer_text") == F.col("_again")), "invalid_cached_rendering").otherwise("")
    )
    return x.select("query_id", error.alias("cache_error"))


def cache_put(cache: DataFrame, answers: DataFrame, *, now: str, ttl_seconds: int) -> DataFrame:
    """The cache (cache_key, status, answer, expires_at) after storing ``answers`` (cache_key, status, answer): only answered ones with a text, each for ``ttl_seconds``; expired entries go."""
    if ttl_seconds <= 0:
        raise ValueError("time to live must be positive")
    at = F.lit(now).cast("timestamp")
    new = answers.where("status = 'answered' and answer <> ''").groupBy("cache_key").agg(F.max("answer").alias("answer")).select("cache_key", F.lit("answered").alias("status"), "answer", (at + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    return cache.where(F.col("expires_at") > at).join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new)


def cached(cache: DataFrame, queries: DataFrame, now: str) -> DataFrame:
    """Cached answers of ``queries`` (cache_key) that are valid at ``now``: status answered, not expired, with a text."""
    live = cache.where((F.col("status") == "answered") & (F.col("expires_at") > F.lit(now).cast("timestamp")) & F.col("answer").isNotNull())
    return queries.join(live.select("cache_key", "answer"), "cache_key")


def cache_key(df: DataFrame, parts: list[str]) -> DataFrame:
    """Adds ``cache_key``: a hash of everything an answer depends on, nulls included, whatever the order of ``parts``."""
    return df.withColumn("cache_key", F.sha2(F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}), 256))


def first_route(queries: DataFrame, *routes: tuple[str, DataFrame]) -> DataFrame:
    """``query_id, route, ...``: the rows of the first route (name, rows with query_id) that answers a query; ``not_found`` where none does.

    Each route gets rows only for queries that no earlier one answers, by anti-joins.
    """
    left, out = queries.select("query_id").distinct(), None
    for name, rows in routes:
        own = rows.join(left, "query_id", "left_semi").withColumn("route", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        left = left.join(rows.select("query_id"), "query_id", "left_anti")
    return out.unionByName(left.withColumn("route", F.lit("not_found")), allowMissingColumns=True)


def top_evidence(hits: DataFrame, m: int) -> DataFrame:
    """The first ``m`` documents of each query's context, by rank and id."""
    w = Window.partitionBy("query_id").orderBy("rank", "parent_id")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= m).drop("_n")
