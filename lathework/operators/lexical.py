"""BM25 over a question corpus, for batches of queries.

Corpus statistics come from the whole corpus; only entries within a query's
scope are scored. Queries and entries meet by an equi-join on tokens, hot tokens
spread by AQE's skew join. Where all entries are in scope and only the best or a
sum over them is asked for, blocks of queries meet blocks of entries instead, each
in its own task, and no score but what is asked for is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions import text

# The usual constants of BM25Okapi.
K1, B, EPSILON = 1.5, 0.75, 0.25


def corpus_terms(corpus: DataFrame, *, key: str, question: Column) -> DataFrame:
    """``entry_id, token, tf, dl`` of every entry; entries without tokens have none and repeated keys count once."""
    entries = corpus.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("entry_id")).agg(F.min(question).alias("q"))
    listed = entries.select("entry_id", text.tokens(text.normal_question(F.col("q"))).alias("t")).withColumn("dl", F.size("t"))
    return listed.select("entry_id", "dl", F.explode("t").alias("token")).groupBy("entry_id", "dl", "token").agg(F.count("*").alias("tf"))


def inverse_frequencies(terms: DataFrame) -> DataFrame:
    """``token, idf``; negative values are floored at epsilon times the mean over the vocabulary."""
    df = terms.groupBy("token").agg(F.count("*").alias("df"))
    n = terms.agg(F.countDistinct("entry_id").alias("n"))
    raw = df.crossJoin(F.broadcast(n)).select("token", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # n is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # mean is one row


def bm25_scores(queries: DataFrame, terms: DataFrame, *, query_key: str, query_text: Column, scope: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id, entry_id, score, matched`` for entries that share a token with the query; repeated query tokens count repeatedly.

    ``scope`` = (query scopes: query_id, scope; entry scopes: entry_id, scope) keeps entries of the query's scope
    only; a null scope of a query means all, a null scope of an entry matches none.
    """
    asked, postings = _weighted(queries, terms, query_key, query_text)
    if scope is not None:
        asked = asked.join(scope[0].withColumnRenamed("scope", "q_scope"), "query_id", "left")
        postings = postings.join(scope[1].withColumnRenamed("scope", "e_scope"), "entry_id", "left")
    hits = asked.join(postings, "token")
    if scope is not None:
        hits = hits.where(F.col("q_scope").isNull() | (F.col("q_scope") == F.col("e_scope")))
    return hits.groupBy("query_id", "entry_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"), F.count("*").alias("matched"))


def _weighted(queries: DataFrame, terms: DataFrame, query_key: str, query_text: Column) -> tuple[DataFrame, DataFrame]:
    """(``query_id, token, qtf``, ``entry_id, token, w``): a score is the sum of qtf times w over the tokens that both have."""
    stats = terms.select("entry_id", "dl").distinct().agg(F.avg("dl").alias("avgdl"))
    q = queries.groupBy(F.col(query_key).alias("query_id")).agg(F.min(query_text).alias("q"))
    asked = q.select("query_id", F.explode(text.tokens(text.normal_question(F.col("q")))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    postings = terms.join(inverse_frequencies(terms), "token").crossJoin(F.broadcast(stats))  # stats is one row
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return asked, postings.select("entry_id", "token", weight.alias("w"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries per query with ``rank`` from 1; ties go to the smaller entry id. Scores are rounded to 6 places first, so ties do not hang on the order of additions."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    rounded = scores.where(text.finite(F.col("score"))).withColumn("score", F.round("score", 6))
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _in_blocks(queries: DataFrame, terms: DataFrame, query_key: str, query_text: Column, taken: Callable, block_terms: int, block_asked: int) -> DataFrame:
    """What ``taken`` makes of each query's scores (rounded to 6 places) in each block of entries; queries without an id are left out.

    ``taken`` gets the ids of a block's entries in their order, and of those that share a token with the query
    the positions, scores and counts of tokens. Queries with the same tokens are scored once.
    """
    asked, postings = _weighted(queries.where(F.col(query_key).isNotNull()), terms, query_key, query_text)
    least = min(16, terms.sparkSession.sparkContext.defaultParallelism)
    blocks = lambda n, most, at_least: F.greatest(F.ceil(F.col(n) / most), F.lit(at_least)).cast("int")
    n_asked, n_terms = asked.agg(F.count("*").alias("na")), terms.agg(F.count("*").alias("nt"))
    sizes = F.broadcast(n_asked.crossJoin(n_terms).select(blocks("na", block_asked, 1).alias("nqb"), blocks("nt", block_terms, least).alias("neb")))  # one row
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = asked.crossJoin(sizes).select("query_id", "token", "qtf", own("query_id", "nqb").alias("qb"), each("neb").alias("eb"))
    right = postings.crossJoin(sizes).select("entry_id", "token", "w", each("nqb").alias("qb"), own("entry_id", "neb").alias("eb"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", *taken.columns]
        entries, at = np.unique(right["entry_id"].to_numpy(), return_inverse=True)
        code, vocabulary = pd.factorize(right["token"])
        order = np.argsort(code, kind="stable")
        at, w, starts = at[order], right["w"].to_numpy()[order], np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
        left = left.sort_values(["query_id", "token"], ignore_index=True)
        left = left.assign(code=pd.Index(vocabulary).get_indexer(left["token"])).query("code >= 0")
        ids, rows, known = [], [], {}
        for query, x in _runs(left["query_id"].to_numpy(), left["code"].to_numpy(), left["qtf"].to_numpy()):
            key = x.tobytes()
            if key not in known:
                spans = [(slice(starts[c], starts[c + 1]), n) for c, n in x]
                met = np.concatenate([at[s] for s, _ in spans])
                total, matched = np.bincount(met, np.concatenate([w[s] * n for s, n in spans]), len(entries)), np.bincount(met, minlength=len(entries))
                there = np.flatnonzero(matched)
                there = there[np.isfinite(total[there])]
                known[key] = taken(entries, there, np.round(total[there], 6), matched[there])
            ids += [query] * len(known[key])
            rows += known[key]
        columns = list(zip(*rows)) or [()] * len(taken.columns)
        return pd.DataFrame(dict(zip(names, [ids, *columns])))

    types = dict(asked.dtypes)["query_id"], dict(terms.dtypes)["entry_id"]
    return left.groupBy("qb", "eb").cogroup(right.groupBy("qb", "eb")).applyInPandas(score, f"query_id {types[0]}, " + taken.schema.format(entry=types[1]))


def _runs(ids: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Each run of one id with its values side by side."""
    ends = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)) if len(ids) else []
    table, start = np.stack(values, axis=1), 0
    for end in ends:
        yield ids[start], table[start:end]
        start = end


class _Best:
    """The ``k`` best entries; ties go to the smaller id."""

    columns, schema = ["entry_id", "score", "matched"], "entry_id {entry}, score double, matched long"

    def __init__(self, k: int):
        self.k = k

    def __call__(self, entries: np.ndarray, at: np.ndarray, score: np.ndarray, matched: np.ndarray) -> list[tuple]:
        if len(score) > self.k:
            some = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
        else:
            some = np.arange(len(score))
        some = some[np.argsort(-score[some], kind="stable")][: self.k]
        return list(zip(entries[at[some]].tolist(), score[some].tolist(), matched[some].tolist()))


class _Mass:
    """The best entry, how many entries there are, and the sum of their exponentials relative to ``m``."""

    columns, schema = ["entry_id", "top", "n", "m", "mass"], "entry_id {entry}, top double, n long, m double, mass double"

    def __call__(self, entries: np.ndarray, at: np.ndarray, score: np.ndarray, matched: np.ndarray) -> list[tuple]:
        if not len(score):
            return []
        best = int(score.argmax())
        m = max(float(score[best]), 0.0)
        return [(entries[at[best : best + 1]].tolist()[0], float(score[best]), len(score), m, float(np.exp(score - m).sum()))]


def best_entries(queries: DataFrame, terms: DataFrame, *, query_key: str, query_text: Column, k: int, block_terms: int = 1_000_000, block_asked: int = 500_000) -> DataFrame:
    """The ``k`` best entries per query, as :func:`ranked` of :func:`bm25_scores` gives them; a task hands on ``k`` entries per query at most."""
    return ranked(_in_blocks(queries, terms, query_key, query_text, _Best(k), block_terms, block_asked), k)


def softmax_best(queries: DataFrame, terms: DataFrame, n_entries: int | Column, *, query_key: str, query_text: Column, accept: float, block_terms: int = 1_000_000, block_asked: int = 500_000) -> DataFrame:
    """The best entry per query with its softmax over all ``n_entries`` entries (those without a shared token score 0), and whether it exceeds ``accept``; a task hands on one row per query."""
    parts = _in_blocks(queries, terms, query_key, query_text, _Mass(), block_terms, block_asked)
    best = F.min(F.struct((-F.col("top")).alias("order"), "entry_id"))["entry_id"]
    per = parts.groupBy("query_id").agg(best.alias("entry_id"), F.max("top").alias("top"), F.sum("n").alias("n"), F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("m", "mass"))).alias("parts"))  # a part for each block
    mass = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["mass"] * F.exp(x["m"] - F.col("m")))
    rest = (F.lit(n_entries) if isinstance(n_entries, int) else n_entries) - F.col("n")
    p = F.exp(F.col("top") - F.col("m")) / (mass + rest * F.exp(-F.col("m")))
    return per.select("query_id", "entry_id", F.round(p, 6).alias("probability"), (p > accept).alias("accepted"))
