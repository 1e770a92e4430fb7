"""Queries on vector, sparse, hybrid and lexical search, fusion, aggregation and their metrics.

Query sets are all rows whose id is divisible by 20, searched against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.functions import text
from lathework.operators import evaluation, fastpath, lexical, ranking, vectors
from lathework.session import table, written

K = 5


def _embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null and size(embedding) > 0")
    rows = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), F.col("label").alias("grp"))
    return rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), rows


def _dense(metric):
    def run(spark, sf_dir):
        q, r = _embeddings(spark, sf_dir)
        return vectors.block_search(q, r, k=K, metric=metric)

    return run


def dense_filtered(spark, sf_dir):
    q, r = _embeddings(spark, sf_dir)
    return vectors.block_search(q, r, k=K, metric="cosine", same_group=True, exclude_self=True)


def dense_range(spark, sf_dir):
    """All rows with 0.1 < cosine <= 0.9; the query itself lies above the range. Small query blocks bound a task's hits."""
    q, r = _embeddings(spark, sf_dir)
    return vectors.block_search(q, r, k=None, metric="cosine", above=0.1, up_to=0.9, block_queries=100)


def ivf_recall(spark, sf_dir):
    """Recall at 5 of the inverted-file index with its own defaults against the exact search, over the query set: one row."""
    q, r = _embeddings(spark, sf_dir)
    exact = vectors.block_search(q, r, k=K, metric="cosine").select("query_id", "row_id")
    found = vectors.ivf_search(q, r, k=K, metric="cosine").select("query_id", "row_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "row_id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") / F.count("*") >= 0.9).alias("recall_reached"))


HEX20 = "cast(conv(substring(id, 1, 8), 16, 10) as bigint) % 20 = 0"


def _chunks(spark, sf_dir, columns=None):
    """(query set, all rows) of the chunks, each id once, without their texts and with ``columns`` only if given; written once for all that reads them."""
    c = table(spark, sf_dir, "chunks").where("id is not null")
    narrow = c.select(F.col("id").alias("row_id"), F.col("dense_vector").alias("vector"), F.col("sparse_vector").alias("sparse"), F.col("equipment_model").alias("grp"), "parent_id", "knowledge_type", "manufacturer", "language")
    rows = written((narrow.select("row_id", *columns) if columns else narrow).dropDuplicates(["row_id"]), "chunks-once")
    return rows.where(HEX20.replace("id", "row_id", 1)).withColumnRenamed("row_id", "query_id"), rows


def _routes(spark, sf_dir):
    q, r = _chunks(spark, sf_dir)
    dense = vectors.block_search(q.select("query_id", "vector", "grp"), r.select("row_id", "vector", "grp"), k=K, same_group=True)
    sparse = vectors.sparse_search(q.select("query_id", "sparse", "grp"), r.select("row_id", "sparse", "grp"), k=K, same_group=True)
    return q, r, dense, sparse


def sparse_ip(spark, sf_dir):
    q, r = _chunks(spark, sf_dir)
    return vectors.sparse_search(q.select("query_id", "sparse"), r.select("row_id", "sparse"), k=K)


def hybrid(spark, sf_dir):
    _, _, dense, sparse = _routes(spark, sf_dir)
    return vectors.weighted_fusion(dense, sparse, k=K)


def hybrid_rrf(spark, sf_dir):
    _, _, dense, sparse = _routes(spark, sf_dir)
    return vectors.reciprocal_rank_fusion(dense, sparse, k=K)


def filter_relaxation(spark, sf_dir):
    """Search under hard (model) and soft (type and maker) filters; queries without a strict hit but themselves drop the soft ones."""
    q, r = _chunks(spark, sf_dir)
    both = F.when(F.col("grp").isNotNull(), F.concat_ws("|", "grp", "knowledge_type", F.coalesce("manufacturer", F.lit(""))))
    named = lambda df, key, g: df.where("grp is not null").select(key, "vector", g.alias("grp"))
    strict = vectors.block_search(named(q, "query_id", both), named(r, "row_id", both), k=K, same_group=True, exclude_self=True).withColumn("relaxed", F.lit(False))
    strict = written(strict, "strict-hits")
    left = q.join(strict.select("query_id").distinct(), "query_id", "left_anti")  # only these are searched again
    relaxed = vectors.block_search(named(left, "query_id", F.col("grp")), named(r, "row_id", F.col("grp")), k=K, same_group=True, exclude_self=True).withColumn("relaxed", F.lit(True))
    return strict.unionByName(relaxed)


def _variant_hits(spark, sf_dir):
    q, r, dense, sparse = _routes(spark, sf_dir)
    hits = dense.withColumn("variant", F.lit(1)).unionByName(sparse.withColumn("variant", F.lit(2))).withColumnRenamed("row_id", "child_id")
    return q, r, hits


def child_fusion(spark, sf_dir):
    _, _, hits = _variant_hits(spark, sf_dir)
    out = ranking.fuse_children(hits)
    return out.withColumn("variants", F.array_join("variants", ","))


def _parents(spark, sf_dir):
    q, r, hits = _variant_hits(spark, sf_dir)
    fused = ranking.fuse_children(hits).select("query_id", "child_id", "score", F.col("fused_rank").alias("rank"))
    children = fused.join(r.select(F.col("row_id").alias("child_id"), "parent_id", "knowledge_type", "language"), "child_id")
    return q, r, ranking.aggregate_parents(children, ["knowledge_type", "language"])


def parent_aggregate(spark, sf_dir):
    _, _, p = _parents(spark, sf_dir)
    return p.withColumn("children", F.array_join("children", ","))


def rerank_top(spark, sf_dir):
    q, r, p = _parents(spark, sf_dir)
    c = table(spark, sf_dir, "chunks").where("id is not null")
    texts = c.join(p.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.max("parent_content").alias("parent_text"))  # one text per parent
    asked = c.where(HEX20).groupBy(F.col("id").alias("query_id")).agg(F.max("text").alias("query_text"))
    return ranking.rerank(p.join(texts, "parent_id").join(asked, "query_id")).select("query_id", "parent_id", "rerank_score", "final_rank")


def _judged(spark, sf_dir):
    q, r = _chunks(spark, sf_dir)
    hits = vectors.block_search(q.select("query_id", "vector", "grp"), r.select("row_id", "vector", "grp"), k=20, metric="cosine", same_group=True, exclude_self=True)
    named = hits.join(r.select("row_id", "parent_id"), "row_id")
    lists = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "parent_id"))), lambda x: x["parent_id"]).alias("ranking"))
    base = q.select("query_id", F.array("parent_id").alias("relevant"), "knowledge_type", "language", F.array_compact(F.array("manufacturer", "grp")).alias("tags"))
    return evaluation.ranking_metrics(base.join(lists, "query_id", "left"), K)


def rank_metrics(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", "hit", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.col("first_rank").cast("int").alias("first_rank"))


def macro(spark, sf_dir):
    return evaluation.macro_metrics(_judged(spark, sf_dir))


def sliced(spark, sf_dir):
    return evaluation.sliced_metrics(_judged(spark, sf_dir), ["knowledge_type", "language"], "tags")


def _faq(spark, sf_dir):
    corpus = table(spark, sf_dir, "jpkb")
    queries = table(spark, sf_dir, "rag_evaluate_data").where("sample_id % 20 = 0")
    return queries, written(lexical.corpus_terms(corpus, key="id", question=F.col("question")), "corpus-terms")


def bm25_topk(spark, sf_dir):
    return lexical.best_entries(*_faq(spark, sf_dir), query_key="sample_id", query_text=F.col("question"), k=K)


def bm25_softmax(spark, sf_dir):
    queries, terms = _faq(spark, sf_dir)
    return lexical.softmax_best(queries, terms, terms.select("entry_id").distinct().count(), query_key="sample_id", query_text=F.col("question"), accept=0.85)


ENTRY20 = "cast(right(entry_id, 7) as int) % 20 = 0"


def bm25_scoped(spark, sf_dir):
    entries = table(spark, sf_dir, "fast_path").where("entry_id is not null")
    terms = written(lexical.corpus_terms(entries, key="entry_id", question=F.col("question")), "corpus-terms")
    scope = entries.groupBy("entry_id").agg(F.min("equipment_model").alias("scope"))
    queries = entries.where(ENTRY20)
    scores = lexical.bm25_scores(queries, terms, query_key="entry_id", query_text=F.col("question"), scope=(scope.where(ENTRY20).withColumnRenamed("entry_id", "query_id"), scope))
    return lexical.ranked(scores, K)


def threshold_sweep(spark, sf_dir):
    top = lexical.best_entries(*_faq(spark, sf_dir), query_key="sample_id", query_text=F.col("question"), k=1)
    q = table(spark, sf_dir, "rag_evaluate_data").groupBy(F.col("sample_id").alias("query_id")).agg(F.min("question").alias("asked"))
    e = table(spark, sf_dir, "jpkb").groupBy(F.col("id").alias("entry_id")).agg(F.min("question").alias("answered"))
    seen = top.join(q, "query_id").join(e, "entry_id").withColumn("correct", text.squeezed(F.col("asked")) == text.squeezed(F.col("answered")))
    return evaluation.threshold_sweep(seen, [0.0, 5.0, 10.0, 20.0, 40.0])


def fast_answers(spark, sf_dir):
    e = table(spark, sf_dir, "fast_path").select("entry_id", "question", "alarm_code", "equipment_model").distinct()
    return fastpath.exact_answers(e.where(ENTRY20).withColumnRenamed("entry_id", "query_id"), e)


QUERIES = {
    "v1_dense_ip": _dense("ip"), "v4_dense_cosine": _dense("cosine"), "v5_dense_l2": _dense("l2"), "r1_dense_filtered": dense_filtered, "f8_dense_range": dense_range,
    "r8_ivf_recall": ivf_recall, "v2_sparse_ip": sparse_ip, "v3_hybrid_search": hybrid, "v6_hybrid_rrf": hybrid_rrf, "f4_filter_relaxation": filter_relaxation,
    "a2_child_fusion": child_fusion, "a1_parent_aggregate": parent_aggregate, "t2_rerank": rerank_top, "a3_rank_metrics": rank_metrics, "a4_macro_metrics": macro,
    "a8_sliced_metrics": sliced, "v8_bm25_topk": bm25_topk, "w6_bm25_softmax": bm25_softmax, "r4_bm25_scoped": bm25_scoped, "a5_threshold_sweep": threshold_sweep, "v11_fast_path": fast_answers,
}

_SCORES = {
    "ip": "list_inner_product(q.v, r.v)",
    "cosine": "list_inner_product(q.v, r.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(r.v, r.v))",
    "l2": "-sqrt(greatest(list_inner_product(q.v, q.v) + list_inner_product(r.v, r.v) - 2 * list_inner_product(q.v, r.v), 0))",
}
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)"


def _vectors_sql(metric, k=K, where="true", within=""):
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round({_SCORES[metric]}, 6) AS score FROM e q, e r WHERE q.vec_id % 20 = 0 AND {where}),
t AS (SELECT *, CAST({_TOP} AS INT) AS rank FROM s {within})
SELECT query_id, row_id, score, rank FROM t WHERE {"true" if k is None else f"rank <= {k}"}"""


_CHUNK = """
WITH c AS (SELECT DISTINCT ON (id) id, CAST(dense_vector AS DOUBLE[]) AS v, sparse_vector AS sp, equipment_model AS grp, parent_id, knowledge_type, manufacturer, text, language FROM chunks WHERE id IS NOT NULL),
qs AS (SELECT * FROM c WHERE CAST('0x' || substr(id, 1, 8) AS BIGINT) % 20 = 0),
terms AS (SELECT id, grp, unnest(map_entries(sp)) AS e FROM c),
"""
_DENSE = _CHUNK + f"""ds AS (SELECT q.id AS query_id, r.id AS row_id, round(list_inner_product(q.v, r.v), 6) AS score FROM qs q JOIN c r ON q.grp IS NULL OR q.grp = r.grp),
dense AS (SELECT * FROM (SELECT *, CAST({_TOP} AS INT) AS rank FROM ds) WHERE rank <= {K}),
"""


def _sparse_sql(group):
    return f"""ss AS (SELECT q.id AS query_id, r.id AS row_id, round(sum(CAST(q.e.value AS DOUBLE) * CAST(r.e.value AS DOUBLE)), 6) AS score
  FROM terms q JOIN terms r ON q.e.key = r.e.key AND ({group}) WHERE CAST('0x' || substr(q.id, 1, 8) AS BIGINT) % 20 = 0 GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, CAST({_TOP} AS INT) AS rank FROM ss) WHERE rank <= {K})
"""


_ROUTES = _DENSE + _sparse_sql("q.grp IS NULL OR q.grp = r.grp")
_FUSED = _ROUTES + """, hits AS (SELECT *, 1 AS variant FROM dense UNION ALL SELECT *, 2 AS variant FROM sparse),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, row_id ORDER BY score DESC, variant, rank) AS n FROM hits),
lists AS (SELECT query_id, row_id, string_agg(CAST(variant AS VARCHAR), ',' ORDER BY variant) AS variants FROM (SELECT DISTINCT query_id, row_id, variant FROM hits) GROUP BY 1, 2),
fused AS (SELECT b.query_id, b.row_id AS child_id, b.score, b.variant, b.rank, l.variants,
  CAST(row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.variant, b.rank, b.row_id) AS INT) AS fused_rank FROM best b JOIN lists l USING (query_id, row_id) WHERE n = 1)
"""
_PARENT = _FUSED + """, kids AS (SELECT f.query_id, f.child_id, f.score, f.fused_rank AS rank, c.parent_id, c.knowledge_type, c.language FROM fused f JOIN c ON c.id = f.child_id),
par AS (SELECT query_id, parent_id, max(score) AS score, min(rank) AS first_rank, count(*) AS n_hits, string_agg(child_id, ',' ORDER BY rank, child_id) AS children,
  count(DISTINCT (knowledge_type, language)) > 1 AS conflict FROM kids GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank, parent_id) AS INT) AS parent_rank FROM par)
"""


def tokens_sql(c):
    """Tokens of a question in DuckDB."""
    words = rf"regexp_extract_all(trim(regexp_replace(nfc_normalize({c}), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g')), '[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*|[\x{{3400}}-\x{{9fff}}]+')"
    return f"""flatten(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '^[\\x{{3400}}-\\x{{9fff}}]')
      THEN list_concat(list_transform(range(1, length(w) + 1), lambda i: substring(w, i, 1)), list_transform(range(1, length(w)), lambda i: substring(w, i, 2))) ELSE [w] END))"""


def _bm25_sql(corpus, key, queries, qkey, scope=False):
    join = "JOIN scopes qs ON qs.entry_id = a.query_id JOIN scopes es ON es.entry_id = t.entry_id AND (qs.scope IS NULL OR qs.scope = es.scope)" if scope else ""
    scopes = f"scopes AS (SELECT {key} AS entry_id, min(equipment_model) AS scope FROM {corpus} GROUP BY 1)," if scope else ""
    return f"""
WITH entries AS (SELECT {key} AS entry_id, min(question) AS q FROM {corpus} WHERE {key} IS NOT NULL GROUP BY 1), {scopes}
listed AS (SELECT entry_id, {tokens_sql("q")} AS t FROM entries),
terms AS (SELECT entry_id, len(t) AS dl, unnest(t) AS token FROM listed),
tf AS (SELECT entry_id, dl, token, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(DISTINCT entry_id) AS n, (SELECT avg(dl) FROM (SELECT DISTINCT entry_id, dl FROM tf)) AS avgdl FROM tf),
raw AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY token, n),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql("q")}) AS token FROM (SELECT {qkey} AS query_id, min(question) AS q FROM {queries} GROUP BY 1)) GROUP BY 1, 2),
scores AS (SELECT a.query_id, t.entry_id, round(sum(a.qtf * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * t.dl / n.avgdl))), 6) AS score, count(*) AS matched
  FROM asked a JOIN tf t USING (token) JOIN idf i USING (token) CROSS JOIN n {join} GROUP BY 1, 2),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INT) AS rank FROM scores)
"""


_FAQ = _bm25_sql("jpkb", "id", "(SELECT * FROM rag_evaluate_data WHERE sample_id % 20 = 0)", "sample_id")
_JUDGED = _CHUNK + f"""js AS (SELECT q.id AS query_id, r.id AS row_id, r.parent_id, round({_SCORES["cosine"]}, 6) AS score FROM qs q JOIN c r ON (q.grp IS NULL OR q.grp = r.grp) AND q.id <> r.id),
jt AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM js) WHERE rank <= 20),
firsts AS (SELECT query_id, parent_id, min(rank) AS rank FROM jt GROUP BY 1, 2),
placed AS (SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM firsts),
judged AS (SELECT q.id AS query_id, q.knowledge_type, q.language, q.manufacturer, q.grp, CASE WHEN p.place <= {K} THEN 1.0 ELSE 0.0 END AS hit,
  CASE WHEN p.place <= {K} THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN p.place <= {K} THEN 1.0 / p.place ELSE 0.0 END AS mrr, CASE WHEN p.place <= {K} THEN p.place END AS first_rank
  FROM qs q LEFT JOIN placed p ON p.query_id = q.id AND p.parent_id = q.parent_id)
"""
_MEANS = "count(*) AS n_samples, round(avg(CAST(hit AS DOUBLE)), 6) AS hit, round(avg(CAST(recall AS DOUBLE)), 6) AS recall, round(avg(CAST(mrr AS DOUBLE)), 6) AS mrr"
_FASTQ = r"regexp_replace(nfc_normalize(question), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')"
_RELAXED = _CHUNK + f"""pairs AS (SELECT q.id AS query_id, r.id AS row_id, round(list_inner_product(q.v, r.v), 6) AS score,
  q.knowledge_type = r.knowledge_type AND coalesce(q.manufacturer, '') = coalesce(r.manufacturer, '') AS strict_ok FROM qs q JOIN c r ON q.grp = r.grp AND q.id <> r.id),
kept AS (SELECT * FROM (SELECT *, bool_or(strict_ok) OVER (PARTITION BY query_id) AS any_strict FROM pairs) WHERE strict_ok OR NOT any_strict),
t AS (SELECT *, CAST({_TOP} AS INT) AS rank FROM kept)
SELECT query_id, row_id, score, rank, NOT any_strict AS relaxed FROM t WHERE rank <= {K}"""

_PLAIN = tokens_sql("X").replace("nfc_normalize(X)", "X")

SQL = {
    "r8_ivf_recall": "SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0",
    "t2_rerank": _PARENT + f""", texts AS (SELECT parent_id, max(parent_content) AS body FROM chunks WHERE id IS NOT NULL AND parent_id IN (SELECT parent_id FROM ranked) GROUP BY 1),
pt AS (SELECT parent_id, {_PLAIN.replace("X", "body")} AS has FROM texts),
qt AS (SELECT id AS query_id, list_distinct({_PLAIN.replace("X", "text")}) AS asked FROM (SELECT id, max(text) AS text FROM chunks WHERE id IN (SELECT id FROM qs) GROUP BY 1)),
sc AS (SELECT r.*, round(coalesce(len(list_filter(asked, lambda w: list_contains(has, w))) / nullif(len(asked), 0), 0), 6) AS rerank_score FROM ranked r JOIN pt USING (parent_id) JOIN qt USING (query_id)),
fin AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, first_rank, parent_id) AS INT) AS final_rank FROM sc)
SELECT query_id, parent_id, rerank_score, final_rank FROM fin WHERE final_rank <= 2""",
    "v1_dense_ip": _vectors_sql("ip"), "v4_dense_cosine": _vectors_sql("cosine"), "v5_dense_l2": _vectors_sql("l2"),
    "r1_dense_filtered": _vectors_sql("cosine", where="q.label = r.label AND q.vec_id <> r.vec_id"),
    "f8_dense_range": _vectors_sql("cosine", k=None, within="WHERE score > 0.1 AND score <= 0.9"),
    "v2_sparse_ip": _CHUNK + _sparse_sql("true") + "SELECT query_id, row_id, score, rank FROM sparse",
    "v3_hybrid_search": _ROUTES + f", f AS (SELECT query_id, row_id, round(0.8 * coalesce(d.score, 0) + 0.3 * coalesce(s.score, 0), 6) AS score FROM dense d FULL OUTER JOIN sparse s USING (query_id, row_id)), t AS (SELECT *, CAST({_TOP} AS INT) AS rank FROM f) SELECT * FROM t WHERE rank <= {K}",
    "v6_hybrid_rrf": _ROUTES + f", f AS (SELECT query_id, row_id, round(sum(1.0::DOUBLE / (100 + rank)), 6) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY 1, 2), t AS (SELECT *, CAST({_TOP} AS INT) AS rank FROM f) SELECT * FROM t WHERE rank <= {K}",
    "f4_filter_relaxation": _RELAXED,
    "a2_child_fusion": _FUSED + "SELECT query_id, child_id, score, variant, rank, variants, fused_rank FROM fused",
    "a1_parent_aggregate": _PARENT + "SELECT * FROM ranked",
    "a3_rank_metrics": _JUDGED + "SELECT query_id, CAST(hit AS DOUBLE) AS hit, CAST(recall AS DOUBLE) AS recall, round(CAST(mrr AS DOUBLE), 6) AS mrr, CAST(first_rank AS INT) AS first_rank FROM judged",
    "a4_macro_metrics": _JUDGED + f"SELECT {_MEANS} FROM judged",
    "a8_sliced_metrics": _JUDGED + f"""SELECT 'overall' AS slice, NULL AS value, {_MEANS} FROM judged
UNION ALL SELECT 'knowledge_type', knowledge_type, {_MEANS} FROM judged GROUP BY 2 UNION ALL SELECT 'language', language, {_MEANS} FROM judged GROUP BY 2
UNION ALL SELECT 'tags', tag, {_MEANS} FROM (SELECT *, unnest(list_distinct([manufacturer, grp])) AS tag FROM judged) WHERE tag IS NOT NULL GROUP BY 2""",
    "v8_bm25_topk": _FAQ + f"SELECT query_id, entry_id, score, matched, rank FROM top WHERE rank <= {K}",
    "w6_bm25_softmax": _FAQ + """, per AS (SELECT query_id, max(score) AS top, greatest(max(score), 0) AS m, count(*) AS k FROM scores GROUP BY 1),
mass AS (SELECT s.query_id, sum(exp(s.score - p.m)) AS mass FROM scores s JOIN per p USING (query_id) GROUP BY 1)
SELECT t.query_id, t.entry_id, round(exp(p.top - p.m) / (mass + (n.n - p.k) * exp(-p.m)), 6) AS probability, exp(p.top - p.m) / (mass + (n.n - p.k) * exp(-p.m)) > 0.85 AS accepted
FROM top t JOIN per p USING (query_id) JOIN mass USING (query_id) CROSS JOIN n WHERE t.rank = 1""",
    "r4_bm25_scoped": _bm25_sql("fast_path", "entry_id", "(SELECT * FROM fast_path WHERE CAST(right(entry_id, 7) AS INT) % 20 = 0)", "entry_id", scope=True) + f"SELECT query_id, entry_id, score, matched, rank FROM top WHERE rank <= {K}",
    "a5_threshold_sweep": _FAQ + r""", o AS (SELECT t.score, t.matched, trim(regexp_replace(q.asked, '[\s\p{Z}]+', ' ', 'g')) = trim(regexp_replace(e.answered, '[\s\p{Z}]+', ' ', 'g')) AS correct FROM top t
  JOIN (SELECT sample_id, min(question) AS asked FROM rag_evaluate_data GROUP BY 1) q ON q.sample_id = t.query_id JOIN (SELECT id, min(question) AS answered FROM jpkb GROUP BY 1) e ON e.id = t.entry_id WHERE rank = 1),
x AS (SELECT *, matched > 0 AND score >= threshold AS accepted FROM o, (SELECT unnest([0.0, 5.0, 10.0, 20.0, 40.0]::DOUBLE[]) AS threshold))
SELECT threshold, count(*) AS eligible, count(*) FILTER (accepted) AS accepted, round(count(*) FILTER (accepted AND correct) / nullif(count(*) FILTER (accepted), 0), 6) AS precision,
 round(count(*) FILTER (accepted) / count(*), 6) AS coverage, round(count(*) FILTER (accepted AND correct) / nullif(count(*) FILTER (correct), 0), 6) AS recall,
 count(*) FILTER (accepted AND NOT correct) AS false_accepts FROM x GROUP BY threshold""",
    "v11_fast_path": f"""
WITH e AS (SELECT DISTINCT entry_id, alarm_code, equipment_model, trim({_FASTQ}) AS nq FROM fast_path),
q AS (SELECT * FROM e WHERE CAST(right(entry_id, 7) AS INT) % 20 = 0),
a AS (SELECT q.entry_id AS query_id, count(DISTINCT e.entry_id) AS n, min(e.entry_id) AS x FROM q JOIN e ON q.alarm_code = e.alarm_code AND (q.equipment_model IS NULL OR q.equipment_model = e.equipment_model) GROUP BY 1),
f AS (SELECT q.entry_id AS query_id, count(DISTINCT e.entry_id) AS n, min(e.entry_id) AS x FROM q JOIN e ON q.nq = e.nq AND (q.equipment_model IS NULL OR q.equipment_model = e.equipment_model) AND (q.alarm_code IS NULL OR q.alarm_code = e.alarm_code) GROUP BY 1)
SELECT q.query_id, CASE WHEN a.n = 1 THEN 'exact_alarm' WHEN a.n > 1 THEN 'ambiguous_alarm' WHEN f.n = 1 THEN 'exact_faq' WHEN f.n > 1 THEN 'ambiguous_faq' ELSE 'fallback' END AS route,
 CASE WHEN a.n = 1 THEN a.x WHEN a.n IS NULL AND f.n = 1 THEN f.x END AS entry_id
FROM (SELECT DISTINCT entry_id AS query_id FROM q) q LEFT JOIN a USING (query_id) LEFT JOIN f USING (query_id)""",
}
