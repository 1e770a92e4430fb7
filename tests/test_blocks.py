import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lathework.operators import lexical, runs, vectors
from lathework.plans import corpus, search


def _questions(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["pump", "fan", "轴承", "alarm", "E-1", "E-2", "oil"]) for _ in range(r.randint(1, 5)))) for i in range(n)]


def _faq(spark):
    corpus = spark.createDataFrame([*_questions(90, 1), (90, None)], "id int, question string")
    queries = spark.createDataFrame([*_questions(40, 2), (40, "nothing known"), (41, "")], "sample_id int, question string")
    return queries, lexical.corpus_terms(corpus, key="id", question=F.col("question"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_best_entries_in_blocks_equal_all_scores_ranked(spark):
    queries, terms = _faq(spark)
    every = lexical.bm25_scores(queries, terms, query_key="sample_id", query_text=F.col("question"))
    got = lexical.best_entries(queries, terms, query_key="sample_id", query_text=F.col("question"), k=3, block_terms=40, block_asked=30)
    names = ["query_id", "entry_id", "score", "matched", "rank"]
    assert _rows(got.select(names)) == _rows(lexical.ranked(every, 3).select(names))


def test_softmax_in_blocks_equals_the_formula(spark):
    queries, terms = _faq(spark)
    every = lexical.ranked(lexical.bm25_scores(queries, terms, query_key="sample_id", query_text=F.col("question")), 1000)
    n = terms.select("entry_id").distinct().count()
    per = every.groupBy("query_id").agg(F.min_by("entry_id", "rank").alias("entry_id"), (F.exp(F.max("score")) / (F.sum(F.exp("score")) + n - F.count("*"))).alias("p"))
    want = _rows(per.select("query_id", "entry_id", F.round("p", 6), F.col("p") > 0.2))
    got = lexical.softmax_best(queries, terms, n, query_key="sample_id", query_text=F.col("question"), accept=0.2, block_terms=40, block_asked=30)
    assert _rows(got) == want and len(want) == 40


def _own_tables(spark, folder):
    spark.createDataFrame(_questions(90, 1), "id int, question string").write.parquet(f"{folder}/jpkb.parquet")
    spark.createDataFrame(_questions(60, 2), "sample_id int, question string").write.parquet(f"{folder}/rag_evaluate_data.parquet")
    return str(folder)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_all_entries_are_not_shuffled_for_the_best(spark, tmp_path):
    folder = _own_tables(spark, tmp_path)
    for run in (search.bm25_topk, search.threshold_sweep):
        plan = _plan(run(spark, folder))
        assert "FlatMapCoGroups" in plan and "sum((cast(qtf" not in plan


def test_scores_of_all_entries_are_not_shuffled_for_the_softmax(spark, tmp_path):
    plan = _plan(search.bm25_softmax(spark, _own_tables(spark, tmp_path)))
    assert "FlatMapCoGroups" in plan and "sum((cast(qtf" not in plan


@pytest.mark.parametrize("metric", ["ip", "cosine"])
@pytest.mark.parametrize("groups", [False, True])
def test_nearest_rows_equal_brute_force_with_ties_and_without_a_full_sort(metric, groups, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 640)
    monkeypatch.setattr(vectors, "MOST_PAIRS", 3000)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(5000, 4)), 1).astype(np.float32)  # many near and equal scores
    x[:300], x[300:310] = x[0], 0
    ids = [f"{i:05d}" for i in r.permutation(5000)]
    right = pd.DataFrame({"row_id": ids, "vector": list(x), "grp": [i % 7 for i in range(5000)]})
    left = right.iloc[[0, 305, *range(600, 900)]].rename(columns={"row_id": "query_id"})
    sorted_over = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sorted_over.append(np.shape(a)) or argsort(a, *args, **kw))
    score, _ = vectors._scorer(("string", "string"), metric, 20, groups=groups, exclude_self=True)
    got = score(left, right)
    assert not [s for s in sorted_over if len(s) == 2 and s[1] == 5000]
    for i in (0, 1, 2, 99, 301):
        q = left.iloc[i]
        s = np.round(vectors._scores(np.array([q.vector], dtype=float), x.astype(float), metric)[0], 6)
        rows = [(-v, n) for v, n, g in zip(s, ids, right["grp"]) if n != q.query_id and (not groups or g == q.grp)]
        mine = got[got.query_id == q.query_id]
        assert [n for _, n in sorted(rows)[:20]] == mine.row_id.tolist() and np.allclose([-v for v, _ in sorted(rows)[:20]], mine.score)


def _shared(monkeypatch, query):
    """How often the chunks are made, and whether both runs got the same."""
    made, runs_of = [], []
    monkeypatch.setattr(search, "_chunks", lambda *a: made.append(a) or ("q", "r"))
    monkeypatch.setattr(corpus, "_run", lambda spark, sf_dir, chunks, same_group: runs_of.append(chunks))
    monkeypatch.setattr(runs, "paired", lambda a, b: None)
    monkeypatch.setattr(runs, "paired_macro", lambda pairs: None)
    query(None, "x")
    return len(made), len(runs_of) == 2 and runs_of[0] is runs_of[1]


def test_paired_runs_share_one_table_of_chunks(monkeypatch):
    assert _shared(monkeypatch, corpus.paired_runs) == (1, True)


def test_paired_macro_shares_one_table_of_chunks(monkeypatch):
    assert _shared(monkeypatch, corpus.paired_macro) == (1, True)


def test_cosines_in_few_dimensions_score_only_boxes_within_reach(monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(30_000, 4)).astype(np.float32)
    x[15_000:] = x[:15_000]  # ties
    ids = [f"{i:05d}" for i in range(30_000)]
    right = pd.DataFrame({"row_id": ids, "vector": list(x)})
    left = right.iloc[::20].rename(columns={"row_id": "query_id"})
    seen = []
    nonzero = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda a: seen.append(np.size(a)) or nonzero(a))
    monkeypatch.delattr(vectors, "_nearest")  # it scores all pairs
    score, _ = vectors._scorer(("string", "string"), "cosine", 20, groups=False, exclude_self=True)
    got = score(left, right).sort_values(["query_id", "score", "row_id"], ascending=[True, False, True])
    assert sum(seen) < len(left) * len(right) / 2
    s = np.round(vectors._scores(x[::20].astype(float), x.astype(float), "cosine"), 6)
    s[np.arange(len(left)), np.arange(len(left)) * 20] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :20]
    assert np.array_equal(got["row_id"].to_numpy().reshape(-1, 20), np.array(ids)[best])


def test_paired_runs_write_ids_vectors_and_groups_only(spark, tmp_path, monkeypatch):
    fields = "id string, dense_vector array<float>, sparse_vector map<bigint,float>, equipment_model string, parent_id string, knowledge_type string, manufacturer string, language string"
    spark.createDataFrame([(f"{k:064x}", [1.0], {1: 1.0}, "m", "p", "k", "f", "en") for k in range(3)], fields).write.parquet(f"{tmp_path}/chunks.parquet")
    wrote = []
    monkeypatch.setattr(search, "written", lambda df, what: wrote.append(df.columns) or df)
    monkeypatch.setattr(corpus, "_run", lambda *a, **k: None)
    monkeypatch.setattr(runs, "paired", lambda a, b: None)
    corpus._pairs(spark, str(tmp_path))
    assert wrote == [["row_id", "vector", "grp"]]
