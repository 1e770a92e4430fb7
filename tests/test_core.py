import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lathework.functions import text
from lathework.operators import analysis, answers, chunking, evaluation, fastpath, guards, ingestion, lexical, ranking, sessions, vectors
from lathework.plans import records, search
from lathework.sources import files
from lathework.streaming import ingest


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_tokens_and_normal_forms(spark):
    df = spark.createDataFrame([(1, "  QV-4100\u3000 主轴报警 e\u0301 "), (2, None), (3, "")], "id int, t string")
    got = {r.id: r for r in df.select("id", text.normal_question(F.col("t")).alias("n"), text.tokens(text.normal_question(F.col("t"))).alias("k")).collect()}
    assert got[1].n == "QV-4100 主轴报警 é"
    assert got[1].k == ["QV-4100", "主", "轴", "报", "警", "主轴", "轴报", "报警"]
    assert got[2].n is None and got[2].k == [] and got[3].k == []


def test_content_hash_ignores_layout_only(spark):
    df = spark.createDataFrame([("a \r\nb",), ("a\nb\n\n",), (" a\nb",), ("a\n b",)], "t string")
    h = [r[0] for r in df.select(text.content_sha(F.col("t"))).collect()]
    assert h[0] == h[1] == h[2] != h[3]


def test_identity_is_the_hash_of_the_json_array(spark):
    import hashlib
    import json

    df = spark.createDataFrame([('a"\\b\n主', "s")], "d string, s string")
    got = df.select(text.identity("parent", F.col("d"), F.col("s"), occurrence=F.lit(2))).first()[0]
    want = json.dumps(["parent", 'a"\\b\n主', "s", 2], ensure_ascii=False, separators=(",", ":"))
    assert got == hashlib.sha256(want.encode()).hexdigest()


def test_bm25_is_the_formula(spark):
    docs = {1: "alarm E80 pump", 2: "alarm pump pump", 3: "valve"}
    corpus = spark.createDataFrame(list(docs.items()), "id int, question string")
    queries = spark.createDataFrame([(7, "pump pump E80")], "q int, t string")
    terms = lexical.corpus_terms(corpus, key="id", question=F.col("question"))
    got = {r.entry_id: r.score for r in lexical.bm25_scores(queries, terms, query_key="q", query_text=F.col("t")).collect()}
    n, tok = len(docs), {k: v.split() for k, v in docs.items()}
    vocab = {w for v in tok.values() for w in v}
    raw = {w: math.log(n - sum(w in v for v in tok.values()) + 0.5) - math.log(sum(w in v for v in tok.values()) + 0.5) for w in vocab}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    avg = sum(map(len, tok.values())) / n
    for k, v in tok.items():
        want = sum(idf.get(w, 0) * v.count(w) * 2.5 / (v.count(w) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for w in "pump pump E80".split() if w in v)
        assert got.get(k, 0) == pytest.approx(want)


def test_block_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 4))
    rows = spark.createDataFrame([(i, v.tolist(), str(i % 3) if i % 7 else None) for i, v in enumerate(x)], "row_id int, vector array<double>, grp string")
    queries = rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    for metric in vectors.METRICS:
        got = vectors.block_search(queries, rows, k=3, metric=metric, block_rows=17, block_queries=2).collect()
        for q in range(0, 90, 20):
            s = np.round(vectors._scores(x[q : q + 1], x, metric)[0], 6)
            want = sorted(range(90), key=lambda i: (-s[i], i))[:3]
            assert [r.row_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    same = vectors.block_search(queries, rows, k=90, same_group=True, exclude_self=True).collect()
    g = {i: str(i % 3) if i % 7 else None for i in range(90)}
    assert all(r.query_id != r.row_id and (g[r.query_id] is None or g[r.query_id] == g[r.row_id]) for r in same)
    assert vectors.block_search(queries.limit(0), rows, k=3).count() == 0


def test_range_search_is_not_cut_by_nearer_rows(spark, tmp_path):
    import numpy as np

    angles = np.concatenate([np.zeros(31), np.linspace(0.5, 1.4, 40), np.linspace(1.5, 3, 29)])  # 30 copies of the query, 40 rows in range, 29 beyond
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    df = spark.createDataFrame([(i + 1001 * (i % 20 == 0 and i > 0), v.tolist(), 0) for i, v in enumerate(x)], "vec_id int, embedding array<double>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = search.dense_range(spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0}
    want = [(i + 1001 * (i % 20 == 0), float(s)) for i, s in enumerate(np.round(np.cos(angles), 6)) if 0.1 < s <= 0.9]
    assert len(want) == 40 and [(r.row_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 41))


def test_ivf_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id int, vector array<double>")
    queries = rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    exact = vectors.block_search(queries, rows, k=5, metric="cosine").select("query_id", "row_id")
    found = vectors.ivf_search(queries, rows, k=5, metric="cosine", lists=8, probes=6, sample=200)
    assert exact.join(found, ["query_id", "row_id"]).count() / exact.count() >= 0.9


def test_fusion_and_parents(spark):
    hits = spark.createDataFrame([(1, "2", 1, 1, 0.7), (1, "1", 1, 2, 0.6), (1, "1", 2, 1, 0.9), (1, "3", 2, 2, 0.7), (1, "2", 2, 3, 0.7), (1, "9", 2, 4, float("nan"))], "query_id int, child_id string, variant int, rank int, score double")
    got = sorted(one(ranking.fuse_children(hits), "fused_rank", "child_id", "score", "variant", "variants"))
    assert got == [(1, "1", 0.9, 2, [1, 2]), (2, "2", 0.7, 1, [1, 2]), (3, "3", 0.7, 2, [2])]
    kids = spark.createDataFrame([(1, "a", "1", 0.73, 1, "x"), (1, "a", "2", 0.81, 2, "x"), (1, "b", "3", 0.77, 3, None), (1, "c", "4", 0.1, 4, "x"), (1, "c", "5", 0.1, 5, None)], "query_id int, parent_id string, child_id string, score double, rank int, m string")
    got = sorted(one(ranking.aggregate_parents(kids, ["m"]), "parent_rank", "parent_id", "score", "n_hits", "children", "first_rank", "conflict"))
    assert got == [(1, "a", 0.81, 2, ["1", "2"], 1, False), (2, "b", 0.77, 1, ["3"], 3, False), (3, "c", 0.1, 2, ["4", "5"], 4, True)]


def test_rerank_reads_the_whole_parent(spark, tmp_path):
    rows = [("0" * 64, "P1", "alpha beta", "alpha beta\nzzz"), ("1" * 64, "P1", "zzz", "alpha beta\nzzz"), ("2" * 64, "P2", "alpha", "alpha")]
    df = spark.createDataFrame([(i, p, t, c, [1.0, 0.0], {1: 1.0}, None, "manual", None, "en") for i, p, t, c in rows], "id string, parent_id string, text string, parent_content string, dense_vector array<double>, sparse_vector map<bigint,double>, equipment_model string, knowledge_type string, manufacturer string, language string")
    df.write.parquet(str(tmp_path / "chunks.parquet"))
    got = one(search.rerank_top(spark, str(tmp_path)), "query_id", "parent_id", "rerank_score", "final_rank")
    assert sorted(got) == [("0" * 64, "P1", 1.0, 1), ("0" * 64, "P2", 0.5, 2)]


def test_weighted_and_reciprocal_fusion(spark):
    d = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2)], "query_id int, row_id string, score double, rank int")
    s = spark.createDataFrame([(1, "b", 1.0, 1), (1, "c", 0.9, 2)], "query_id int, row_id string, score double, rank int")
    assert one(vectors.weighted_fusion(d, s, k=9), "row_id", "score") == [("b", 0.62), ("a", 0.4), ("c", 0.27)]
    assert one(vectors.reciprocal_rank_fusion(d, s, k=1), "row_id") == [("b",)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["x", "x", "r"], ["r", "s"]), (2, None, ["r"]), (3, ["r"], []), (4, ["a", "b", "c", "r"], ["r"])], "id int, ranking array<string>, relevant array<string>")
    got = {r.id: (r.hit, r.recall, r.mrr, r.first_rank) for r in evaluation.ranking_metrics(df, 2).collect()}
    assert got == {1: (1.0, 0.5, 0.5, 2), 2: (0.0, 0.0, 0.0, None), 3: (None, None, None, None), 4: (0.0, 0.0, 0.0, None)}
    assert one(evaluation.macro_metrics(evaluation.ranking_metrics(df.limit(0), 2)), "n_samples", "hit") == [(0, None)]
    o = spark.createDataFrame([(5.0, 1, True), (3.0, 1, False), (9.0, 0, True)], "score double, matched int, correct boolean")
    got = sorted(one(evaluation.threshold_sweep(o, [0.0, 4.0, 99.0]), "threshold", "accepted", "precision", "recall", "false_accepts"))
    assert got == [(0.0, 2, 0.5, 0.5, 1), (4.0, 1, 1.0, 0.5, 0), (99.0, 0, None, 0.0, 0)]
    assert one(evaluation.latency(spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(None,)], "v double"), "v"), "n", "p95") == [(20, 19.0)]


def test_slices_of_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, "a", "x", ["t", "t"]), (0.0, 0.0, 0.0, "b", "x", ["t", "u"]), (1.0, 1.0, 1.0, None, "y", None)], "hit double, recall double, mrr double, d string, e string, tags array<string>")
    got = {(r.slice, r.value): (r.n_samples, r.hit) for r in evaluation.sliced_metrics(df, ["d", "e"], "tags").collect()}
    assert got[("overall", None)] == (3, 0.666667) and got[("d", None)] == (1, 1.0) and got[("e", "x")] == (2, 0.5) and got[("tags", "t")] == (2, 0.5)


def analysed(spark, questions):
    df = analysis.with_intent(analysis.entities(spark.createDataFrame(list(enumerate(questions, 1)), "id int, t string"), "t"), "t")
    return df


def test_query_analysis(spark):
    q = ["型号：QV-4100 报警码 E895 怎么办", "QV-4100 和 BEA-20 设备主轴", "转速 3000rpm", None, "备件 BKL-77-RS", "厂家：Norvex，设备类型=车床", "报警 E12 与 报警 E13", "型号 unknown 报警 2024-05-17 保养 QV-", "型号为 QV-41 小时", "Alarm code: E7 fault"]
    got = {r.id: r for r in analysis.filter_plan(analysed(spark, q)).collect()}
    assert (got[1].equipment_model, got[1].alarm_code, got[1].intent) == ("QV-4100", "E895", "alarm_fault")
    assert got[2].equipment_model is None and got[2].ambiguous == ["equipment_model"] and got[2].hard_equipment_model is None and got[2]["mode"] == "NONE"
    assert got[3].equipment_model is None and got[3].intent == "parameter" and got[3].confidence == "MEDIUM"
    assert got[4].intent == "general" and got[5].part_number == "BKL-77-RS"
    assert (got[6].manufacturer, got[6].equipment_type) == ("Norvex", "车床") and got[7].ambiguous == ["alarm_code"]
    assert got[8].equipment_model is None and got[8].alarm_code is None and got[9].equipment_model is None and got[10].alarm_code == "E7"


def test_shapes_count_only_near_their_words(spark):
    far = "x" * 30
    q = ["设备 QV-4100", f"设备{far}：QV-4100", "parts P-12-A", f"parts {far} P-12-A", "故障 ALM-55", "fault 1234567890123 E55", "fault 12345678 E55", "报警 E5 型号", "设备 A.QV-4100"]
    got = [(r.equipment_model, r.alarm_code, r.part_number) for r in analysed(spark, q).orderBy("id").collect()]
    assert got == [("QV-4100", None, None), (None, None, None), (None, None, "P-12-A"), (None, None, None), (None, "ALM-55", None), (None, None, None), (None, "E55", None), (None, "E5", None), (None, None, None)]


def test_pieces_keep_every_character(spark):
    texts = ["", "型号QV-4100。", "a.b c_d-", "-x- é", "y" * 300]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.pieces(F.col("t")).alias("p")).collect()]
    assert ["".join(x.piece for x in p) for p in got] == texts
    assert all(t[x["at"] - 1 :].startswith(x.piece) for t, p in zip(texts, got) for x in p)


def test_merge_with_a_classifier(spark):
    q = ["设备 QV-4100 怎么办", "换油 AB-7 吗", "型号 A-1 型号 B-2", "清洗", "清洗 E55", "报警 维护"]
    fields = {1: ("maintenance", "HIGH", "ZZ-9", None), 2: ("maintenance", "HIGH", "AB-7", None), 3: ("parts", "HIGH", "A-1", None), 4: ("parts", "HIGH", None, "Q-1"), 5: (None, None, None, None)}
    rows = [(k, i, c, m, None, p, None, None, None) for k, (i, c, m, p) in fields.items()]
    proposals = spark.createDataFrame(rows, "id int, p_intent string, p_confidence string, p_equipment_model string, p_alarm_code string, p_part_number string, p_manufacturer string, p_equipment_type string, p_fault_symptom string")
    got = {r.id: r for r in analysis.filter_plan(analysis.merged(analysed(spark, q), proposals, "id", "t")).collect()}
    assert got[1].equipment_model == "QV-4100" and got[1].warnings == ["semantic_entity_conflict_equipment_model"] and (got[1].confidence, got[1].source) == ("MEDIUM", "hybrid")
    assert got[2].equipment_model == "AB-7" and (got[2].confidence, got[2]["mode"], got[2].soft_types) == ("HIGH", "STRICT", ["maintenance", "case", "manual"])
    assert got[3].equipment_model is None and got[3].confidence == "LOW" and got[3].soft_types is None
    assert got[4].part_number is None and got[4].warnings == ["semantic_entity_rejected_part_number"] and got[4]["mode"] == "NONE" and got[4].source == "llm"
    assert got[5].source == "fallback" and "semantic_classifier_failed" in got[5].warnings
    assert got[6].source == "rules" and got[6].warnings == ["multiple_intent_cues"]
    plans = analysis.filter_plan(analysis.merged(analysed(spark, q), proposals, "id", "t"))
    assert {r.mode_error for r in analysis.mode_errors(plans).collect()} == {""}
    assert [(r.id, r["mode"], r.removed) for r in analysis.relaxed_plan(plans).collect()] == [(2, "RELAXED", ["types"])]
    wrong = plans.withColumn("mode", F.when(F.col("id") == 2, "RELAXED").when(F.col("id") == 4, "STRICT").otherwise("NONE"))
    assert {r.id: r.mode_error for r in analysis.mode_errors(wrong).collect() if r.mode_error} == {1: "none_with_filters", 2: "relaxed_needs_hard_only", 4: "strict_without_filters"}


def test_classifier_hook(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    answer = lambda c: F.when(c == "a", F.lit('{"intent":"parts","confidence":"HIGH","part_number":"P-1"}')).otherwise("no json")
    got = {r.id: (r.p_intent, r.p_part_number) for r in analysis.classified(q, answer, "t", "id").collect()}
    assert got == {1: ("parts", "P-1"), 2: (None, None)}


def test_relaxation_happens_only_without_strict_hits(spark):
    h = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "query_id int, row_id string, strict_ok boolean")
    assert sorted(one(analysis.relaxed_where_empty(h), "query_id", "row_id", "relaxed")) == [(1, "a", False), (2, "c", True)]


def test_fast_path_never_bypasses_ambiguity(spark):
    e = spark.createDataFrame([("1", "how?", "A1", "M"), ("2", "how?", "A2", "M"), ("3", "why?", "A2", "M"), ("4", "what?", None, "N")], "entry_id string, question string, alarm_code string, equipment_model string")
    q = spark.createDataFrame([("q1", "x", "A1", None), ("q2", "why?", "A2", "M"), ("q3", " what? ", None, None), ("q4", "how?", None, "M"), ("q5", "none", None, None), ("q6", None, None, None)], "query_id string, question string, alarm_code string, equipment_model string")
    got = dict((a, (b, c)) for a, b, c in one(fastpath.exact_answers(q, e), "query_id", "route", "entry_id"))
    assert got == {"q1": ("exact_alarm", "1"), "q2": ("ambiguous_alarm", None), "q3": ("exact_faq", "4"), "q4": ("ambiguous_faq", None), "q5": ("fallback", None), "q6": ("fallback", None)}


def test_claim_guard(spark):
    ev = spark.createDataFrame([(1, "E1", "set 4.5 MPa on QV-4100", "t"), (1, "E2", "12%", None)], "query_id int, evidence_id string, page_content string, title string")
    c = [(1, 1, "q", "QV-4100: 4.5 MPa", ["E1"]), (1, 2, "q", "QV-4100: 5 MPa", ["E1"]), (1, 3, "q", "XX-1", ["E1"]), (1, 4, "q", "ok", ["E9"]), (1, 5, "q", "see [E1]", ["E1"]), (1, 6, "７ 号", "７", []), (1, 7, "q", "12%", ["E2"])]
    got = dict(one(guards.check_claims(spark.createDataFrame(c, "query_id int, claim_id int, query_text string, text string, evidence_ids array<string>"), ev), "claim_id", "verdict"))
    assert got == {1: "ok", 2: "ungrounded_identifier_token", 3: "ungrounded_identifier_token", 4: "unknown_citation", 5: "claim_contains_renderer_markup", 6: "ok", 7: "ok"}


def test_evidence_numbers_guard_rendering_slices(spark):
    h = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "a", 3), (1, None, 4)], "query_id int, child_id string, rank int")
    assert sorted(one(guards.number_evidence(h), "evidence_id", "child_id")) == [("E1", "b"), ("E2", "a")]
    r = spark.createDataFrame([(1, "M", "M"), (2, None, "M"), (3, "x", None)], "query_id int, equipment_model string, hard_equipment_model string")
    assert dict(one(guards.evidence_holds(r, ["equipment_model"]), "query_id", "ok")) == {1: True, 2: False, 3: True}
    c = spark.createDataFrame([(1, 2, "b", ["E2", "E1"]), (1, 1, "a", ["E1"])], "query_id int, claim_id int, text string, evidence_ids array<string>")
    assert one(guards.render(c), "answer") == [("a[E1]\nb[E2][E1]",)]
    t = spark.createDataFrame([(1, "x" * 600), (2, ""), (3, None)], "id int, t string")
    assert [(i, s, len(d)) for i, s, d in one(guards.slices(t, "id", "t"), "id", "seq", "delta")] == [(1, 0, 256), (1, 1, 256), (1, 2, 88)]


def test_row_rules(spark):
    good = {c: "x" for c in ingestion.MOST_BYTES} | {c: "a" * 64 for c in ingestion.HASHES}
    good |= {"knowledge_type": "manual", "effective_date": "2024-02-29", "maintenance_cycle_value": 1.0, "maintenance_cycle_unit": "day", "dense_vector": [1.0], "sparse_vector": {1: 1.0}}
    bad = good | {"id": "A" * 64, "effective_date": "2023-02-29", "knowledge_type": "alarm", "alarm_code": " ", "maintenance_cycle_value": float("inf"), "dense_vector": [float("nan")], "sparse_vector": {}, "title": "é" * 600}
    schema = ", ".join(f"{c} string" for c in good if c not in ("maintenance_cycle_value", "dense_vector", "sparse_vector")) + ", maintenance_cycle_value double, dense_vector array<double>, sparse_vector map<bigint,double>"
    got = [r.errors for r in ingestion.row_errors(spark.createDataFrame([good, bad], schema)).collect()]
    assert got[0] == []
    assert got[1] == ["alarm_needs_code", "bytes:title", "cycle_value", "dense_vector", "effective_date", "hash:id", "id_is_child_id", "sparse_vector"]


def test_decisions_and_delta(spark):
    s = "document_id string, version string, document_sha256 string, metadata_sha256 string, signature string, child_ids array<string>"
    src = [("new", "1", "a", "m", "s", []), ("up", "2", "a", "m", "s", []), ("bad", "1", "b", "m", "s", []), ("re", "1", "a", "m", "t", []), ("same", "1", "a", "m", "s", []), ("rec", "1", "a", "m", "s", [])]
    man = [(d, "1", "a", "m", "s", ["k"]) for d in ("up", "bad", "re", "same", "rec")]
    stored = spark.createDataFrame([("same", "k"), ("rec", "z")], "document_id string, child_id string")
    got = dict(one(ingestion.decide(spark.createDataFrame(src, s), spark.createDataFrame(man, s), stored), "document_id", "decision"))
    assert got == {"new": "INGEST", "up": "UPDATE", "bad": "CONFLICT", "re": "REINDEX", "same": "SKIP_UNCHANGED", "rec": "RECONCILE"}
    a = spark.createDataFrame([("d", c) for c in "abc"], "d string, c string")
    b = spark.createDataFrame([("d", c) for c in "abd"], "d string, c string")
    assert one(ingestion.id_delta(b, a, "d", "c"), "added", "retained", "removed") == [(1, 2, 1)]


def test_decisions_look_at_the_stored_ids(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(n, t, d, "1", "a", "m", "s", [" K1", "k2"]) for n in (1, 2) for d in ("same", "lost", "more", "none")]
    manifest = "snapshot_no int, delivered_at timestamp, document_id string, active_document_version string, document_sha256 string, metadata_sha256 string, processing_signature string, child_ids array<string>"
    spark.createDataFrame(rows, manifest).write.parquet(str(tmp_path / "active_documents.parquet"))
    stored = [("same", "k1"), ("same", "K2"), ("same", "k2"), ("lost", "k1"), ("more", "k1"), ("more", "k2"), ("more", "k3")]
    spark.createDataFrame(stored, "document_id string, child_id string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert dict(one(records.decisions(spark, str(tmp_path)), "decision", "n_documents")) == {"SKIP_UNCHANGED": 1, "RECONCILE": 3}


def test_fingerprint_does_not_depend_on_order(spark):
    rows = [(i, None if i % 3 else "x") for i in range(50)]
    f = lambda r: ingestion.fingerprint(spark.createDataFrame(r, "a int, b string"), ["a", "b"]).first()
    assert f(rows) == f(rows[::-1]) and f(rows).fingerprint != f(rows[1:]).fingerprint


def test_last_turns(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    rows = [(i, "s", f"q{i}", None, t(i // 2)) for i in range(8)] + [(99, None, "x", "x", t(1)), (98, "s", "x", "x", None)]
    turns = sessions.last_turns(spark.createDataFrame(rows, "id int, session_id string, question string, answer string, timestamp timestamp"))
    assert sorted(one(turns, "turn", "id")) == [(1, 3), (2, 4), (3, 5), (4, 6), (5, 7)]
    assert one(sessions.context(turns), "context")[0][0].startswith("Q:q3\nA:\nQ:q4")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。，. \n", max_size=200), st.integers(5, 40))
def test_pieces_keep_the_text(t, size):
    pieces = chunking.cut(t, size)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(pieces)) == squeeze(t)
    assert all(len(p) <= size or not any(c in p[:-1] for c in "\n。") for p in pieces)


def test_parents_and_children(spark):
    d = spark.createDataFrame([(1, ("甲乙丙。" * 50 + "\n\n") * 6), (2, None), (3, " "), (4, "同。\n\n同。")], "doc_id int, text string")
    got = chunking.parents_and_children(d, key="doc_id", text="text").collect()
    assert {r.document_id for r in got} == {"1", "4"} and len({r.child_id for r in got}) == len(got)
    assert all(len(r.text) <= 128 for r in got)


def test_semantic_sections(spark):
    rows = [(1, i, [1.0, 0.0] if i < 3 else [0.0, 1.0], f"s{i}") for i in range(6)]
    got = sorted(one(chunking.by_meaning(spark.createDataFrame(rows, "d int, i int, v array<double>, t string"), key="d", order="i", vector="v", text="t", percentile=0.5), "section", "content"))
    assert got == [(0, "s0 s1 s2"), (1, "s3 s4 s5")]


def test_files_with_metadata(spark, tmp_path):
    d = tmp_path / "pump_data"
    d.mkdir()
    head = "document_id: D1\ndocument_version: '1.10'\ntitle: T\nknowledge_type: manual\n"
    (d / "a.txt").write_text(f"\ufeff---\n{head}---\nbody\n", "utf-8")
    (d / "b.md").write_text("# b", "utf-8")
    (d / "b.md.yaml").write_text(head, "utf-8")
    (d / "c.txt").write_text(f"---\n{head}---\nx", "utf-8")
    (d / "c.txt.yaml").write_text(head, "utf-8")
    (d / "e.txt").write_text(f"---\n{head}title: U\n---\nx", "utf-8")
    (d / "f.pdf").write_bytes(b"%PDF")
    (d / "f.pdf.yaml").write_text(head.replace("manual", "alarm"), "utf-8")
    (d / "g.pdf").write_bytes(b"x")
    (d / "h.exe").write_bytes(b"x")
    got = {r.path[-5:]: r for r in files.documents(spark, str(tmp_path), parsers={"pdf": lambda b: b.decode()}).collect()}
    assert (got["a.txt"].text, got["a.txt"].metadata_source, got["a.txt"].source, got["a.txt"].document_version, got["a.txt"].language) == ("body\n", "front_matter", "pump", "1.10", "zh-CN")
    assert got["/b.md"].text == "# b" and got["/b.md"].metadata_source == "sidecar"
    assert got["c.txt"].error == "metadata in two places" and "repeated" in got["e.txt"].error
    assert got["f.pdf"].error == "conditional:alarm" and got["g.pdf"].error == "no metadata" and len(got) == 6


def test_question_table_and_json_lines(spark, tmp_path):
    (tmp_path / "faq.csv").write_text('学科名称,问题,答案\n设备,"a, ""b""",c\n', "utf-8")
    assert one(files.question_table(spark, str(tmp_path / "faq.csv")), "subject_name", "question", "answer") == [("设备", 'a, "b"', "c")]
    (tmp_path / "x.jsonl").write_text('{"v": 1}\n{"a": 1}\n{"a": 1, "a": 2}\n{"a": NaN}\n', "utf-8")
    got = one(files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", header=True), "a", "error")
    assert got[0] == (1, "") and got[1][1] == "repeated key" and "finite" in got[2][1]


def test_cache(spark):
    q = answers.cache_key(spark.createDataFrame([("a", None), ("a", "m"), ("b", "m")], "q string, model string"), ["q", "model"])
    keys = [r.cache_key for r in q.collect()]
    assert len(set(keys)) == 3 and keys == [r.cache_key for r in answers.cache_key(q.drop("cache_key"), ["model", "q"]).collect()]
    t = dt.datetime(2025, 1, 1)
    c = spark.createDataFrame([(keys[0], "answered", t, "x"), (keys[1], "answered", t + dt.timedelta(1), "y"), (keys[2], "failed", t + dt.timedelta(1), "z")], "cache_key string, status string, expires_at timestamp, answer string")
    assert one(answers.cached(c, q, "2025-01-01 12:00:00"), "answer") == [("y",)]
    new = spark.createDataFrame([(keys[0], "answered", "n"), (keys[1], "failed", "m"), (keys[2], "answered", "")], "cache_key string, status string, answer string")
    after = answers.cache_put(c, new, now="2025-01-01 12:00:00", ttl_seconds=3600)
    assert sorted(one(after, "answer", "expires_at")) == [("n", dt.datetime(2025, 1, 1, 13)), ("y", t + dt.timedelta(1)), ("z", t + dt.timedelta(1))]
    assert sorted(one(answers.cached(after, q, "2025-01-01 12:30:00"), "answer")) == [("n",), ("y",)]
    with pytest.raises(ValueError):
        answers.cache_put(c, new, now="2025-01-01", ttl_seconds=0)


def test_streamed_ingestion(spark, tmp_path):
    src, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    schema = "id int, at int, v string"
    for batch in ([(1, 1, "a"), (1, 2, "b")], [(1, 3, "c"), (2, 1, "d")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_stream(spark, src, log, schema, state=state)
    rows = spark.read.parquet(log)
    assert rows.count() == 4 and sorted(one(ingest.newest(rows, "id", "at"), "id", "v")) == [(1, "c"), (2, "d")]


def test_windowed_counts(spark):
    e = spark.createDataFrame([(dt.datetime(2025, 1, 1, h, 10), "k", 1.0) for h in (0, 0, 2)], "ts timestamp, k string, v double")
    assert sorted(r.n for r in ingest.windowed_counts(e, time="ts", by="k", value="v").collect()) == [1, 2]
