import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lathework.functions import text
from lathework.operators import answers, evaluation, fastpath, manifest, runs, storage, variants
from lathework.sources import files, sinks
from lathework.streaming import ingest  # noqa: F401


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


MANIFEST = "document_id string, revision long, child_ids array<string>, child_count int, v string"


def test_commits_check_the_revision(spark):
    m = spark.createDataFrame([("a", 3, ["1"], 1, "old"), ("b", 1, [], 0, "old")], MANIFEST)
    r = spark.createDataFrame([("a", 3, ["2"], 1, "new"), ("b", 5, [], 0, "new"), ("c", 0, [], 0, "new"), ("d", 0, [], 0, "x"), ("d", 0, [], 0, "y")], MANIFEST.replace("revision", "expected_revision"))
    after, outcomes = manifest.commit(m, r)
    assert rows_of(after, "document_id", "revision", "v") == [("a", 4, "new"), ("b", 1, "old"), ("c", 1, "new")]
    assert rows_of(outcomes, "document_id", "outcome", "revision") == [("a", "COMMITTED", 4), ("b", "CONFLICT", 1), ("c", "COMMITTED", 1), ("d", "CONFLICT", 0)]
    left, gone = manifest.remove(after, spark.createDataFrame([("a", 4), ("b", 9), ("z", 0)], "document_id string, expected_revision long"))
    assert rows_of(left, "document_id") == [("b",), ("c",)] and rows_of(gone, "document_id", "outcome") == [("a", "REMOVED"), ("b", "CONFLICT"), ("z", "REMOVED")]
    assert manifest.commit(m.limit(0), r.limit(0))[1].count() == 0


def test_integrity_and_deletes(spark):
    m = spark.createDataFrame([("a", 1, ["x"], 1, ""), ("b", 1, ["x"], 2, ""), ("c", 0, [], 0, ""), ("d", None, None, None, "")], MANIFEST)
    assert rows_of(manifest.lookup(m, m.select("document_id")), "document_id", "integrity") == [("a", ""), ("b", "child_count"), ("c", "revision"), ("d", "child_count")]
    stored = spark.createDataFrame([("a", "x"), ("a", "x"), ("s", "y")], "document_id string, child_id string")
    asked = spark.createDataFrame([("a",), ("b",), ("s",), ("n",), ("n",)], "document_id string")
    d = manifest.delete_documents(asked, m, stored)
    assert rows_of(d, "document_id", "status", "removed") == [("a", "DELETED", ["x"]), ("b", "DELETED", []), ("n", "NOOP", []), ("s", "DELETED", ["y"])]
    again = manifest.delete_documents(asked, manifest.without_documents(m, d), manifest.without_documents(stored, d))
    assert {r.status for r in again.collect()} == {"NOOP"}
    assert manifest.same_ids(stored, stored.distinct(), "child_id") and not manifest.same_ids(stored, stored.limit(1), "child_id")


def test_schema_guard_and_signature(spark):
    wanted = manifest.table_schema("jpkb")
    good = spark.createDataFrame([], wanted)
    assert manifest.schema_errors(good, wanted) == []
    bad = spark.createDataFrame([], "id long, subject_name string, question string, extra int")
    assert manifest.schema_errors(bad, wanted) == ["missing:answer", "type:id", "unknown:extra"]
    assert manifest.schema_errors(spark.createDataFrame([], "id int, subject_name string, question string, answer string"), wanted) == ["nullable:id"]
    c = {"parent_chunk_size": 500, "parent_chunk_overlap": 50, "processing_version": "v1"}
    assert manifest.signature(c) == manifest.signature(dict(reversed(c.items()))) != manifest.signature(c | {"processing_version": "v2"})
    for wrong in ({"parent_chunk_overlap": 500}, {"processing_version": " "}):
        with pytest.raises(ValueError):
            manifest.signature(c | wrong)


def test_storage_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0], {1: 1.0}), (2, [1.0], {1: 1.0}), (3, [1.0, nan], {1: 1.0}), (4, [1.0, 2.0], {}), (5, [1.0, 2.0], {-1: 1.0}), (6, [1.0, 2.0], {1: nan}), (7, None, None)]
    d = spark.createDataFrame([(i, "clash") for i in range(1, 9)], "k int, vector string")
    v = spark.createDataFrame(rows, "k int, dense_vector array<double>, sparse_vector map<bigint,double>")
    got = dict(rows_of(storage.vector_rows(d, v, key="k", dim=2), "k", "vector_error"))
    assert got == {1: "", 2: "dimension", 3: "dense_not_finite", 4: "sparse_empty", 5: "sparse_key", 6: "sparse_not_finite", 7: "dimension", 8: "dimension"}
    m = spark.createDataFrame([(1, [3, 1], [0.5, 2.0]), (2, [1, 1], [1.0, 1.0]), (3, [1], []), (4, [-1], [1.0]), (5, [], [])], "k int, i array<int>, v array<double>")
    assert {r.k: r.sparse for r in storage.csr_rows(m, row="k", indices="i", values="v").collect()} == {1: {3: 0.5, 1: 2.0}, 2: None, 3: None, 4: None, 5: {}}
    c = spark.createDataFrame([(1, (2.0, "day", None)), (2, None)], "k int, maintenance_cycle struct<value:double,unit:string,trigger:string>")
    assert rows_of(storage.flat_cycle(c), "k", "maintenance_cycle_value", "maintenance_cycle_unit") == [(1, 2.0, "day"), (2, None, None)]
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert storage.insert(old, old).count() == 2 and storage.checked_upsert(old, old, "k").count() == 1
    with pytest.raises(ValueError):
        storage.checked_upsert(old, storage.insert(old, old), "k")
    assert rows_of(storage.like(spark.createDataFrame([("red_9",), ("redx95",), ("red",), (None,)], "c string"), "c", "red_9%"), "c") == [("red_9",), ("redx95",)]
    hits = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", nan, 2), (1, "z", 0.1, 3), (1, "w", 0.1, 4)], "query_id int, row_id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "a", "p", "d", "manual"), ("b", "b", "p", "d", "manual"), ("w", "v", "p", "d", "manual")], "id string, child_id string, parent_id string, document_id string, knowledge_type string")
    assert rows_of(storage.typed_hits(hits, chunks), "row_id", "hit_error") == [("a", ""), ("b", "score"), ("w", "identity"), ("z", "missing")]


def test_variants_keep_identifiers(spark):
    rows = [
        (1, "check QV-1 now", ["QV-1 check"], "QV-1"), (2, "check QV-1 now", ["check now"], "QV-1"), (3, "check QV-1", ["check QV-12", "x"], "QV-1"), (4, "check it", ["it check ZZ"], None),
        (5, "check it", [" check  it ", "check it"], None), (6, "check it", [], None), (7, "check it", None, None), (8, "check it", ["it", "it ", "check"], None), (9, "check it", [" "], None),
    ]
    df = spark.createDataFrame(rows, "k int, q string, p array<string>, m string")
    got = {r.k: (r.variant_error, r.variants) for r in variants.guarded(df, query="q", proposed="p", hard=["m"]).collect()}
    assert got == {
        1: ("", ["check QV-1 now", "QV-1 check"]), 2: ("hard_identifier_not_preserved", ["check QV-1 now"]), 3: ("hard_identifier_not_preserved", ["check QV-1"]), 4: ("new_identifier_token", ["check it"]),
        5: ("duplicate_query_variant", ["check it"]), 6: ("", ["check it"]), 7: ("", ["check it"]), 8: ("", ["check it", "it", "check"]), 9: ("invalid_query", ["check it"]),
    }


def test_decision_contract_and_fallbacks(spark):
    rows = [
        ("direct", None, None, "ok", ""), ("direct", "x", None, "ok", "direct_has_variants"), ("rewrite", "x", None, "ok", ""), ("rewrite", None, None, "ok", "rewrite_requires_one_query"), ("rewrite", " ", None, "ok", "invalid_query"),
        ("subquery", None, ["a", "b"], "ok", ""), ("subquery", None, [], "ok", "subquery_count"), ("subquery", None, list("abcde"), "ok", "subquery_count"), ("direct", None, None, "Bad", "invalid_reason_code"), ("other", None, None, "ok", "invalid_strategy"),
        (None, None, None, None, "invalid_strategy"),
    ]
    df = spark.createDataFrame(rows, "strategy string, rewritten_query string, subqueries array<string>, reason_code string, want string")
    assert df.where(variants.decision_errors() != F.col("want")).count() == 0
    q = spark.createDataFrame([("direct",), ("bad",), ("timeout",), ("null",), ("no json",), ("new",), ("sub",)], "q string").withColumn("equipment_model", F.lit(None).cast("string"))
    answer = {
        "direct": '{"strategy":"direct","reason_code":"plain"}', "bad": '{"strategy":"rewrite","reason_code":"x"}', "timeout": "timeout", "no json": "hello", "new": '{"strategy":"rewrite","rewritten_query":"new X1","reason_code":"x"}',
        "sub": '{"strategy":"subquery","subqueries":["sub?"," sub ?"],"reason_code":"x"}',
    }
    plan = lambda c: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in answer.items()), F.lit(None).cast("string"))
    got = {r.q: (r.strategy, r.decision_source, r.fallback_reason, len(r.variants)) for r in variants.planned(q, plan, query="q").collect()}
    assert got == {
        "direct": ("direct", "planner", None, 1), "bad": ("direct", "fallback", "planner_invalid_schema", 1), "timeout": ("direct", "fallback", "planner_timeout", 1), "null": ("direct", "fallback", "planner_error", 1),
        "no json": ("direct", "fallback", "planner_invalid_json", 1), "new": ("direct", "fallback", "new_identifier_token", 1), "sub": ("subquery", "planner", None, 3),
    }
    assert {r.decision_source for r in variants.planned(q, None, query="q").collect()} == {"default"}


def test_lists_in_model_output(spark):
    df = spark.createDataFrame([(" a \n\n b",), (None,), ("x,，y , ",), ('```json\n{"k": 1}\n```',), ("{}",)], "t string")
    got = [(r[0], r[1], r[2]) for r in df.select(variants.lines(F.col("t")), variants.comma_list(F.col("t")), variants.json_output(F.col("t"), "k int")).collect()]
    assert got[0][0] == ["a", "b"] and got[1] == ([], [], None) and got[2][1] == ["x", "y"] and got[3][2].k == 1 and got[4][2].k is None


def test_rendering_and_cache_check(spark):
    claims = spark.createDataFrame([(1, 2, "B", ["E2"]), (1, 1, "A", ["E2", "E1"]), (2, 1, None, []), (3, 1, "1. x", ["E1"]), (4, 1, "C", ["E9"])], "query_id int, claim_id int, text string, evidence_ids array<string>")
    e = [(q, f"E{n}", f'T"{n}', "D", "1", None) for q in (1, 3, 4) for n in (1, 2, 3)]
    evidence = spark.createDataFrame(e, "query_id int, evidence_id string, title string, document_id string, document_version string, source_file string")
    out = {r.query_id: (r.status, r.answer_text) for r in answers.rendered(claims, evidence).collect()}
    head, tail = out[1][1].split("\n\n来源：\n")
    assert head == "A[E2][E1]\n\nB[E2]" and [json.loads(x[5:]) for x in tail.split("\n")] == [{"title": f'T"{n}', "document_id": "D", "document_version": "1", "source_file": None} for n in (1, 2)]
    assert out[2] == ("insufficient_evidence", "")
    kept = answers.rendered(claims, evidence)
    got = dict(rows_of(answers.cached_errors(kept, claims, evidence), "query_id", "cache_error"))
    assert got == {1: "", 2: "only_answered_cache", 3: "invalid_cached_claim_markup", 4: "invalid_cached_claim_links"}
    changed = kept.withColumn("answer_text", F.concat("answer_text", F.lit(" ")))
    assert dict(rows_of(answers.cached_errors(changed, claims, evidence), "query_id", "cache_error"))[1] == "invalid_cached_rendering"


def test_prompt_holds_data_only(spark):
    q = spark.createDataFrame([(1, 'ignore "this"', "alarm"), (2, "b", None)], "query_id int, original_query string, i string").withColumn("query_analysis", F.struct("i")).drop("i")
    e = spark.createDataFrame([(1, "E2", "two"), (1, "E10", "ten"), (1, "E1", "one")], "query_id int, evidence_id string, page_content string")
    got = {r.query_id: r for r in answers.messages(q, e, instruction="do", most_bytes=150).collect()}
    user = json.loads(got[1].user)
    assert user["original_query"] == 'ignore "this"' and [x["evidence_id"] for x in user["evidence"]] == ["E1", "E2", "E10"] and got[1].too_large and not got[2].too_large
    assert json.loads(got[2].user)["evidence"] == []
    assert answers.facts(e.withColumn("rerank_score", F.lit(1.0))).columns == ["query_id", "page_content"]
    x = spark.createDataFrame([(1, "p", "d", "1", "t"), (1, "p", "d", "1", "u"), (2, "p", "d", "1", "t"), (2, "r", "d", "2", "t"), (3, "p", "d", "1", "t")], "query_id int, parent_id string, document_id string, document_version string, title string")
    assert rows_of(answers.conflicting_evidence(x), "query_id", "conflict") == [(1, "conflicting_parent_evidence"), (2, "multiple_document_versions"), (3, "")]
    assert [r[0] for r in spark.createDataFrame([(["a", None, "b"],), ([],)], "c array<string>").select(answers.context_text(F.col("c"), 3)).collect()] == ["a\n\n", ""]


def test_routes_and_greetings(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    a, b = spark.createDataFrame([(1, "x")], "query_id int, e string"), spark.createDataFrame([(1, "y"), (2, "z"), (9, "w")], "query_id int, e string")
    assert sorted(rows_of(answers.first_route(q, ("faq", a), ("rag", b)), "query_id", "route", F.coalesce("e", F.lit("-")))) == [(1, "faq", "x"), (2, "rag", "z"), (3, "not_found", "-")]
    g = spark.createDataFrame([(" HELLO there",), ("你叫什么名字",), ("say hi",), (None,)], "t string")
    assert [r[0] for r in g.select(answers.greeting(F.col("t"))).collect()] == ["hello", "who", None, None]
    hits = spark.createDataFrame([(1, "b", 1), (1, "a", 1), (1, "c", 2)], "query_id int, parent_id string, rank int")
    assert rows_of(answers.top_evidence(hits, 2), "parent_id") == [("a",), ("b",)]
    t = spark.createDataFrame([("STRICT", None, 0), ("RELAXED", True, 3)], "mode string, relaxed boolean, n_hits int")
    assert [r.attempt.asDict() for r in answers.attempt(t).collect()][0] == {"filter_mode": "STRICT", "relaxed": False, "hit_count": 0, "zero_hits": True}


def test_probe_takes_its_steps_in_order(spark):
    e = [("1", "how?", "alarm", "M", "A1", None), ("2", "why?", "alarm", "M", "A2", None), ("3", "why?", "alarm", "N", "A2", None), ("4", "what?", "manual", None, None, None), ("5", "twice?", "manual", None, None, None), ("6", "twice?", "manual", None, None, None), ("7", "doc?", "manual", "M", "A7", None)]
    entries = spark.createDataFrame(e, "entry_id string, question string, knowledge_type string, equipment_model string, alarm_code string, part_number string")
    q = [
        ("alarm", "x", "alarm_fault", [], None, "A1"), ("other intent", "how?", "parts", [], None, "A1"), ("two", "x", "alarm_fault", [], None, "A2"), ("scoped", "x", "alarm_fault", [], "N", "A2"), ("open", "is A1 bad", "alarm_fault", [], None, None),
        ("many", "how?", "general", ["equipment_model"], None, None), ("faq", " what? ", "general", [], None, None), ("twice", "twice?", "general", [], None, None), ("no", "none", "general", [], None, None), ("null", None, None, None, None, None), ("kind", "x", "alarm_fault", [], None, "A7"),
    ]
    queries = spark.createDataFrame(q, "query_id string, question string, intent string, ambiguous array<string>, hard_equipment_model string, hard_alarm_code string").withColumn("hard_part_number", F.lit(None).cast("string"))
    got = {r.query_id: (r.reason, r.entry_id) for r in fastpath.probe(queries, entries).collect()}
    assert got == {
        "alarm": ("exact_alarm", "1"), "other intent": ("exact_faq", "1"), "two": ("ambiguous_alarm_evidence", None), "scoped": ("exact_alarm", "3"), "open": ("unresolved_alarm_identifier", None), "many": ("ambiguous_hard_identifier", None),
        "faq": ("exact_faq", "4"), "twice": ("ambiguous_exact_faq", None), "no": ("no_candidate", None), "null": ("no_candidate", None), "kind": ("no_candidate", None),
    }
    ranked = spark.createDataFrame([("no", "4", 7.0, 1, 1), ("null", "5", 2.0, 1, 1)], "query_id string, entry_id string, score double, matched int, rank int")
    got = {r.query_id: (r.reason, r.entry_id) for r in fastpath.probe(queries, entries, ranked=ranked, accept=5.0).collect()}
    assert got["no"] == ("bm25_faq", "4") and got["null"] == ("bm25_rejected", None)
    assert {r.reason for r in fastpath.probe(queries, entries, ranked=ranked).where("query_id = 'no'").collect()} == {"bm25_not_enabled"}
    assert fastpath.probe(queries.limit(0), entries).count() == 0 and fastpath.probe(queries, entries.limit(0)).where("status = 'ACCEPTED'").count() == 0


RUN = "sample_id int, expected_child_ids array<string>, expected_parent_ids array<string>, expected_document_ids array<string>, returned_child_ids array<string>, returned_parent_ids array<string>, returned_document_ids array<string>, expected_equipment_model string, expected_alarm_code string, expected_part_number string, n_leaks int, error string, strategy string, decision_source string, fallback_reason string, fast_status string, intent_match boolean"


def test_run_figures(spark):
    r = [
        (1, ["c"], ["p"], ["d"], ["x", "c"], ["p"], ["d"], "M", None, None, 2, None, "direct", "planner", None, None, True), (2, ["c"], ["p"], ["d"], None, ["q", "p"], ["e"], None, None, None, 0, None, "direct", "fallback", "new_identifier_token", "ACCEPTED", False),
        (3, ["c"], ["p"], ["d"], [], [], [], None, "A", None, 0, None, "rewrite", "planner", None, "FALLBACK", None), (4, ["c"], ["p"], ["d"], [], [], [], "M", None, None, 0, "TypeError", None, None, None, None, None),
    ]
    m = runs.measured(spark.createDataFrame(r, RUN), k=5, m=5)
    f = runs.run_aggregate(m).first()
    assert (f.sample_count, f.error_count, f.zero_result_count, f.zero_result_rate, f.hard_count, f.leak_count, f.leak_rate, f.leaked_items) == (4, 1, 2, 0.5, 2, 1, 0.5, 2)
    assert (f.child_hit, f.parent_mrr, f.document_hit) == (round(1 / 3, 6), 0.375, 0.25)
    assert (f.strategy_direct, f.strategy_rewrite, f.planner_fallbacks, f.variant_refusals, f.fast_accepted, f.fast_fallback, f.intent_mismatches) == (2, 1, 1, 1, 1, 1, 1)
    assert runs.run_aggregate(m.limit(0)).first().zero_result_rate is None
    items = spark.createDataFrame([("M", [("M", None, None), ("N", None, None), (None, None, None)]), (None, [("N", None, None)]), ("M", None)], "expected_equipment_model string, items array<struct<equipment_model:string,alarm_code:string,part_number:string>>")
    items = items.withColumns({"expected_alarm_code": F.lit(None).cast("string"), "expected_part_number": F.lit(None).cast("string")})
    assert [x[0] for x in items.select(runs.leaked("items")).collect()] == [2, 0, 0]
    d = runs.paired(m.where("sample_id < 4"), m.where("sample_id > 1").withColumn("parent_mrr", F.lit(1.0)))
    assert rows_of(d, "sample_id", F.coalesce("mrr_delta", F.lit(-9.0)), F.coalesce("only_in", F.lit(""))) == [(1, -9.0, "a"), (2, 0.5, ""), (3, 1.0, ""), (4, -9.0, "b")]
    assert runs.paired_macro(d).first().asDict() == {"n_samples": 2, "better": 2, "worse": 0, "hit_delta": 0.0, "mrr_delta": 0.75}


def test_channels(spark):
    s = [(["exact_faq"], "ACCEPTED", "exact_faq", True), (["exact_faq", "exact_alarm"], "ACCEPTED", "exact_faq", False), (["exact_faq"], "FALLBACK", "fallback", None), ([], "ACCEPTED", "exact_faq", True), (None, None, None, None)]
    got = {r.channel: r for r in runs.channel_metrics(spark.createDataFrame(s, "fast_labels array<string>, fast_status string, match_type string, correct boolean")).collect()}
    f, a = got["exact_faq"], got["exact_alarm"]
    assert (f.eligible, f.accepted, f.correct, f.incorrect, f.unlabelled, f.fallback, f.precision) == (3, 3, 2, 1, 1, 1, round(2 / 3, 6))
    assert (a.eligible, a.accepted, a.coverage, a.precision, a.fallback_rate) == (1, 0, 0.0, None, 1.0) and got["bm25_faq"].coverage is None


def test_labels_against_the_corpus(spark):
    labels = spark.createDataFrame([(1, ["d"], ["1", "2"], ["p"]), (2, ["gone"], ["1"], ["p"]), (3, ["d"], ["1", "3"], ["p"]), (4, ["d"], [], [])], "sample_id int, expected_document_ids array<string>, expected_child_ids array<string>, expected_parent_ids array<string>")
    m = spark.createDataFrame([("d", ["1", "2"])], "document_id string, child_ids array<string>")
    c = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q")], "child_id string, parent_id string")
    assert rows_of(runs.label_errors(labels, m, c), "sample_id", "problem") == [(2, "missing_child"), (2, "missing_document"), (3, "missing_child"), (3, "parent_mismatch")]


def test_latency_and_reports(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("a", None), ("b", None), ("c", 5.0), ("c", 5.0)], "g string, v double")
    assert rows_of(evaluation.latency(df, "v", "g"), "g", "n", F.coalesce("mean", F.lit(-1.0)), F.coalesce("p95", F.lit(-1.0))) == [("a", 20, 10.5, 19.0), ("b", 0, -1.0, -1.0), ("c", 2, 5.0, 5.0)]
    c = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("z", "x"), (None, "x")], "t string, p string")
    assert rows_of(evaluation.confusion(c.where("t is not null"), "t", "p"), "true_label", "predicted_label", "n", "share") == [("x", "x", 1, 0.5), ("x", "y", 1, 0.5), ("y", "y", 1, 1.0), ("z", "x", 1, 1.0)]
    assert rows_of(evaluation.classification_report(c, "t", "p"), "label", "precision", "recall", "support") == [("x", 0.5, 0.5, 2), ("y", 0.5, 1.0, 1), ("z", 0.0, 0.0, 1)]


def test_sinks_and_snapshots(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([(2, 'b,"\n', [1.0]), (1, None, None)], "k int, t string, v array<double>")
    sinks.append(df, at("a"), df.schema)
    sinks.append(df, at("a"), df.schema)
    assert spark.read.parquet(at("a")).count() == 4
    with pytest.raises(ValueError):
        sinks.append(df.drop("t"), at("a"), df.schema)
    sinks.report(df, at("r"))
    assert {json.loads(r.value)["t"] for r in spark.read.text(at("r")).collect()} == {None, 'b,"\n'}
    with pytest.raises(ValueError):
        sinks.report(df.withColumn("v", F.array(F.lit(float("nan")))), at("r2"))
    sinks.canonical_lines(df.select("t", "k"), at("c"))
    assert sorted(r.value for r in spark.read.text(at("c")).collect()) == ['{"k":1,"t":null}', '{"k":2,"t":"b,\\"\\n"}']
    sinks.csv(df.select("k", "t"), at("csv"))
    assert rows_of(spark.read.csv(at("csv"), header=True, multiLine=True, escape='"', schema="k int, t string").where("k = 2"), "t") == [('b,"\n',)]
    sinks.snapshot(df, at("s"), key="k", version="v1")
    assert rows_of(sinks.read_snapshot(spark, at("s"), df.schema, version="v1"), "k") == [(1,), (2,)]
    with pytest.raises(Exception, match="another schema version"):
        sinks.read_snapshot(spark, at("s"), df.schema, version="v2").collect()
    with pytest.raises(ValueError):
        sinks.snapshot(df.unionByName(df), at("s2"), key="k", version="v1")
    (tmp_path / "t.jsonl").write_text('{"query":"q","label":"l"}\n{"query":"q"}\n', "utf-8")
    assert rows_of(sinks.training_lines(spark, at("t.jsonl")), "label") == [("l",)]
    (tmp_path / "e.json").write_text('[{"question":"q","context":["c"],"answer":"a","ground_truth":"g"}]', "utf-8")
    assert rows_of(sinks.samples(spark, at("e.json")), "question", "ground_truth") == [("q", "g")]


def test_json_text_equals_a_json_writer(spark):
    values = ['a"\\\n\r\t\b\f', "\x00\x01\x1f\x7f é 主", ""]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(text.json_text(F.col("t"))).collect()]
    assert got == [json.dumps(v, ensure_ascii=False) for v in values]


def test_every_query_with_sql_is_registered():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(o) > 60


def test_metadata_rules():
    good = {"document_id": "D", "document_version": "1", "title": "T", "knowledge_type": "manual"}
    assert files.checked_metadata(good | {"effective_date": "2024-02-29", "maintenance_cycle": {"value": 3, "unit": "day"}})[1] == ""
    wrong = {
        "knowledge_type": {"knowledge_type": "poem"}, "effective_date": {"effective_date": "2023-02-29"}, "maintenance_cycle": {"maintenance_cycle": {"value": 0, "unit": "day"}},
        "unknown_field:colour": {"colour": "red"}, "required:title": {"title": " "}, "conditional:parts": {"knowledge_type": "parts"},
    }
    assert {e: files.checked_metadata(good | w)[1] for e, w in wrong.items()} == {e: e for e in wrong}


def test_headers_of_several_files_are_left_out(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.jsonl").write_text('{"about":"set"}\n{"a":%d}\n\n{"a":1,"a":2}\n' % n, "utf-8")
    (tmp_path / "3.jsonl").write_text('{"about":"set"}\n' + '{"a":9}\n' * 40, "utf-8")
    got = rows_of(files.json_lines(spark, str(tmp_path), "a int", header=True, most_bytes=200), F.coalesce("a", F.lit(-1)), "error")
    assert got == [(-1, "repeated key"), (-1, "repeated key"), (-1, "too_large"), (1, ""), (2, "")]
