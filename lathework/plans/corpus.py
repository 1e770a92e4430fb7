"""Queries on evaluation runs, the manifest, storage rows, query variants and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.functions import text
from lathework.operators import analysis, answers, evaluation, fastpath, ingestion, lexical, manifest, runs, storage, variants, vectors
from lathework.operators.snapshots import id_set, stripped
from lathework.plans import records, search
from lathework.session import shared_path, table, written
from lathework.sources import files, sinks

NONE = "array<string>"
#: What a run reads of the chunks to search them.
VECTORS = ["vector", "grp"]


# evaluation runs


def _run(spark, sf_dir, chunks, *, same_group: bool):
    """A run over the query set: each chunk asks with its vector for its siblings, its parent and its document, and expects hits of its own identifiers.

    ``chunks``: the query set and all rows. Their vectors are short, so large blocks of them fit a task and fewer copies are shuffled.
    """
    q, r = chunks
    sizes = {"block_rows": 200_000, "block_queries": 20_000}
    hits = vectors.block_search(q.select("query_id", "vector", "grp"), r.select("row_id", "vector", "grp"), k=20, metric="cosine", same_group=same_group, exclude_self=True, **sizes)
    c = table(spark, sf_dir, "chunks").where("id is not null").groupBy(F.col("id").alias("row_id")).agg(F.min(F.struct("parent_id", "document_id", "equipment_model", "alarm_code", "part_number")).alias("c")).select("row_id", "c.*")
    item = F.struct("rank", "row_id", "parent_id", "document_id", *runs.HARD)
    got = hits.join(c, "row_id").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    own = q.select("query_id").join(c.withColumnRenamed("row_id", "query_id"), "query_id")
    ids = lambda f: F.array_distinct(F.coalesce(F.transform("items", lambda x: x[f]), F.array().cast(NONE)))
    kids = c.where("parent_id is not null").join(own.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.collect_set("row_id").alias("kids"))
    siblings = F.array_except(F.coalesce("kids", F.array().cast(NONE)), F.array("query_id"))
    x = own.join(kids, "parent_id", "left").join(got, "query_id", "left").select(
        F.col("query_id").alias("sample_id"), siblings.alias("expected_child_ids"), F.array("parent_id").alias("expected_parent_ids"), F.array("document_id").alias("expected_document_ids"),
        *(F.col(h).alias(f"expected_{h}") for h in runs.HARD), ids("row_id").alias("returned_child_ids"), ids("parent_id").alias("returned_parent_ids"), ids("document_id").alias("returned_document_ids"), "items",
    )
    return runs.measured(x.withColumns({"n_leaks": runs.leaked("items"), "error": F.lit(None).cast("string")}), k=20, m=5)


def run_aggregate(spark, sf_dir):
    """The run without filters, overall and for samples that expect an alarm code or not."""
    x = written(_run(spark, sf_dir, search._chunks(spark, sf_dir, VECTORS), same_group=False).withColumn("part", F.when(F.col("expected_alarm_code").isNotNull(), "alarm").otherwise("other")), "run")
    return runs.run_aggregate(x.withColumn("part", F.lit("all"))).withColumn("part", F.lit("all")).unionByName(runs.run_aggregate(x, "part"))


def _pairs(spark, sf_dir):
    chunks = search._chunks(spark, sf_dir, VECTORS)  # written once for both runs
    return runs.paired(_run(spark, sf_dir, chunks, same_group=False), _run(spark, sf_dir, chunks, same_group=True))


def paired_runs(spark, sf_dir):
    """The filtered run against the unfiltered one, sample by sample."""
    return _pairs(spark, sf_dir)


def paired_macro(spark, sf_dir):
    return runs.paired_macro(_pairs(spark, sf_dir))


def _asked(spark, sf_dir):
    """All fast-path entries as queries with their own identifiers, each id once."""
    columns = ("question", "knowledge_type", "equipment_model", "alarm_code", "part_number", "parent_id", "document_id")
    e = table(spark, sf_dir, "fast_path").where("entry_id is not null").groupBy("entry_id").agg(F.min(F.struct(*columns)).alias("e")).select("entry_id", "e.*")
    hard = {f"hard_{f}": F.col(f) for f in runs.HARD}
    q = analysis.with_intent(e.withColumnRenamed("entry_id", "query_id").withColumns(hard), "question").withColumn("ambiguous", F.array().cast(NONE))
    return q, e


def probe(spark, sf_dir):
    """The fast path's answer to every entry's own question under its own identifiers."""
    q, e = _asked(spark, sf_dir)
    return fastpath.probe(q, e)


def channels(spark, sf_dir):
    """The channels' figures where every entry should be found by its question, and those of kind alarm with a code by their alarm."""
    q, e = _asked(spark, sf_dir)
    p = fastpath.probe(q, e)
    labels = F.array_compact(F.array(F.when((F.col("knowledge_type") == "alarm") & F.col("alarm_code").isNotNull(), "exact_alarm"), F.lit("exact_faq")))
    right = e.select("entry_id", F.col("parent_id").alias("got_parent"), F.col("document_id").alias("got_document"))
    x = q.join(p, "query_id").join(right, "entry_id", "left")
    correct = (F.col("got_parent") == F.col("parent_id")) & (F.col("got_document") == F.col("document_id"))
    return runs.channel_metrics(x.select(labels.alias("fast_labels"), F.col("status").alias("fast_status"), "match_type", correct.alias("correct")))


def routed(spark, sf_dir):
    """Fast path, else the best entry by BM25 within the query's model, else nothing: the whole chain for the query set."""
    q, e = _asked(spark, sf_dir)
    q = q.where(search.ENTRY20.replace("entry_id", "query_id"))
    fast = fastpath.probe(q, e).where("status = 'ACCEPTED'").select("query_id", "entry_id")
    terms = lexical.corpus_terms(e, key="entry_id", question=F.col("question"))
    scope = e.select("entry_id", F.col("equipment_model").alias("scope"))
    left = q.join(fast, "query_id", "left_anti")
    scores = lexical.bm25_scores(left, terms, query_key="query_id", query_text=F.col("question"), scope=(left.select("query_id", F.col("equipment_model").alias("scope")), scope))
    best = lexical.ranked(scores, 1).where("score >= 12").select("query_id", "entry_id")
    return answers.first_route(q, ("fast_path", fast), ("retrieval", best)).select("query_id", "route", "entry_id")


def document_counts(spark, sf_dir):
    return runs.document_counts(table(spark, sf_dir, "chunks"))


def _manifest(spark, sf_dir):
    """The valid rows of the newest snapshot."""
    a = table(spark, sf_dir, "active_documents").withColumn("document_id", stripped(F.col("document_id")))
    last = a.join(a.agg(F.max("snapshot_no").alias("snapshot_no")), "snapshot_no")
    r = F.struct("delivered_at", F.col("revision").alias("revision"), id_set(F.col("child_ids")).alias("child_ids"), F.col("child_count").alias("child_count"), F.lower(stripped(F.col("document_sha256"))).alias("document_sha256"))
    return last.groupBy("document_id").agg(F.max(r).alias("r")).select("document_id", "r.revision", "r.child_ids", "r.child_count", "r.document_sha256")


def label_errors(spark, sf_dir):
    """The entries' labels (their document, the children of their parent) against the newest manifest and the chunks, counted by problem."""
    chunks = table(spark, sf_dir, "chunks").where("child_id is not null").select(F.lower("child_id").alias("child_id"), "parent_id").distinct()
    kids = chunks.groupBy("parent_id").agg(F.array_sort(F.collect_set("child_id")).alias("expected_child_ids"))
    _, e = _asked(spark, sf_dir)
    labels = e.join(kids, "parent_id", "left").select("entry_id", F.array("document_id").alias("expected_document_ids"), F.coalesce("expected_child_ids", F.array().cast(NONE)).alias("expected_child_ids"), F.array("parent_id").alias("expected_parent_ids"))
    found = runs.label_errors(labels.withColumnRenamed("entry_id", "sample_id"), _manifest(spark, sf_dir).select("document_id", "child_ids"), chunks)
    return found.groupBy("problem").agg(F.count("*").alias("n"))


def intent_report(spark, sf_dir):
    f = analysis.with_intent(table(spark, sf_dir, "fast_path"), "question").withColumn("predicted", F.when(F.col("intent") == "alarm_fault", "alarm").otherwise(F.col("intent")))
    return evaluation.classification_report(f, "knowledge_type", "predicted")


# manifest


def integrity(spark, sf_dir):
    """Records of all snapshots by what is wrong with them."""
    return manifest.with_integrity(table(spark, sf_dir, "active_documents")).groupBy("snapshot_no", "integrity").agg(F.count("*").alias("n"))


def commits(spark, sf_dir):
    """The newest manifest's records committed again, every second one (by its hash) with an outdated revision, and some under ids that are new."""
    m = _manifest(spark, sf_dir).where("revision is not null")
    late = F.col("document_sha256") < "8"
    r = m.withColumn("expected_revision", F.when(late, F.col("revision")).otherwise(F.col("revision") - 1))
    new = m.where("document_sha256 like 'a%'").withColumns({"document_id": F.concat("document_id", F.lit("-new")), "expected_revision": F.lit(0).cast("long")})
    return manifest.commit(m, r.unionByName(new))[1]


def deletes(spark, sf_dir):
    """Deleting all documents that chunks or the newest manifest know, and one more for each of the manifest that nothing knows."""
    m = _manifest(spark, sf_dir).select("document_id")
    stored = table(spark, sf_dir, "chunks").where("document_id is not null and child_id is not null").select("document_id", F.lower("child_id").alias("child_id"))
    asked = m.unionByName(stored.select("document_id")).unionByName(m.select(F.concat("document_id", F.lit("-none")).alias("document_id")))
    return manifest.delete_documents(asked, m, stored).select("document_id", "status", F.size("removed").alias("n_removed"))


def metadata_sha(spark, sf_dir):
    """The hash of the business fields of every metadata record."""
    d = table(spark, sf_dir, "document_metadata").dropDuplicates()
    fields = ["document_id", "document_version", "title", "knowledge_type", "equipment_model", "alarm_code", "part_number", "language"]
    return d.select("record_id", manifest.canonical_sha(fields).alias("sha")).distinct()


def revision(spark, sf_dir):
    m = ingestion.fingerprint(_manifest(spark, sf_dir).withColumn("children", F.array_join("child_ids", ",")), ["document_id", "revision", "document_sha256", "children"])
    f = ingestion.fingerprint(table(spark, sf_dir, "fast_path").select("entry_id", "question", "evidence_text").distinct(), ["entry_id", "question", "evidence_text"])
    return manifest.knowledge_revision(m, "equipment", f)


def stored_children(spark, sf_dir):
    """The rows that the newest manifest's child ids point at, by document."""
    m = _manifest(spark, sf_dir)
    ids = m.select(F.explode("child_ids").alias("child_id"))
    c = table(spark, sf_dir, "chunks").withColumn("child_id", F.lower("child_id"))
    return storage.children_of(storage.by_ids(c, ids, "child_id"), m).groupBy("document_id").agg(F.count("*").alias("n"))


# storage rows


def flat_cycles(spark, sf_dir):
    f = storage.flat_cycle(table(spark, sf_dir, "document_metadata").select("record_id", "maintenance_cycle").distinct())
    return f.groupBy("maintenance_cycle_unit", "maintenance_cycle_trigger").agg(F.count("*").alias("n"), F.round(F.sum("maintenance_cycle_value"), 6).alias("total"))


def sparse_maps(spark, sf_dir):
    """Sparse vectors taken apart into a matrix's rows and built again; each tenth part of the ids gets a key twice, which gives null."""
    c = table(spark, sf_dir, "chunks").where("id is not null and sparse_vector is not null").select("id", F.map_keys("sparse_vector").alias("k"), F.map_values("sparse_vector").alias("v")).distinct()
    twice = F.col("id").startswith("7") & (F.size("k") > 0)
    m = c.select("id", F.when(twice, F.concat("k", F.slice("k", 1, 1))).otherwise(F.col("k")).alias("k"), F.when(twice, F.concat("v", F.slice("v", 1, 1))).otherwise(F.col("v")).alias("v"))
    r = storage.csr_rows(m, row="id", indices="k", values="v")
    return r.select("id", F.cardinality("sparse").alias("n"), F.round(F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def vector_checks(spark, sf_dir):
    """Storage rows by what keeps their vectors from being stored, on chunks broken on purpose."""
    c = records._broken(spark, sf_dir)
    return c.select(storage.vector_errors(F.col("dense_vector"), F.col("sparse_vector"), 4).alias("vector_error")).groupBy("vector_error").agg(F.count("*").alias("n"))


def file_prefix(spark, sf_dir):
    """Rows of files under a pattern, in which _ stands for any character."""
    return storage.like(table(spark, sf_dir, "chunks"), "source_file", "/plant/docs/dm0_-m%").groupBy("knowledge_type").agg(F.count("*").alias("n"))


# variants


def _proposals(question: str):
    """Three proposals made from a question by the first digit of its hash: the same with other spaces, one with a new token, a shorter one, or two of them."""
    q = F.col(question)
    kind = F.substring(F.md5(q), 1, 1)
    spaced, longer, shorter = F.concat(F.lit("  "), q), F.concat(q, F.lit(" QX-1")), F.left(q, F.floor(F.length(q) / 2).cast("int"))
    return F.when(kind < "4", F.array(spaced)).when(kind < "8", F.array(longer)).when(kind < "c", F.array(shorter)).otherwise(F.array(spaced, shorter))


def query_variants(spark, sf_dir):
    _, e = _asked(spark, sf_dir)
    x = e.where("question is not null").withColumn("proposed", _proposals("question"))
    edge = lambda h: F.when(F.col(h).rlike(r"^[A-Za-z0-9_.-]+$") & variants.stands_in(F.col("question"), F.col(h)), F.col(h))
    x = x.withColumns({f"h_{h}": edge(h) for h in runs.HARD})
    return variants.guarded(x, query="question", proposed="proposed", hard=[f"h_{h}" for h in runs.HARD]).select("entry_id", "variant_error", F.size("variants").alias("n_variants"))


def _plan(question):
    """A planner for tests of the contract: its answer hangs on the first digit of the question's hash."""
    kind = F.substring(F.md5(question), 1, 1)
    js = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    return (
        F.when(kind < "3", js(strategy=F.lit("direct"), reason_code=F.lit("plain"))).when(kind < "6", js(strategy=F.lit("rewrite"), rewritten_query=F.left(question, F.lit(4)), reason_code=F.lit("short")))
        .when(kind < "8", js(strategy=F.lit("rewrite"), reason_code=F.lit("no_query"))).when(kind < "a", F.lit("not json")).when(kind < "c", F.lit("timeout"))
        .when(kind < "e", js(strategy=F.lit("subquery"), subqueries=F.array(F.concat(question, F.lit(" ZZ9"))), reason_code=F.lit("more")))
    )


def planned(spark, sf_dir):
    q = records._questions(spark, sf_dir)
    return variants.planned(q, _plan, query="question").select("qid", "strategy", "decision_source", "fallback_reason", F.size("variants").alias("n_variants"))


def text_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.size(variants.lines(F.col("text"))).alias("n_lines"), F.size(variants.comma_list(F.col("text"))).alias("n_items"))


# answers


def contexts(spark, sf_dir):
    r = table(spark, sf_dir, "rag_evaluate_data").where("context is not null").dropDuplicates(["sample_id"])
    return r.select("sample_id", F.md5(answers.context_text(F.col("context"))).alias("digest"))


def _cited(spark, sf_dir):
    columns = ("question", *answers.CITED)
    e = table(spark, sf_dir, "fast_path").where("entry_id is not null and question is not null").groupBy(F.col("entry_id").alias("query_id")).agg(F.min(F.struct(*columns)).alias("e")).select("query_id", "e.*")
    claims = e.select("query_id", F.lit(1).alias("claim_id"), F.col("question").alias("text"), F.array(F.lit("E1")).alias("evidence_ids"))
    return claims, e.withColumn("evidence_id", F.lit("E1"))


def rendered(spark, sf_dir):
    claims, evidence = _cited(spark, sf_dir)
    return answers.rendered(claims, evidence).select("query_id", "status", F.md5("answer_text").alias("digest"))


def cached(spark, sf_dir):
    """Cached answers, some changed on purpose, by what the check says."""
    claims, evidence = _cited(spark, sf_dir)
    kind = F.substring(F.md5("query_id"), 1, 1)
    kept = answers.rendered(claims, evidence).withColumns({"answer_text": F.when(kind < "4", F.concat("answer_text", F.lit("."))).otherwise(F.col("answer_text")), "status": F.when(kind > "b", "failed").otherwise(F.col("status"))})
    return answers.cached_errors(kept, claims, evidence).groupBy("cache_error").agg(F.count("*").alias("n"))


def greetings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("question is not null")
    return c.select(answers.greeting(F.col("question")).alias("reply")).groupBy("reply").agg(F.count("*").alias("n"))


def files_read(spark, sf_dir):
    """The documents written as text files with front matter, and read back from their folders as source files."""
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    path = shared_path(spark, "files")
    head = F.concat(F.lit("---\ndocument_id: D-"), F.col("doc_id").cast("string"), F.lit("\ndocument_version: '1.0'\ntitle: T\nknowledge_type: manual\n---\n"))
    named = d.select(F.concat_ws("/", F.pmod(F.xxhash64("doc_id"), F.lit(256)), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"), F.concat(head, "text", F.lit("\n")).alias("value"))
    sinks.write_files(named, path)
    read = files.documents(spark, path)
    return read.select(F.substring("document_id", 3, 20).cast("bigint").alias("doc_id"), "ext", "metadata_source", "language", "error", F.md5("text").alias("digest"))


QUERIES = {
    "s2_files": files_read,
    "a6_run_aggregate": run_aggregate, "a7_channels": channels, "a10_paired_delta": paired_runs, "a10_paired_macro": paired_macro, "a17_document_counts": document_counts, "j8_label_errors": label_errors,
    "a16_intent_report": intent_report, "v11_probe": probe, "v12_routed": routed, "k7_integrity": integrity, "k5_commits": commits, "k17_deletes": deletes, "x17_metadata_sha": metadata_sha, "x7_revision": revision,
    "s19_stored_children": stored_children, "row_flat_cycles": flat_cycles, "row_sparse_maps": sparse_maps, "row_vector_checks": vector_checks, "f7_file_prefix": file_prefix, "f15_variants": query_variants,
    "e2_planned": planned, "x26_lines": text_lines, "h3_contexts": contexts, "g12_rendered": rendered, "f18_cached": cached, "f19_greetings": greetings,
}

_ONE = """
WITH e AS (SELECT entry_id, min({question: question, knowledge_type: knowledge_type, equipment_model: equipment_model, alarm_code: alarm_code, part_number: part_number, parent_id: parent_id, document_id: document_id}) AS s
  FROM fast_path WHERE entry_id IS NOT NULL GROUP BY 1),
o AS (SELECT entry_id, s.question AS question, s.knowledge_type AS knowledge_type, s.equipment_model AS model, s.alarm_code AS code, s.part_number AS part, s.parent_id AS parent_id, s.document_id AS document_id FROM e),
q AS (SELECT *, trim(NORMAL) AS nq, INTENT AS intent FROM o),
d AS (SELECT DISTINCT entry_id, knowledge_type, equipment_model AS model, alarm_code AS code, part_number AS part, trim(NORMAL) AS nq FROM fast_path WHERE entry_id IS NOT NULL),
told AS (SELECT entry_id, code, unnest(TOKENS) AS t FROM q),
open AS (SELECT DISTINCT entry_id FROM told WHERE t IN (SELECT code FROM d WHERE code IS NOT NULL) AND t IS DISTINCT FROM code),
a AS (SELECT q.entry_id, count(DISTINCT d.entry_id) AS n, min(d.entry_id) AS x FROM q JOIN d ON q.code = d.code AND (q.model IS NULL OR q.model = d.model) AND (q.part IS NULL OR q.part = d.part) GROUP BY 1),
f AS (SELECT q.entry_id, count(DISTINCT d.entry_id) AS n, min(d.entry_id) AS x FROM q JOIN d ON q.nq = d.nq AND (q.model IS NULL OR q.model = d.model) AND (q.part IS NULL OR q.part = d.part) AND (q.code IS NULL OR q.code = d.code) GROUP BY 1),
kinds AS (SELECT entry_id AS x, min(knowledge_type) AS kind FROM d GROUP BY 1),
r AS (SELECT q.*, CASE WHEN open.entry_id IS NOT NULL THEN 'unresolved_alarm_identifier' WHEN a.n > 1 THEN 'ambiguous_alarm_evidence' WHEN a.n = 1 AND q.intent = 'alarm_fault' AND kinds.kind = 'alarm' THEN 'exact_alarm'
  WHEN f.n > 1 THEN 'ambiguous_exact_faq' WHEN f.n = 1 THEN 'exact_faq' ELSE 'no_candidate' END AS reason, a.x AS ax, f.x AS fx
  FROM q LEFT JOIN open USING (entry_id) LEFT JOIN a USING (entry_id) LEFT JOIN f USING (entry_id) LEFT JOIN kinds ON kinds.x = a.x),
p AS (SELECT *, reason IN ('exact_alarm', 'exact_faq') AS hit, CASE reason WHEN 'exact_alarm' THEN ax WHEN 'exact_faq' THEN fx END AS got FROM r)
""".replace("NORMAL", search._FASTQ).replace("INTENT", records._INTENT).replace("TOKENS", search.tokens_sql("question"))
_NEWEST = """
WITH m AS (SELECT document_id, revision, kids, n, ds FROM (SELECT trim(document_id) AS document_id, revision, child_count AS n, lower(trim(document_sha256)) AS ds,
  list_sort(list_distinct(list_transform(child_ids, lambda x: lower(trim(x))))) AS kids, row_number() OVER (PARTITION BY trim(document_id) ORDER BY delivered_at DESC, revision DESC) AS rn
  FROM active_documents WHERE snapshot_no = (SELECT max(snapshot_no) FROM active_documents)) WHERE rn = 1)
"""
_EDGE = "[A-Za-z0-9_.-]+"


def _run_sql(name: str, where: str) -> str:
    return f"""{name}_s AS (SELECT q.id AS sample_id, r.id AS row_id, round({search._SCORES["cosine"]}, 6) AS score FROM qs q JOIN c r ON q.id <> r.id AND ({where})),
{name}_h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, row_id) AS rank FROM {name}_s) WHERE rank <= 20),
{name}_i AS (SELECT h.*, i.parent_id, i.document_id, i.model, i.code, i.part FROM {name}_h h JOIN info i ON i.id = h.row_id),
{name}_p AS (SELECT sample_id, parent_id, row_number() OVER (PARTITION BY sample_id ORDER BY min(rank)) AS place FROM {name}_i WHERE parent_id IS NOT NULL GROUP BY 1, 2),
{name}_d AS (SELECT sample_id, document_id, row_number() OVER (PARTITION BY sample_id ORDER BY min(rank)) AS place FROM {name}_i WHERE document_id IS NOT NULL GROUP BY 1, 2),
{name}_l AS (SELECT q.id AS sample_id, count(i.row_id) AS n, count(*) FILTER (i.row_id IS NOT NULL AND ((o.model IS NOT NULL AND o.model IS DISTINCT FROM i.model) OR (o.code IS NOT NULL AND o.code IS DISTINCT FROM i.code) OR (o.part IS NOT NULL AND o.part IS DISTINCT FROM i.part))) AS leaks
  FROM qs q JOIN info o ON o.id = q.id LEFT JOIN {name}_i i ON i.sample_id = q.id GROUP BY 1),
{name}_k AS (SELECT q.id AS sample_id, count(s.id) AS rel, count(h.row_id) AS hits, min(h.rank) AS first FROM qs q JOIN info o ON o.id = q.id LEFT JOIN info s ON s.parent_id = o.parent_id AND s.id <> o.id LEFT JOIN {name}_h h ON h.sample_id = q.id AND h.row_id = s.id GROUP BY 1),
{name} AS (SELECT q.id AS sample_id, CASE WHEN k.rel > 0 THEN CAST(k.hits > 0 AS DOUBLE) END AS ch, CASE WHEN k.rel > 0 THEN k.hits / k.rel END AS cr, CASE WHEN k.rel > 0 THEN coalesce(1 / k.first, 0) END AS cm, o.code, o.model IS NOT NULL OR o.code IS NOT NULL OR o.part IS NOT NULL AS hard, l.n, l.leaks, p.place AS pp, d.place AS dp,
  CASE WHEN p.place <= 5 THEN 1.0 ELSE 0.0 END AS ph, CASE WHEN p.place <= 5 THEN 1.0 / p.place ELSE 0.0 END AS pm, CASE WHEN d.place <= 5 THEN 1.0 ELSE 0.0 END AS dh, CASE WHEN d.place <= 5 THEN 1.0 / d.place ELSE 0.0 END AS dm
  FROM qs q JOIN info o ON o.id = q.id JOIN {name}_l l ON l.sample_id = q.id JOIN {name}_k k ON k.sample_id = q.id LEFT JOIN {name}_p p ON p.sample_id = q.id AND p.parent_id = o.parent_id LEFT JOIN {name}_d d ON d.sample_id = q.id AND d.document_id = o.document_id)"""


_INFO = search._CHUNK + """info AS (SELECT id, s.p AS parent_id, s.d AS document_id, s.m AS model, s.a AS code, s.n AS part FROM (
  SELECT id, min({p: parent_id, d: document_id, m: equipment_model, a: alarm_code, n: part_number}) AS s FROM chunks WHERE id IS NOT NULL GROUP BY 1)),
"""
_FIGURES = """count(*) AS sample_count, 0 AS error_count, count(*) FILTER (n = 0) AS zero_result_count, round(count(*) FILTER (n = 0) / count(*), 6) AS zero_result_rate, count(*) FILTER (hard) AS hard_count,
 count(*) FILTER (hard AND leaks > 0) AS leak_count, round(count(*) FILTER (hard AND leaks > 0) / nullif(count(*) FILTER (hard), 0), 6) AS leak_rate, CAST(coalesce(sum(leaks) FILTER (hard), 0) AS BIGINT) AS leaked_items,
 round(avg(ch), 6) AS child_hit, round(avg(cr), 6) AS child_recall, round(avg(cm), 6) AS child_mrr, round(avg(ph), 6) AS parent_hit, round(avg(ph), 6) AS parent_recall, round(avg(pm), 6) AS parent_mrr, round(avg(dh), 6) AS document_hit, round(avg(dh), 6) AS document_recall, round(avg(dm), 6) AS document_mrr"""
_DELTAS = _INFO + _run_sql("a", "true") + ", " + _run_sql("b", "q.grp IS NULL OR q.grp = r.grp") + ", x AS (SELECT sample_id, round(b.ph - a.ph, 6) AS hit_delta, round(b.pm - a.pm, 6) AS mrr_delta, CAST(NULL AS VARCHAR) AS only_in FROM a JOIN b USING (sample_id)) "
_RENDER = """
WITH e AS (SELECT entry_id AS query_id, min({q: question, t: title, d: document_id, v: document_version, s: source_file}) AS s FROM fast_path WHERE entry_id IS NOT NULL AND question IS NOT NULL GROUP BY 1),
r AS (SELECT query_id, s.q || '[E1]' || chr(10) || chr(10) || '来源：' || chr(10) || '[E1] {"title": ' || coalesce(CAST(to_json(s.t) AS VARCHAR), 'null') || ', "document_id": ' || coalesce(CAST(to_json(s.d) AS VARCHAR), 'null')
  || ', "document_version": ' || coalesce(CAST(to_json(s.v) AS VARCHAR), 'null') || ', "source_file": ' || coalesce(CAST(to_json(s.s) AS VARCHAR), 'null') || '}' AS answer, s.q AS text FROM e)
"""
_QUESTIONS = "WITH q AS (SELECT DISTINCT question, md5(question) AS qid FROM (SELECT question FROM jpkb UNION ALL SELECT question FROM rag_evaluate_data UNION ALL SELECT question FROM fast_path) WHERE question IS NOT NULL)"
_ENDS = r"regexp_replace(regexp_replace(x, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '')"

SQL = {
    "s2_files": "SELECT doc_id, 'txt' AS ext, 'front_matter' AS metadata_source, 'zh-CN' AS language, '' AS error, md5(max(text) || chr(10)) AS digest FROM documents WHERE text IS NOT NULL GROUP BY doc_id",
    "a6_run_aggregate": _INFO + _run_sql("a", "true") + f" SELECT 'all' AS part, {_FIGURES} FROM a UNION ALL SELECT CASE WHEN code IS NOT NULL THEN 'alarm' ELSE 'other' END, {_FIGURES} FROM a GROUP BY 1",
    "a10_paired_delta": _DELTAS + "SELECT * FROM x",
    "a10_paired_macro": _DELTAS + "SELECT count(*) AS n_samples, count(*) FILTER (mrr_delta > 0) AS better, count(*) FILTER (mrr_delta < 0) AS worse, round(avg(hit_delta), 6) AS hit_delta, round(avg(mrr_delta), 6) AS mrr_delta FROM x",
    "a7_channels": _ONE + """, s AS (SELECT p.*, p.knowledge_type = 'alarm' AND p.code IS NOT NULL AS label_alarm, g.parent_id = p.parent_id AND g.document_id = p.document_id AS correct FROM p LEFT JOIN o g ON g.entry_id = p.got),
x AS (SELECT c.channel, CASE c.channel WHEN 'exact_alarm' THEN coalesce(label_alarm, false) WHEN 'exact_faq' THEN true ELSE false END AS el, s.reason = c.channel AS took, coalesce(s.correct, false) AS correct
  FROM s, (SELECT unnest(['exact_alarm', 'exact_faq', 'bm25_faq']) AS channel) c)
SELECT channel, count(*) FILTER (el) AS eligible, count(*) FILTER (took) AS accepted, count(*) FILTER (took AND correct) AS correct, count(*) FILTER (took AND NOT correct) AS incorrect, count(*) FILTER (took AND NOT el) AS unlabelled,
 count(*) FILTER (el AND NOT took) AS fallback, round(count(*) FILTER (el AND took) / nullif(count(*) FILTER (el), 0), 6) AS coverage, round(count(*) FILTER (took AND correct) / nullif(count(*) FILTER (took), 0), 6) AS precision,
 round(count(*) FILTER (el AND NOT took) / nullif(count(*) FILTER (el), 0), 6) AS fallback_rate FROM x GROUP BY 1""",
    "v11_probe": _ONE + "SELECT entry_id AS query_id, CASE WHEN hit THEN 'ACCEPTED' ELSE 'FALLBACK' END AS status, CASE WHEN hit THEN reason ELSE 'fallback' END AS match_type, reason, got AS entry_id FROM p",
    "v12_routed": "WITH fast AS (SELECT * FROM (" + _ONE + "SELECT entry_id AS query_id, hit, got FROM p) WHERE CAST(right(query_id, 7) AS INT) % 20 = 0), scored AS (" + search.SQL["r4_bm25_scoped"]
    + """) SELECT f.query_id, CASE WHEN f.hit THEN 'fast_path' WHEN s.entry_id IS NOT NULL THEN 'retrieval' ELSE 'not_found' END AS route, CASE WHEN f.hit THEN f.got ELSE s.entry_id END AS entry_id
FROM fast f LEFT JOIN scored s ON s.query_id = f.query_id AND s.rank = 1 AND s.score >= 12""",
    "a17_document_counts": "SELECT document_id, count(DISTINCT child_id) AS n_children, count(DISTINCT parent_id) AS n_parents, count(DISTINCT document_version) <= 1 AS one_version FROM chunks WHERE document_id IS NOT NULL GROUP BY 1",
    "j8_label_errors": _NEWEST + """, o AS (SELECT entry_id, s.p AS parent_id, s.d AS document_id FROM (SELECT entry_id, min({q: question, k: knowledge_type, e: equipment_model, a: alarm_code, n: part_number, p: parent_id, d: document_id}) AS s FROM fast_path WHERE entry_id IS NOT NULL GROUP BY 1)),
ch AS (SELECT DISTINCT lower(child_id) AS child_id, parent_id FROM chunks WHERE child_id IS NOT NULL),
kids AS (SELECT o.entry_id, o.document_id, o.parent_id, ch.child_id FROM o JOIN ch USING (parent_id)),
act AS (SELECT document_id, unnest(kids) AS child_id FROM m),
real AS (SELECT k.entry_id, list_sort(list(DISTINCT ch.parent_id)) AS real FROM kids k JOIN ch USING (child_id) GROUP BY 1),
x AS (SELECT entry_id, 'missing_document' AS problem FROM o WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM m)
 UNION SELECT k.entry_id, 'missing_child' FROM kids k LEFT JOIN act ON act.document_id = k.document_id AND act.child_id = k.child_id WHERE act.child_id IS NULL
 UNION SELECT o.entry_id, 'parent_mismatch' FROM o LEFT JOIN real USING (entry_id) WHERE coalesce(real, []) IS DISTINCT FROM [o.parent_id])
SELECT problem, count(*) AS n FROM x GROUP BY 1""",
    "a16_intent_report": f"""
WITH f AS (SELECT knowledge_type AS t, CASE WHEN i = 'alarm_fault' THEN 'alarm' ELSE i END AS p FROM (SELECT knowledge_type, {records._INTENT} AS i FROM fast_path) WHERE knowledge_type IS NOT NULL),
l AS (SELECT t AS label FROM f UNION SELECT p FROM f),
c AS (SELECT label, (SELECT count(*) FROM f WHERE t = label) AS support, (SELECT count(*) FROM f WHERE p = label) AS claimed, (SELECT count(*) FROM f WHERE t = label AND p = label) AS hits FROM l)
SELECT label, round(coalesce(hits / nullif(claimed, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hits / nullif(claimed + support, 0), 0), 6) AS f1, support FROM c""",
    "k7_integrity": "SELECT snapshot_no, CASE WHEN coalesce(child_count <> len(child_ids), true) THEN 'child_count' WHEN coalesce(revision < 1, true) THEN 'revision' ELSE '' END AS integrity, count(*) AS n FROM active_documents GROUP BY 1, 2",
    "k5_commits": _NEWEST + """, k AS (SELECT * FROM m WHERE revision IS NOT NULL)
SELECT document_id, CASE WHEN ds < '8' THEN 'COMMITTED' ELSE 'CONFLICT' END AS outcome, CASE WHEN ds < '8' THEN revision + 1 ELSE revision END AS revision FROM k
UNION ALL SELECT document_id || '-new', 'COMMITTED', 1 FROM k WHERE ds LIKE 'a%'""",
    "k17_deletes": _NEWEST + """, s AS (SELECT document_id, count(DISTINCT lower(child_id)) AS n FROM chunks WHERE document_id IS NOT NULL AND child_id IS NOT NULL GROUP BY 1)
SELECT document_id, 'DELETED' AS status, CAST(coalesce(s.n, 0) AS INT) AS n_removed FROM (SELECT document_id FROM m UNION SELECT document_id FROM s) LEFT JOIN s USING (document_id)
UNION ALL SELECT document_id || '-none', 'NOOP', 0 FROM m""",
    "x17_metadata_sha": """
SELECT DISTINCT record_id, sha256(CAST(to_json({alarm_code: alarm_code, document_id: document_id, document_version: document_version, equipment_model: equipment_model, knowledge_type: knowledge_type, language: language, part_number: part_number, title: title}) AS VARCHAR)) AS sha FROM document_metadata""",
    "x7_revision": _NEWEST + """, h1 AS (SELECT sha256(concat_ws('|', T(document_id), T(revision), T(ds), T(array_to_string(kids, ',')))) AS h FROM m),
h2 AS (SELECT sha256(concat_ws('|', T(entry_id), T(question), T(evidence_text))) AS h FROM (SELECT DISTINCT entry_id, question, evidence_text FROM fast_path)),
p1 AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h1 GROUP BY 1), p2 AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h2 GROUP BY 1)
SELECT sha256((SELECT sha256(string_agg(p, '' ORDER BY b)) FROM p1) || '|equipment|' || (SELECT sha256(string_agg(p, '' ORDER BY b)) FROM p2)) AS revision""",
    "s19_stored_children": _NEWEST + """, ids AS (SELECT DISTINCT unnest(kids) AS child_id FROM m)
SELECT document_id, count(DISTINCT lower(child_id)) AS n FROM chunks WHERE document_id IS NOT NULL AND lower(child_id) IN (SELECT child_id FROM ids) AND document_id IN (SELECT document_id FROM m) GROUP BY 1""",
    "row_flat_cycles": "SELECT c.unit AS maintenance_cycle_unit, c.trigger AS maintenance_cycle_trigger, count(*) AS n, round(sum(c.value), 6) AS total FROM (SELECT DISTINCT record_id, maintenance_cycle AS c FROM document_metadata) GROUP BY 1, 2",
    "row_sparse_maps": """
SELECT id, CASE WHEN id LIKE '7%' AND cardinality(sp) > 0 THEN NULL ELSE CAST(cardinality(sp) AS INT) END AS n, CASE WHEN id LIKE '7%' AND cardinality(sp) > 0 THEN NULL ELSE round(coalesce(list_sum(list_transform(map_values(sp), lambda x: CAST(x AS DOUBLE))), 0), 4) END AS total
FROM (SELECT DISTINCT ON (id) id, sparse_vector AS sp FROM chunks WHERE id IS NOT NULL AND sparse_vector IS NOT NULL)""",
    "row_vector_checks": records._BROKEN + """
SELECT CASE WHEN dense_vector IS NULL OR len(dense_vector) <> 4 THEN 'dimension' WHEN list_bool_or(list_transform(dense_vector, lambda x: NOT isfinite(x))) THEN 'dense_not_finite' WHEN coalesce(cardinality(sparse_vector), 0) = 0 THEN 'sparse_empty'
 WHEN list_bool_or(list_transform(map_keys(sparse_vector), lambda k: k < 0 OR k > 4294967295)) THEN 'sparse_key' WHEN list_bool_or(list_transform(map_values(sparse_vector), lambda x: NOT isfinite(x))) THEN 'sparse_not_finite' ELSE '' END AS vector_error, count(*) AS n
FROM broken GROUP BY 1""",
    "f7_file_prefix": "SELECT knowledge_type, count(*) AS n FROM chunks WHERE source_file LIKE '/plant/docs/dm0_-m%' GROUP BY 1",
    "f15_variants": f"""
WITH e AS (SELECT entry_id, min({{question: question, knowledge_type: knowledge_type, equipment_model: equipment_model, alarm_code: alarm_code, part_number: part_number, parent_id: parent_id, document_id: document_id}}) AS s FROM fast_path WHERE entry_id IS NOT NULL GROUP BY 1),
q AS (SELECT entry_id, s.question AS q, [s.equipment_model, s.alarm_code, s.part_number] AS ids, substr(md5(s.question), 1, 1) AS k, left(s.question, CAST(floor(length(s.question) / 2) AS BIGINT)) AS short FROM e WHERE s.question IS NOT NULL),
v AS (SELECT entry_id, q, short, k, list_filter(ids, lambda x: x IS NOT NULL AND regexp_full_match(x, '{_EDGE}') AND list_contains(regexp_extract_all(q, '{_EDGE}'), x)) AS hard,
  CASE WHEN k < '4' THEN ['  ' || q] WHEN k < '8' THEN [q || ' QX-1'] WHEN k < 'c' THEN [short] ELSE ['  ' || q, short] END AS p FROM q),
t AS (SELECT *, list_bool_or(list_transform(p, lambda x: trim(x) = '')) AS blank,
  len(list_filter(hard, lambda h: len(list_filter(p, lambda x: NOT list_contains(regexp_extract_all(x, '{_EDGE}'), h))) > 0)) > 0 AS lost,
  len(list_filter(p, lambda x: len(list_filter(regexp_extract_all(x, '[A-Za-z0-9][A-Za-z0-9_.-]*'), lambda w: NOT list_contains(regexp_extract_all(q, '[A-Za-z0-9][A-Za-z0-9_.-]*'), w))) > 0)) > 0 AS fresh,
  len(list_distinct(list_transform(list_concat([q], p), lambda x: trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g'))))) AS n FROM v)
SELECT entry_id, CASE WHEN blank THEN 'invalid_query' WHEN lost THEN 'hard_identifier_not_preserved' WHEN fresh THEN 'new_identifier_token' WHEN n = 1 THEN 'duplicate_query_variant' ELSE '' END AS variant_error,
 CASE WHEN NOT blank AND NOT lost AND NOT fresh AND n > 1 THEN CAST(n AS INT) ELSE 1 END AS n_variants FROM t""",
    "e2_planned": _QUESTIONS + """, k AS (SELECT *, substr(qid, 1, 1) AS k, left(question, 4) AS short FROM q),
v AS (SELECT *, len(list_filter(regexp_extract_all(short, '[A-Za-z0-9][A-Za-z0-9_.-]*'), lambda w: NOT list_contains(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9_.-]*'), w))) > 0 AS fresh, trim(short) = '' AS blank,
  trim(regexp_replace(short, '[\\s\\p{Z}]+', ' ', 'g')) = trim(regexp_replace(question, '[\\s\\p{Z}]+', ' ', 'g')) AS same FROM k),
r AS (SELECT qid, k, CASE WHEN k < '3' THEN NULL WHEN k < '6' THEN CASE WHEN blank THEN 'planner_invalid_schema' WHEN fresh THEN 'new_identifier_token' WHEN same THEN 'duplicate_query_variant' END
  WHEN k < '8' THEN 'planner_invalid_schema' WHEN k < 'a' THEN 'planner_invalid_json' WHEN k < 'c' THEN 'planner_timeout' WHEN k < 'e' THEN 'new_identifier_token' ELSE 'planner_error' END AS reason FROM v)
SELECT qid, CASE WHEN reason IS NULL AND k >= '3' THEN 'rewrite' ELSE 'direct' END AS strategy, CASE WHEN reason IS NULL THEN 'planner' ELSE 'fallback' END AS decision_source, reason AS fallback_reason, CASE WHEN reason IS NULL AND k >= '3' THEN 2 ELSE 1 END AS n_variants FROM r""",
    "x26_lines": f"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: {_ENDS} <> '')) AS INT) AS n_lines, CAST(len(list_filter(regexp_split_to_array(text, '[,，]'), lambda x: {_ENDS} <> '')) AS INT) AS n_items FROM documents WHERE text IS NOT NULL",
    "h3_contexts": "SELECT sample_id, md5(left(array_to_string(context, chr(10) || chr(10)), 4096)) AS digest FROM (SELECT DISTINCT ON (sample_id) * FROM rag_evaluate_data WHERE context IS NOT NULL)",
    "g12_rendered": _RENDER + "SELECT query_id, 'answered' AS status, md5(answer) AS digest FROM r WHERE text <> ''",
    "f18_cached": _RENDER + r"""SELECT CASE WHEN substr(md5(query_id), 1, 1) > 'b' THEN 'only_answered_cache' WHEN regexp_matches(text, '\[E[0-9]+\]|^\s*\d+[.)、]') THEN 'invalid_cached_claim_markup' WHEN substr(md5(query_id), 1, 1) < '4' THEN 'invalid_cached_rendering' ELSE '' END AS cache_error, count(*) AS n FROM r GROUP BY 1""",
    "f19_greetings": "SELECT CASE " + " ".join(f"WHEN regexp_matches(t, '^(?i:{p})') THEN '{n}'" for n, p in answers.GREETINGS) + r" END AS reply, count(*) AS n FROM (SELECT regexp_replace(question, '^[\s\p{Z}]+', '') AS t FROM conversations WHERE question IS NOT NULL) GROUP BY 1",
}


def _told(sql: str) -> str:
    """``T(x)`` as a value with its length in front."""
    import re

    return re.sub(r"\bT\(((?:[^()]|\([^()]*\))*)\)", r"coalesce(strlen(CAST(\1 AS VARCHAR)) || ':' || CAST(\1 AS VARCHAR), '~')", sql)


SQL["x7_revision"] = _told(SQL["x7_revision"])
