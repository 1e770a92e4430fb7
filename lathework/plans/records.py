"""Queries on documents, stored rows, manifests, sessions and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.functions import text
from lathework.operators import analysis, chunking, evaluation, guards, ingestion, sessions
from lathework.operators.snapshots import id_set, stripped
from lathework.plans.search import tokens_sql
from lathework.session import table


def content_groups(spark, sf_dir):
    return ingestion.content_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def stable_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    out = ingestion.stable_ids(lines.where("trim(content) <> ''"))
    return out.select("document_id", "pos", F.col("occurrence").cast("int").alias("occurrence"), "piece_id")


def id_delta(spark, sf_dir):
    """Child ids that the newest manifest wants against those stored."""
    a = table(spark, sf_dir, "active_documents")
    last = a.join(a.agg(F.max("snapshot_no").alias("snapshot_no")), "snapshot_no")
    desired = last.select(stripped(F.col("document_id")).alias("document_id"), F.explode(id_set(F.col("child_ids"))).alias("child_id"))
    actual = table(spark, sf_dir, "chunks").where("document_id is not null and child_id is not null").select("document_id", F.lower("child_id").alias("child_id"))
    return ingestion.id_delta(desired, actual, "document_id", "child_id")


def fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return ingestion.fingerprint(d, ["doc_id", "document_id", "lang", "n_chars", "text"], by="lang")


#: How each tenth of the rows is broken on purpose, by the first digits of the id.
BREAKS = {
    "title": "cast(null as string)", "text": "''", "id": "upper(id)", "knowledge_type": "'other'", "alarm_code": "' '", "part_number": "cast(null as string)", "maintenance_cycle_value": "cast(-1 as double)",
    "maintenance_cycle_unit": "'decade'", "effective_date": "'2024-02-30'", "dense_vector": "array(cast('nan' as float))", "sparse_vector": "map(cast(-5 as bigint), cast(1 as float))", "schema_version": "repeat('é', 33)",
}


def _broken(spark, sf_dir):
    """All stored rows, and those whose id begins with 1 once more for every way of :data:`BREAKS`."""
    c = table(spark, sf_dir, "chunks")
    out = c
    for column, value in BREAKS.items():
        out = out.unionByName(c.where("id like '1%'").withColumn(column, F.expr(value)))
    return out


def row_errors(spark, sf_dir):
    """How many rows break each rule, rules that none breaks included."""
    rules = spark.createDataFrame([(r,) for r in ingestion.rule_names(table(spark, sf_dir, "chunks").columns)], "rule string")
    c = ingestion.row_errors(_broken(spark, sf_dir))
    n = c.select(F.explode("errors").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return rules.join(n, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n_rows"))


def duplicate_ids(spark, sf_dir):
    return ingestion.duplicate_keys(table(spark, sf_dir, "chunks"), "id")


def _newest(spark, sf_dir, back):
    """The valid rows of the newest snapshot, or of the one before it."""
    a = table(spark, sf_dir, "active_documents").withColumn("document_id", stripped(F.col("document_id")))
    numbers = a.select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(back).agg(F.min("snapshot_no").alias("snapshot_no"))
    rows = a.join(numbers, "snapshot_no")
    columns = {"version": "active_document_version", "document_sha256": "document_sha256", "metadata_sha256": "metadata_sha256", "signature": "processing_signature"}
    r = F.struct("delivered_at", *(F.lower(stripped(F.col(c))).alias(n) for n, c in columns.items()), id_set(F.col("child_ids")).alias("child_ids"))
    return rows.groupBy("document_id").agg(F.max(r).alias("r")).select("document_id", *(F.col(f"r.{n}").alias(n) for n in (*columns, "child_ids")))


def decisions(spark, sf_dir):
    """What ingestion would do with the newest snapshot's documents, given the manifest before it and the child ids stored in chunks."""
    stored = table(spark, sf_dir, "chunks").where("document_id is not null and child_id is not null").select("document_id", F.lower("child_id").alias("child_id")).distinct()
    d = ingestion.decide(_newest(spark, sf_dir, 1), _newest(spark, sf_dir, 2), stored)
    return d.groupBy("decision").agg(F.count("*").alias("n_documents"))


def upserted(spark, sf_dir):
    """The manifest before the newest snapshot, with the newest rows of documents whose hash begins with 0 to 9 put over it and those that begin with f deleted."""
    old, new = _newest(spark, sf_dir, 2), _newest(spark, sf_dir, 1)
    merged = ingestion.upsert(old, new.where("document_sha256 < 'a'"), "document_id")
    gone = new.where("document_sha256 like 'f%'").select("document_id")
    return ingestion.delete(merged, gone, "document_id").select("document_id", "version", F.size("child_ids").alias("n_children"))


def token_counts(spark, sf_dir):
    q = table(spark, sf_dir, "fast_path").select("entry_id", "question").distinct()
    t = q.select(F.explode(text.tokens(text.normal_question(F.col("question")))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


def intents(spark, sf_dir):
    c = analysis.with_intent(table(spark, sf_dir, "conversations").where("question is not null"), "question")
    return c.groupBy("intent", "confidence").agg(F.count("*").alias("n"))


def intent_confusion(spark, sf_dir):
    f = analysis.with_intent(table(spark, sf_dir, "fast_path"), "question")
    return evaluation.confusion(f, "knowledge_type", "intent")


def _questions(spark, sf_dir):
    """All distinct questions of the three question tables, each with its hash as key."""
    q = None
    for name in ("jpkb", "rag_evaluate_data", "fast_path"):
        part = table(spark, sf_dir, name).select("question")
        q = part if q is None else q.unionByName(part)
    return q.where("question is not null").distinct().withColumn("qid", F.md5("question"))


def entities(spark, sf_dir):
    a = analysis.with_intent(analysis.entities(_questions(spark, sf_dir), "question"), "question")
    plan = analysis.filter_plan(a)
    return plan.select("qid", "intent", "confidence", *analysis.ALL_FIELDS, "mode", F.array_join("ambiguous", ",").alias("ambiguous"))


def labelled_identifiers(spark, sf_dir):
    """Catalogue identifiers put into a question after a label, and the value that comes out; those that are not one token in Latin letters are left null."""
    c = table(spark, sf_dir, "identifier_catalog")
    label = F.when(F.col("field_name") == "equipment_model", "型号：").when(F.col("field_name") == "alarm_code", "报警码：").otherwise("备件号：")
    a = analysis.entities(c.select("item_id", "field_name", "canonical_value", F.concat(label, "canonical_value", F.lit("，请说明")).alias("question")), "question")
    found = F.when(F.col("field_name") == "equipment_model", F.col("equipment_model")).when(F.col("field_name") == "alarm_code", F.col("alarm_code")).otherwise(F.col("part_number"))
    return a.select("item_id", F.when(F.col("canonical_value").rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$"), found).alias("found"))


def filter_plans(spark, sf_dir):
    """Filter plans of all distinct conversation questions with a classifier that always proposes the rules' own intent with confidence HIGH."""
    q = table(spark, sf_dir, "conversations").where("question is not null").select("question").distinct().withColumn("qid", F.md5("question"))
    a = analysis.with_intent(analysis.entities(q, "question"), "question")
    proposals = a.select("qid", F.col("intent").alias("p_intent"), F.lit("HIGH").alias("p_confidence"), *(F.lit(None).cast("string").alias(f"p_{f}") for f in analysis.ALL_FIELDS))
    plans = analysis.mode_errors(analysis.filter_plan(analysis.merged(a, proposals, "qid", "question")))
    return plans.groupBy("intent", "confidence", F.array_join("soft_types", ",").alias("soft_types"), "mode_error").agg(F.count("*").alias("n"))


def claim_guard(spark, sf_dir):
    """Answers as claims that cite all passages of their context."""
    r = table(spark, sf_dir, "rag_evaluate_data").where("context is not null and answer is not null").dropDuplicates(["sample_id"])
    ids = F.transform(F.sequence(F.lit(1), F.size("context")), lambda i: F.concat(F.lit("E"), i))
    ids = F.when(F.size("context") > 0, ids).otherwise(F.array().cast("array<string>"))
    claims = r.select(F.col("sample_id").alias("query_id"), F.lit(1).alias("claim_id"), F.col("question").alias("query_text"), F.col("answer").alias("text"), ids.alias("evidence_ids"))
    evidence = r.select(F.col("sample_id").alias("query_id"), F.posexplode("context").alias("i", "page_content")).withColumn("evidence_id", F.concat(F.lit("E"), F.col("i") + 1))
    return guards.check_claims(claims, evidence).groupBy("verdict").agg(F.count("*").alias("n"))


def history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").dropDuplicates(["id"])
    return sessions.last_turns(c).select("session_id", "id", "turn")


def history_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").dropDuplicates(["id"])
    return sessions.context(sessions.last_turns(c)).select("session_id", F.md5("context").alias("digest"))


def answer_slices(spark, sf_dir):
    s = guards.slices(table(spark, sf_dir, "documents"), "doc_id", "text")
    return s.select("doc_id", "seq", F.md5("delta").alias("digest"))


def chunk_children(spark, sf_dir):
    return chunking.parents_and_children(table(spark, sf_dir, "documents"), key="doc_id", text="text").select("document_id", "parent_no", "child_no", "parent_id", "child_id")


def chunk_rules(spark, sf_dir):
    """Without overlap, the children of a text hold its letters and digits once and in order, under ids of their own."""
    d = table(spark, sf_dir, "documents").where("text is not null").dropDuplicates(["doc_id"])
    c = chunking.parents_and_children(d, key="doc_id", text="text", parent_overlap=0, child_overlap=0)
    solid = F.regexp_replace("text", r"[^\p{L}\p{N}]", "")
    per = c.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("child_id").alias("n_ids"), F.array_sort(F.collect_list(F.struct("parent_no", "child_no", solid.alias("s")))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["s"]), "")
    return per.where(whole != "").select(F.col("document_id").cast("bigint").alias("doc_id"), (F.col("n") == F.col("n_ids")).alias("unique_ids"), F.md5(whole).alias("digest"))


def heading_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.size(chunking.at_separator(F.col("text"), "\n\n")).alias("n_pieces"))


def latency(spark, sf_dir):
    return evaluation.latency(table(spark, sf_dir, "events"), "value", "event_type")


def sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    return d.groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {
    "a13_content_groups": content_groups, "w1_stable_ids": stable_ids, "u1_id_delta": id_delta, "a11_fingerprint": fingerprint, "f10_row_errors": row_errors, "u6_duplicate_ids": duplicate_ids,
    "i1_decisions": decisions, "k1_upsert_delete": upserted, "x9_token_counts": token_counts, "x14_intents": intents, "a16_intent_confusion": intent_confusion, "x11_entities": entities, "x11_labelled": labelled_identifiers, "f2_filter_plans": filter_plans, "c1_chunk_rules": chunk_rules,
    "f14_claim_guard": claim_guard, "w2_history": history, "h1_history_context": history_context, "h2_answer_slices": answer_slices, "c1_chunk_children": chunk_children,
    "c2_separator_pieces": heading_sections, "a9_latency": latency, "s1_sources": sources,
}

_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
_NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(%s), '\r\n?', chr(10), 'g'), '[\t\x{{0b}}\x{{0c}}\r\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+(\n|$)', '\1', 'g'), '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


def _hash(c: str) -> str:
    return f"sha256({_NORMAL.replace('%s', c)})"


_CUES = {name: p for name, p in analysis.INTENT_CUES}
_NTH = "+".join(f"CAST(coalesce(regexp_matches(question, '(?i){p}'), false) AS INT)" for p in _CUES.values())
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(question, '(?i){p}') THEN '{n}'" for n, p in _CUES.items()) + " ELSE 'general' END"
_LAST = """
WITH once AS (SELECT DISTINCT ON (id) * FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS back FROM once WHERE session_id IS NOT NULL AND timestamp IS NOT NULL),
t AS (SELECT *, CAST(count(*) OVER (PARTITION BY session_id) - back + 1 AS INT) AS turn FROM n WHERE back <= 5)
"""
_MANIFEST = """
WITH nums AS (SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no DESC) AS r FROM (SELECT DISTINCT snapshot_no FROM active_documents)),
m AS (SELECT n.r, trim(document_id) AS document_id, lower(trim(active_document_version)) AS version, lower(trim(document_sha256)) AS ds, lower(trim(metadata_sha256)) AS ms, lower(trim(processing_signature)) AS sig,
  list_sort(list_distinct(list_transform(child_ids, lambda x: lower(trim(x))))) AS kids,
  row_number() OVER (PARTITION BY n.r, trim(document_id) ORDER BY delivered_at DESC) AS rn FROM active_documents JOIN nums n USING (snapshot_no) WHERE n.r <= 2),
new AS (SELECT * FROM m WHERE r = 1 AND rn = 1), old AS (SELECT * FROM m WHERE r = 2 AND rn = 1)
"""
_RULES = (
    [(f"required:{c}", f"coalesce(trim({c}), '') = ''") for c in ingestion.REQUIRED]
    + [(f"hash:{c}", f"NOT regexp_full_match({c}, '[0-9a-f]{{64}}')") for c in ingestion.HASHES]
    + [(f"bytes:{c}", f"strlen({c}) > {n}") for c, n in ingestion.MOST_BYTES.items()]
    + [
        ("id_is_child_id", "id IS DISTINCT FROM child_id"),
        ("knowledge_type", "knowledge_type NOT IN (" + ", ".join(f"'{k}'" for k in ingestion.KNOWLEDGE_TYPES) + ")"),
        ("alarm_needs_code", "knowledge_type = 'alarm' AND nullif(trim(alarm_code), '') IS NULL"),
        ("fault_needs_detail", "knowledge_type = 'fault' AND coalesce(nullif(trim(fault_type), ''), nullif(trim(fault_symptom), '')) IS NULL"),
        ("parts_needs_number", "knowledge_type = 'parts' AND nullif(trim(part_number), '') IS NULL"),
        ("cycle_value", "maintenance_cycle_value IS NOT NULL AND (NOT isfinite(maintenance_cycle_value) OR maintenance_cycle_value <= 0)"),
        ("cycle_unit", "maintenance_cycle_unit NOT IN (" + ", ".join(f"'{k}'" for k in ingestion.CYCLE_UNITS) + ")"),
        ("cycle_pair", "(maintenance_cycle_value IS NULL) <> (maintenance_cycle_unit IS NULL)"),
        ("effective_date", r"effective_date IS NOT NULL AND (NOT regexp_full_match(effective_date, '\d{4}-\d{2}-\d{2}') OR TRY_CAST(effective_date AS DATE) IS NULL)"),
        ("dense_vector", "dense_vector IS NULL OR list_bool_or(list_transform(dense_vector, lambda x: NOT isfinite(x)))"),
        ("sparse_vector", "coalesce(cardinality(sparse_vector), 0) = 0"),
        ("sparse_keys", "list_bool_or(list_transform(map_keys(sparse_vector), lambda d: d < 0 OR d > 4294967295))"),
    ]
)

_TO_SQL = [("cast(null as string)", "CAST(NULL AS VARCHAR)"), ("array(cast('nan' as float))", "[CAST('nan' AS FLOAT)]"), ("map(cast(-5 as bigint), cast(1 as float))", "MAP {CAST(-5 AS BIGINT): CAST(1 AS FLOAT)}")]


def _to_sql(value: str) -> str:
    return next((b for a, b in _TO_SQL if a == value), value)


_BROKEN = "WITH broken AS (SELECT * FROM chunks" + "".join(f" UNION ALL SELECT * REPLACE ({_to_sql(v)} AS {c}) FROM chunks WHERE id LIKE '1%'" for c, v in BREAKS.items()) + ") "
_WORDS = "regexp_extract_all(%s, '[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*')"
_NUMBERS = r"regexp_extract_all(%s, '(?:^|[^A-Za-z0-9_.\p{Nd}])([-+]?\p{Nd}+(?:[.,]\p{Nd}+)*(?:[eE][-+]?\p{Nd}+)?(?:%%|[°℃])?)', 1)".replace("%%", "%")

SQL = {
    "a13_content_groups": f"SELECT {_hash('text')} AS content_sha, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "w1_stable_ids": f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT document_id, unnest(l) AS content, CAST(unnest(range(len(l))) AS INT) AS pos FROM d),
h AS (SELECT document_id, pos, {_hash("content")} AS s FROM e WHERE trim(content, ' ') <> ''),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id, s ORDER BY pos) - 1 AS INT) AS occurrence FROM h)
SELECT document_id, pos, occurrence, sha256('["parent","' || document_id || '","' || s || '",' || occurrence || ']') AS piece_id FROM o""",
    "u1_id_delta": """
WITH d AS (SELECT DISTINCT trim(document_id) AS document_id, unnest(list_transform(child_ids, lambda x: lower(trim(x)))) AS child_id FROM active_documents WHERE snapshot_no = (SELECT max(snapshot_no) FROM active_documents)),
a AS (SELECT DISTINCT document_id, lower(child_id) AS child_id FROM chunks WHERE document_id IS NOT NULL AND child_id IS NOT NULL)
SELECT coalesce(d.document_id, a.document_id) AS document_id, count(*) FILTER (a.child_id IS NULL) AS added, count(*) FILTER (a.child_id IS NOT NULL AND d.child_id IS NOT NULL) AS retained, count(*) FILTER (d.child_id IS NULL) AS removed
FROM d FULL OUTER JOIN a ON d.document_id = a.document_id AND d.child_id = a.child_id GROUP BY 1""",
    "f10_row_errors": _BROKEN + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n_rows FROM broken WHERE {c}" for n, c in _RULES),
    "a11_fingerprint": f"""
WITH h AS (SELECT lang, sha256(concat_ws('|', {", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in ("doc_id", "document_id", "lang", "n_chars", "text"))})) AS h FROM documents),
p AS (SELECT lang, substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p, count(*) AS n FROM h GROUP BY 1, 2)
SELECT lang, sha256(string_agg(p, '' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM p GROUP BY 1""",
    "c1_chunk_rules": r"""
SELECT doc_id, true AS unique_ids, md5(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS digest FROM (SELECT DISTINCT ON (doc_id) * FROM documents)
WHERE regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') <> ''""",
    "x11_labelled": rf"""
SELECT item_id, CASE WHEN regexp_full_match(canonical_value, '[A-Za-z0-9][A-Za-z0-9_-]*') AND NOT regexp_matches(canonical_value, '[-_]$') AND NOT regexp_full_match(canonical_value, '\d{{4}}[-_]\d\d?[-_]\d\d?')
 AND NOT regexp_full_match(canonical_value, '(?i)\d+({"|".join(analysis.UNITS)})') AND lower(canonical_value) NOT IN ({", ".join(f"'{w}'" for w in analysis.PLACEHOLDERS)}) THEN canonical_value END AS found FROM identifier_catalog""",
    "f14_claim_guard": rf"""
WITH r AS (SELECT DISTINCT ON (sample_id) * FROM rag_evaluate_data WHERE context IS NOT NULL AND answer IS NOT NULL),
s AS (SELECT sample_id, answer, list_concat([coalesce(question, '')], list_transform(context, lambda x: coalesce(x, ''))) AS fields FROM r),
k AS (SELECT sample_id, answer, {_WORDS.replace("%s", "answer")} AS words, {_NUMBERS.replace("%s", "answer")} AS numbers,
  flatten(list_transform(fields, lambda x: {_WORDS.replace("%s", "x")})) AS own_words, flatten(list_transform(fields, lambda x: {_NUMBERS.replace("%s", "x")})) AS own_numbers FROM s),
v AS (SELECT CASE WHEN regexp_matches(answer, '\[E[0-9]+\]|^\s*\d+[.)、]') THEN 'claim_contains_renderer_markup'
  WHEN len(list_filter(words, lambda w: NOT list_contains(own_words, w))) > 0 THEN 'ungrounded_identifier_token'
  WHEN len(list_filter(numbers, lambda w: NOT list_contains(own_numbers, w))) > 0 THEN 'ungrounded_numeric_literal' ELSE 'ok' END AS verdict FROM k)
SELECT verdict, count(*) AS n FROM v GROUP BY 1""",
    "u6_duplicate_ids": "SELECT id, count(*) AS n FROM chunks GROUP BY id HAVING count(*) > 1",
    "i1_decisions": _MANIFEST
    + """, have AS (SELECT document_id, list_sort(list_distinct(list(lower(child_id)))) AS have FROM chunks WHERE document_id IS NOT NULL AND child_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN old.document_id IS NULL THEN 'INGEST' WHEN new.version <> old.version THEN 'UPDATE' WHEN new.ds <> old.ds OR new.ms <> old.ms THEN 'CONFLICT'
 WHEN new.sig <> old.sig THEN 'REINDEX' WHEN old.kids = coalesce(have, []) THEN 'SKIP_UNCHANGED' ELSE 'RECONCILE' END AS decision, count(*) AS n_documents
FROM new LEFT JOIN old USING (document_id) LEFT JOIN have USING (document_id) GROUP BY 1""",
    "k1_upsert_delete": _MANIFEST
    + """, merged AS (SELECT * FROM new WHERE ds < 'a' UNION ALL SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new WHERE ds < 'a'))
SELECT document_id, version, CAST(len(kids) AS INT) AS n_children FROM merged WHERE document_id NOT IN (SELECT document_id FROM new WHERE ds LIKE 'f%')""",
    "x9_token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('question')}) AS token FROM (SELECT DISTINCT entry_id, question FROM fast_path)) GROUP BY 1",
    "x14_intents": f"SELECT {_INTENT} AS intent, CASE WHEN {_NTH} = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS n FROM conversations WHERE question IS NOT NULL GROUP BY 1, 2",
    "a16_intent_confusion": f"SELECT knowledge_type AS true_label, {_INTENT} AS predicted_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY knowledge_type), 6) AS share FROM fast_path GROUP BY 1, 2",
    "w2_history": _LAST + "SELECT session_id, id, turn FROM t",
    "h1_history_context": _LAST + "SELECT session_id, md5(string_agg('Q:' || coalesce(question, '') || chr(10) || 'A:' || coalesce(answer, ''), chr(10) ORDER BY turn)) AS digest FROM t GROUP BY 1",
    "h2_answer_slices": "SELECT doc_id, CAST(seq AS INT) AS seq, md5(substring(text, CAST(seq * 256 + 1 AS BIGINT), 256)) AS digest FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 256) AS BIGINT))) AS seq FROM documents WHERE length(text) > 0)",
    "c2_separator_pieces": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ') <> '')) AS INT) AS n_pieces FROM documents WHERE text IS NOT NULL",
    "a9_latency": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "s1_sources": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1",
}
