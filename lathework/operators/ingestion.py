"""Versioned ingestion as relations: identities, row rules, deltas, decisions and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions import text

# Most UTF-8 bytes of the stored columns.
MOST_BYTES = {
    "schema_version": 64, "text": 65535, "parent_content": 65535, "document_id": 256, "document_version": 64, "title": 1024, "knowledge_type": 32, "equipment_type": 128,
    "equipment_model": 256, "manufacturer": 256, "alarm_code": 128, "fault_type": 256, "fault_symptom": 8192, "maintenance_type": 256, "maintenance_cycle_unit": 16,
    "maintenance_cycle_trigger": 256, "part_number": 256, "effective_date": 10, "language": 32, "source_file": 4096, "metadata_source": 32, "source": 256, "timestamp": 64,
}
# Allowed types and units, columns that hold hashes, and columns that must not be empty.
KNOWLEDGE_TYPES = ["manual", "alarm", "fault", "maintenance", "parameter", "parts", "case"]
CYCLE_UNITS = ["hour", "day", "week", "month", "year", "cycle"]
HASHES = ["id", "child_id", "parent_id", "document_sha256", "parent_content_sha256", "child_content_sha256"]
REQUIRED = [*HASHES, "schema_version", "text", "parent_content", "document_id", "document_version", "title", "knowledge_type", "language", "source_file", "metadata_source"]


def occurrence(partition: list[str], order: list[str]) -> Column:
    """The running number, from 0, of equal content within its document or parent."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1


def content_groups(df: DataFrame, key: str, content: str) -> DataFrame:
    """Texts equal in their normal form: ``content_sha, n, first_id``."""
    return df.where(F.col(content).isNotNull()).select(F.col(key).alias("k"), text.content_sha(F.col(content)).alias("content_sha")).groupBy("content_sha").agg(F.count("*").alias("n"), F.min("k").alias("first_id"))


def stable_ids(pieces: DataFrame) -> DataFrame:
    """Adds ``occurrence`` and ``piece_id`` to pieces (document_id, pos, content): identity of document, content and which of its equals it is."""
    hashed = pieces.withColumn("content_sha", text.content_sha(F.col("content")))
    placed = hashed.withColumn("occurrence", occurrence(["document_id", "content_sha"], ["pos"]))
    return placed.withColumn("piece_id", text.identity("parent", F.col("document_id"), F.col("content_sha"), occurrence=F.col("occurrence")))


def cleaned(c: Column) -> Column:
    """Trimmed, and null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def rule_names(columns: list[str]) -> list[str]:
    """Names of all rules for rows with these columns."""
    return [name for name, _ in _rules(set(columns))]


def row_errors(chunks: DataFrame) -> DataFrame:
    """Adds ``errors``: the names of all rules a stored row breaks, sorted; an empty array for a valid row."""
    named = F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in _rules(set(chunks.columns))))
    return chunks.withColumn("errors", F.array_sort(F.array_compact(named)))


def _rules(have: set[str]) -> list[tuple[str, Column]]:
    """(name, condition that breaks it) of all rules for rows that ``have`` these columns."""
    checks = [(f"required:{c}", F.coalesce(cleaned(F.col(c)), F.lit("")) == "") for c in REQUIRED if c in have]
    checks += [(f"hash:{c}", ~F.col(c).rlike(r"^[0-9a-f]{64}\z")) for c in HASHES if c in have]
    checks += [(f"bytes:{c}", F.octet_length(c) > n) for c, n in MOST_BYTES.items() if c in have]
    checks += [
        ("id_is_child_id", ~F.col("id").eqNullSafe(F.col("child_id"))),
        ("knowledge_type", ~F.col("knowledge_type").isin(KNOWLEDGE_TYPES)),
        ("alarm_needs_code", (F.col("knowledge_type") == "alarm") & cleaned(F.col("alarm_code")).isNull()),
        ("fault_needs_detail", (F.col("knowledge_type") == "fault") & F.coalesce(cleaned(F.col("fault_type")), cleaned(F.col("fault_symptom"))).isNull()),
        ("parts_needs_number", (F.col("knowledge_type") == "parts") & cleaned(F.col("part_number")).isNull()),
        ("cycle_value", F.col("maintenance_cycle_value").isNotNull() & (~text.finite(F.col("maintenance_cycle_value")) | (F.col("maintenance_cycle_value") <= 0))),
        ("cycle_unit", F.col("maintenance_cycle_unit").isNotNull() & ~F.col("maintenance_cycle_unit").isin(CYCLE_UNITS)),
        ("cycle_pair", F.col("maintenance_cycle_value").isNotNull() != F.col("maintenance_cycle_unit").isNotNull()),
        ("effective_date", F.col("effective_date").isNotNull() & (~F.col("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}\z") | F.expr("try_to_date(effective_date)").isNull())),
        ("dense_vector", F.col("dense_vector").isNull() | ~F.forall("dense_vector", lambda x: text.finite(x.cast("double")))),
        ("sparse_vector", F.coalesce(F.cardinality("sparse_vector"), F.lit(0)) <= 0),
        ("sparse_keys", F.exists(F.map_keys("sparse_vector"), lambda d: (d < 0) | (d > 4294967295))),
    ]
    return checks


def id_delta(desired: DataFrame, actual: DataFrame, document: str, child: str) -> DataFrame:
    """Ids to add, keep and remove per document: ``<document>, added, retained, removed`` as counts."""
    d = desired.select(document, child).distinct().withColumn("_wanted", F.lit(1))
    a = actual.select(document, child).distinct().withColumn("_stored", F.lit(1))
    both = d.join(a, [document, child], "full_outer")
    return both.groupBy(document).agg(
        F.count_if(F.col("_stored").isNull()).alias("added"), F.count_if(F.col("_stored").isNotNull() & F.col("_wanted").isNotNull()).alias("retained"), F.count_if(F.col("_wanted").isNull()).alias("removed")
    )


def decide(sources: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """What ingestion does with each source: ``document_id, decision``.

    ``sources`` and ``manifest``: document_id, version, document_sha256, metadata_sha256, signature, child_ids;
    ``stored``: document_id, child_id. INGEST without a record, UPDATE for a new version, CONFLICT where one version's
    bytes or metadata changed, REINDEX for another signature, SKIP_UNCHANGED where the stored ids are the recorded ones, else RECONCILE.
    """
    m = manifest.select("document_id", *(F.col(c).alias(f"m_{c}") for c in ("version", "document_sha256", "metadata_sha256", "signature", "child_ids")))
    have = stored.groupBy("document_id").agg(F.array_sort(F.collect_set("child_id")).alias("have"))
    x = sources.join(m, "document_id", "left").join(have, "document_id", "left")
    same = F.array_sort(F.array_distinct("m_child_ids")) == F.coalesce("have", F.array().cast("array<string>"))
    decision = (
        F.when(F.col("m_version").isNull(), "INGEST").when(F.col("version") != F.col("m_version"), "UPDATE")
        .when((F.col("document_sha256") != F.col("m_document_sha256")) | (F.col("metadata_sha256") != F.col("m_metadata_sha256")), "CONFLICT")
        .when(F.col("signature") != F.col("m_signature"), "REINDEX").when(same, "SKIP_UNCHANGED").otherwise("RECONCILE")
    )
    return x.select("document_id", decision.alias("decision"))


def fingerprint(rows: DataFrame, columns: list[str], *, by: str | None = None) -> DataFrame:
    """One hash over all rows, whatever their order: hashes of rows are gathered per bucket of their first two digits, and the buckets' hashes give the result, so no task holds all rows.

    A value counts with its length in bytes in front, a null as ~, so no two rows read alike.
    """
    told = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    keys = [by] if by else []
    h = rows.select(*keys, F.sha2(F.concat_ws("|", *map(told, columns)), 256).alias("h")).withColumn("b", F.substring("h", 1, 2))
    parts = h.groupBy(*keys, "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "p"))), lambda x: x["p"]), ""), 256).alias("fingerprint"), F.sum("n").alias("n_rows"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys in ``ids``."""
    return old.join(ids.select(key).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
