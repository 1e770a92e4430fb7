"""The manifest of active documents as relations: integrity, commits against an expected revision, deletes, revisions and hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the stored tables.
TABLES = {
    "jpkb": "id int not null, subject_name string, question string, answer string",
    "conversations": "id int not null, session_id string not null, question string, answer string, timestamp timestamp not null",
    "active_documents": (
        "document_id string not null, active_document_version string not null, document_sha256 string not null, metadata_sha256 string not null, processing_signature string not null, collection_name string not null,"
        " storage_schema_version string not null, source_file string not null, metadata_source string not null, child_ids array<string> not null, revision bigint not null, updated_at timestamp not null,"
        " manifest_schema_version string not null, child_count int not null"
    ),
}


def table_schema(name: str) -> T.StructType:
    """The schema of a stored table."""
    return T.StructType.fromDDL(TABLES[name])


def schema_errors(df: DataFrame, wanted: T.StructType) -> list[str]:
    """How the columns of ``df`` differ from ``wanted``: missing, of another type, null where that is not allowed, or unknown; [] if they agree."""
    have, want = {f.name: f for f in df.schema}, {f.name: f for f in wanted}
    out = [f"missing:{n}" for n in want if n not in have] + [f"unknown:{n}" for n in have if n not in want]
    for n in want.keys() & have.keys():
        if have[n].dataType.simpleString() != want[n].dataType.simpleString():
            out.append(f"type:{n}")
        elif have[n].nullable and not want[n].nullable:
            out.append(f"nullable:{n}")
    return sorted(out)


def with_integrity(manifest: DataFrame) -> DataFrame:
    """Adds ``integrity``: '' or what is wrong with a record, that is its count of children or its revision."""
    wrong_count = ~F.coalesce(F.col("child_count") == F.size("child_ids"), F.lit(False))
    return manifest.withColumn("integrity", F.when(wrong_count, "child_count").when(F.coalesce(F.col("revision") < 1, F.lit(True)), "revision").otherwise(""))


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The records of ``keys`` (document_id) with their integrity; keys without a record give no row."""
    return with_integrity(manifest.join(keys.select("document_id").distinct(), "document_id", "left_semi"))


def commit(manifest: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the manifest after the commits, ``document_id, outcome, revision`` of each record).

    ``records`` have the manifest's columns but revision, and ``expected_revision``: 0 for a new document. Where the
    current revision is another, the outcome is CONFLICT and the old record stays; two records of one
    document are a CONFLICT both.
    """
    many = records.groupBy("document_id").agg(F.count("*").alias("_n"))
    x = records.join(many, "document_id").join(manifest.select("document_id", F.col("revision").alias("_current")), "document_id", "left")
    x = x.withColumn("_ok", (F.coalesce("_current", F.lit(0)) == F.col("expected_revision")) & (F.col("_n") == 1))
    done = x.where("_ok").withColumn("revision", F.col("expected_revision") + 1).select(manifest.columns)
    outcome = F.when(F.col("_ok"), "COMMITTED").otherwise("CONFLICT")
    revision = F.when(F.col("_ok"), F.col("expected_revision") + 1).otherwise(F.coalesce("_current", F.lit(0)))
    return manifest.join(done.select("document_id"), "document_id", "left_anti").unionByName(done), x.select("document_id", outcome.alias("outcome"), revision.cast("long").alias("revision")).distinct()


def remove(manifest: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the manifest without the requested documents, ``document_id, outcome``); ``requests``: document_id, expected_revision. Another revision is a CONFLICT and removes nothing."""
    r = requests.select("document_id", "expected_revision").distinct().join(manifest.select("document_id", F.col("revision").alias("_current")), "document_id", "left")
    r = r.withColumn("outcome", F.when(F.coalesce("_current", F.lit(0)) == F.col("expected_revision"), "REMOVED").otherwise("CONFLICT"))
    gone = r.where("outcome = 'REMOVED'").select("document_id")
    return manifest.join(gone, "document_id", "left_anti"), r.select("document_id", "outcome")


def delete_documents(requests: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """``document_id, status, removed``: DELETED where the document had stored children or a record, else NOOP, so a repeated delete changes nothing. ``stored``: document_id, child_id."""
    have = stored.groupBy("document_id").agg(F.array_sort(F.collect_set("child_id")).alias("removed"))
    known = manifest.select("document_id").distinct().withColumn("_known", F.lit(True))
    x = requests.select("document_id").distinct().join(have, "document_id", "left").join(known, "document_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<string>"))
    return x.select("document_id", F.when((F.size(removed) > 0) | F.coalesce("_known", F.lit(False)), "DELETED").otherwise("NOOP").alias("status"), removed.alias("removed"))


def without_documents(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """``df`` without the documents in ``deleted`` (document_id)."""
    return df.join(deleted.select("document_id").distinct(), "document_id", "left_anti")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables have the same set of keys."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def canonical_json(columns: list[str]) -> Column:
    """A row's columns as JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_sha(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of a row's columns."""
    return F.sha2(canonical_json(columns), 256)


def signature(contract: dict) -> str:
    """SHA-256 of a processing contract: sizes and overlaps of pieces (0 <= overlap < size) and versions, which must not be blank."""
    for name, size in contract.items():
        if name.endswith("_size"):
            overlap = contract[name.replace("_size", "_overlap")]
            if type(size) is not int or type(overlap) is not int or not 0 <= overlap < size:
                raise ValueError(f"{name}: needs an overlap below it")
        elif name.endswith("_version") and not str(contract[name]).strip():
            raise ValueError(f"{name} is blank")
    return hashlib.sha256(json.dumps(contract, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def knowledge_revision(manifest_fingerprint: DataFrame, collection: str, fast_path_fingerprint: DataFrame) -> DataFrame:
    """``revision``: one hash of the manifest, the collection's name and the fast path's entries; the fingerprints are single rows."""
    m = manifest_fingerprint.select(F.col("fingerprint").alias("m"))
    p = fast_path_fingerprint.select(F.col("fingerprint").alias("p"))
    return m.crossJoin(F.broadcast(p)).select(F.sha2(F.concat_ws("|", "m", F.lit(collection), "p"), 256).alias("revision"))  # one row each
