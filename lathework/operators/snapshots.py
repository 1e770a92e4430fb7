"""Change events between consecutive full snapshots of a table.

Every snapshot lists all records, so a record's history is a run-length problem:
rows of one key with the same content hash in consecutive snapshots form an
island, i.e. a validity interval. Interval starts, ends and adjacencies are the
change events. The work is one aggregation by (key, snapshot) and one window by
key; a key has at most one row per snapshot after the aggregation, so no window
partition can grow with repeated deliveries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of any script, for trimming.
EDGE_SPACE = r"(?U)^[\s\uFEFF\u200B]+|[\s\uFEFF\u200B]+$"


def stripped(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def id_set(c: Column) -> Column:
    """An array of hexadecimal ids as a sorted set in lower case; null and blank ids vanish, null is an empty set."""
    ids = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(stripped(x)))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != ""))))


def snapshot_order(df: DataFrame, snapshot: str) -> DataFrame:
    """``snapshot, snap_ord, prev_snap, next_snap`` for every snapshot number present.

    One row per delivery of the whole table, hence tiny beside the table itself.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(snapshot)
    return (
        df.where(F.col(snapshot).isNotNull())
        .select(snapshot)
        .distinct()
        .select(snapshot, F.row_number().over(w).alias("snap_ord"), F.lag(snapshot).over(w).alias("prev_snap"), F.lead(snapshot).over(w).alias("next_snap"))
    )


def validity_intervals(
    df: DataFrame,
    *,
    snapshot: str = "snapshot_no",
    delivered: str = "delivered_at",
    key: Column,
    content: Sequence[Column],
    payload: Column,
) -> DataFrame:
    """Validity intervals of every key: ``key, first_snap, last_snap, prev_snap, next_snap, content_hash, payload`` and the neighbours' payloads.

    * ``key`` identifies a record; rows whose key is null or '' and rows without a snapshot number are ignored.
    * ``content`` are the columns whose values make up the record. Null differs from ''.
    * ``payload`` (an array<string>, sorted set) travels with the interval.
    * Of several rows of a key in a snapshot the one delivered last is valid; a
      null delivery time counts as earliest, ties go to the larger content hash, so any order of rows gives the same result.

    ``before``/``after`` are the payloads of the directly adjacent intervals, null
    where the key is absent in the neighbouring snapshot. An empty table gives no rows.
    """
    fields = [c.alias(f"c{i}") for i, c in enumerate(content)]
    rows = df.select(
        F.col(snapshot).alias("snap"),
        key.alias("key"),
        F.col(delivered).alias("delivered"),
        F.sha2(F.to_json(F.struct(*fields, payload.alias("payload")), {"ignoreNullFields": "false"}), 256).alias("content_hash"),
        payload.alias("payload"),
    ).where("snap is not null and key is not null and key <> ''")
    valid = rows.groupBy("key", "snap").agg(
        F.max_by(F.struct("content_hash", "payload"), F.struct(F.col("delivered").isNotNull(), "delivered", "content_hash")).alias("r")
    )
    order = snapshot_order(rows, "snap")
    by_key = Window.partitionBy("key").orderBy("snap_ord")
    marked = (
        valid.select("key", "snap", "r.content_hash", "r.payload")
        .join(order, "snap")
        .withColumn(
            "starts",
            F.when((F.lag("content_hash").over(by_key) == F.col("content_hash")) & (F.lag("snap_ord").over(by_key) == F.col("snap_ord") - 1), 0).otherwise(1),
        )
        .withColumn("island", F.sum("starts").over(by_key))
    )
    intervals = marked.groupBy("key", "island").agg(
        F.min("snap_ord").alias("first_ord"),
        F.max("snap_ord").alias("last_ord"),
        F.min_by("snap", "snap_ord").alias("first_snap"),
        F.max_by("snap", "snap_ord").alias("last_snap"),
        F.min_by("prev_snap", "snap_ord").alias("prev_snap"),
        F.max_by("next_snap", "snap_ord").alias("next_snap"),
        F.first("content_hash").alias("content_hash"),
        F.first("payload").alias("payload"),
    )
    by_start = Window.partitionBy("key").orderBy("first_ord")
    return intervals.withColumn(
        "before", F.when(F.lag("last_ord").over(by_start) == F.col("first_ord") - 1, F.lag("payload").over(by_start))
    ).withColumn("after", F.when(F.lead("first_ord").over(by_start) == F.col("last_ord") + 1, F.lead("payload").over(by_start)))


def change_events(intervals: DataFrame) -> DataFrame:
    """Events at the interval bounds: ``prev_snap, snap, key, kind, added, removed``.

    ``kind`` is *added*, *removed* or *changed*; ``added``/``removed`` are the
    payload members gained and lost. The first snapshot gives no events.
    """
    none = F.array().cast("array<string>")
    at_start = F.when(
        F.col("prev_snap").isNotNull(),
        F.struct(
            F.col("prev_snap"),
            F.col("first_snap").alias("snap"),
            F.when(F.col("before").isNull(), "added").otherwise("changed").alias("kind"),
            F.array_except("payload", F.coalesce("before", none)).alias("added"),
            F.array_except(F.coalesce("before", none), "payload").alias("removed"),
        ),
    )
    at_end = F.when(
        F.col("next_snap").isNotNull() & F.col("after").isNull(),
        F.struct(
            F.col("last_snap").alias("prev_snap"),
            F.col("next_snap").alias("snap"),
            F.lit("removed").alias("kind"),
            none.alias("added"),
            F.col("payload").alias("removed"),
        ),
    )
    return (
        intervals.select("key", F.explode(F.filter(F.array(at_start, at_end), lambda e: e.isNotNull())).alias("e"))
        .select("e.prev_snap", "e.snap", "key", "e.kind", "e.added", "e.removed")
    )


def manifest_intervals(active_documents: DataFrame) -> DataFrame:
    """Validity intervals of the manifest table ``active_documents``.

    White space around values and letter case of hashes mean nothing; columns
    that move by themselves (revision, update times, counts) are no content.
    """
    hexes = ["document_sha256", "metadata_sha256", "processing_signature"]
    plain = ["active_document_version", "source_file", "metadata_source"]
    return validity_intervals(
        active_documents,
        key=stripped(F.col("document_id")),
        content=[*(F.lower(stripped(F.col(c))) for c in hexes), *(stripped(F.col(c)) for c in plain)],
        payload=id_set(F.col("child_ids")),
    )


def manifest_changes(active_documents: DataFrame) -> DataFrame:
    """One row per change: documents with ``child_id`` '', and each child id gained or lost."""
    events = change_events(manifest_intervals(active_documents))
    named = lambda ids, kind: F.transform(F.col(ids), lambda c: F.struct(c.alias("child_id"), F.lit(kind).alias("change_kind")))
    own = F.array(F.struct(F.lit("").alias("child_id"), F.col("kind").alias("change_kind")))
    return (
        events.select("prev_snap", "snap", "key", F.explode(F.concat(own, named("added", "child_added"), named("removed", "child_removed"))).alias("c"))
        .select(
            F.col("prev_snap").cast("int").alias("prev_snapshot_no"),
            F.col("snap").cast("int").alias("snapshot_no"),
            F.col("key").alias("document_id"),
            "c.child_id",
            "c.change_kind",
        )
    )


def manifest_results(active_documents: DataFrame) -> DataFrame:
    """What an ingestion run should have reported for each snapshot and document that changed: status and the child ids added, retained and removed, counted."""
    iv = manifest_intervals(active_documents)
    ev = change_events(iv)
    size = iv.select(F.col("key"), F.col("first_snap").alias("snap"), F.size("payload").alias("n_children"))
    return ev.join(size, ["key", "snap"], "left").select(
        F.col("snap").cast("int").alias("snapshot_no"),
        F.col("key").alias("document_id"),
        F.col("kind").alias("status"),
        F.size("added").alias("n_added"),
        F.when(F.col("kind") == "removed", 0).otherwise(F.col("n_children") - F.size("added")).alias("n_retained"),
        F.size("removed").alias("n_removed"),
    )
