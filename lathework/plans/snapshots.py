"""Queries on the manifest snapshots (problem 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.operators import snapshots as op
from lathework.session import table


def p3_found(spark, sf_dir):
    return op.manifest_changes(table(spark, sf_dir, "active_documents"))


def p3_intervals(spark, sf_dir):
    iv = op.manifest_intervals(table(spark, sf_dir, "active_documents"))
    return iv.select(
        F.col("key").alias("document_id"),
        F.col("first_snap").alias("first_snapshot_no"),
        F.col("last_snap").alias("last_snapshot_no"),
        F.size("payload").alias("n_children"),
    )


def p3_results(spark, sf_dir):
    return op.manifest_results(table(spark, sf_dir, "active_documents"))


QUERIES = {"p3_found": p3_found, "p3_intervals": p3_intervals, "p3_results": p3_results}

_VALID = """
WITH ranked AS (
  SELECT snapshot_no, trim(document_id) AS document_id,
         trim(active_document_version) AS v, lower(trim(document_sha256)) AS s, lower(trim(metadata_sha256)) AS m,
         lower(trim(processing_signature)) AS p, trim(source_file) AS f, trim(metadata_source) AS ms,
         list_sort(list_distinct(list_transform(child_ids, lambda x: lower(trim(x))))) AS kids,
         row_number() OVER (PARTITION BY snapshot_no, trim(document_id) ORDER BY delivered_at DESC) AS rn
  FROM active_documents),
valid AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1),
snaps AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS nxt,
                 row_number() OVER (ORDER BY snapshot_no) AS ord FROM (SELECT DISTINCT snapshot_no FROM active_documents)),
old AS (SELECT v.*, s.nxt FROM valid v JOIN snaps s USING (snapshot_no) WHERE s.nxt IS NOT NULL),
new AS (SELECT v.*, s.prev FROM valid v JOIN snaps s USING (snapshot_no) WHERE s.prev IS NOT NULL),
pairs AS (
  SELECT coalesce(new.prev, old.snapshot_no) AS prev_snapshot_no, coalesce(new.snapshot_no, old.nxt) AS snapshot_no,
         coalesce(new.document_id, old.document_id) AS document_id,
         CASE WHEN old.document_id IS NULL THEN 'added' WHEN new.document_id IS NULL THEN 'removed' ELSE 'changed' END AS kind,
         coalesce(old.kids, []) AS old_kids, coalesce(new.kids, []) AS new_kids
  FROM new FULL OUTER JOIN old ON new.document_id = old.document_id AND new.snapshot_no = old.nxt
  WHERE old.document_id IS NULL OR new.document_id IS NULL
     OR (old.v, old.s, old.m, old.p, old.f, old.ms, old.kids) IS DISTINCT FROM (new.v, new.s, new.m, new.p, new.f, new.ms, new.kids))
"""

SQL = {
    "p3_found": _VALID
    + """
SELECT prev_snapshot_no, snapshot_no, document_id, '' AS child_id, kind AS change_kind FROM pairs
UNION ALL
SELECT prev_snapshot_no, snapshot_no, document_id, unnest(list_filter(new_kids, lambda x: NOT list_contains(old_kids, x))), 'child_added' FROM pairs
UNION ALL
SELECT prev_snapshot_no, snapshot_no, document_id, unnest(list_filter(old_kids, lambda x: NOT list_contains(new_kids, x))), 'child_removed' FROM pairs
""",
    "p3_results": _VALID
    + """
SELECT snapshot_no, document_id, kind AS status,
       CAST(len(list_filter(new_kids, lambda x: NOT list_contains(old_kids, x))) AS INT) AS n_added,
       CAST(len(list_filter(new_kids, lambda x: list_contains(old_kids, x))) AS INT) AS n_retained,
       CAST(len(list_filter(old_kids, lambda x: NOT list_contains(new_kids, x))) AS INT) AS n_removed
FROM pairs
""",
    "p3_intervals": _VALID
    + """
, placed AS (SELECT valid.*, snaps.ord FROM valid JOIN snaps USING (snapshot_no)),
marked AS (
  SELECT *, CASE WHEN lag(ord) OVER w = ord - 1
    AND lag((v, s, m, p, f, ms, kids)) OVER w IS NOT DISTINCT FROM (v, s, m, p, f, ms, kids) THEN 0 ELSE 1 END AS starts
  FROM placed WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY ord) AS island FROM marked)
SELECT document_id, min(snapshot_no) AS first_snapshot_no, max(snapshot_no) AS last_snapshot_no, CAST(any_value(len(kids)) AS INT) AS n_children
FROM islands GROUP BY document_id, island
""",
}
