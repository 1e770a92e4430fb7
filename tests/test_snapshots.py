import datetime as dt

import pytest
from pyspark.sql import functions as F

from lathework.operators import snapshots as op

SCHEMA = (
    "snapshot_no int, delivered_at timestamp, document_id string, active_document_version string, document_sha256 string, metadata_sha256 string,"
    " processing_signature string, source_file string, metadata_source string, child_ids array<string>, snap int, key string, payload string"
)


def row(snap, doc, kids, *, version="1", sha="ab", hour=0, src="f", delivered=True):
    at = dt.datetime(2025, 1, 1 + (snap or 0), hour) if delivered else None
    return (snap, at, doc, version, sha, "m", "p", src, "sidecar", kids, 9, "clash", "clash")


def found(spark, rows):
    out = op.manifest_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_events_across_a_gap_in_the_numbers(spark):
    got = found(spark, [row(1, "A", ["x", "y"]), row(1, "B", ["z"]), row(3, "A", ["x", "w"]), row(3, "C", ["q"]), row(4, "A", ["x", "w"]), row(4, "B", ["z"])])
    assert got == {
        (1, 3, "A", "", "changed"), (1, 3, "A", "w", "child_added"), (1, 3, "A", "y", "child_removed"),
        (1, 3, "B", "", "removed"), (1, 3, "B", "z", "child_removed"),
        (1, 3, "C", "", "added"), (1, 3, "C", "q", "child_added"),
        (3, 4, "B", "", "added"), (3, 4, "B", "z", "child_added"),
        (3, 4, "C", "", "removed"), (3, 4, "C", "q", "child_removed"),
    }


def test_spelling_is_no_change_and_the_last_delivery_counts(spark):
    rows = [
        row(1, "A", ["X", "y", None, " "]), row(2, " A　", ["y ", "x", "x"], sha="AB "),
        row(3, "A", ["wrong"], hour=1), row(3, "A", ["x", "y"], hour=2), row(3, "A", ["late"], delivered=False), row(3, "A", ["x", "y"], hour=2),
    ]
    assert found(spark, rows) == set()


def test_nulls_in_keys_and_content(spark):
    rows = [row(1, None, ["a"]), row(1, " ", ["a"]), row(None, "A", ["a"]), row(1, "A", None), row(2, "A", []), row(3, "A", [], src=None)]
    assert found(spark, rows) == {(2, 3, "A", "", "changed")}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_ties_do_not_depend_on_row_order(spark):
    rows = [row(1, "A", ["a"]), row(2, "A", ["b"]), row(2, "A", ["c"])]
    assert found(spark, rows) == found(spark, rows[::-1])


@pytest.mark.parametrize("n", [3, 9])
def test_intervals_partition_each_history(spark, n):
    rows = [row(s, "A", [str(s // 3)]) for s in range(1, n + 1)] + [row(s, "B", ["b"]) for s in range(1, n + 1, 2)]
    iv = op.manifest_intervals(spark.createDataFrame(rows, SCHEMA)).select("key", (F.col("last_ord") - F.col("first_ord") + 1).alias("n")).collect()
    assert sum(r.n for r in iv if r.key == "A") == n
    assert [r.n for r in iv if r.key == "B"] == [1] * ((n + 1) // 2)
