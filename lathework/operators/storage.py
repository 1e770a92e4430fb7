"""Rows of the vector store: building and checking them, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.functions.text import finite
from lathework.operators.ingestion import duplicate_keys, upsert

#: Largest key of a sparse vector.
MOST_KEY = 4294967295


def flat_cycle(df: DataFrame, cycle: str = "maintenance_cycle") -> DataFrame:
    """The struct ``cycle`` as ``maintenance_cycle_value``, ``_unit`` and ``_trigger``; a null struct gives three nulls."""
    return df.withColumns({f"maintenance_cycle_{p}": F.col(f"{cycle}.{p}") for p in ("value", "unit", "trigger")}).drop(cycle)


def sparse_map(keys: Column, values: Column) -> Column:
    """A map from the arrays of a row of a sparse matrix; null where their lengths differ, a key comes twice or is no unsigned 32-bit number."""
    ok = (F.size(keys) == F.size(values)) & (F.size(F.array_distinct(keys)) == F.size(keys)) & F.forall(keys, lambda k: (k >= 0) & (k <= MOST_KEY))
    return F.when(ok, F.map_from_arrays(F.transform(keys, lambda k: k.cast("long")), F.transform(values, lambda v: v.cast("float"))))


def csr_rows(matrix: DataFrame, *, row: str, indices: str, values: str) -> DataFrame:
    """``<row>, sparse`` of all rows of a sparse matrix."""
    return matrix.select(row, sparse_map(F.col(indices), F.col(values)).alias("sparse"))


def vector_errors(dense: Column, sparse: Column, dim: int) -> Column:
    """'' or what keeps a row's vectors from being stored."""
    bad_number = lambda x: ~finite(x.cast("double"))
    error = (
        F.when(dense.isNull() | (F.size(dense) != dim), "dimension").when(F.exists(dense, bad_number), "dense_not_finite").when(sparse.isNull() | (F.cardinality(sparse) <= 0), "sparse_empty")
        .when(F.exists(F.map_keys(sparse), lambda k: (k < 0) | (k > MOST_KEY)), "sparse_key").when(F.exists(F.map_values(sparse), bad_number), "sparse_not_finite")
    )
    return F.coalesce(error, F.lit(""))


def vector_rows(documents: DataFrame, vectors: DataFrame, *, key: str, dim: int) -> DataFrame:
    """Storage rows: documents with their vectors (``key``, dense_vector, sparse_vector) and ``vector_error``; documents without vectors have the error 'dimension'."""
    x = documents.join(vectors.select(key, "dense_vector", "sparse_vector"), key, "left")
    return x.withColumn("vector_error", vector_errors(F.col("dense_vector"), F.col("sparse_vector"), dim))


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with ``new`` appended; unlike an upsert it may leave a key twice."""
    return old.unionByName(new)


def checked_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An upsert that takes no batch with a repeated key."""
    if not duplicate_keys(new, key).isEmpty():
        raise ValueError("repeated keys in one batch")
    return upsert(old, new, key)


def children_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``document_id, child_id``: all stored children of the documents, each once."""
    return chunks.where("document_id is not null and child_id is not null").select("document_id", "child_id").join(documents.select("document_id").distinct(), "document_id", "left_semi").distinct()


def by_ids(chunks: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``ids``, whatever their number."""
    return chunks.join(ids.select(key).distinct(), key, "left_semi")


def typed_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, row_id, score, rank) with the fields of their rows and ``hit_error``: the row is missing, its id is not its child id, or the score is no finite number."""
    c = chunks.dropDuplicates(["id"]).select(F.col("id").alias("row_id"), "child_id", "parent_id", "document_id", "knowledge_type")
    x = hits.join(c, "row_id", "left")
    error = F.when(F.col("child_id").isNull(), "missing").when(F.col("child_id") != F.col("row_id"), "identity").when(~finite(F.col("score")), "score").otherwise("")
    return x.withColumn("hit_error", error)


def like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose ``column`` matches an SQL pattern, in which _ stands for any character and % for any text; nulls never match."""
    return df.where(F.col(column).like(pattern))
