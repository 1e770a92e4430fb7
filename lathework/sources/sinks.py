"""Plain sinks and the snapshots read back from them, all by Spark's own writers and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.functions.text import finite
from lathework.operators.ingestion import duplicate_keys
from lathework.operators.manifest import canonical_json, schema_errors


def append(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Appends rows to a table; with ``schema`` only rows of exactly these columns and types, checked before anything is written."""
    if schema is not None and (errors := [e for e in schema_errors(df, schema) if not e.startswith("nullable")]):
        raise ValueError("columns differ: " + ", ".join(errors))
    df.write.mode("append").parquet(path)


def not_finite(df: DataFrame) -> DataFrame:
    """Rows in which a number, at the top or in an array of numbers, is NaN or infinite."""
    bad = F.lit(False)
    for f in df.schema:
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            bad = bad | (F.col(f.name).isNotNull() & ~finite(F.col(f.name).cast("double")))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType | T.DoubleType):
            bad = bad | F.exists(f.name, lambda x: ~finite(x.cast("double")))
    return df.where(bad)


def report(df: DataFrame, path: str) -> None:
    """Writes a report as JSON lines, nulls included; a number that is not finite is an error before anything is written."""
    if not not_finite(df).isEmpty():
        raise ValueError("not finite")
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def canonical_lines(df: DataFrame, path: str) -> None:
    """Writes a data set as JSON lines with sorted keys, ordered by their text."""
    df.select(canonical_json(df.columns).alias("value")).orderBy("value").write.mode("errorifexists").text(path)


def csv(df: DataFrame, path: str) -> None:
    """Writes results as CSV with headings; quotes, commas and line breaks survive."""
    df.write.mode("errorifexists").option("header", "true").option("escape", '"').option("quoteAll", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def snapshot(df: DataFrame, path: str, *, key: str, version: str) -> None:
    """Writes a corpus snapshot: JSON lines with ``schema_version`` in every row, ordered by ``key``; repeated keys are an error before anything is written."""
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError("repeated keys")
    df.withColumn("schema_version", F.lit(version)).orderBy(key).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str, *, version: str) -> DataFrame:
    """A snapshot of :func:`snapshot`; another version, or a row that does not fit the schema, is an error when it is read."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = spark.read.schema(T.StructType([*wanted, T.StructField("schema_version", T.StringType())])).option("mode", "FAILFAST").json(path)
    ok = F.col("schema_version").eqNullSafe(F.lit(version))
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("another schema version")).cast("boolean"))).drop("schema_version")


def training_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of query and label; rows without either are left out."""
    return spark.read.schema("query string, label string").json(path).where("query is not null and label is not null")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples of one JSON array or object per file: question, context, answer, ground_truth."""
    return spark.read.schema("question string, context array<string>, answer string, ground_truth string").option("multiLine", "true").json(path)


def write_files(df: DataFrame, path: str) -> None:
    """One file below ``path`` for each row: ``name`` (with its folders) and ``value``. Tasks write them in place, and a repeated task writes the same files again; Spark's own writer moves each file and starts a process for its permissions on local disks."""

    def write(batches):
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(path)
        folders = set()
        for b in batches:
            for name, value in zip(b["name"], b["value"]):
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in folders:
                    at.create_dir(folder, recursive=True)
                    folders.add(folder)
                with at.open_output_stream(f"{root}/{name}") as f:
                    f.write(value.encode())
            yield b.iloc[:0][["name"]]

    df.select("name", "value").mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
