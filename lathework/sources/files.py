"""Reading source files: directories of documents with their metadata, question tables and evaluation sets."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.operators.ingestion import CYCLE_UNITS, KNOWLEDGE_TYPES

EXTENSIONS = ["txt", "md", "pdf", "docx", "ppt", "pptx", "jpg", "png"]
PLAIN = ["txt", "md"]
#: Column names of the question table's file, and ours.
FAQ_COLUMNS = {"学科名称": "subject_name", "问题": "question", "答案": "answer"}
METADATA = ["document_id", "document_version", "title", "knowledge_type", "equipment_type", "equipment_model", "manufacturer", "alarm_code", "fault_type", "fault_symptom", "maintenance_type", "part_number", "effective_date", "language"]
REQUIRED = ["document_id", "document_version", "title", "knowledge_type"]

Parser = Callable[[bytes], str]


def files(spark: SparkSession, path: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """All files below ``path`` of the allowed kinds: ``path, ext, source, document_sha256, content``; ``source`` is the folder's name without a trailing _data."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    folder = F.regexp_replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "_data$", "")
    return raw.select("path", ext.alias("ext"), folder.alias("source"), F.sha2("content", 256).alias("document_sha256"), "content").where(F.col("ext").isin(extensions))


def strict_json(text: str):
    """JSON without repeated keys or numbers that are not finite."""

    def unique(pairs):
        d = dict(pairs)
        if len(d) < len(pairs):
            raise ValueError("repeated key")
        return d

    def reject(x):
        raise ValueError(f"not finite: {x}")

    return json.loads(text, object_pairs_hook=unique, parse_constant=reject)


def strict_yaml(text: str) -> dict:
    """A YAML mapping of plain values without repeated keys."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        if len(set(keys)) < len(keys):
            raise ValueError("repeated key")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    value = yaml.load(text, Loader)
    if not isinstance(value, dict):
        raise ValueError("no mapping")
    return value


def split_front_matter(text: str) -> tuple[str | None, str]:
    """(front matter, body): the block between --- lines at the start, if there is one; a block that is never closed is an error."""
    t = text.removeprefix("\ufeff")
    lines = t.split("\n")
    if lines[0].strip() != "---":
        return None, t
    end = next((i for i, s in enumerate(lines[1:], 1) if s.strip() == "---"), None)
    if end is None:
        raise ValueError("front matter is not closed")
    return "\n".join(lines[1:end]), "\n".join(lines[end + 1 :])


def checked_metadata(value: dict) -> tuple[dict, str]:
    """(values as text, name of the first broken rule or '')."""
    unknown = set(value) - set(METADATA) - {"maintenance_cycle"}
    if unknown:
        return {}, "unknown_field:" + ",".join(sorted(map(str, unknown)))
    out = {k: str(v).strip() or None for k, v in value.items() if v is not None and k != "maintenance_cycle"}
    missing = [k for k in REQUIRED if not out.get(k)]
    if missing:
        return {}, "required:" + ",".join(missing)
    need = {"alarm": ["alarm_code"], "fault": ["fault_type", "fault_symptom"], "parts": ["part_number"], "maintenance": ["maintenance_type"]}.get(out["knowledge_type"], [])
    if need and not any(out.get(k) for k in need) and not (out["knowledge_type"] == "maintenance" and value.get("maintenance_cycle")):
        return {}, "conditional:" + out["knowledge_type"]
    if out["knowledge_type"] not in KNOWLEDGE_TYPES:
        return {}, "knowledge_type"
    day = out.get("effective_date")
    if day and (not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) or not _is_date(day)):
        return {}, "effective_date"
    cycle = value.get("maintenance_cycle")
    if cycle is not None and not (isinstance(cycle, dict) and isinstance(cycle.get("value"), int | float) and not isinstance(cycle["value"], bool) and 0 < cycle["value"] < float("inf") and cycle.get("unit") in CYCLE_UNITS):
        return {}, "maintenance_cycle"
    return {"language": "zh-CN"} | out, ""


def _is_date(day: str) -> bool:
    try:
        date.fromisoformat(day)
    except ValueError:
        return False
    return True


DOCUMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("path", "ext", "source", "document_sha256", "text", "metadata_source", "error")] + [T.StructField(c, T.StringType()) for c in METADATA]
)


def documents(spark: SparkSession, path: str, *, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Documents below ``path`` with their metadata, one row per file: :data:`DOCUMENT`.

    Metadata stand in front matter or in ``<file>.yaml`` beside the file, never in both. Texts and Markdown are
    read as UTF-8; other kinds need a parser (bytes to text). ``error`` names what is wrong with a file, whose text is then null.
    """
    parsers = parsers or {}
    everything = files(spark, path, [*EXTENSIONS, "yaml"])
    side = everything.where("ext = 'yaml'").select(F.regexp_replace("path", r"\.yaml$", "").alias("path"), F.col("content").alias("sidecar"))
    own = everything.where("ext <> 'yaml'").join(side, "path", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                row = {"path": r.path, "ext": r.ext, "source": r.source, "document_sha256": r.document_sha256, "error": ""}
                try:
                    if r.ext in PLAIN:
                        front, body = split_front_matter(bytes(r.content).decode("utf-8"))
                    elif r.ext in parsers:
                        front, body = None, parsers[r.ext](bytes(r.content))
                    else:
                        raise ValueError("no parser for " + r.ext)
                    if front is not None and r.sidecar is not None:
                        raise ValueError("metadata in two places")
                    if front is None and r.sidecar is None:
                        raise ValueError("no metadata")
                    values, error = checked_metadata(strict_yaml(front if front is not None else bytes(r.sidecar).decode("utf-8-sig")))
                    row |= {"text": None if error else body, "metadata_source": "front_matter" if front is not None else "sidecar", "error": error, **values}
                except Exception as e:
                    row["error"] = str(e).split("\n")[0][:200]
                rows.append(row)
            yield pd.DataFrame(rows, columns=DOCUMENT.fieldNames(), dtype=object)

    return own.mapInPandas(read, DOCUMENT)


def question_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of subject, question and answer under its own headings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FAQ_COLUMNS])
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', enforceSchema=False)
    return raw.select(*(F.col(a).alias(b) for a, b in FAQ_COLUMNS.items()))


@F.pandas_udf(T.StringType())
def _json_error(lines: pd.Series) -> pd.Series:
    def error(s):
        try:
            strict_json(s)
        except Exception as e:
            return str(e)[:200]
        return ""

    return lines.map(error)


def json_error(c: Column) -> Column:
    """'' for strict JSON, else what is wrong: repeated keys and NaN count, which the built-in parser lets pass."""
    return _json_error(c)


def json_lines(spark: SparkSession, path: str, schema: str, *, header: bool = False, most_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """Rows of JSON-lines files by ``schema`` with ``error``; ``header`` leaves out the first line of every file, which describes the set.

    A file larger than ``most_bytes`` gives one row with the error 'too_large', so whole files can be read at once and their lines numbered.
    """
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_size").alias("size"))
    large = F.col("size") > most_bytes
    lines = whole.where(~large).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))
    if header:
        lines = lines.where("n > 0")
    checked = lines.where("trim(value) <> ''").withColumn("error", json_error(F.col("value"))).select("value", "error")
    checked = checked.unionByName(whole.where(large).select(F.lit(None).cast("string").alias("value"), F.lit("too_large").alias("error")))
    return checked.select("error", F.when(F.col("error") == "", F.from_json("value", schema)).alias("r")).select("r.*", "error")
