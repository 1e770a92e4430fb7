"""Two-level chunking of documents into parents and children with stable ids."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.functions import text as tx
from lathework.operators.ingestion import occurrence

# Where to cut, coarsest first.
SEPARATORS = [r"\n\n", r"\n", r"。|！|？", r"\.\s|\!\s|\?\s", r"；|;\s", r"，|,\s"]
HEADINGS = [r"\n(?=#{1,6}\s)", r"\n(?=```)", r"\n(?=\s*(?:\*\*\*+|---+|___+)\s*\n)", r"\n\n", r"\n", r"\s"]


def cut(t: str, size: int, overlap: int = 0, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of ``t`` of up to ``size`` characters: cut at the coarsest separator present, which stays with the piece before it; longer pieces are cut again by finer ones.

    Pieces are joined up to the size, with up to ``overlap`` characters carried over. A piece with no finer
    separator stays over-size. Blank pieces vanish.
    """

    def parts(s: str, level: int) -> list[str]:
        if len(s) <= size:
            return [s]
        for i in range(level, len(separators)):
            ends = [m.end() for m in re.finditer(separators[i], s) if 0 < m.end() < len(s)]
            if ends:
                bounds = [0, *ends, len(s)]
                return [q for a, b in zip(bounds, bounds[1:]) if b > a for q in parts(s[a:b], i + 1)]
        return [s]

    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in parts(t, 0):
        if held and total + len(p) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    out.append("".join(held))
    return [s for s in (re.sub(r"\n{2,}", "\n", x).strip() for x in out) if s]


def splitter(size: int, overlap: int = 0, separators: list[str] = SEPARATORS) -> Callable[[Column], Column]:
    """:func:`cut` as a function from a text column to an array of pieces."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else cut(t, size, overlap, separators))

    return split


def at_separator(c: Column, separator: str) -> Column:
    """Pieces between a fixed separator, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, re.escape(separator)), lambda x: F.trim(x)), lambda x: x != "")


def by_headings(c: Column) -> Column:
    """Sections of a Markdown text, each beginning with its heading."""
    return F.filter(F.transform(F.split(c, r"(?m)(?=^#{1,6}\s)"), lambda x: F.trim(x)), lambda x: x != "")


def by_meaning(sentences: DataFrame, *, key: str, order: str, vector: str, text: str, percentile: float = 0.95) -> DataFrame:
    """Sections of neighbouring sentences: a new one begins where the cosine distance to the sentence before exceeds the document's percentile. ``<key>, section, content``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    d = sentences.withColumn("p", F.lag(vector).over(w)).withColumn("dist", 1 - dot(F.col("p"), F.col(vector)) / F.sqrt(dot(F.col("p"), F.col("p")) * dot(F.col(vector), F.col(vector))))
    limit = d.groupBy(key).agg(F.percentile("dist", percentile).alias("limit"))
    placed = d.join(limit, key).withColumn("section", F.sum(F.when(F.col("dist") > F.col("limit"), 1).otherwise(0)).over(w))
    return placed.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("content"))


def parents_and_children(documents: DataFrame, *, key: str, text: str, parent_size: int = 512, parent_overlap: int = 120, child_size: int = 128, child_overlap: int = 30) -> DataFrame:
    """Children of every document: ``document_id, parent_no, parent_id, child_no, child_id, text``, ids by content and occurrence. Null and blank texts give no rows."""
    d = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("document_id"), F.col(text).alias("t"))
    parents = d.select("document_id", F.posexplode(splitter(parent_size, parent_overlap)("t")).alias("parent_no", "parent"))
    parents = parents.withColumn("parent_sha", tx.content_sha(F.col("parent")))
    parents = parents.withColumn("parent_id", tx.identity("parent", F.col("document_id"), F.col("parent_sha"), occurrence=occurrence(["document_id", "parent_sha"], ["parent_no"])))
    children = parents.select("document_id", "parent_no", "parent_id", F.posexplode(splitter(child_size, child_overlap)("parent")).alias("child_no", "text"))
    children = children.withColumn("child_sha", tx.content_sha(F.col("text")))
    child_id = tx.identity("child", F.col("document_id"), F.col("parent_id"), F.col("child_sha"), occurrence=occurrence(["parent_id", "child_sha"], ["child_no"]))
    return children.withColumn("child_id", child_id).select("document_id", "parent_no", "parent_id", "child_no", "child_id", "text")
