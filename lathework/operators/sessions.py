"""Session history: the last turns, as rows and as one context string."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest turns of each session, ``turn`` counting from the oldest kept; ties in time go by id. Rows without a session or time are left out."""
    w = Window.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("id"))
    newest = rows.where("session_id is not null and timestamp is not null").withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    size = F.count("*").over(Window.partitionBy("session_id"))
    return newest.withColumn("turn", (size - F.col("back") + 1).cast("int")).drop("back")


def context(turns: DataFrame) -> DataFrame:
    """``session_id, context``: the turns as Q: and A: lines, oldest first; null texts count as ''."""
    line = F.concat(F.lit("Q:"), F.coalesce("question", F.lit("")), F.lit("\nA:"), F.coalesce("answer", F.lit("")))
    return turns.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "\n").alias("context"))


def without_session(rows: DataFrame, session_id: str) -> DataFrame:
    """History with one session cleared; rows without a session stay."""
    return rows.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))
