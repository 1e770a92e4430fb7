"""Queries on conversations (problem 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.llm import conversations as op


def p5_found(spark, sf_dir):
    return op.conversations(spark, f"{sf_dir}/conversations.parquet")


def p5_arrivals(spark, sf_dir):
    """The messages as they come out when the rows arrive in the order of their ids, in eight micro-batches."""
    return op.conversations(spark, op.replayed(spark, f"{sf_dir}/conversations.parquet", 8), files_per_trigger=1)


def p5_transcripts(spark, sf_dir):
    out = op.transcripts(spark, f"{sf_dir}/conversations.parquet")
    return out.select("session_id", "part", "n_messages", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["speaker"], F.lit(":"), m["content"])), "\n")).alias("digest"))


QUERIES = {"p5_found": p5_found, "p5_arrivals": p5_arrivals, "p5_transcripts": p5_transcripts}

_PLACED = r"""
WITH base AS (
  SELECT lower(trim(session_id)) AS session_id, id, question, answer, timestamp AS ts,
         coalesce(regexp_replace(question, '[\p{Z}\p{Cc}\p{Cf}]', '', 'g') <> '', false) AS q,
         coalesce(regexp_replace(answer, '[\p{Z}\p{Cc}\p{Cf}]', '', 'g') <> '', false) AS a
  FROM conversations WHERE trim(session_id) <> ''),
once AS (
  SELECT session_id, ts, min(id) AS id, q, a, CASE WHEN q THEN question END AS question, CASE WHEN a THEN answer END AS answer
  FROM base WHERE q OR a GROUP BY ALL),
said AS (
  SELECT session_id, ts, id, q, 1 AS part, 'user' AS speaker, question AS content FROM once WHERE q
  UNION ALL SELECT session_id, ts, id, q, 2, 'assistant', answer FROM once WHERE a),
placed AS (
  SELECT *, row_number() OVER w AS msg_pos, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after
  FROM said WINDOW w AS (PARTITION BY session_id ORDER BY ts, CASE WHEN q THEN 0 ELSE 1 END, id, part)),
usable AS (
  SELECT session_id FROM placed GROUP BY session_id
  HAVING bool_and(ts IS NOT NULL) AND bool_and(coalesce(before, 'assistant') <> speaker) AND bool_and(after IS NOT NULL OR speaker = 'assistant'))
"""

SQL = {
    "p5_found": _PLACED + "SELECT session_id, CAST(msg_pos AS INT) AS msg_pos, id, speaker FROM placed WHERE session_id IN (FROM usable)",
    "p5_transcripts": _PLACED
    + "SELECT session_id, CAST((msg_pos - 1) // 1000 AS INT) AS part, count(*) AS n_messages, md5(string_agg(speaker || ':' || content, chr(10) ORDER BY msg_pos)) AS digest FROM placed WHERE session_id IN (FROM usable) GROUP BY 1, 2",
}
SQL["p5_arrivals"] = SQL["p5_found"]
