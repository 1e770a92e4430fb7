"""Conversations from message rows, with keyed streaming state.

Rows arrive in any order, in micro-batches. Two stateful streams follow one
another:

1. By session and event-time bucket, under a watermark. A row that arrives late
   joins its bucket while that is open; when the watermark passes the bucket's
   end it comes out as a fragment: its messages in order, whether they alternate
   and who speaks at its ends. A session as large as a third of the table is
   therefore never one task's state. Rows that come after their bucket was
   closed are found by comparing counts per bucket, and only those buckets are
   made again, as corrections.
2. By session, under a session window of event time: the state is a short summary
   of each fragment. When the watermark closes the session, it is validated across
   its fragments and comes out if it is usable.

The messages of a fragment then take their places. Both states are Spark's own
aggregations: a Python function per session took 17 times the CPU.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.session import shared_path, written

#: Characters of which nothing can be seen.
UNSEEN = r"[\p{Z}\p{Cc}\p{Cf}\u034F\u115F\u1160\u3164\uFFA0\u2800\uFE00-\uFE0F]"
#: Kept state of a row: no text, so state stays small.
ROW = "session_id string, ts timestamp, id long, asks boolean, replies boolean, text_hash long"


def visible(c: Column) -> Column:
    """Whether anything of ``c`` can be seen; null counts as nothing."""
    return F.coalesce(F.regexp_replace(c, UNSEEN, "") != "", F.lit(False))


def session_key(c: Column) -> Column:
    """A session id without outer white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def message_rows(rows: DataFrame) -> DataFrame:
    """Rows with at least one visible text and a session id, as :data:`ROW`. Works on streams and tables."""
    said = lambda c: F.when(visible(F.col(c)), F.col(c))
    return (
        rows.select(
            session_key(F.col("session_id")).alias("session_id"),
            F.col("timestamp").cast("timestamp").alias("ts"),
            F.col("id").cast("long").alias("id"),
            visible(F.col("question")).alias("asks"),
            visible(F.col("answer")).alias("replies"),
            F.xxhash64(F.coalesce(said("question"), F.lit("")), F.coalesce(said("answer"), F.lit(""))).alias("text_hash"),
        )
        .where("session_id is not null and session_id <> '' and (asks or replies)")
    )


def fragments(rows: DataFrame, bucket: str) -> DataFrame:
    """Each session's messages of one event-time bucket: ``session_id, start, n_rows, messages, alternates``.

    ``messages`` is array<struct<id, speaker>> in order. ``rows`` (:data:`ROW`,
    timestamps present) may be a stream with a watermark or a table.
    """
    row = F.struct("ts", "text_hash", "id", "asks", "replies")
    buffered = rows.groupBy("session_id", F.window("ts", bucket).alias("w")).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(row)).alias("r"))
    new = lambda x, i: (i == 0) | (F.get("r", i - 1)["ts"] != x["ts"]) | (F.get("r", i - 1)["text_hash"] != x["text_hash"])
    kept = buffered.withColumn("r", F.filter("r", new))
    ordered = kept.withColumn("r", F.array_sort(F.transform("r", lambda x: F.struct(x["ts"], (~x["asks"]).alias("answers_only"), x["id"], x["asks"], x["replies"]))))
    said = lambda x, flag, who: F.when(x[flag], F.array(F.struct(x["id"].alias("id"), F.lit(who).alias("speaker")))).otherwise(F.array())
    messages = F.flatten(F.transform("r", lambda x: F.concat(said(x, "asks", "user"), said(x, "replies", "assistant"))))
    same = lambda m, i: (i > 0) & (F.get("messages", i - 1)["speaker"] == m["speaker"])
    return (
        ordered.select("session_id", F.col("w.start").alias("start"), "n_rows", messages.alias("messages"))
        .withColumn("alternates", F.size(F.filter("messages", same)) == 0)
    )


#: Later than any row: the delay within which no summary counts as late, and half of what the closing mark adds.
ALL_TIME = "36500 days"


def _until_closed(run, marks: str, last: DataFrame, like: str) -> None:
    """Runs a stream over all its files, then over a mark at ``last`` (ts), later than every row, which closes what is open."""
    run()
    fields = {f.split()[0]: f.split()[1] for f in like.split(", ")}
    empty = {"string": F.lit(""), "boolean": F.lit(False), "timestamp": F.col("ts")}
    last.where("ts is not null").select(*(empty.get(kind, F.lit(0)).cast(kind).alias(name) for name, kind in fields.items())).coalesce(1).write.mode("append").parquet(marks)
    run()


def _stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern matches a single file as well as a folder; a stream takes a plain path only for a folder


def stream_fragments(spark: SparkSession, path: str, *, delay: str, bucket: str, files_per_trigger: int | None = None) -> DataFrame:
    """:func:`fragments` of the table at ``path``, read as a stream with watermark ``delay``, ``files_per_trigger`` files in a micro-batch."""
    table = spark.read.parquet(path)
    out, state, marks = (shared_path(spark, f"conversations-{x}") for x in ("out", "state", "marks"))
    spark.createDataFrame([], ROW).coalesce(1).write.parquet(marks)

    def run() -> None:
        events = message_rows(_stream(spark, path, table.schema, files_per_trigger)).where("ts is not null")
        events = events.unionByName(spark.readStream.schema(ROW).parquet(marks)).withWatermark("ts", delay)
        fragments(events, bucket).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    last = table.agg(F.max(F.col("timestamp").cast("timestamp")).alias("ts"))
    _until_closed(run, marks, last.select((F.col("ts") + F.expr(f"interval {delay}") + F.expr(f"interval {bucket}") * 2).alias("ts")), ROW)
    schema = fragments(spark.createDataFrame([], ROW), bucket).schema
    return spark.read.schema(schema).parquet(out).where("session_id <> ''")


def all_fragments(spark: SparkSession, path: str, *, delay: str = "3 hours", bucket: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """:func:`stream_fragments` with the buckets to which rows came too late made again from all their rows."""
    keys = ["session_id", "start"]
    rows = message_rows(spark.read.parquet(path)).where("ts is not null").withColumn("start", F.window("ts", bucket)["start"])
    found = stream_fragments(spark, path, delay=delay, bucket=bucket, files_per_trigger=files_per_trigger)
    emitted = found.select(*keys, F.col("n_rows").alias("n"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    short = written(counted.join(emitted, [*keys, "n"], "left_anti").select(*keys), "conversations-late")
    corrected = fragments(rows.join(short, keys, "left_semi").drop("start"), bucket)
    return found.join(short, keys, "left_anti").unionByName(corrected)


SUMMARY = "session_id string, start timestamp, at long, n int, first string, last string, alternates boolean"


def closed_sessions(summaries: DataFrame) -> DataFrame:
    """Sessions on closure, if usable: ``session_id, parts``, the summaries of their fragments in order.

    ``summaries`` (:data:`SUMMARY`) may be a stream with a watermark: the state of a session holds its summaries until the
    watermark is :data:`ALL_TIME` past the last of them. The messages of a usable session alternate within and across
    the fragments, from user to assistant.
    """
    part = F.struct("at", "n", "first", "last", "alternates")
    kept = summaries.groupBy("session_id", F.session_window("start", ALL_TIME)).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = lambda x, i: x["alternates"] & (x["first"] != F.coalesce(F.get("parts", i - 1)["last"], F.lit("assistant")))
    broken = F.size(F.filter("parts", lambda x, i: ~joined(x, i)))
    return kept.where((broken == 0) & (F.element_at("parts", -1)["last"] == "assistant")).select("session_id", "parts")


def usable_fragments(spark: SparkSession, found: DataFrame, untimed: DataFrame) -> DataFrame:
    """The fragments of usable sessions with the number of messages ``before`` each, by keyed state of each session (:func:`closed_sessions`).

    ``untimed`` (session_id) are sessions with a message of unknown time; they are not usable.
    """
    summaries = found.select(
        "session_id", "start", F.unix_micros("start").alias("at"), F.size("messages").alias("n"), F.get("messages", F.lit(0))["speaker"].alias("first"),
        F.element_at("messages", -1)["speaker"].alias("last"), "alternates",
    ).unionByName(untimed.select("session_id", F.lit(None).cast("timestamp").alias("start"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), F.lit("").alias("first"), F.lit("").alias("last"), F.lit(False).alias("alternates")))
    summaries = summaries.withColumn("start", F.greatest("start", F.lit("1970-01-02").cast("timestamp")))  # the watermark begins at 1970-01-01
    path, out, state, marks = (shared_path(spark, f"conversations-{x}") for x in ("summaries", "placed", "sessions", "closing"))
    summaries.write.parquet(path)
    spark.createDataFrame([], SUMMARY).coalesce(1).write.parquet(marks)

    def run() -> None:
        events = _stream(spark, path, SUMMARY, None).unionByName(spark.readStream.schema(SUMMARY).parquet(marks)).withWatermark("start", ALL_TIME)
        closed_sessions(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    last = spark.read.schema(SUMMARY).parquet(path).agg(F.max("start").alias("ts"))
    _until_closed(run, marks, last.select((F.col("ts") + F.expr(f"interval {ALL_TIME}") * 2 + F.expr("interval 1 day")).alias("ts")), SUMMARY)
    schema = closed_sessions(spark.createDataFrame([], SUMMARY)).schema
    parts = spark.read.schema(schema).parquet(out).where("session_id <> ''").select("session_id", F.explode("parts").alias("p"))
    before = F.sum("p.n").over(Window.partitionBy("session_id").orderBy("p.at").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("session_id", F.col("p.at").alias("at"), F.coalesce(before, F.lit(0)).alias("before"))


def conversations(spark: SparkSession, path: str, **options) -> DataFrame:
    """Messages of all usable sessions of the table at ``path``: ``session_id, msg_pos, id, speaker``; ids keep their type.

    The table has id, session_id, question, answer, timestamp; other columns are
    ignored. A usable session has messages, all with a timestamp, that alternate
    between user and assistant, start with user and end with assistant. Rows
    alike in both texts (texts of which nothing is visible count as none) and
    timestamp count once, under the smallest id. Rows without a session id are
    ignored. An empty table gives no rows. ``options``: ``delay`` of the watermark,
    ``bucket`` of event time, ``files_per_trigger``; none changes the result.
    """
    table = spark.read.parquet(path)
    found = written(all_fragments(spark, path, **options), "conversations-fragments")
    untimed = message_rows(table).where("ts is null").select("session_id").distinct()
    places = usable_fragments(spark, found, untimed)
    return (
        found.select("session_id", F.unix_micros("start").alias("at"), "messages").join(places, ["session_id", "at"])
        .select("session_id", "before", F.posexplode("messages").alias("i", "m"))
        .select("session_id", (F.col("before") + F.col("i") + 1).cast("int").alias("msg_pos"), F.col("m.id").cast(table.schema["id"].dataType).alias("id"), "m.speaker")
    )


def replayed(spark: SparkSession, path: str, steps: int) -> str:
    """The table at ``path`` written again in the order of arrival (id), in ``steps`` files, as a source of as many micro-batches; gives the new path."""
    out = shared_path(spark, "conversations-replay")
    rows = spark.read.parquet(path)
    rows.repartitionByRange(steps, "id").write.parquet(out)
    return out


def transcripts(spark: SparkSession, path: str, *, per_part: int = 1000, **options) -> DataFrame:
    """Usable sessions as conversations: ``session_id, part, n_messages, messages`` (array<struct<msg_pos, speaker, content>> in order).

    A conversation of more than ``per_part`` messages comes in several parts, counted from 0, so no row grows with the table.
    """
    placed = conversations(spark, path, **options)
    text = spark.read.parquet(path).select("id", "question", "answer").dropDuplicates(["id"])
    said = placed.join(text, "id").select(
        "session_id", F.floor((F.col("msg_pos") - 1) / per_part).cast("int").alias("part"),
        F.struct("msg_pos", "speaker", F.when(F.col("speaker") == "user", F.col("question")).otherwise(F.col("answer")).alias("content")).alias("m"),
    )
    return said.groupBy("session_id", "part").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list("m")).alias("messages"))
