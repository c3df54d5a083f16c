"""Structured Streaming around the engine: incremental ingest, answering a stream of questions, monitoring decisions.

None of this has a counterpart in batch semantics; it adds to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.calibrate import Policy
from ..plans import pipeline


def new_documents(spark: SparkSession, folder: str, schema: str, id_col: str = "doc_id", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Documents that arrive as JSON files, each id once.

    Without a watermark every id is remembered; with (time column, delay) ids
    are remembered for that long.
    """
    rows = spark.readStream.schema(schema).json(folder)
    if watermark:
        return rows.withWatermark(*watermark).dropDuplicatesWithinWatermark([id_col])
    return rows.dropDuplicates([id_col])


def answer_stream(questions: DataFrame, chunks: DataFrame, policy: Callable[[], Policy | None], path: str, checkpoint: str) -> StreamingQuery:
    """Answer micro-batches of questions against a fixed corpus into a Parquet table.

    The policy is read once per batch, so a batch never mixes two. A batch that
    is repeated after a failure writes to the same folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        out = pipeline.answer(chunks, batch.select("query_id", "text"), policy())
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone; a batch as it is."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if rows.isStreaming else rows


def windowed(decisions: DataFrame, ts: str = "ts", length: str = "1 hour", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Per window: decisions, answered, wrong, coverage and risk. Rows later than the watermark are dropped, as in any stream.

    decisions: ts, answered, wrong (booleans).
    """
    source = _timed(decisions, ts, late)
    answered = F.col("answered")
    out = source.groupBy(F.window(ts, length), *(by or [])).agg(F.count("*").alias("n"), F.count_if(answered).alias("n_answered"), F.count_if(answered & F.col("wrong")).alias("n_wrong"))
    return out.select(
        F.col("window.start").alias("window_start"),
        *(by or []),
        "n",
        "n_answered",
        "n_wrong",
        (F.col("n_answered") / F.col("n")).alias("coverage"),
        F.try_divide(F.col("n_wrong").cast("double"), F.col("n_answered").cast("double")).alias("risk"),
    )


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Per user and session: start, end, events."""
    source = _timed(events, ts, late)
    out = source.groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def drain(stream: DataFrame, mode: str, checkpoint: str, out: str) -> None:
    """Run a stream over what is there into a Parquet table, then stop.

    In append mode rows are added as they become final; in complete mode every
    batch replaces the table, so a batch that is repeated leaves the same rows.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
