"""Registered queries on the events table, as batch and as a stream that is run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.settle import shared_dir
from ..streaming import jobs
from .registry import register


def decisions(events):
    """Events as a decision log: clicks and purchases are answers; a value below 20 counts as wrong."""
    return events.select("ts", "event_type", (F.col("value") >= 10).alias("answered"), (F.col("value") < 20).alias("wrong"))


_WINDOWS = """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (value >= 10) AS n_answered, count(*) FILTER (value >= 10 AND value < 20) AS n_wrong,
  round(count(*) FILTER (value >= 10)::DOUBLE / count(*), 6) AS coverage, round(count(*) FILTER (value >= 10 AND value < 20)::DOUBLE / nullif(count(*) FILTER (value >= 10), 0), 6) AS risk FROM events GROUP BY ALL"""


def _rounded(df):
    return df.select("window_start", "event_type", "n", "n_answered", "n_wrong", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@register("decision_windows", _WINDOWS)
def decision_windows(spark, sf_dir):
    return _rounded(jobs.windowed(decisions(spark.read.parquet(f"{sf_dir}/events.parquet")), by=["event_type"]))


@register("decision_windows_stream", _WINDOWS)
def decision_windows_stream(spark, sf_dir):
    """The same over a file stream drained by availableNow, in complete mode."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else sf_dir + "/events*")
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    out = _rounded(jobs.windowed(decisions(stream), by=["event_type"]))
    jobs.drain(out, "complete", f"{base}/checkpoint", f"{base}/rows")
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def _is_file(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@register(
    "user_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark, sf_dir):
    return jobs.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
