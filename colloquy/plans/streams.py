"""Queries of the streaming jobs over the events as a stream."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import keywords
from ..operators.builder import build_memory
from ..operators.scoring import names_in
from ..sources.fixtures import VIEWS, Views, with_views
from ..streaming import jobs as J
from ..streaming.memory import stream_memory
from .registry import _PHASE, QUERIES, SQL

PRICES = {"backbone": (0.15, 0.6)}


def _stream(spark, sf_dir: str, view: str, *more: str):
    """A view that only selects from events, over the stream of events."""
    J.table_stream(spark, sf_dir, "events").createOrReplaceTempView("colloquy_event_stream")
    return spark.sql(re.sub(r"\bFROM events\b", "FROM colloquy_event_stream", VIEWS[view].replace("AS phrase FROM", ", ".join(["AS phrase", *more]) + " FROM") if more else VIEWS[view]))


def build(spark, sf_dir: str):
    p = _stream(spark, sf_dir, "fx_phrases", "CAST(ts AS TIMESTAMP) AS ts").where("message_id % 8 in (0, 1, 4, 5)").withWatermark("ts", "1 hour")
    text = F.col("phrase")
    return J.drained(J.stream_trajectories(p.select("sample_id", "message_id", "ts", keywords(text).alias("terms"), names_in(text).alias("names")), 6))


def cost(spark, sf_dir: str):
    calls = _stream(spark, sf_dir, "fx_calls").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.drained(J.stream_call_cost(calls, PRICES))


def _exchanges(x):
    """Sayings as exchanges: their words and names, and a claim for each sentence."""
    text = F.col("text")
    said = F.filter(F.transform(F.split(text, "[.;]"), lambda s: F.trim(s)), lambda s: F.length(s) > 3)
    status = lambda s: F.when(s.rlike(r"\b(ago|last)\b"), "deprecated").otherwise("active")
    return x.select("sample_id", "message_id", "ts", keywords(text).alias("terms"), names_in(text).alias("names"), F.transform(said, lambda s: F.struct(s.alias("text"), status(s).alias("status"))).alias("claims"))


MOST, LEAST, IDLE = 4, 0.3, "2 days"


def memory(spark, sf_dir: str):
    """Trajectories, snapshots, claims and operations of the sayings of events."""
    v = Views(spark, sf_dir)
    times = spark.read.parquet(f"{v.sf_dir}/events.parquet").select(F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    return build_memory(_exchanges(v("fx_sayings").join(times, "message_id")), MOST, LEAST, IDLE)


def memory_stream(spark, sf_dir: str):
    """The same from the events as a stream."""
    J.table_stream(spark, sf_dir, "events").createOrReplaceTempView("colloquy_event_stream")
    x = spark.sql(re.sub(r"\bFROM events\b", "FROM colloquy_event_stream", VIEWS["fx_sayings"].replace(" AS text FROM", " AS text, CAST(ts AS TIMESTAMP) AS ts FROM")))
    return J.drained(stream_memory(_exchanges(x.withWatermark("ts", "1 hour")), MOST, LEAST, IDLE))


QUERIES["d5_memory_rows"] = memory
QUERIES["s1_stream_memory"] = memory_stream
QUERIES["s1_stream_build_trajectories"] = build
QUERIES["s2_stream_call_cost"] = cost
SQL["s2_stream_call_cost"] = with_views(f"WITH w AS (SELECT *, date_trunc('day', ts) AS d, CASE WHEN role = 'backbone' THEN (prompt_tokens * 0.15::DOUBLE + completion_tokens * 0.6::DOUBLE) / 1e6 END AS c FROM fx_calls) SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, {_PHASE} AS phase, count(*) AS calls, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) FILTER (c IS NULL) AS unpriced, round(sum(c), 8) AS dollars FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM fx_calls) - INTERVAL 1 HOUR GROUP BY 1, 2")
