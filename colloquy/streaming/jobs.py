"""Trajectories and call costs from live streams, with the state and watermarks that they need."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import phase_for_task
from ..operators.build import CHAIN_SCHEMA, CONTINUE, Chains


def stream_trajectories(messages: DataFrame, most: int, least: float = CONTINUE, idle: str = "7 days") -> DataFrame:
    """A stream of (sample_id, message_id, ts, terms, names), with a watermark on ts -> the rows of ``build_trajectories``.

    A sample's open trajectories are its state; they are dropped, and thereby closed, once it has been idle for ``idle`` of
    event time. Messages of a micro-batch are taken in order of id.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, open_ = state.get if state.exists else (0, "[]")
        chains = Chains(most, json.loads(open_), first)
        rows = pd.concat(list(batches)).sort_values("message_id")
        out = []
        for r in rows.itertuples():
            t, n, score = chains.add(set(r.terms), set(r.names), least)
            out.append((key[0], r.message_id, key[0] * 100_000 + t, n, score))
        state.update((chains.next, json.dumps(chains.state())))
        state.setTimeoutTimestamp(max(int(rows.ts.max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=["sample_id", "message_id", "trajectory_id", "version", "score"])

    return messages.groupBy("sample_id").applyInPandasWithState(run, CHAIN_SCHEMA, "first long, chains string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_call_cost(calls: DataFrame, prices: dict[str, tuple[float, float]], late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """A stream of calls (call_item_uid, ts, role, task, prompt_tokens, completion_tokens) -> per window and phase the calls,
    tokens and dollars, each call once within the watermark. A window comes out when it is closed; unknown usage has no price."""
    dollars = F.lit(None).cast("double")
    for role, (inward, outward) in prices.items():
        dollars = F.when(F.col("role") == role, (F.col("prompt_tokens") * inward + F.col("completion_tokens") * outward) / 1e6).otherwise(dollars)
    x = calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["call_item_uid"]).withColumn("dollars", dollars)
    x = x.groupBy(F.window("ts", width).alias("w"), phase_for_task(F.col("task")).alias("phase"))
    x = x.agg(F.count(F.lit(1)).alias("calls"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if(F.col("dollars").isNull()).alias("unpriced"), F.round(F.sum("dollars"), 8).alias("dollars"))
    return x.select(F.col("w.start").cast("string").alias("start"), "phase", "calls", "completion_tokens", "unpriced", "dollars")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, a file being a micro-batch at least."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    glob = f"{path[: -len('s.parquet')]}[s].parquet" if name.endswith("s") else path  # a pattern, so that one file will do
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob)


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over what there is, into files of the shared folder, and reads them."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = tempfile.mkdtemp(prefix="spark-stream-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
