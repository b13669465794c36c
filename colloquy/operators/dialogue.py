"""Shaping dialogues: history and query, exchanges, chains, snapshots, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_history_query(messages: DataFrame) -> DataFrame:
    """Each message with its part: the last turn is the query if a user speaks it, all before is history."""
    last = F.max("turn_index").over(Window.partitionBy("sample_id"))
    x = messages.withColumn("last", last)
    return x.select("sample_id", "turn_index", F.when(F.col("turn_index") < F.col("last"), "history").when(F.col("role") == "user", "query").otherwise("rejected").alias("part"))


def pair_exchanges(messages: DataFrame) -> DataFrame:
    """An assistant turn with the user turn just before it; null where there is none. System turns are left out."""
    before = Window.partitionBy("sample_id").orderBy("turn_index")
    x = messages.where("role <> 'system'").withColumn("p", F.lag("role").over(before)).withColumn("pid", F.lag("message_id").over(before))
    return x.where("role = 'assistant'").select("sample_id", F.when(F.col("p") == "user", F.col("pid")).alias("user_message_id"), F.col("message_id").alias("assistant_message_id"))


def bounded_chains(rows: DataFrame, m: int) -> DataFrame:
    """Chains of at most ``m`` versions in turn order."""
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("turn_index")) - 1
    x = rows.withColumn("n", n)
    return x.select("sample_id", "message_id", F.floor(F.col("n") / m).cast("long").alias("chain"), (F.col("n") % m + 1).cast("long").alias("version"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot of the highest version of each trajectory."""
    return snapshots.groupBy("sample_id", "trajectory_id").agg(F.max_by("snapshot_id", "version").alias("snapshot_id"), F.max("version").cast("long").alias("version"))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """One claim per sample and normalised text, with the most cautious status and the number of its sources."""
    order = F.create_map(*[F.lit(x) for p in (("active", 0), ("deprecated", 1), ("needs-confirmation", 2), ("contradictory", 3)) for x in p])
    from ..functions.text import normalize_answer

    x = claims.withColumn("norm", normalize_answer(F.col("text"))).withColumn("priority", order[F.col("status")])
    return x.groupBy("sample_id", "norm").agg(F.max_by("status", "priority").alias("status"), F.countDistinct("source_message_id").alias("sources"), F.min("claim_id").alias("claim_id"))


def expand_neighbors(hits: DataFrame, snapshots: DataFrame, radius: int) -> DataFrame:
    """Snapshots of the hits' trajectories within ``radius`` versions of a hit."""
    s = snapshots.select(F.col("trajectory_id").alias("t"), F.col("version").alias("v"), F.col("snapshot_id").alias("neighbor_id"))
    near = (F.col("trajectory_id") == F.col("t")) & F.col("v").between(F.col("version") - radius, F.col("version") + radius)
    return hits.join(s, near).select("snapshot_id", "neighbor_id").distinct()


def fragmentation(page_members: DataFrame) -> DataFrame:
    """Pages of each sample: how many, how wide, how many hold one trajectory."""
    width = page_members.where("page_type <> 'index'").groupBy("sample_id", "page_id").agg(F.count(F.lit(1)).alias("w"))
    return width.groupBy("sample_id").agg(F.count(F.lit(1)).alias("pages"), F.avg("w").alias("mean_width"), F.max("w").alias("max_width"), F.avg((F.col("w") == 1).cast("double")).alias("singleton_rate"))


def conflict_lines(claims: DataFrame) -> DataFrame:
    """Snapshots that hold disputed claims, with the claims' ids in order."""
    bad = claims.where(F.col("status").isin("contradictory", "needs-confirmation"))
    return bad.groupBy("sample_id", "snapshot_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("claim_id")), lambda c: c.cast("string")), ",").alias("claim_ids"))
