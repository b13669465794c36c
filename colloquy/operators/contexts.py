"""The contexts that variants of retrieval give to an answer, all of them from one shared plan.

A policy is a row: where evidence comes from (routing), what of it is shown (evidence), and flags. Questions are keyed by the
routings that any policy needs, so that pages, trajectories, snapshots and messages are ranked once for each (question, routing)
by the functions of ``retrieve``, and policies are joined to what comes out: a new policy is a new row, not another plan.

Whole dialogues are by far the most of what comes out. What they use up is summed along a sample's messages, before any question meets
them, and they go from that join to the result: they are neither written in between nor sorted once more for each question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import hash_embedding
from ..functions.text import estimate_tokens, rounded, unit_cosine
from .memory import ordered
from .retrieve import Settings, traced
from .scoring import hybrid_messages

POLICY = "variant string, routing string, evidence string, supported boolean, pages boolean, summaries boolean, sources boolean, matched boolean"
# The policies of the variants, in the order of their report.
POLICIES = [
    ("full", "wiki_routed", "full_expansion", True, True, True, True, False),
    ("direct_trajectory", "all_trajectories", "full_expansion", True, False, True, True, False),
    ("latest_snapshot", "wiki_routed", "latest_per_trajectory", True, True, True, True, False),
    ("hybrid_raw_rag", "hybrid_raw_messages", "raw_messages", True, False, False, True, False),
    ("hybrid_raw_rag_matched", "hybrid_raw_messages", "raw_messages", True, False, False, True, True),
    ("wiki_summaries", "wiki_routed", "wiki_summary_context", True, True, False, False, False),
    ("no_claim_state", "wiki_routed", "flat_claim_state", True, True, True, True, False),
    ("no_source_constraint", "wiki_routed", "full_expansion", False, True, True, True, False),
    ("full_context", "all_raw_messages", "raw_messages", True, False, False, True, False),
    ("full_context_matched", "all_raw_messages", "raw_messages", True, False, False, True, True),
    ("naive_dense_rag", "naive_dense_chunks", "raw_chunks", True, False, False, False, False),
]
#: Messages and chunks that a ranking of messages gives (a top-k is what these variants are), and messages of a chunk.
MESSAGES, CHUNKS, CHUNK = 12, 4, 4
SECTIONS = ["page", "trajectory", "snapshot", "source", "message", "chunk"]


def policy_table(spark: SparkSession, policies: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(policies if policies is not None else POLICIES, POLICY)


def _chunks(messages: DataFrame) -> DataFrame:
    """(sample_id, chunk_id, text): every ``CHUNK`` messages of a sample in order."""
    n = F.floor((F.row_number().over(Window.partitionBy("sample_id").orderBy("turn_index", "message_id")) - 1) / CHUNK)
    x = messages.select("sample_id", "message_id", "turn_index", "content").withColumn("chunk", n)
    return x.groupBy("sample_id", "chunk").agg(F.min("message_id").alias("chunk_id"), F.array_join(ordered(F.col("content"), "turn_index", "message_id"), "\\n").alias("text"))


def variant_contexts(questions: DataFrame, index: dict[str, DataFrame], claims: DataFrame, pages: DataFrame, policies: DataFrame, settings: Settings = Settings(), stage: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """(query_id, variant, section, rank, item_id, text, tokens): what each policy shows for each question, in order.

    Snapshots are shown with the status of each claim, by ``flat_claim_state`` without it, and by ``latest_per_trajectory`` the newest
    alone; with ``supported`` those without a source message are left out. A ``matched`` policy stops before it would have more tokens
    than the question's ``full`` context; without such a policy it is not cut. ``pages``: page_id, text; ``claims``: snapshot_id,
    claim_id, text, status.
    """
    wanted = {r["routing"] for r in policies.select("routing").distinct().collect()}  # a row for each kind of routing
    tiers = [(r, d) for r, d in (("wiki_routed", False), ("all_trajectories", True)) if r in wanted]
    rows = []
    columns = ["query_id", "routing", "section", "rank", "item_id", "text", "flat", "latest", "has_source", "tokens", "flat_tokens"]
    yes, none = F.lit(True), F.lit(None).cast("string")
    tokens = lambda c: estimate_tokens(F.col(c)).alias("tokens")  # noqa: E731  counted once a text, before any question meets it
    if tiers:
        t = traced(questions, index, settings, stage, tiers)
        split = [F.col("query_id.query_id").alias("query_id"), F.col("query_id.routing").alias("routing")]
        row = lambda df, section, rank, item, text, flat=none, latest=yes, source=yes: df.select(*split, F.lit(section).alias("section"), rank.cast("long").alias("rank"), item.cast("long").alias("item_id"), text.alias("text"), flat.alias("flat"), latest.alias("latest"), source.alias("has_source"), "tokens", ("flat_tokens" if "flat_tokens" in df.columns else F.lit(0).cast("long").alias("flat_tokens")))
        rows.append(row(t["pages"].join(pages.select("page_id", "text", tokens("text")), "page_id"), "page", F.col("rank"), F.col("page_id"), F.col("text")))
        best = t["trajectories"].where(F.col("rank") <= settings.trajectories)
        rows.append(row(best.join(index["trajectories"].select("trajectory_id", "text", tokens("text")), "trajectory_id"), "trajectory", F.col("rank"), F.col("trajectory_id"), F.col("text")))
        said = claims.groupBy("snapshot_id").agg(F.array_join(ordered(F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("text")), "claim_id"), "\\n").alias("text"), F.array_join(ordered(F.col("text"), "claim_id"), "\\n").alias("flat")).select("*", tokens("text"), tokens("flat").alias("flat_tokens"))
        backed = index["sources"].select("snapshot_id").distinct().withColumn("backed", F.lit(True))
        snaps = t["snapshots"].where("kept").join(said, "snapshot_id").join(backed, "snapshot_id", "left")
        rows.append(row(snaps, "snapshot", F.col("order"), F.col("snapshot_id"), F.col("text"), F.col("flat"), F.col("kind") == "seed", F.coalesce("backed", F.lit(False))))
        rows.append(row(t["messages"].join(index["messages"].select("message_id", "content", tokens("content")), "message_id"), "source", F.col("rank"), F.col("message_id"), F.col("content")))
    flat_row = lambda df, routing, section, rank, item, text: df.select("query_id", F.lit(routing).alias("routing"), F.lit(section).alias("section"), rank.cast("long").alias("rank"), item.cast("long").alias("item_id"), text.alias("text"), none.alias("flat"), yes.alias("latest"), yes.alias("has_source"), "tokens", F.lit(0).cast("long").alias("flat_tokens"))
    messages = index["messages"]
    if "hybrid_raw_messages" in wanted:
        found = hybrid_messages(questions.select("query_id", "sample_id", "question", "question_vector"), messages).where(F.col("rank") <= MESSAGES)
        rows.append(flat_row(found.join(messages.select("message_id", "content", tokens("content")), "message_id"), "hybrid_raw_messages", "message", F.col("rank"), F.col("message_id"), F.col("content")))
    if "naive_dense_chunks" in wanted:
        near = questions.select("query_id", "sample_id", "question_vector").join(_chunks(messages).select("*", tokens("text"), hash_embedding(F.col("text")).alias("v")), "sample_id").withColumn("close", unit_cosine(F.col("question_vector"), F.col("v")))
        near = near.select("query_id", "chunk_id", "text", "tokens", rounded(F.col("close"), 6).alias("close"))
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("close"), "chunk_id"))).where(F.col("rank") <= CHUNKS)
        rows.append(flat_row(near, "naive_dense_chunks", "chunk", F.col("rank"), F.col("chunk_id"), F.col("text")))
    if not rows and "all_raw_messages" not in wanted:
        raise ValueError("no policy with a known routing")
    shown = ["query_id", "variant", "section", "rank", "item_id", "text", "tokens"]
    whole_too = "all_raw_messages" in wanted
    if not rows:
        return _dialogues(questions, messages, policies, _whole(_totals(questions, messages, policies))).select(shown)
    items = rows[0]
    for r in rows[1:]:
        items = items.unionByName(r)
    items = stage("context_items", items.select(columns))
    e, section = F.col("evidence"), F.col("section")
    states = e.isin("full_expansion", "latest_per_trajectory", "flat_claim_state")
    shows = (
        F.when(section == "page", F.col("pages")).when(section == "trajectory", F.col("summaries"))
        .when(section == "snapshot", states & ((e != "latest_per_trajectory") | F.col("latest")) & (~F.col("supported") | F.col("has_source")))
        .when(section == "source", F.col("sources") & states).when(section == "message", e == "raw_messages").otherwise(e == "raw_chunks")
    )
    x = items.join(F.broadcast(policies), "routing").where(shows)  # a row for each policy
    x = x.withColumn("tokens", F.when((section == "snapshot") & (e == "flat_claim_state"), F.col("flat_tokens")).otherwise(F.col("tokens")))
    x = x.withColumn("text", F.when((section == "snapshot") & (e == "flat_claim_state"), F.col("flat")).otherwise(F.col("text")))
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), section)
    used = F.sum("tokens").over(Window.partitionBy("query_id", "variant").orderBy("place", "rank", "item_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = x.where("matched").withColumn("place", place).withColumn("used", used)
    told = x.select("query_id", "variant", "tokens")
    whole = _whole(told.unionByName(_totals(questions, messages, policies)) if whole_too else told)
    cut = cut.join(whole, "query_id", "left").where(F.col("whole").isNull() | (F.col("used") <= F.col("whole")))
    x = x.where("not matched").select(shown).unionByName(cut.select(shown))
    return x.unionByName(_dialogues(questions, messages, policies, whole).select(shown)) if whole_too else x


def _whole(x: DataFrame) -> DataFrame:
    """(query_id, whole): the tokens of each question's ``full`` context."""
    return x.where(F.col("variant") == "full").groupBy("query_id").agg(F.sum("tokens").alias("whole"))


def _shown_whole(policies: DataFrame) -> DataFrame:
    return policies.where((F.col("routing") == "all_raw_messages") & (F.col("evidence") == "raw_messages")).select("variant", "matched")


def _totals(questions: DataFrame, messages: DataFrame, policies: DataFrame) -> DataFrame:
    """(query_id, variant, tokens): what a whole dialogue uses up, for each policy that shows it."""
    total = messages.groupBy("sample_id").agg(F.sum(estimate_tokens(F.col("content"))).alias("tokens"))
    return questions.select("query_id", "sample_id").join(total, "sample_id").crossJoin(F.broadcast(_shown_whole(policies))).select("query_id", "variant", "tokens")


def _dialogues(questions: DataFrame, messages: DataFrame, policies: DataFrame, whole: DataFrame) -> DataFrame:
    """Every message of a question's sample, for each policy that shows whole dialogues, and of matched ones those up to the
    question's ``whole``, which it brings along: the messages are not sent once more to be cut."""
    ahead = Window.partitionBy("sample_id").orderBy("turn_index", "message_id")
    x = messages.select("sample_id", "message_id", "turn_index", F.col("content").alias("text"), estimate_tokens(F.col("content")).alias("tokens"))
    x = x.select("sample_id", F.lit("message").alias("section"), F.row_number().over(ahead).cast("long").alias("rank"), F.col("message_id").cast("long").alias("item_id"), "text", "tokens", F.sum("tokens").over(ahead.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    asked = questions.select("query_id", "sample_id").join(whole, "query_id", "left")
    x = asked.join(x, "sample_id").crossJoin(F.broadcast(_shown_whole(policies)))
    return x.where(~F.col("matched") | F.col("whole").isNull() | (F.col("used") <= F.col("whole")))
