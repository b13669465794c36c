"""Retrieval of evidence for many questions at once, from pages to source messages, over an index that is written once.

The index (``build_index``) holds what every question reads: the signals and vectors of trajectories, pages and snapshots, which
snapshots their claims' revisions reach, and the sources. ``write_index`` puts a version of it under a path, dealt into parts by
the sample's hash, so that a sample's rows lie together and new versions never touch old ones; ``read_index`` opens the newest.

``retrieve`` narrows from tier to tier in one plan: pages are ranked, trajectories come from the best of them (those that broad pages
alone give are capped; questions with few get the best others of their sample), only these are scored, the best give seed
snapshots, which are expanded, compacted and traced to messages; where the evidence is weak, messages are looked up by
their words. Every question has an event, be it empty; nothing leaves its sample.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import hash_embedding
from ..functions.text import keywords
from . import scoring as S
from .memory import ordered
from .retrieval import rrf_fuse


@dataclass(frozen=True)
class Settings:
    """Pages and trajectories that a question takes; trajectories that make more unneeded, and the most that are added; the width
    that makes a page broad, and the most that such pages give; versions to each side of a seed."""

    pages: int = 2
    trajectories: int = 2
    enough: int = 3
    added: int = 24
    broad: int = 6
    broad_most: int = 6
    radius: int = 1


def build_index(claims: DataFrame, pages: DataFrame, members: DataFrame, edges: DataFrame, sources: DataFrame, messages: DataFrame, depth: int) -> dict[str, DataFrame]:
    """The tables of an index. ``claims``: sample_id, trajectory_id, snapshot_id, version, claim_id, text, status; ``pages``: sample_id, page_id,
    page_type, text, width; ``members``: page_id, trajectory_id; ``edges``: revisions (trajectory_id, claim_id, other_id); ``sources``:
    snapshot_id, message_id, position; ``messages``: sample_id, message_id, content, turn_index, role; ``depth``: most versions of a trajectory."""
    samples = claims.select("sample_id", "trajectory_id").distinct()
    others = F.max((F.col("page_type") != "index").cast("int")).over(Window.partitionBy("sample_id"))
    p = pages.withColumn("others", others).where((F.col("page_type") != "index") | (F.col("others") == 0)).drop("others", "page_type")
    none = F.array().cast("array<string>")
    p = p.select("sample_id", "page_id", "width", keywords(F.col("text")).alias("have"), S.names_in(F.col("text")).alias("names"), none.alias("items"), none.alias("values"), hash_embedding(F.col("text")).alias("text_vector"))
    own = claims.select("sample_id", "trajectory_id", "snapshot_id", "version", "text", "status", "claim_id")
    snapshots = own.groupBy("sample_id", "trajectory_id", "snapshot_id", "version").agg(F.array_join(ordered(F.col("text"), "claim_id"), " ").alias("text"), F.array_join(ordered(F.when(F.col("status") != "deprecated", F.col("text")), "claim_id"), " ").alias("live"), F.count_if(F.col("status") != "deprecated").alias("claims"))
    text = F.col("text")
    snapshots = snapshots.select("*", hash_embedding(text).alias("text_vector"), keywords(text).alias("have"), S.names_in(text).alias("names"), F.regexp_extract_all("text", F.lit("favorite color is ([a-z]+)"), F.lit(1)).alias("values"))
    every = claims.select("sample_id", "trajectory_id", "snapshot_id").distinct()
    reach = S.update_linked(every.select(F.col("snapshot_id").alias("query_id"), "trajectory_id", "snapshot_id"), claims, edges, depth)
    return {
        "trajectories": S.trajectory_signals(claims), "pages": p, "members": members.join(samples, "trajectory_id").select("sample_id", "page_id", "trajectory_id").distinct(), "snapshots": snapshots,
        "linked": reach.join(samples, "trajectory_id").select("sample_id", "trajectory_id", F.col("query_id").alias("snapshot_id"), F.col("snapshot_id").alias("other")),
        "sources": sources.join(every, "snapshot_id").select("sample_id", "snapshot_id", "message_id", "position"),
        "messages": S.with_words(messages),
    }


def write_index(index: dict[str, DataFrame], path: str, parts: int = 16) -> str:
    """Writes a new version of an index below ``path`` and gives its name. The version counts from the moment its own row is
    written, after all its tables."""
    version = uuid.uuid4().hex
    for name, df in index.items():
        dealt = df.withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int"))
        dealt.repartition("part").sortWithinPartitions("sample_id").write.partitionBy("part").parquet(f"{path.rstrip('/')}/{version}/{name}")
    spark = df.sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"), F.lit(",".join(index)).alias("tables")).write.mode("append").parquet(f"{path.rstrip('/')}/versions")
    return version


def read_index(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version of an index, the newest if none is named."""
    path = path.rstrip("/")
    known = spark.read.parquet(f"{path}/versions")
    row = known.where(F.col("version") == version).first() if version else known.orderBy(F.desc("written")).first()
    if row is None:
        raise ValueError(f"no version {version} of the index at {path}")
    return {name: spark.read.parquet(f"{path}/{row['version']}/{name}").drop("part") for name in row["tables"].split(",")}


def ranked_pages(questions: DataFrame, pages: DataFrame, widest: int) -> DataFrame:
    """(query_id, page_id, width, rank): the pages of a question's sample, as ``scoring.page_scores`` ranks them."""
    y = S.page_pairs(questions, pages, widest).withColumnRenamed("page_id", "id")
    return rrf_fuse(y, keep=("dense", "sparse", "width")).withColumnRenamed("id", "page_id").drop("fused", "dense", "sparse")


def keyed(rows: DataFrame, routings: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` for each of the routings (name, direct), with (query_id, routing) as their ``query_id``; as they are without routings."""
    if not routings:
        return rows
    return rows.withColumn("query_id", F.explode(F.array(*(F.struct("query_id", F.lit(name).alias("routing")) for name, _ in routings))))


def candidates(questions: DataFrame, chosen: DataFrame, index: dict[str, DataFrame], s: Settings, routings: list[tuple[str, bool]] = []) -> DataFrame:  # noqa: B006
    """(query_id, trajectory_id, latest_snapshot_id, origin, score, dense, sparse): what the chosen pages give, ``broad`` where broad pages
    alone do, and ``index`` others for questions with few. With ``routings`` (name, direct) the ids are those of ``keyed``, and a direct one
    takes every trajectory of its question's sample instead; a pair is scored once for all of them.

    A question brings its few pages and a trajectory those that list it, so that a pair is routed and scored where the sample's
    questions and trajectories meet; only its scores go on to the question's ranking.
    """
    routed = chosen.join(index["members"], "page_id").groupBy("query_id", "trajectory_id").agg(F.bool_and(F.col("width") > s.broad).alias("broad"))
    count = routed.groupBy("query_id").agg((F.count_if(~F.col("broad")) + F.least(F.count_if("broad"), F.lit(s.broad_most))).alias("n"))
    own = chosen.groupBy("query_id").agg(F.collect_list(F.struct("page_id", "width")).alias("chosen"))
    listed = index["members"].groupBy("trajectory_id").agg(F.collect_set("page_id").alias("pages"))
    asked = S.with_hashes(questions).join(own.join(count, "query_id", "left"), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    x = asked.join(S.with_hashes(index["trajectories"]).join(listed, "trajectory_id", "left"), "sample_id")
    routes = F.filter("chosen", lambda p: F.array_contains("pages", p.page_id))
    x = x.withColumn("routes", F.coalesce(F.transform(routes, lambda p: p.width > s.broad), F.array().cast("array<boolean>"))).drop("chosen", "pages")
    origin = F.when(F.size("routes") == 0, F.when(F.col("n") < s.enough, "index")).when(F.forall("routes", lambda b: b), "broad").otherwise("page")
    x = x.withColumn("origin", origin).drop("routes")
    if not any(direct for _, direct in routings):
        x = x.where("origin is not null")
    x = S.with_scores(S.with_overlap(S.with_event(S.with_family(x))))
    x = x.select("query_id", "trajectory_id", "latest_snapshot_id", "origin", "score", "dense", "sparse")
    if routings:
        ways = F.array(*(F.struct(F.struct("query_id", F.lit(name).alias("routing")).alias("query_id"), (F.lit("direct") if direct else F.col("origin")).alias("origin")) for name, direct in routings))
        x = x.withColumn("way", F.explode(ways)).where("way.origin is not null").select("way.query_id", "trajectory_id", "latest_snapshot_id", "way.origin", "score", "dense", "sparse")
    x = x.repartition("query_id")
    k = F.row_number().over(Window.partitionBy("query_id", "origin").orderBy(F.desc("score"), F.desc("trajectory_id")))
    most = F.when(F.col("origin").isin("page", "direct"), F.lit(1 << 30)).when(F.col("origin") == "broad", s.broad_most).otherwise(s.added)
    return x.withColumn("k", k).where((F.col("k") <= most) & ((F.col("origin") != "index") | (F.col("score") > 0))).drop("k")


def traced(questions: DataFrame, index: dict[str, DataFrame], s: Settings, stage: Callable[[str, DataFrame], DataFrame], routings: list[tuple[str, bool]] = []) -> dict[str, DataFrame]:  # noqa: B006
    """What each tier gives: ``pages``, ``trajectories`` (all candidates with their rank), ``snapshots`` (kept and not), ``messages``;
    for each of the ``routings`` if there are any, with the ids of ``keyed``."""
    paged = [r for r in routings if not r[1]]
    asked = questions if paged or not routings else questions.limit(0)
    chosen = stage("chosen_pages", ranked_pages(asked, index["pages"], s.broad).where(F.col("rank") <= s.pages))
    scored = candidates(questions, chosen, index, s, routings)
    best = rrf_fuse(scored.withColumnRenamed("trajectory_id", "id"), keep=("latest_snapshot_id",)).withColumnRenamed("id", "trajectory_id")
    best = stage("ranked_trajectories", best.select("query_id", "trajectory_id", "rank", "latest_snapshot_id"))
    seeds = best.where(F.col("rank") <= s.trajectories).select("query_id", "trajectory_id", F.col("latest_snapshot_id").alias("seed"), F.col("rank").cast("long").alias("seed_place"))
    snap = index["snapshots"]
    linked = index["linked"].groupBy("trajectory_id", F.col("snapshot_id").alias("seed")).agg(F.collect_set("other").alias("linked"))
    asked = keyed(questions.select("query_id", "question_vector", "terms", "entities", "listing"), routings)
    at = snap.select("trajectory_id", F.col("snapshot_id").alias("seed"), F.col("version").alias("at")).join(linked, ["trajectory_id", "seed"], "left")
    # a seed's question goes to its trajectory, whose snapshots it meets once; only scores go back to the question
    x = seeds.join(at, ["trajectory_id", "seed"]).join(S.with_hashes(asked), "query_id")
    x = x.join(S.with_hashes(snap.select("trajectory_id", "snapshot_id", "version", "have", "text_vector", "names", "values", "live", "claims")), "trajectory_id")
    is_seed = F.col("snapshot_id") == F.col("seed")
    reached = F.coalesce(F.array_contains("linked", F.col("snapshot_id")), F.lit(False))
    near = F.abs(F.col("version") - F.col("at")) <= s.radius
    kind = F.when(is_seed, "seed").when(reached, "update_linked").when(near, "neighbor")
    x = x.withColumns({"kind": kind, "place": F.when(is_seed, F.col("seed_place")).otherwise(0)}).where("kind is not null")
    kept = S.snapshot_scores(x, "kind", "place", "listing", "live", "claims").repartition("query_id")
    kept = stage("compacted", S.compact_snapshots(kept, "live", "claims", "place"))
    return {"pages": keyed(chosen, paged or routings), "trajectories": best, "snapshots": kept, "messages": S.compact_sources(kept, index["sources"].drop("sample_id"))}


def retrieve(questions: DataFrame, index: dict[str, DataFrame], settings: Settings = Settings(), stage: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """One event per question: (sample_id, query_id, page_ids, candidate_ids, trajectory_ids, expanded_ids, source_ids, rescued_ids, weak).

    ``questions`` are profiles (``scoring.question_profiles``). Ids come in rank order; ``stage`` may write what is read several times.
    """
    s, t = settings, traced(questions, index, settings, stage)
    chosen, best, kept, messages = t["pages"], t["trajectories"], t["snapshots"], t["messages"]
    seed = F.col("kind") == "seed"
    evidence = kept.groupBy("query_id").agg(F.array_join(ordered(F.when(seed & (F.col("claims") > 0), F.col("live")), "place"), " ").alias("texts"), F.sum(F.when(seed, F.col("claims"))).alias("claims"), F.count_if(seed).alias("snapshots"), F.countDistinct(F.when(seed, F.col("trajectory_id"))).alias("trajectories"))
    state = S.evidence_state(questions, evidence.withColumn("sources", F.col("claims")))
    weak = state.select("query_id", (F.col("weak") | F.col("semantic_weak")).alias("weak"))
    rescued = S.raw_rescue(questions.join(weak.where("weak"), "query_id", "left_semi"), index["messages"])

    ids = lambda df, c, name, by="rank": df.groupBy("query_id").agg(ordered(F.col(c), by).alias(name))
    lists = [
        ids(chosen, "page_id", "page_ids"), ids(best.where(F.col("rank") <= s.trajectories), "trajectory_id", "trajectory_ids"), best.groupBy("query_id").agg(F.array_sort(F.collect_list("trajectory_id")).alias("candidate_ids")),
        ids(kept.where("kept"), "snapshot_id", "expanded_ids", "order"), ids(messages, "message_id", "source_ids"), ids(rescued, "message_id", "rescued_ids"),
    ]
    # lists of one key each, brought together by one grouping
    names = ["page_ids", "candidate_ids", "trajectory_ids", "expanded_ids", "source_ids", "rescued_ids"]
    none = F.lit(None).cast("array<long>")
    rows = [df.select("query_id", *(F.col(n).cast("array<long>").alias(n) if n in df.columns else none.alias(n) for n in names), F.lit(None).cast("long").alias("sample_id"), F.lit(None).cast("boolean").alias("weak")) for df in lists]
    rows.append(questions.select("query_id", *(none.alias(n) for n in names), F.col("sample_id").cast("long").alias("sample_id"), F.lit(None).cast("boolean").alias("weak")))
    rows.append(weak.select("query_id", *(none.alias(n) for n in names), F.lit(None).cast("long").alias("sample_id"), "weak"))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    empty = F.array().cast("array<long>")
    return every.groupBy("query_id").agg(F.max("sample_id").alias("sample_id"), *(F.coalesce(F.max(n), empty).alias(n) for n in names), F.coalesce(F.bool_or("weak"), F.lit(True)).alias("weak"))
