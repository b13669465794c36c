"""Building memory: candidates that must be kept, claims and their changes, chains of snapshots, and their summaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import salience, spaced, temporal_match
from ..functions.text import keywords, normalize_answer
from .containment import found_in
from .memory import shown, sorted_set

#: What a faithful memory keeps: (category, relation, pattern); the surface is the pattern's group. A small configuration.
CANDIDATES = [
    ("activity", "went_to", r"(?i)\bwent to (?:a |an |the )?([a-z]+(?: [a-z]+)?)"),
    ("list", "enjoys", r"(?i)\benjoy ([a-z, ]+)"),
    ("preference", "favorite", r"(?i)\bfavorite [a-z]+ is ([a-z]+)"),
    ("count", "number", r"\b(\d+ [a-z]+)\b"),
    ("event", "met", r"\bmet ([A-Z][a-z]+)"),
]
#: Statuses of a claim from the least to the most cautious.
CAUTION = ["active", "deprecated", "needs-confirmation", "contradictory"]


def _rows() -> Column:
    return F.count(F.lit(1))


def candidates(messages: DataFrame) -> DataFrame:
    """(sample_id, category, relation, surface, temporal, message_ids): what the messages (sample_id, message_id, text) say
    that a memory must keep, one row per category, relation and surface; lists are cut into their items."""

    def found(category: str, relation: str, pattern: str) -> Column:
        surfaces = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        if category == "list":
            surfaces = F.flatten(F.transform(surfaces, lambda s: F.split(F.regexp_replace(F.trim(s), " and ", ", "), ", *")))
        return F.transform(surfaces, lambda s: F.struct(F.lit(category).alias("category"), F.lit(relation).alias("relation"), F.lower(F.trim(s)).alias("surface")))

    temporal = F.nullif(F.regexp_extract(F.lower("text"), r"\b(\d+ (?:day|week|month|year)s? ago|yesterday|today|last (?:week|month|year))\b", 1), F.lit(""))
    x = messages.select("sample_id", "message_id", temporal.alias("temporal"), F.inline(F.flatten(F.array(*(found(*c) for c in CANDIDATES))))).where("surface <> ''")
    return x.groupBy("sample_id", "category", "relation", "surface").agg(F.min("temporal").alias("temporal"), sorted_set("message_id").alias("message_ids"))


def _covers(text: Column, surface: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), normalize_answer(text), F.lit(" ")), F.concat(F.lit(" "), normalize_answer(surface), F.lit(" ")))


def preservation(wanted: DataFrame, claims: DataFrame) -> DataFrame:
    """Each candidate's state: ``covered`` by claims of its sample (text, and the time if it has one), ``weak`` if they don't
    rest on all its messages, else ``missing``. Claims: sample_id, text, source_message_id."""
    known = claims.select("sample_id", "text", "source_message_id").distinct().withColumn("said", normalize_answer(F.col("text")))
    asked = wanted.withColumn("norm", normalize_answer(F.col("surface")))
    met = found_in(asked.select("sample_id", F.col("norm").alias("surface")), known.select("sample_id", F.struct("text", "source_message_id").alias("text_id"), F.col("said").alias("text")), words=True).withColumnRenamed("surface", "norm")
    x = asked.join(met, ["sample_id", "norm"], "left")
    hit = F.col("text_id").isNotNull() & temporal_match(F.coalesce("temporal", F.lit("")), F.coalesce("text_id.text", F.lit("")))
    y = x.groupBy("sample_id", "category", "relation", "surface").agg(F.first("message_ids").alias("message_ids"), F.collect_set(F.when(hit, F.col("text_id.source_message_id"))).alias("by"))
    state = F.when(F.size("by") == 0, "missing").when(F.size(F.array_except("message_ids", "by")) > 0, "weak").otherwise("covered")
    return y.select("sample_id", "category", "relation", "surface", F.size("message_ids").alias("sources"), state.alias("state"))


def merged_surfaces(wanted: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims with the surfaces of the candidates that share their source message."""
    c = wanted.select("sample_id", "surface", F.explode("message_ids").alias("source_message_id"))
    x = claims.join(c, ["sample_id", "source_message_id"], "left")
    return x.groupBy("claim_id").agg(sorted_set("surface").alias("surfaces"))


def fallback_claims(wanted: DataFrame) -> DataFrame:
    """A claim for each different surface of a sample, with all its messages: memory without a model."""
    x = wanted.groupBy("sample_id", "surface").agg(F.min("category").alias("category"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("message_ids")))).alias("message_ids"))
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("surface"))
    return x.select("sample_id", n.cast("long").alias("claim_no"), "surface", "category", "message_ids", F.lit("active").alias("status"))


def match_features(messages: DataFrame, wanted: DataFrame, names: Column) -> DataFrame:
    """(sample_id, message_id): the keywords, names and surfaces that an incoming message is matched by."""
    s = wanted.select("sample_id", F.explode("message_ids").alias("message_id"), "surface", "category").groupBy("sample_id", "message_id").agg(sorted_set("surface").alias("surfaces"), sorted_set("category").alias("tags"))
    x = messages.select("sample_id", "message_id", F.array_sort(keywords(F.col("text"))).alias("terms"), F.array_sort(names).alias("names"))
    return x.join(s, ["sample_id", "message_id"], "left")


def facet_owners(claims: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each candidate's best claim among those that share a source: one whose text names it, active before others, then the
    least id; ``copied`` counts the active claims of the same sources that get it as well."""
    c = wanted.select("sample_id", "category", "surface", F.explode("message_ids").alias("source_message_id"))
    x = c.join(claims.select("sample_id", "source_message_id", "claim_id", "status", "text"), ["sample_id", "source_message_id"])
    score = 2 * _covers(F.col("text"), F.col("surface")).cast("int") + (F.col("status") == "active").cast("int")
    y = x.groupBy("sample_id", "category", "surface").agg(F.max(F.struct(score.alias("s"), (-F.col("claim_id")).alias("c"))).alias("best"), F.countDistinct(F.when(F.col("status") == "active", F.col("claim_id"))).alias("active"), F.collect_set(F.when(F.col("status") == "active", F.col("claim_id"))).alias("ids"))
    owner = -F.col("best.c")
    return y.select("sample_id", "category", "surface", owner.alias("claim_id"), F.size(F.array_except("ids", F.array(owner))).alias("copied"))


def claim_changes(claims: DataFrame, least: int = 2, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What each version of a trajectory changed in the claims of the version before.

    ``claims``: trajectory_id, version, claim_id, text, status. A claim of equal normalised text keeps its id: KEEP, or
    DEPRECATE or REVISE if its status changed; another one REVISEs the unmatched claim before it that shares the most
    keywords, at least ``least`` (ties by id), else it is an ADD; what nothing replaces is CARRYed forward.

    ``stage`` may write the matched versions, which are read three times, and give them back.
    """
    norm = normalize_answer(F.col("text"))
    nth = F.row_number().over(Window.partitionBy("trajectory_id", "version", "norm").orderBy("claim_id"))
    now = claims.select("trajectory_id", "version", "claim_id", "status", norm.alias("norm"), keywords(F.col("text")).alias("k")).withColumn("nth", nth)
    # an old claim counts in the version after its own, if its trajectory has that one
    have = F.collect_set("version").over(Window.partitionBy("trajectory_id"))
    old = now.withColumn("have", have).where("array_contains(have, version + 1)").select("trajectory_id", (F.col("version") + 1).alias("version"), F.col("claim_id").alias("old_id"), F.col("status").alias("old_status"), "norm", "nth", F.col("k").alias("old_k"))
    same = stage(now.join(old, ["trajectory_id", "version", "norm", "nth"], "full_outer").select("trajectory_id", "version", "claim_id", "old_id", "status", "old_status", "k", "old_k"))
    fresh, gone = same.where("old_id is null").select("trajectory_id", "version", "claim_id", "k"), same.where("claim_id is null").select("trajectory_id", "version", "old_id", "old_k")
    near = fresh.join(gone, ["trajectory_id", "version"]).withColumn("shared", F.size(F.array_intersect("k", "old_k"))).where(F.col("shared") >= least)
    # one claim replaces one: the best of both sides
    a = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("shared"), "old_id"))
    b = F.row_number().over(Window.partitionBy("old_id").orderBy(F.desc("shared"), "claim_id"))
    near = stage(near.withColumns({"a": a, "b": b}).where("a = 1 and b = 1").select("claim_id", F.col("old_id").alias("revised")))
    new, replaced = near, near.select(F.col("revised").alias("old_id"), F.lit(1).alias("done"))
    x = same.join(new, "claim_id", "left").join(replaced, "old_id", "left").where("done is null OR claim_id is not null")
    changed = F.when(F.col("status") == F.col("old_status"), "KEEP").when(F.col("status") == "deprecated", "DEPRECATE").otherwise("REVISE")
    op = F.when(F.col("claim_id").isNull(), "CARRY").when(F.col("old_id").isNotNull(), changed).when(F.col("revised").isNotNull(), "REVISE").otherwise("ADD")
    return x.select("trajectory_id", "version", "claim_id", F.coalesce("old_id", "revised").alias("old_id"), op.alias("op"))


def zero_claim_policy(snapshots: DataFrame, claims: DataFrame) -> DataFrame:
    """Snapshots (snapshot_id, text) without a claim: kept if what was said is worth it, with the reason, else skipped."""
    x = snapshots.join(claims.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    why = salience(F.col("text"))
    return x.select("snapshot_id", why.alias("reason"), (why != "none").alias("kept"))


def lifecycle(changes: DataFrame, claims: DataFrame) -> DataFrame:
    """Changes (ADD, REVISE, DEPRECATE) with their sample, source and a short text of the claim."""
    c = claims.select("sample_id", "claim_id", "source_message_id", F.substring(spaced(F.col("text")), 1, 40).alias("rationale"))
    return changes.where("op in ('ADD', 'REVISE', 'DEPRECATE')").join(c, "claim_id").select("sample_id", "trajectory_id", "version", "claim_id", "op", "old_id", "source_message_id", "rationale")


def signal_summary(claims: DataFrame, suspects: DataFrame, wanted: DataFrame, names: Column) -> DataFrame:
    """Per trajectory the names, surfaces, categories and counts of its active claims that are not suspect."""
    good = claims.where("status = 'active'").join(suspects.where("suspect").select("claim_id"), "claim_id", "left_anti")
    s = wanted.select("sample_id", "category", "surface", F.explode("message_ids").alias("source_message_id"))
    x = good.withColumn("names", names).join(s, ["sample_id", "source_message_id"], "left")
    return x.groupBy("trajectory_id").agg(F.countDistinct("claim_id").alias("claims"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), sorted_set("surface").alias("surfaces"), sorted_set("category").alias("tags"))


def retrieval_summary(summary: DataFrame, texts: DataFrame, template: list[str]) -> DataFrame:
    """A trajectory's text in four sections (who, what, kinds, latest) and its keywords without the sections' own words.
    ``texts``: trajectory_id, latest."""
    x = summary.join(texts, "trajectory_id")
    line = lambda head, c: F.concat(F.lit(f"{head}: "), F.array_join(c, ", "))
    text = F.concat_ws("\n", line("Who", "names"), line("What", "surfaces"), line("Kinds", "tags"), F.concat(F.lit("Latest: "), "latest"))
    kept = F.array_sort(F.array_except(keywords(text), F.array(*map(F.lit, template))))
    return x.select("trajectory_id", text.alias("text"), shown(kept).alias("keywords"))


def historical_cards(claims: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per trajectory the surfaces of all its versions, those that its latest version no longer has, and the messages of
    both as anchors."""
    s = wanted.select("sample_id", "surface", F.explode("message_ids").alias("source_message_id"))
    top = F.max("version").over(Window.partitionBy("trajectory_id"))
    x = claims.withColumn("top", top).join(s, ["sample_id", "source_message_id"])
    y = x.groupBy("trajectory_id").agg(sorted_set("surface").alias("surfaces"), F.collect_set(F.when(F.col("version") == F.col("top"), F.col("surface"))).alias("now"), sorted_set("source_message_id").alias("anchors"))
    return y.select("trajectory_id", "surfaces", F.array_sort(F.array_except("surfaces", "now")).alias("drifted"), "anchors")


#: Weights of a match with an open trajectory, the score that continues one, and how many open ones are scored.
SUMMARY, LATEST, WORDS, CONTINUE, SHORTLIST = 0.6, 0.2, 0.2, 0.72, 32
CHAIN_SCHEMA = "sample_id long, message_id long, trajectory_id long, version long, score double"


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class Chains:
    """The open trajectories of one sample: what a batch job and a stream both keep between messages."""

    def __init__(self, most: int, state: list | None = None, first: int = 0):
        self.most, self.next = most, first
        self.open: dict[int, list] = {int(t): [set(words), set(latest), int(n)] for t, words, latest, n in state or []}

    def add(self, words: set[str], names: set[str], least: float = CONTINUE) -> tuple[int, int, float]:
        """The trajectory, version and score that a message gets; a trajectory closes when it is full."""
        near = sorted(self.open, key=lambda t: (-len(words & self.open[t][0]) - 2 * len(names & self.open[t][0]), t))[:SHORTLIST]
        scored = [(round(SUMMARY * _jaccard(words, self.open[t][0]) + LATEST * _jaccard(words, self.open[t][1]) + WORDS * (len(words & self.open[t][0]) / max(1, len(words))) + 0.10 * bool(names & self.open[t][0]), 9), -t) for t in near]
        best, at = max(scored, default=(0.0, 0))
        if best >= least:
            at = -at
        else:
            at, self.next = self.next, self.next + 1
            self.open[at] = [set(), set(), 0]
        chain = self.open[at]
        chain[0] |= words
        chain[1], chain[2] = words, chain[2] + 1
        n = chain[2]
        if n >= self.most:
            del self.open[at]
        return at, n, best

    def state(self) -> list:
        return [(t, sorted(a), sorted(b), n) for t, (a, b, n) in sorted(self.open.items())]


def build_trajectories(messages: DataFrame, most: int, least: float = CONTINUE) -> DataFrame:
    """(sample_id, message_id, terms, names) -> (sample_id, message_id, trajectory_id, version, score): each message, in order
    of id, continues the open trajectory of its sample that it fits best, or opens one; a trajectory of ``most`` versions is
    closed. Sequential within a sample, parallel over samples, whose open trajectories are all that is held."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chains, out = Chains(most), []
        for r in rows.sort_values("message_id").itertuples():
            t, n, score = chains.add(set(r.terms), set(r.names), least)
            out.append((key[0], r.message_id, key[0] * 100_000 + t, n, score))
        return pd.DataFrame(out, columns=["sample_id", "message_id", "trajectory_id", "version", "score"])

    return messages.select("sample_id", "message_id", "terms", "names").groupBy("sample_id").applyInPandas(run, CHAIN_SCHEMA)


def matched_trajectory(incoming: DataFrame, chains: DataFrame) -> DataFrame:
    """(sample_id, message_id, terms, names) against open trajectories (sample_id, trajectory_id, words, latest): the best that
    reaches ``CONTINUE``, null if none does; only trajectories that share a word or name are scored."""
    x = incoming.join(chains, "sample_id").where(F.arrays_overlap("terms", "words"))
    size = lambda a, b: F.size(F.array_intersect(a, b))
    jac = lambda a, b: F.coalesce(F.try_divide(size(a, b), F.size(F.array_union(a, b))), F.lit(0.0))
    order = F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc(size("terms", "words") + 2 * size("names", "words")), "trajectory_id"))
    score = F.round(SUMMARY * jac("terms", "words") + LATEST * jac("terms", "latest") + WORDS * F.try_divide(size("terms", "words"), F.size("terms")) + F.when(size("names", "words") > 0, 0.10).otherwise(0.0), 9)
    x = x.withColumn("place", order).where(F.col("place") <= SHORTLIST).withColumn("score", score)
    best = x.groupBy("message_id").agg(F.max(F.struct("score", (-F.col("trajectory_id")).alias("t"))).alias("b"))
    y = incoming.select("message_id").join(best, "message_id", "left")
    return y.select("message_id", F.when(F.col("b.score") >= CONTINUE, -F.col("b.t")).alias("trajectory_id"), F.col("b.score").alias("score"))


def op_counts(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per sample the changes of each kind, zero where a sample has none."""
    own = snapshots.select("trajectory_id", "sample_id").distinct()
    kinds = ["ADD", "REVISE", "DEPRECATE", "KEEP", "CARRY"]
    x = own.join(changes, "trajectory_id", "left").groupBy("sample_id").agg(*(F.count_if(F.col("op") == k).alias(k.lower()) for k in kinds))
    return x


