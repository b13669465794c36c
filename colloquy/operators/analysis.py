"""Reports over memories, rankings, calls and outcomes: one plan each, grouped before anything is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, judge_score, keywords, overlap, phase_for_task
from . import dense


def _rows() -> Column:
    return F.count(F.lit(1))


def _mean(c: Column) -> Column:
    return F.round(F.avg(c), 9)


def source_refs(text: Column) -> Column:
    """Distinct references such as D1:2, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bD\d+:\d+\b"), F.lit(0)))


def history_fingerprints(messages: DataFrame) -> DataFrame:
    """SHA-256 of each sample's messages in turn order: equal histories, equal fingerprints."""
    line = F.struct("turn_index", F.concat_ws(":", "role", "content").alias("line"))
    return messages.groupBy("sample_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x.line), "\n"), 256).alias("fingerprint"))



def question_overlap(queries: DataFrame, messages: DataFrame) -> DataFrame:
    """Keyword Jaccard of each query with the messages of its sample."""
    x = messages.join(queries.select("sample_id", "query_id", "question"), "sample_id")
    return x.select("query_id", "message_id", F.round(overlap(keywords(F.col("question")), keywords(F.col("content"))), 9).alias("score"))


def source_date(text: Column) -> Column:
    """A date written like ``7 May, 2023`` anywhere in the text, else an ISO date at its start; null if neither."""
    long = F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]+, \d{4})", 1)
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(long, F.lit("")), F.lit("d MMMM, yyyy")), F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd"))).cast("date")


def judge_verdict(text: Column) -> Column:
    """The word behind ``VERDICT:``, or a text that is nothing but a verdict; judge_error otherwise."""
    found = F.regexp_extract(text, r"(?i)^(?:\s*verdict:\s*)?(correct|partial|incorrect)\s*$", 1)
    return F.when(found == "", "judge_error").otherwise(F.lower(found))


def transition_shortlist(claims: DataFrame, snapshots: DataFrame, most: int = 3) -> DataFrame:
    """For each claim the claims of its trajectory's version before that share keywords, best ``most``; ties by id."""
    now = claims.join(snapshots.select("snapshot_id", "version"), "snapshot_id").select("trajectory_id", "claim_id", "version", keywords(F.col("text")).alias("k"))
    old = now.select("trajectory_id", (F.col("version") + 1).alias("version"), F.col("claim_id").alias("previous_id"), F.col("k").alias("p"))
    x = now.join(old, ["trajectory_id", "version"]).withColumn("shared", F.size(F.array_intersect("k", "p"))).where("shared > 0")
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("shared"), "previous_id"))
    return x.withColumn("rank", rank).where(F.col("rank") <= most).select("claim_id", "previous_id", "shared", "rank")


def build_summary(snapshots: DataFrame, claims: DataFrame) -> DataFrame:
    """Per sample: trajectories, mean length, and the share of snapshots with a disputed claim."""
    bad = claims.where(F.col("status").isin("contradictory", "needs-confirmation")).select("snapshot_id").distinct().withColumn("bad", F.lit(1.0))
    x = snapshots.join(bad, "snapshot_id", "left").groupBy("sample_id", "trajectory_id").agg(_rows().alias("n"), F.count("bad").alias("bad"))
    return x.groupBy("sample_id").agg(_rows().alias("trajectories"), _mean(F.col("n")).alias("mean_length"), F.round(F.sum("bad") / F.sum("n"), 9).alias("conflict_ratio"))


def candidate_union(pages: DataFrame) -> DataFrame:
    """Distinct trajectories of a sample's pages, in the order of their first page, then by id."""
    first = pages.groupBy("sample_id", "trajectory_id").agg(F.min("page_id").alias("page_id"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("sample_id").orderBy("page_id", "trajectory_id")))


def backtracks(ranked: DataFrame) -> DataFrame:
    """How often the turn goes back in the emitted order, as a count and a share of the steps."""
    step = F.col("turn_index") < F.lag("turn_index").over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("back", step).groupBy("query_id").agg(F.count_if("back").alias("backtracks"), F.round(F.coalesce(F.try_divide(F.count_if("back"), _rows() - 1), F.lit(0.0)), 9).alias("rate"))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` vectors of a query's sample with the highest cosine; ties (to six places) by id. Every pair is compared, in blocks.

    Pairs without a cosine (no direction, another length) come last, with a null score.
    """
    kind = lambda c: F.when(dense.usable(c), F.size(c)).alias("length")
    q = queries.where("sample_id is not null").select("sample_id", kind("query"), "query_id", "query")
    v = vectors.where("sample_id is not null").select("sample_id", kind("embedding"), "snapshot_id", "embedding")
    by = F.struct("sample_id", "length").alias("by")
    found = dense.all_pairs(q.select(by, "query_id", "query"), v.select(by, F.col("snapshot_id").alias("vec_id"), "embedding"), k)
    found = found.select("query_id", F.col("vec_id").alias("snapshot_id"), "score", "rank")
    # queries with fewer than k cosines take the least ids of the other vectors of their sample
    comparable = v.where("length is not null").groupBy("sample_id", "length").agg(_rows().alias("n"))
    n = q.join(comparable, ["sample_id", "length"], "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") < k)
    place = F.row_number().over(Window.partitionBy("sample_id", "length").orderBy("snapshot_id"))
    least = v.select("sample_id", F.col("length").alias("own"), "snapshot_id", place.alias("place")).where(F.col("place") <= k)
    rest = q.select("sample_id", "length", "query_id").join(n, "query_id").join(least, "sample_id").where("length is null or own is null or own <> length")
    rank = (F.col("n") + F.row_number().over(Window.partitionBy("query_id").orderBy("snapshot_id"))).cast("int")
    rest = rest.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.unionByName(rest.select("query_id", "snapshot_id", F.lit(None).cast("double").alias("score"), "rank"))


def judge_accuracy(outcomes: DataFrame) -> DataFrame:
    """Per variant the mean judge score and the strict share of correct verdicts."""
    return outcomes.groupBy("variant").agg(_mean(judge_score(F.col("verdict"))).alias("score"), _mean((F.col("verdict") == "correct").cast("double")).alias("accuracy"))


def split_usage(calls: DataFrame) -> DataFrame:
    """A sample's memory phase divided by its queries: calls and latency as fractions, tokens rounded down."""
    n = calls.where("sample_id is not null").groupBy("sample_id").agg(F.countDistinct("query_id").alias("queries")).where("queries > 0")
    built = calls.where(phase_for_task(F.col("task")) == "memory").groupBy("sample_id").agg(_rows().alias("c"), F.sum("latency_ms").alias("l"), F.sum("completion_tokens").alias("t"))
    q = F.col("queries")
    return n.join(built, "sample_id").select("sample_id", "queries", F.round(F.col("c") / q, 9).alias("calls"), F.round(F.col("l") / q, 3).alias("latency_ms"), F.floor(F.col("t") / q).alias("tokens"))



def required_rank(gold: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per query the highest version that holds gold evidence."""
    x = gold.join(snapshots.select("sample_id", "source_ref", "version"), ["sample_id", "source_ref"])
    return x.groupBy("query_id").agg(F.max("version").cast("long").alias("required_rank"))


def snapshot_cdf(required: DataFrame) -> DataFrame:
    """Per rank from 1 to the highest: queries newly covered, and the share covered so far. Empty ranks have a row."""
    per = required.groupBy("required_rank").agg(_rows().alias("newly"))
    ends = per.agg(F.max("required_rank").alias("last"), F.sum("newly").alias("all"))
    grid = ends.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("required_rank"), "all")
    run = F.sum("newly").over(Window.orderBy("required_rank").rowsBetween(Window.unboundedPreceding, 0))  # one row for each rank
    x = grid.join(per, "required_rank", "left").withColumn("newly", F.coalesce("newly", F.lit(0)))
    return x.select(F.col("required_rank").alias("rank"), "newly", F.round(run / F.col("all"), 9).alias("covered"))


def compact_calls(calls: DataFrame) -> DataFrame:
    """A call's usage; the total only if both parts are known."""
    return calls.select("call_item_uid", phase_for_task(F.col("task")).alias("phase"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))



def call_scopes(calls: DataFrame) -> DataFrame:
    """Calls by the narrowest scope that they name: query, sample or shared."""
    scope = F.when(F.col("query_id").isNotNull(), "query").when(F.col("sample_id").isNotNull(), "sample").otherwise("shared")
    return calls.groupBy(scope.alias("scope")).agg(_rows().alias("calls"), F.sum("completion_tokens").alias("tokens"))


def memory_scaling(messages: DataFrame, snapshots: DataFrame, claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Per sample: messages, tokens, trajectories, snapshots, claims and pages."""
    x = messages.groupBy("sample_id").agg(_rows().alias("messages"), F.sum(estimate_tokens(F.col("content"))).alias("tokens"))
    s = snapshots.groupBy("sample_id").agg(F.countDistinct("trajectory_id").alias("trajectories"), _rows().alias("snapshots"))
    c = claims.groupBy("sample_id").agg(_rows().alias("claims"))
    p = pages.groupBy("sample_id").agg(F.countDistinct("page_id").alias("pages"))
    out = x.join(s, "sample_id", "left").join(c, "sample_id", "left").join(p, "sample_id", "left").na.fill(0)
    return out.withColumn("mean_length", F.round(F.try_divide("snapshots", "trajectories"), 9))


def _labels(outcomes: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    side = lambda v, name, *more: outcomes.where(F.col("variant") == v).select("query_id", F.col("verdict").alias(name), *more)
    return side(a, "a", *keep).join(side(b, "b"), "query_id")


def cohen_kappa(outcomes: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters' verdicts beyond chance, from their contingency table."""
    cell = _labels(outcomes, a, b, []).groupBy("a", "b").agg(_rows().alias("n"))
    n = cell.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    rows = cell.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("x"))
    cols = cell.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "v").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    x = n.crossJoin(chance).withColumns({"po": F.col("same") / F.col("n"), "pe": F.col("xy") / (F.col("n") * F.col("n"))})  # one row each
    return x.select(F.col("n").alias("pairs"), F.round("po", 9).alias("agreement"), F.round(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 9).alias("kappa"))


def binary_metrics(outcomes: DataFrame, predicted: str, label: str) -> DataFrame:
    """Per stratum: accuracy, precision, recall and F1 of "correct" against another variant's; null without a base."""
    x = _labels(outcomes, predicted, label, ["stratum"]).select("stratum", (F.col("a") == "correct").alias("p"), (F.col("b") == "correct").alias("g"))
    m = x.groupBy("stratum").agg(_rows().alias("n"), F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if("p").alias("pp"), F.count_if("g").alias("gp"), F.count_if(F.col("p") == F.col("g")).alias("same"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 9)
    return m.select("stratum", "n", ratio(F.col("same"), F.col("n")).alias("accuracy"), ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("gp")).alias("recall"), ratio(2 * F.col("tp"), F.col("pp") + F.col("gp")).alias("f1"))


def topk_coverage(ranked: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Per query: gold trajectories, those ranked within ``k`` and at all, and whether all could be found."""
    x = targets.join(ranked.select("query_id", "trajectory_id", "rnk"), ["query_id", "trajectory_id"], "left")
    n = x.groupBy("query_id").agg(_rows().alias("gold"), F.count_if(F.col("rnk") <= k).alias("in_top"), F.count("rnk").alias("in_pool"))
    return n.select("*", F.round(F.col("in_top") / F.col("gold"), 9).alias("recall"), (F.col("in_pool") == F.col("gold")).alias("coverable"))


def length_stats(snapshots: DataFrame, limit: int) -> DataFrame:
    """Trajectory lengths: mean, nearest-rank median, p90 and p95, maximum, and the share at the limit."""
    n = snapshots.groupBy("trajectory_id").agg(_rows().alias("n"))
    size = n.groupBy("n").agg(_rows().alias("c"))  # one row for each length
    before = F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    x = size.withColumn("upto", before).withColumn("all", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("all")), F.col("n")))
    return x.agg(F.sum("c").alias("trajectories"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 9).alias("mean"), at(0.5).alias("median"), at(0.9).alias("p90"), at(0.95).alias("p95"), F.max("n").alias("longest"), F.round(F.sum(F.when(F.col("n") >= limit, F.col("c")).otherwise(0)) / F.sum("c"), 9).alias("at_limit"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """Per drift bucket: trajectories, mean length and head-tail cosine."""
    return drift.groupBy("bucket").agg(_rows().alias("trajectories"), _mean(F.col("length")).alias("mean_length"), F.round(F.avg("head_tail"), 5).alias("head_tail"))


def low_drift_examples(drift: DataFrame, most: int = 10) -> DataFrame:
    """The trajectories of lowest head-tail cosine, singletons excluded; a top-k report."""
    return drift.where("bucket <> 'singleton' and head_tail is not null").orderBy("head_tail", "trajectory_id", *(c for c in ("sample_id",) if c in drift.columns)).limit(most).select("trajectory_id", "head_tail")


def complete_weighted_metric(outcomes: DataFrame) -> DataFrame:
    """Per variant the mean coverage weighted by the strata's shares; null unless every query of every stratum has one."""
    s = outcomes.groupBy("variant", "stratum").agg(_rows().alias("n"), F.count("gold_ref_coverage").alias("seen"), F.avg("gold_ref_coverage").alias("m"))
    whole = F.sum("n") == F.sum("seen")
    return s.groupBy("variant").agg(F.sum("n").alias("n"), F.sum("seen").alias("observed"), F.when(whole, F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6)).alias("coverage"))


def token_budget_audit(outcomes: DataFrame, envelope: int) -> DataFrame:
    """Per variant: prompts within the envelope and beyond it, without usage, and those that use less than 90 % of it."""
    t = F.col("prompt_tokens")
    return outcomes.groupBy("variant").agg(F.count_if(t <= envelope).alias("passed"), F.count_if(t > envelope).alias("failed"), F.count_if(t.isNull()).alias("unavailable"), F.count_if(t < 0.9 * envelope).alias("underused"))


def first_refs(*fields: Column) -> Column:
    """The distinct references of the first field that has any."""
    none = F.array().cast("array<string>")
    out = none
    for f in reversed(fields):
        refs = F.coalesce(source_refs(f), none)
        out = F.when(F.size(refs) > 0, refs).otherwise(out)
    return out
