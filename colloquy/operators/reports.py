"""Selections, grids, funnels, samples and integrity reports, each a grouped plan without rows for all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import covers_item
from ..functions.text import judge_score, normalize_answer, phase_for_task
from .containment import found_in
from .evaluation import interval, metric_deltas, resampled
from .results import provider_key


def _rows() -> Column:
    return F.count(F.lit(1))


def _literals(values: list) -> Column:
    return F.array(*map(F.lit, values))


def hashed_order(*keys: str) -> Column:
    """A repeatable random order: the MD5 of the keys."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))


def first_groups(rows: DataFrame, group: str, position: str, most: int) -> DataFrame:
    """The rows of the first ``most`` groups by first appearance, with the group's place; the number is the feature."""
    firsts = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(position).alias("first")).orderBy("first", group).limit(most)
    place = firsts.withColumn("place", F.row_number().over(Window.orderBy("first", group)))  # ``most`` rows
    return rows.join(F.broadcast(place.select(group, "place")), group)


def round_robin(rows: DataFrame, group: str, position: str, most: int) -> DataFrame:
    """One row of each group in turn, groups by name, until there are ``most``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(position))
    x = rows.withColumn("turn", turn).where(F.col("turn") <= most)
    return x.orderBy("turn", group).limit(most)


def exclusion_report(rows: DataFrame, reason: Column) -> DataFrame:
    """Excluded rows by reason; a null reason is no exclusion."""
    return rows.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(_rows().alias("n"))


def deprecated_hits(answers: DataFrame, claims: DataFrame, least: int = 12) -> DataFrame:
    """(query_id, sample_id, answer): whether a deprecated claim's whole normalised text, if long enough, stands in it."""
    shown = normalize_answer(F.col("text"))
    old = claims.where("status = 'deprecated'").select("sample_id", shown.alias("shown")).where(F.length("shown") >= least).distinct()
    said = answers.select("sample_id", F.col("query_id").alias("text_id"), normalize_answer(F.col("answer")).alias("text"))
    hits = found_in(old.withColumnRenamed("shown", "surface"), said).select(F.col("text_id").alias("query_id"), F.lit(True).alias("hit")).distinct()
    return answers.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def snapshot_texts(snapshots: DataFrame, claims: DataFrame) -> DataFrame:
    """A snapshot and its claims as a text: active claims, then uncertain, then deprecated, each by id."""
    section = F.when(F.col("status") == "active", 0).when(F.col("status") == "deprecated", 2).otherwise(1)
    line = F.struct(section.alias("s"), "claim_id", F.concat(F.lit("- ["), "status", F.lit("] "), F.col("claim_id").cast("string"), F.lit(": "), "text").alias("line"))
    lines = claims.groupBy("snapshot_id").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x.line).alias("lines"))
    x = snapshots.select("snapshot_id").join(lines, "snapshot_id", "left")
    head = F.concat(F.lit("Episodic Snapshot "), F.col("snapshot_id").cast("string"))
    return x.select("snapshot_id", F.concat_ws("\n", head, "lines").alias("block"))


def medium_chunks(members: DataFrame, group: str, member: str, widest: int = 6, target: int = 4, least: int = 3) -> DataFrame:
    """Groups wider than ``widest`` cut into chunks of ``target``; a last chunk under ``least`` joins the one before
    if both fit within ``widest``."""
    x = members.select(group, member).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    x = x.withColumns({"i": F.row_number().over(Window.partitionBy(group).orderBy(member)) - 1, "n": n})
    chunk, tail = F.floor(F.col("i") / target), F.col("n") % target
    last = F.floor((F.col("n") - 1) / target)
    joins = (tail > 0) & (tail < least) & (tail + target <= widest) & (chunk == last)
    return x.select(group, member, F.when(F.col("n") <= widest, F.lit(0)).when(joins, last - 1).otherwise(chunk).cast("long").alias("chunk"))


def page_widths(pages: DataFrame) -> DataFrame:
    """How many pages of each type have each width."""
    width = pages.groupBy("page_type", "page_id").agg(F.countDistinct("trajectory_id").alias("width"))
    return width.groupBy("page_type", "width").agg(_rows().alias("pages"))


def rank_fill(preferred: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Preferred ids of a query first (by id), then the pool in its order, ``k`` distinct ids in all."""
    both = preferred.select("query_id", "trajectory_id", F.lit(0).alias("tier"), F.col("trajectory_id").alias("at")).unionByName(pool.select("query_id", "trajectory_id", F.lit(1).alias("tier"), F.col("rnk").cast("long").alias("at")))
    x = both.groupBy("query_id", "trajectory_id").agg(F.min(F.struct("tier", "at")).alias("best"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "trajectory_id"))
    return x.withColumn("place", place).where(F.col("place") <= k).select("query_id", "trajectory_id", "place")


def truncated_items(ranked: DataFrame, budget: int) -> DataFrame:
    """Items within the budget; the first that overflows it is kept in part, those behind it go."""
    before = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    x = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget)
    kept = F.least(F.col("tokens"), budget - F.col("before"))
    return x.select("query_id", "message_id", "rank", kept.alias("kept"), (kept < F.col("tokens")).alias("truncated"))


def ranked_row_log(ranked: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each ranking, how many there were, and whether some were left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return ranked.withColumn("total", n).where(F.col("rnk") <= most).select("query_id", "trajectory_id", "rnk", "total", (F.col("total") > most).alias("truncated"))


def chunk_spans(messages: DataFrame, width: int, overlap: int) -> DataFrame:
    """Token windows over each sample's messages and the messages that each touches.

    A message is an interval of its sample's token count, so it names its windows by arithmetic and no join is made.
    Messages without tokens touch none.
    """
    step = width - overlap
    end = F.sum("tokens").over(Window.partitionBy("sample_id").orderBy("turn_index", "message_id").rowsBetween(Window.unboundedPreceding, 0))
    x = messages.where("tokens > 0").withColumn("end", end).withColumn("start", F.col("end") - F.col("tokens"))
    first = F.greatest(F.lit(0), F.floor((F.col("start") - width) / step) + 1)
    x = x.withColumn("chunk", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / step))))
    return x.groupBy("sample_id", "chunk").agg(_rows().alias("messages"), F.min("message_id").alias("first_message"), F.max("message_id").alias("last_message"))


def stratum_grid(outcomes: DataFrame, strata: list[str]) -> DataFrame:
    """Per variant and stratum rows and mean judge score; every listed stratum has a row, with or without data."""
    per = outcomes.groupBy("variant", "stratum").agg(_rows().alias("n"), F.round(F.avg(judge_score(F.col("verdict"))), 9).alias("judge"))
    grid = per.select("variant").distinct().withColumn("stratum", F.explode(_literals(strata)))
    return grid.join(per, ["variant", "stratum"], "left").select("variant", "stratum", F.coalesce("n", F.lit(0)).alias("n"), "judge")


def vote_majority(outcomes: DataFrame, baseline: str) -> DataFrame:
    """Per query the other variants' votes; ties are correct, no votes null."""
    yes, n = F.count_if(F.col("verdict") == "correct"), F.count("verdict")
    x = outcomes.where(F.col("variant") != baseline).groupBy("query_id").agg(yes.alias("yes"), n.alias("votes"))
    return x.select("query_id", "yes", "votes", F.when(F.col("votes") > 0, 2 * F.col("yes") >= F.col("votes")).alias("majority"))


def judge_counts(outcomes: DataFrame) -> DataFrame:
    """Per variant: rows with a verdict that counts, and each kind of verdict."""
    v = F.col("verdict")
    return outcomes.groupBy("variant").agg(F.count(judge_score(v)).alias("evaluable"), F.count_if(v == "correct").alias("correct"), F.count_if(v == "partial").alias("partial"), F.count_if(v == "incorrect").alias("failed"))







def calls_from_usage(calls: DataFrame) -> DataFrame:
    """One pseudo call for each query and task, with the sums of its usage."""
    return calls.where("query_id is not null").groupBy("query_id", "task").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def repair_summary(calls: DataFrame) -> DataFrame:
    """Per phase and role: repair calls, their tokens, and their share of the calls."""
    repair = F.col("task").contains("repair")
    return calls.groupBy(phase_for_task(F.col("task")).alias("phase"), "role").agg(F.count_if(repair).alias("repairs"), F.coalesce(F.sum(F.when(repair, F.col("completion_tokens"))), F.lit(0)).alias("tokens"), F.round(F.avg(repair.cast("double")), 9).alias("share"))



def quota_sample(rows: DataFrame, group: str, key: str, quota: int) -> DataFrame:
    """``quota`` rows of each group in a hashed order (all, if there are fewer): a sampling operator."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hashed_order(group, key), key))
    return rows.withColumn("place", place).where(F.col("place") <= quota).select(group, key, "place")


def counterbalanced_tasks(cases: DataFrame, key: str) -> DataFrame:
    """Two annotators and two conditions for each case; which condition comes first alternates."""
    x = cases.select(key).withColumn("annotator", F.explode(_literals([0, 1]))).withColumn("position", F.explode(_literals([0, 1])))
    return x.withColumn("condition", F.when((F.col(key) + F.col("annotator") + F.col("position")) % 2 == 0, "packet").otherwise("dialogue"))


def transition_examples(outcomes: DataFrame, before: str, after: str, each: int) -> DataFrame:
    """The first ``each`` queries, by id, of every change of verdict between two variants."""
    side = lambda v, name: outcomes.where(F.col("variant") == v).select("query_id", F.col("verdict").alias(name))
    x = side(before, "before").join(side(after, "after"), "query_id").where("before <> after")
    place = F.row_number().over(Window.partitionBy("before", "after").orderBy("query_id"))
    return x.withColumn("place", place).where(F.col("place") <= each)


def stratum_summary(outcomes: DataFrame) -> DataFrame:
    """Per variant and stratum the means and how many rows each rests on."""
    s = judge_score(F.col("verdict"))
    return outcomes.groupBy("variant", "stratum").agg(_rows().alias("n"), F.count(s).alias("judged"), F.round(F.avg(s), 9).alias("judge"), F.count("gold_ref_coverage").alias("covered"), F.round(F.avg("gold_ref_coverage"), 6).alias("coverage"))



def run_integrity(calls: DataFrame, gold: DataFrame, messages: DataFrame) -> DataFrame:
    """Findings by kind: repeated call ids, provider calls of several workers, gold references outside their sample."""
    again = calls.groupBy("call_item_uid").agg(_rows().alias("n")).where("n > 1").agg(_rows().alias("n"))
    mixed = calls.groupBy("provider_call_uid").agg(F.min("worker_id").alias("a"), F.max("worker_id").alias("b")).where("a <> b").agg(_rows().alias("n"))
    foreign = gold.join(messages, ["sample_id", "source_ref"], "left_anti").agg(_rows().alias("n"))
    kinds = {"duplicate_call_id": again, "mixed_worker": mixed, "foreign_source": foreign}
    named = [df.select(F.lit(kind).alias("finding"), "n") for kind, df in kinds.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def missing_cells(outcomes: DataFrame, variants: list[str]) -> DataFrame:
    """Per variant the queries of the run that it lacks; the grid is checked by counting each query's variants."""
    have = outcomes.where(F.col("variant").isin(variants)).groupBy("query_id").agg(F.collect_set("variant").alias("have"))
    gone = have.select(F.explode(F.array_except(_literals(variants), "have")).alias("variant"))
    return gone.groupBy("variant").agg(_rows().alias("missing"))


def last_events(calls: DataFrame) -> DataFrame:
    """Per sample the number of events and the last one's phase, ties of time by id."""
    last = F.max_by(phase_for_task(F.col("task")), F.struct("ts", "call_item_uid"))
    return calls.where("sample_id is not null").groupBy("sample_id").agg(_rows().alias("events"), last.alias("last_phase"))


def call_ledger(calls: DataFrame) -> DataFrame:
    """Per provider call: attempts and the last one's task and usage, ties of time by id. A call without a provider's id is one
    for itself."""
    last = lambda c: F.max_by(F.col(c), F.struct("ts", "call_item_uid"))
    return calls.groupBy(provider_key().alias("key"), "provider_call_uid").agg(F.countDistinct("call_item_uid").alias("attempts"), last("task").alias("task"), last("completion_tokens").alias("completion_tokens")).drop("key")


def cluster_bootstrap(outcomes: DataFrame, baseline: str, draws: int, seed: int = 7) -> DataFrame:
    """95 % interval of the mean paired difference per variant and metric, whole samples being drawn with their pairs.

    Pairs are summed to one row per variant, metric and sample first, and samples with equal sums and counts are counted.
    """
    d = metric_deltas(outcomes, baseline)
    sums = d.where("d is not null").groupBy("variant", "metric", "sample_id").agg(F.round(F.sum("d"), 12).alias("d"), _rows().alias("n"))
    cells = sums.groupBy("variant", "metric", "d", "n").agg(_rows().alias("times"))
    return interval(resampled(cells.withColumn("part", F.lit("")), draws, seed), d)


def item_coverage(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, answer) and (query_id, item): items, those that the answer covers, and whether all are."""
    x = items.join(answers, "query_id").withColumn("covered", covers_item(F.col("answer"), F.col("item")))
    return x.groupBy("query_id").agg(_rows().alias("items"), F.count_if("covered").alias("covered"), F.bool_and("covered").alias("whole"))



def fine_snapshots(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, trajectory_id, snapshot_id, score): the best snapshot of each trajectory first, then the best of the
    rest, 2k in all; ties by id."""
    best = F.row_number().over(Window.partitionBy("query_id", "trajectory_id").orderBy(F.desc("score"), "snapshot_id"))
    x = scored.withColumn("rest", (best > 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rest", F.desc("score"), "snapshot_id"))
    return x.withColumn("place", place).where(F.col("place") <= 2 * k).select("query_id", "snapshot_id", "place")


def supported_claims(claims: DataFrame, selected: DataFrame) -> DataFrame:
    """Per query its selected trajectories' claims that name a source, and the distinct sources."""
    x = claims.where("source_message_id is not null").join(selected.select("query_id", "trajectory_id"), "trajectory_id")
    return x.groupBy("query_id").agg(_rows().alias("claims"), F.countDistinct("source_message_id").alias("sources"))


def repair_events(calls: DataFrame) -> DataFrame:
    """One event for each repair call and each call that shares its provider call with an earlier one (a cache hit)."""
    earlier = F.row_number().over(Window.partitionBy(provider_key()).orderBy("call_item_uid")) > 1
    kinds = F.array_compact(F.array(F.when(F.col("task").contains("repair"), "repair"), F.when(F.col("again"), "cache_hit")))
    x = calls.withColumn("again", earlier & F.col("provider_call_uid").isNotNull())
    return x.select("call_item_uid", phase_for_task(F.col("task")).alias("phase"), F.explode(kinds).alias("kind"))


def answer_table(outcomes: DataFrame) -> DataFrame:
    """Per variant all means, each with the rows it rests on."""
    measures = {"judge": judge_score(F.col("verdict")), "token_f1": F.col("token_f1"), "coverage": F.col("gold_ref_coverage"), "prompt_tokens": F.col("prompt_tokens")}
    parts = [e for m, c in measures.items() for e in (F.count(c).alias(f"{m}_n"), F.round(F.avg(c), 6).alias(m))]
    return outcomes.groupBy("variant").agg(_rows().alias("n"), *parts)


def stratified_sample(rows: DataFrame, stratum: str, key: str, shares: dict[str, int], size: int) -> DataFrame:
    """A sample of ``size`` rows with each stratum's share in percent, rounded down, in a hashed order; a stratum with
    too few rows gives all it has. Each row carries the stratum's prevalence. A sampling operator."""
    quota = F.lit(0)
    for name, percent in shares.items():
        quota = F.when(F.col(stratum) == name, size * percent // 100).otherwise(quota)
    n = rows.groupBy(stratum).agg(_rows().alias("n"))  # one row for each stratum
    prevalence = n.select(stratum, F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("prevalence"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(hashed_order(stratum, key), key))
    chosen = rows.withColumn("place", place).where(F.col("place") <= size).where(F.col("place") <= quota)
    return chosen.join(F.broadcast(prevalence), stratum).select(stratum, key, "place", "prevalence")


def cutoff_choice(recalls: DataFrame, levels: list[float]) -> DataFrame:
    """(cutoff, recall, all_gold_rate): for each level the least cutoff at which both reach it; null if none does."""
    met = (F.col("recall") >= F.col("level")) & (F.col("all_gold_rate") >= F.col("level"))
    return recalls.withColumn("level", F.explode(_literals(levels))).groupBy("level").agg(F.min(F.when(met, F.col("cutoff"))).alias("cutoff"))


def prevalence_bootstrap(outcomes: DataFrame, baseline: str, strata: list[str], draws: int, seed: int = 7) -> DataFrame:
    """95 % interval of the paired difference per variant and metric: pairs are resampled within their stratum, and the
    strata's means are weighted by the strata's shares of the baseline's rows; null unless every stratum has pairs."""
    d = metric_deltas(outcomes, baseline)
    share = outcomes.where((F.col("variant") == baseline) & F.col("stratum").isin(strata)).groupBy(F.col("stratum").alias("part")).agg(_rows().alias("share"))  # one row for each stratum
    cells = d.where(F.col("d").isNotNull() & F.col("of").isin(strata)).groupBy("variant", "metric", F.col("of").alias("part"), "d").agg(_rows().alias("times"))
    m = resampled(cells.withColumn("n", F.lit(1)), draws, seed).join(F.broadcast(share), "part").groupBy("variant", "metric", "draw")
    return interval(m.agg(_rows().alias("seen"), (F.sum(F.col("m") * F.col("share")) / F.sum("share")).alias("m")).where(F.col("seen") == len(strata)), d)
