"""Answer metrics, cost tables, drift and paired statistics."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, judge_score, normalize_answer, phase_for_task


def token_overlap(pairs: DataFrame) -> DataFrame:
    """(id, predicted, gold) -> clipped unigram precision and token F1; both empty counts as 1. A row counts its own words."""
    words = lambda c: F.filter(F.split(normalize_answer(F.col(c)), " "), lambda w: w != "")
    x = pairs.select("id", words("predicted").alias("p"), words("gold").alias("g"))
    times = lambda c, w: F.size(F.filter(c, lambda v: v == w))
    shared = F.aggregate(F.array_intersect("p", "g"), F.lit(0), lambda n, w: n + F.least(times("p", w), times("g", w)))
    x = x.select("id", F.size("p").alias("np"), F.size("g").alias("ng"), shared.alias("common"))
    empty = (F.col("np") == 0) & (F.col("ng") == 0)
    bleu = F.when(empty, 1.0).when(F.col("np") == 0, 0.0).otherwise(F.col("common") / F.col("np"))
    f1 = F.when(empty, 1.0).when(F.col("common") == 0, 0.0).otherwise(2 * F.col("common") / (F.col("np") + F.col("ng")))
    return x.select("id", F.round(bleu, 9).alias("bleu1"), F.round(f1, 9).alias("token_f1"))


def aggregate_by_stratum(outcomes: DataFrame) -> DataFrame:
    """Means per variant and stratum, per variant, and over all; nulls are not observed."""
    x = outcomes.withColumn("judge", judge_score(F.col("verdict"))).withColumn("judge_accuracy", F.when(F.col("judge").isNotNull(), (F.col("judge") == 1).cast("double")))
    out = x.groupingSets([["variant", "stratum"], ["variant"], []], "variant", "stratum").agg(F.count(F.lit(1)).alias("n"), F.count("gold_ref_coverage").alias("observed"), F.round(F.avg("judge"), 9).alias("judge"), F.round(F.avg("token_f1"), 6).alias("token_f1"), F.round(F.avg("gold_ref_coverage"), 6).alias("coverage"))
    return out.select(F.coalesce("variant", F.lit("all")).alias("variant"), F.coalesce("stratum", F.lit("all")).alias("stratum"), "n", "observed", "judge", "token_f1", "coverage")


def unpivot_metrics(table: DataFrame) -> DataFrame:
    """Wide metrics to rows, nulls dropped."""
    return table.unpivot(["variant", "stratum"], ["judge", "token_f1", "coverage"], "metric", "value").where("value is not null")


def paired_deltas(outcomes: DataFrame, baseline: str) -> DataFrame:
    """Against the baseline variant: pairs, mean difference of the judge score, wins, ties and losses."""
    x = outcomes.select("variant", "query_id", judge_score(F.col("verdict")).alias("s"))
    base = x.where(F.col("variant") == baseline).select("query_id", F.col("s").alias("b"))
    d = x.where(F.col("variant") != baseline).join(base, "query_id").withColumn("d", F.col("s") - F.col("b"))
    return d.groupBy("variant").agg(F.count("d").alias("pairs"), F.round(F.avg("d"), 9).alias("delta"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"))


def run_diff(outcomes: DataFrame, before: str, after: str) -> DataFrame:
    """Transitions of verdicts between two variants, unmatched queries included."""
    side = lambda v, name: outcomes.where(F.col("variant") == v).select("query_id", F.col("verdict").alias(name))
    x = side(before, "before").join(side(after, "after"), "query_id", "full_outer")
    return x.groupBy(F.coalesce("before", F.lit("missing")).alias("before"), F.coalesce("after", F.lit("missing")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def cost_by_phase(calls: DataFrame) -> DataFrame:
    """Calls and tokens per phase; a total is null unless the usage of every call is known."""
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    return calls.groupBy(phase_for_task(F.col("task")).alias("phase")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("provider_call_uid").alias("provider_calls"), F.count("prompt_tokens").alias("known"), whole("prompt_tokens").alias("prompt_total"), whole("completion_tokens").alias("completion_total"), F.sum("prompt_tokens").alias("prompt_seen"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"))



def token_share(calls: DataFrame, top: int) -> DataFrame:
    """Completion tokens by task as shares, the largest ``top`` and the rest as Other."""
    t = calls.groupBy("task").agg(F.sum("completion_tokens").alias("t"))
    x = t.withColumn("r", F.row_number().over(Window.orderBy(F.desc("t"), "task"))).withColumn("all", F.sum("t").over(Window.partitionBy()))  # one row for each task
    return x.groupBy(F.when(F.col("r") <= top, F.col("task")).otherwise("Other").alias("task")).agg(F.sum("t").alias("tokens"), F.round(F.sum(F.col("t") / F.col("all")), 9).alias("share"))


def amortized_cost(calls: DataFrame, queries: list[int]) -> DataFrame:
    """(upfront + n * per query) / n, upfront being the memory phase and the rest spread over the queries seen."""
    memory = phase_for_task(F.col("task")) == "memory"
    one = calls.agg(F.sum(F.when(memory, F.col("completion_tokens"))).alias("upfront"), (F.sum(F.when(~memory, F.col("completion_tokens"))) / F.countDistinct("query_id")).alias("each"))
    return one.select(F.explode(F.array(*map(F.lit, queries))).alias("n"), "upfront", "each").select("n", F.round((F.col("upfront") + F.col("each") * F.col("n")) / F.col("n"), 6).alias("cost"))


#: A trajectory is one of its sample.
OWN = ("sample_id", "trajectory_id")


def trajectory_drift(vectors: DataFrame, by: tuple[str, ...] = ("trajectory_id",)) -> DataFrame:
    """Cosines between the first and last and between adjacent snapshots of each trajectory, with a bucket. ``by`` tells trajectories
    apart: where samples may use the same numbers, the sample belongs to it, else versions of two trajectories are mixed."""
    order = Window.partitionBy(*by).orderBy("version")
    x = vectors.withColumn("prev", F.lag("embedding").over(order)).withColumn("step", cosine(F.col("prev"), F.col("embedding")))
    d = x.groupBy(*by).agg(F.count(F.lit(1)).alias("length"), F.min_by("embedding", "version").alias("head"), F.max_by("embedding", "version").alias("tail"), F.avg("step").alias("mean"), F.min("step").alias("least"))
    d = d.withColumn("ht", F.when(F.col("length") == 1, 1.0).otherwise(cosine(F.col("head"), F.col("tail"))))
    bucket = F.when(F.col("length") == 1, "singleton").when(F.col("ht") >= 0.7, "stable").when(F.col("ht") >= 0.55, "mild").when(F.col("ht") >= 0.4, "moderate").otherwise("possible_drift")
    return d.select(*by, "length", F.round("ht", 6).alias("head_tail"), F.round("mean", 6).alias("adjacent_mean"), F.round("least", 6).alias("adjacent_min"), bucket.alias("bucket"))


def query_strata(gold: DataFrame, snapshots: DataFrame, claims: DataFrame) -> DataFrame:
    """strict_deep_history if a gold reference is in no latest snapshot, else update_sensitive if its message stands
    behind a deprecated claim, else ordinary."""
    last = snapshots.withColumn("top", F.max("version").over(Window.partitionBy("trajectory_id"))).where("version = top").select("sample_id", "source_ref", F.lit(1).alias("fresh"))
    old = claims.where("status = 'deprecated'").select(F.col("source_message_id").alias("message_id"), F.lit(1).alias("old")).distinct()
    x = gold.join(last, ["sample_id", "source_ref"], "left").join(old, "message_id", "left").groupBy("query_id").agg(F.max(F.col("fresh").isNull()).alias("deep"), F.max(F.col("old").isNotNull()).alias("update"))
    return x.select("query_id", F.when(F.col("deep"), "strict_deep_history").when(F.col("update"), "update_sensitive").otherwise("ordinary").alias("stratum"))


#: Different units that a resampling task holds, about, and draws that it makes at once.
CELLS, DRAW_BLOCK = 4096, 500
#: The metrics that outcomes may have.
METRICS = ("judge", "judge_accuracy", "token_f1", "bleu1", "abstained", "gold_ref_coverage", "source_supported", "unsupported_risk", "validated_judge", "prompt_tokens")


def metric_deltas(outcomes: DataFrame, baseline: str) -> DataFrame:
    """(variant, query_id, sample_id, of, metric, d): every metric's difference to the baseline's outcome of the same
    query, null where one is unknown; ``of`` is the baseline's stratum."""
    x = outcomes.withColumn("judge", judge_score(F.col("verdict"))).withColumn("judge_accuracy", F.when(F.col("judge").isNotNull(), (F.col("judge") == 1).cast("double")))
    names = [m for m in METRICS if m in x.columns]
    base = x.where(F.col("variant") == baseline).select("query_id", F.col("stratum").alias("of"), *(F.col(m).cast("double").alias(f"b_{m}") for m in names))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double") - F.col(f"b_{m}"), 12).alias("d")) for m in names))
    return x.where(F.col("variant") != baseline).join(base, "query_id").select("variant", "query_id", "sample_id", "of", F.inline(pairs))


def resampled(cells: DataFrame, draws: int, seed: int) -> DataFrame:
    """(variant, metric, part, draw, m): the mean of each of ``draws`` resamples with replacement.

    A row of ``cells`` stands for ``times`` equal units, each with the sum ``d`` of ``n`` pairs. How often a row's units
    come up in a resample is multinomial. Rows are dealt to buckets of about ``CELLS`` by hash: a task draws how often each bucket
    comes up, which all tasks of a resample draw alike, and then, given that, its own rows. The sums of the buckets add up to
    exactly a multinomial resample, whatever the number of rows, and no row is held twice.
    """
    group = ["variant", "metric", "part"]
    x = cells.select(*group, F.col("d").cast("double").alias("d"), F.col("n").cast("double").alias("n"), F.col("times").cast("long").alias("times"))
    buckets = max(1, -(-x.count() // CELLS))
    x = x.withColumn("bucket", F.pmod(F.xxhash64("d", "n"), F.lit(buckets)).cast("int"))
    totals = x.groupBy(*group, "bucket").agg(F.sum("times").alias("units"))
    all_ = totals.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("bucket", "units"))).alias("totals"))
    none = F.lit(None).cast("array<struct<bucket: int, units: bigint>>")
    heads = all_.select(*group, F.explode("totals.bucket").alias("bucket"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("long").alias("times"), "totals")
    both = x.select(*group, "bucket", "d", "n", "times", none.alias("totals")).unionByName(heads)

    def run(key, table):
        variant, metric, part, bucket = (k.as_py() for k in key)
        head = next(t for t in table.column("totals").to_pylist() if t is not None)
        table = table.filter(pc.is_valid(table.column("times"))).sort_by([("d", "ascending"), ("n", "ascending")])
        d, n, times = (table.column(c).to_numpy() for c in ("d", "n", "times"))
        units = np.array([t["units"] for t in head])
        own = [t["bucket"] for t in head].index(bucket)
        stream, found = [seed, zlib.crc32(f"{variant}:{metric}:{part}".encode())], []
        for block in range(-(-draws // DRAW_BLOCK)):
            todo = min(DRAW_BLOCK, draws - block * DRAW_BLOCK)
            here = np.random.default_rng([*stream, block]).multinomial(units.sum(), units / units.sum(), size=todo)[:, own]
            rng, step = np.random.default_rng([*stream, block, bucket + 1]), max(1, (1 << 22) // len(d))
            for at in range(0, todo, step):
                w = rng.multinomial(here[at : at + step], times / times.sum())
                found.append((w @ d, w @ n))
        same = lambda v: pa.array([v] * draws, pa.string())
        sums = [np.concatenate([f[k] for f in found]) for k in (0, 1)]
        return pa.table({"variant": same(variant), "metric": same(metric), "part": same(part), "draw": pa.array(np.arange(draws)), "d": pa.array(sums[0]), "n": pa.array(sums[1])})

    made = both.groupBy(*group, "bucket").applyInArrow(run, "variant string, metric string, part string, draw long, d double, n double")
    return made.groupBy(*group, "draw").agg((F.sum("d") / F.sum("n")).alias("m"))


def interval(means: DataFrame, deltas: DataFrame) -> DataFrame:
    """(variant, metric, low, high): the 95 % interval of ``means``; null for a variant's metric without any."""
    ends = means.groupBy("variant", "metric").agg(*(F.round(F.expr(f"percentile(m, {q})"), 9).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))
    return deltas.select("variant", "metric").distinct().join(ends, ["variant", "metric"], "left")


def bootstrap_interval(outcomes: DataFrame, baseline: str, draws: int, seed: int = 7) -> DataFrame:
    """95 % interval of the mean paired difference per variant and metric, over ``draws`` resamples of the pairs.

    Pairs with equal differences are counted first.
    """
    d = metric_deltas(outcomes, baseline)
    cells = d.where("d is not null").groupBy("variant", "metric", "d").agg(F.count(F.lit(1)).alias("times"))
    return interval(resampled(cells.withColumns({"part": F.lit(""), "n": F.lit(1)}), draws, seed), d)
