"""Ranking evidence for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, keywords


def flat_lexical_rank(queries: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of a query's sample by shared keywords: overlap plus overlap over the query's size, at least 0.001."""
    q = queries.select("query_id", "sample_id", keywords(F.col("question")).alias("qk"))
    x = messages.join(q, "sample_id").withColumn("hit", F.size(F.array_intersect("qk", keywords(F.col("content")))))
    x = x.withColumn("score", F.greatest(F.lit(0.001), F.col("hit") + F.coalesce(F.col("hit") / F.nullif(F.size("qk"), F.lit(0)), F.lit(0.0))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "turn_index"))
    return x.select("query_id", "sample_id", "message_id", "source_ref", F.col("score").cast("double"), estimate_tokens(F.col("content")).alias("tokens"), rank.cast("long").alias("rank"))


def budget_prefix(ranked: DataFrame, budget: int, most: int) -> DataFrame:
    """The rows of each ranking before the running sum of tokens first passes the budget, ``most`` at most."""
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.where(F.col("rank") <= most).withColumn("used", run).where(F.col("used") <= budget)


def evidence_recall(selected: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of a query's gold references among the selected; 1 if it has none."""
    hit = gold.join(selected.select("query_id", "source_ref").distinct().withColumn("hit", F.lit(1)), ["query_id", "source_ref"], "left")
    per = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(F.col("found") / F.col("gold"), F.lit(1.0)).alias("recall"))


def rrf_fuse(scored: DataFrame, k: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, dense, sparse); ties by id, descending. Columns to ``keep`` come along."""
    rank = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), F.desc("id")))
    x = scored.withColumn("fused", 1 / (k + rank("dense")) + 1 / (k + rank("sparse")))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("dense"), F.desc("sparse"), F.desc("id")))
    return x.select("query_id", "id", *keep, "fused", last.cast("long").alias("rank"))


def cutoff_universe(ranked: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Distinct trajectories within the first n ranks, for each n."""
    grid = ranked.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).where("rnk <= cutoff")
    return grid.groupBy("query_id", "cutoff").agg(F.countDistinct("trajectory_id").alias("universe"))


def gold_trajectories(gold: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Trajectories that hold a gold reference of the query, matched on sample and reference."""
    return gold.join(snapshots.select("sample_id", "source_ref", "trajectory_id"), ["sample_id", "source_ref"]).select("query_id", "trajectory_id").distinct()


def first_hit_rank(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """The least rank of a target; null if none is ranked."""
    hit = ranked.join(targets, ["query_id", "trajectory_id"], "left_semi").groupBy("query_id").agg(F.min("rnk").cast("long").alias("first_rank"))
    return targets.select("query_id").distinct().join(hit, "query_id", "left")


def rank_recall(ranked: DataFrame, targets: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Per cutoff: mean share of targets ranked within it, and share of queries with all of them."""
    x = targets.join(ranked, ["query_id", "trajectory_id"], "left").withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    per = x.groupBy("cutoff", "query_id").agg(F.avg(F.coalesce((F.col("rnk") <= F.col("cutoff")).cast("double"), F.lit(0.0))).alias("r"))
    return per.groupBy("cutoff").agg(F.round(F.avg("r"), 9).alias("recall"), F.round(F.avg((F.col("r") == 1).cast("double")), 9).alias("all_gold_rate"), F.count(F.lit(1)).alias("queries"))


#: Words that carry no search term.
SEARCH_STOP_WORDS = ["did", "does", "have", "has", "how", "many", "the", "what", "when", "where", "which", "who", "with"]


def plain_questions(queries: DataFrame) -> DataFrame:
    """Questions with their search terms alone: no entities, facets or family are known."""
    none = F.array().cast("array<string>")
    return queries.select("query_id", "sample_id", keywords(F.col("question")).alias("terms"), none.alias("entities"), none.alias("facets"), F.lit(None).cast("string").alias("family"), F.lit(False).alias("counting"), F.lit(False).alias("listing"))


def direct_rank(queries: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Trajectories of a query's sample ranked from their texts alone, without pages.

    ``queries``: query_id, sample_id, terms, entities, facets, family, counting, listing; ``trajectories``: sample_id,
    trajectory_id, text, specific (terms of their own items). The score adds up: shared terms and twice their share of the
    query; 3, 2 or 1.5 for an entity that is a term, shares a term, or stands in the text; 2 or 1 for a facet that is
    covered or touched; 1.5 for the item family and 0.5 for a list; 0.75 for a count; 1.25 times the share of terms that
    are specific; less 0.25 if nothing but plain terms is shared. Ties by id.
    """
    x = queries.join(trajectories.select("sample_id", "trajectory_id", F.lower("text").alias("hay"), keywords(F.col("text")).alias("have"), "specific"), "sample_id")
    share = lambda a, b: F.size(F.array_intersect(a, b))
    n, common = F.size("terms"), share("terms", "have")
    has = lambda a: F.exists(a, lambda t: F.array_contains("have", t))
    entity = F.aggregate("entities", F.lit(0.0), lambda s, e: s + F.when(F.array_contains("have", F.lower(e)), 3.0).when(has(keywords(e)), 2.0).when(F.contains(F.col("hay"), F.lower(e)), 1.5).otherwise(0.0))
    facet = F.aggregate("facets", F.lit(0.0), lambda s, e: s + F.when((F.size(keywords(e)) > 0) & F.forall(keywords(e), lambda t: F.array_contains("have", t)), 2.0).when(has(keywords(e)), 1.0).otherwise(0.0))
    family = F.when(has(keywords(F.coalesce("family", F.lit("")))), 1.5).otherwise(0.0) + F.when(F.col("listing") & F.col("hay").rlike("items|list|visited|participated|bought|read"), 0.5).otherwise(0.0)
    count = F.when(F.col("counting") & F.col("hay").rlike(r"\b(count|number|times?|once|twice|[0-9]+)\b"), 0.75).otherwise(0.0)
    own = F.when(n > 0, 1.25 * share("terms", "specific") / n).otherwise(0.0)
    x = x.withColumns({"common": common, "lexical": common + F.when(n > 0, 2.0 * common / n).otherwise(0.0), "entity": entity, "facet": facet, "family_score": family, "count_score": count, "own": own})
    plain = F.when((F.col("common") > 0) & (F.col("own") == 0) & (F.col("entity") == 0) & (F.col("facet") == 0), 0.25).otherwise(0.0)
    x = x.withColumn("score", F.round(F.col("lexical") + F.col("entity") + F.col("facet") + F.col("family_score") + F.col("count_score") + F.col("own") - plain, 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "trajectory_id"))
    return x.select("query_id", "trajectory_id", "score", rank.cast("long").alias("rank"))
