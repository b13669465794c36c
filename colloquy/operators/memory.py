"""The memory index, retrieval events, gold labels and the counterfactual ablations that stand on them.

References repeat between samples, so every one is resolved by (sample_id, source_ref). A list is an array column until it
is shown; ``shown`` joins it with a blank. What can't be observed is null, never 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

#: The variants of the ablation in the order of their report.
VARIANTS = ["full", "no_pages_direct", "pages_only", "flat_raw", "snapshot_m1", "snapshot_m2", "source_supported_only"]


def _rows() -> Column:
    return F.count(F.lit(1))


def shown(c: Column | str) -> Column:
    """An array as text; an empty or missing one is empty."""
    return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit(""))


def sorted_set(c: Column | str) -> Column:
    return F.array_sort(F.collect_set(c))


def ordered(value: Column, *by: str) -> Column:
    """Values of a group in the order of ``by``, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*by, value.alias("value")))), lambda x: x.value)


def snapshot_refs(snapshots: DataFrame, claims: DataFrame) -> DataFrame:
    """(sample_id, trajectory_id, snapshot_id, source_ref): a snapshot's own references and those of its claims."""
    one = ["sample_id", "trajectory_id", "snapshot_id", "source_ref"]
    return snapshots.select(*one).unionByName(claims.select(*one)).where("source_ref is not null").distinct()


def memory_index(snapshots: DataFrame, claims: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per trajectory: its snapshots in order of version, length, references, text, and the pages that list it."""
    own = snapshots.groupBy("sample_id", "trajectory_id").agg(ordered(F.col("snapshot_id"), "version").alias("snapshot_ids"), ordered(F.col("content"), "version").alias("texts"), _rows().alias("length"))
    refs = snapshot_refs(snapshots, claims).groupBy("trajectory_id").agg(sorted_set("source_ref").alias("source_refs"))
    listed = pages.where("page_type <> 'index'").groupBy("trajectory_id").agg(sorted_set("page_id").alias("page_ids"))
    x = own.join(refs, "trajectory_id", "left").join(listed, "trajectory_id", "left")
    return x.select("sample_id", "trajectory_id", "length", "snapshot_ids", "source_refs", "page_ids", F.array_join("texts", "\n").alias("text"))


def json_ids(text: Column) -> Column:
    """A JSON array of ids as an array; empty if the text is null or no such array."""
    return F.coalesce(F.from_json(text, "array<long>"), F.array().cast("array<long>"))


def retrieval_events(saved: DataFrame, messages: DataFrame) -> DataFrame:
    """Saved events (query_id, sample_id, and JSON arrays page_ids, trajectory_ids, expanded_ids, source_ids) with their
    arrays parsed and expanded and source ids resolved to references, in the saved order."""
    x = saved.select("query_id", "sample_id", *(json_ids(F.col(c)).alias(c) for c in ("page_ids", "trajectory_ids", "expanded_ids", "source_ids")))
    ref = messages.select("sample_id", F.col("message_id").alias("id"), "source_ref")

    def refs(c: str, name: str) -> DataFrame:
        y = x.select("query_id", "sample_id", F.posexplode(c).alias("at", "id")).join(ref, ["sample_id", "id"]).where("source_ref is not null")
        return y.groupBy("query_id").agg(ordered(F.col("source_ref"), "at").alias(name))

    x = x.join(refs("expanded_ids", "expanded_refs"), "query_id", "left").join(refs("source_ids", "source_refs"), "query_id", "left")
    none = F.array().cast("array<string>")
    return x.withColumns({c: F.coalesce(c, none) for c in ("expanded_refs", "source_refs")})


def saved_events(items: DataFrame) -> DataFrame:
    """(sample_id, query_id, tier, rnk, item_id) rows -> one saved event with JSON arrays for each query."""
    tiers = {"page": "page_ids", "trajectory": "trajectory_ids", "expanded": "expanded_ids", "source": "source_ids"}
    ids = lambda t: F.to_json(F.transform(F.sort_array(F.collect_list(F.when(F.col("tier") == t, F.struct("rnk", "item_id")))), lambda x: x.item_id))
    return items.groupBy("sample_id", "query_id").agg(*(ids(t).alias(c) for t, c in tiers.items()))


def gold_labels(queries: DataFrame, gold: DataFrame, snapshots: DataFrame, claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Per query its gold references and the messages, trajectories, pages and snapshots that hold one; queries without
    gold references keep a row of empty lists."""
    held = gold.join(snapshot_refs(snapshots, claims), ["sample_id", "source_ref"], "left").join(pages.where("page_type <> 'index'").select("trajectory_id", "page_id"), "trajectory_id", "left")
    lists = {"source_refs": "source_ref", "message_ids": "message_id", "trajectory_ids": "trajectory_id", "page_ids": "page_id", "snapshot_ids": "snapshot_id"}
    x = queries.select("sample_id", "query_id").join(held.groupBy("query_id").agg(*(sorted_set(c).alias(n) for n, c in lists.items())), "query_id", "left")
    empty = lambda n: F.array().cast("array<string>" if n == "source_refs" else "array<long>")
    return x.select("query_id", "sample_id", *(F.coalesce(n, empty(n)).alias(n) for n in lists))


def _item(variant: str, rank, cut, item, refs, trajectories, tokens) -> list[Column]:
    return [F.col("query_id"), F.lit(variant).alias("variant"), rank.cast("long").alias("rank"), cut.cast("long").alias("cut"), item.cast("string").alias("item_id"), refs.alias("refs"), trajectories.alias("trajectories"), tokens.cast("long").alias("tokens")]


def full_items(expanded: DataFrame, sources: DataFrame) -> DataFrame:
    """The selected trajectories with the references of the final context's sources alone; their tokens, or those of the
    snapshots if a trajectory has none of them."""
    s = sources.select("query_id", F.col("item_id").alias("snapshot_id"), F.lit(1).alias("kept"))
    x = expanded.join(s, ["query_id", "snapshot_id"], "left").withColumn("t", estimate_tokens(F.col("content")))
    kept = F.col("kept").isNotNull()
    per = x.groupBy("query_id", "trajectory_id").agg(F.min("rnk").alias("first"), F.array_sort(F.collect_set(F.when(kept, F.col("source_ref")))).alias("refs"), F.coalesce(F.sum(F.when(kept, F.col("t"))), F.lit(0)).alias("own"), F.sum("t").alias("all"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    per = per.withColumn("rank", rank)
    return per.select(*_item("full", F.col("rank"), F.col("rank"), F.col("trajectory_id"), F.col("refs"), F.array("trajectory_id"), F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("all"))))


def page_items(page_ranks: DataFrame, pages: DataFrame, index: DataFrame) -> DataFrame:
    """The ranked pages with their trajectories and references."""
    x = page_ranks.join(pages.where("page_type <> 'index'").select("page_id", "trajectory_id"), "page_id").join(index.select("trajectory_id", "source_refs", estimate_tokens(F.col("text")).alias("t")), "trajectory_id")
    per = x.groupBy("query_id", "page_id", "rnk").agg(sorted_set("trajectory_id").alias("trajectories"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_refs")))).alias("refs"), F.sum("t").alias("t"))
    return per.select(*_item("pages_only", F.col("rnk"), F.col("rnk"), F.col("page_id"), F.col("refs"), F.col("trajectories"), F.col("t")))


def flat_items(ranked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The lexically ranked messages; the cutoff does not apply to them, so they pass every one."""
    own = snapshots.groupBy("sample_id", "source_ref").agg(sorted_set("trajectory_id").alias("trajectories"))
    x = ranked.join(own, ["sample_id", "source_ref"], "left")
    none = F.array().cast("array<long>")
    return x.select(*_item("flat_raw", F.col("rank"), F.lit(0), F.col("message_id"), F.array("source_ref"), F.coalesce("trajectories", none), F.col("tokens")))


def direct_items(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """Trajectories ranked without pages (query_id, trajectory_id, rank)."""
    x = ranked.join(index.select("trajectory_id", "source_refs", "text"), "trajectory_id")
    return x.select(*_item("no_pages_direct", F.col("rank"), F.col("rank"), F.col("trajectory_id"), F.col("source_refs"), F.array("trajectory_id"), estimate_tokens(F.col("text"))))


def depth_items(selected: DataFrame, snapshots: DataFrame, refs: DataFrame, depth: int) -> DataFrame:
    """The last ``depth`` versions of each selected trajectory (query_id, trajectory_id, rnk), in order of version; the
    cutoff counts trajectories."""
    x = selected.select("query_id", "trajectory_id", F.col("rnk").alias("cut")).join(snapshots.select("trajectory_id", "snapshot_id", "version", "content"), "trajectory_id")
    x = x.withColumn("back", F.row_number().over(Window.partitionBy("query_id", "trajectory_id").orderBy(F.desc("version")))).where(F.col("back") <= depth)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("cut", "version")))
    x = x.join(refs.groupBy("snapshot_id").agg(sorted_set("source_ref").alias("refs")), "snapshot_id", "left")
    return x.select(*_item(f"snapshot_m{depth}", F.col("rank"), F.col("cut"), F.col("snapshot_id"), F.coalesce("refs", F.array().cast("array<string>")), F.array("trajectory_id"), estimate_tokens(F.col("content"))))


def claim_items(expanded: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims of the expanded snapshots that name a source."""
    x = expanded.select("query_id", "snapshot_id", "rnk").join(claims.where("source_ref is not null"), "snapshot_id")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rnk", "claim_id")))
    return x.select(*_item("source_supported_only", F.col("rank"), F.col("rank"), F.col("claim_id"), F.array("source_ref"), F.array("trajectory_id"), estimate_tokens(F.col("text"))))


def all_items(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ablation_grid(items: DataFrame, labels: DataFrame, cutoffs: list[int], budgets: list[int], variants: list[str] = VARIANTS) -> DataFrame:
    """Query x variant x cutoff x budget: what is selected and what it covers. Every cell has a row.

    Items enter in rank order until the first that would pass the budget. Reference measures of ``pages_only`` are null;
    shares are null without gold. The grid itself has a few dozen cells.
    """
    used = F.sum("tokens").over(Window.partitionBy("query_id", "variant").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    grid = lambda x: x.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    chosen = grid(items.withColumn("used", used).where(F.col("used") <= max(budgets))).where((F.col("cut") <= F.col("cutoff")) & (F.col("used") <= F.col("budget")))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    chosen = chosen.groupBy("query_id", "variant", "cutoff", "budget").agg(_rows().alias("n"), F.sum("tokens").alias("tokens"), flat("refs").alias("refs"), flat("trajectories").alias("trajectories"))
    size = items.groupBy("query_id", "variant").agg(_rows().alias("universe"))
    cells = grid(labels.select("query_id", F.col("source_refs").alias("gold"), F.col("trajectory_ids").alias("gold_t")).withColumn("variant", F.explode(F.array(*map(F.lit, variants)))))
    x = cells.join(chosen, ["query_id", "variant", "cutoff", "budget"], "left").join(size, ["query_id", "variant"], "left")
    found = lambda gold, c: F.size(F.array_intersect(gold, F.coalesce(c, F.array().cast("array<string>" if c == "refs" else "array<long>"))))
    refs, own = F.col("variant") != "pages_only", F.size("gold") > 0
    whole = own & (found("gold", "refs") == F.size("gold"))
    return x.select(
        "query_id", "variant", "cutoff", "budget", F.coalesce("universe", F.lit(0)).alias("universe"), F.coalesce("n", F.lit(0)).alias("items"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.when(refs & own, F.round(found("gold", "refs") / F.size("gold"), 9)).alias("ref_coverage"), F.when(refs, whole).alias("all_refs"),
        F.when(F.size("gold_t") > 0, F.round(found("gold_t", "trajectories") / F.size("gold_t"), 9)).alias("trajectory_recall"),
        ((F.size("gold_t") > 0) & (found("gold_t", "trajectories") == F.size("gold_t"))).alias("all_trajectories"), F.when(refs, ~whole).alias("risk"),
    )


def _share(c: str) -> Column:
    return F.round(F.try_divide(F.count_if(c), F.count(c)), 9)


def _mean(c: str) -> Column:
    return F.round(F.avg(c), 6)


def ablation_summary(grid: DataFrame, cutoff: int) -> DataFrame:
    """Per variant and budget, at one cutoff: means and the rates over rows where they can be observed."""
    return grid.where(F.col("cutoff") == cutoff).groupBy("variant", "budget").agg(
        _rows().alias("queries"), _mean("ref_coverage").alias("ref_coverage"), _mean("trajectory_recall").alias("trajectory_recall"), _share("all_refs").alias("all_refs_rate"),
        _share("all_trajectories").alias("all_trajectories_rate"), _mean("universe").alias("universe"), _mean("tokens").alias("tokens"), _share("risk").alias("risk_rate"),
    )


def cost_recall_curve(grid: DataFrame) -> DataFrame:
    """Per variant, budget and cutoff the mean coverage, recall and tokens; unobservable cells do not count."""
    return grid.groupBy("variant", "budget", "cutoff").agg(_rows().alias("queries"), _mean("ref_coverage").alias("ref_coverage"), _mean("trajectory_recall").alias("trajectory_recall"), _mean("tokens").alias("tokens"))


def variant_examples(grid: DataFrame, cutoff: int, most: int) -> DataFrame:
    """For each kind of difference between variants the first ``most`` queries: a bounded report."""
    x = grid.where(F.col("cutoff") == cutoff)
    per = x.groupBy("query_id", "budget").agg(*(F.coalesce(F.max(F.when(F.col("variant") == v, F.col("ref_coverage"))), F.lit(0.0)).alias(v) for v in ("full", "no_pages_direct", "pages_only")), F.coalesce(F.bool_or(F.when(F.col("variant") == "flat_raw", F.col("all_refs"))), F.lit(False)).alias("flat"))
    kinds = {"direct_beats_full": F.col("no_pages_direct") > F.col("full"), "full_beats_direct": F.col("full") > F.col("no_pages_direct"), "pages_lose_evidence": F.col("pages_only") < F.col("full"), "flat_hits_at_high_cost": F.col("flat")}
    y = per.select("query_id", "budget", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in kinds.items())))).alias("kind"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("query_id", "budget"))
    return y.withColumn("place", place).where(F.col("place") <= most)


def stage_hits(labels: DataFrame, events: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, stored, routed, selected, expanded, grounded): whether each stage still holds some of a query's gold.
    Only queries with gold references."""
    stored = index.groupBy("sample_id").agg(F.array_distinct(F.flatten(F.collect_list("source_refs"))).alias("sample_refs"))
    routed = events.select("query_id", F.explode("page_ids").alias("page_id")).join(pages.select("page_id", "trajectory_id"), "page_id").groupBy("query_id").agg(F.collect_set("trajectory_id").alias("routed_ids"))
    e = events.select("query_id", F.col("trajectory_ids").alias("chosen_ids"), F.col("expanded_ids").alias("expanded_ids"), F.col("source_refs").alias("final_refs"))
    x = labels.where(F.size("source_refs") > 0).join(stored, "sample_id", "left").join(e, "query_id", "left").join(routed, "query_id", "left")
    met = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return x.select(
        "query_id", met("source_refs", "sample_refs").alias("stored"), met("trajectory_ids", "routed_ids").alias("routed"), met("trajectory_ids", "chosen_ids").alias("selected"),
        met("snapshot_ids", "expanded_ids").alias("expanded"), met("source_refs", "final_refs").alias("grounded"),
    )


def evidence_funnel(hits: DataFrame) -> DataFrame:
    """Five stages: queries with gold references, those that a stage still serves, and their share."""
    stages = ["stored", "routed", "selected", "expanded", "grounded"]
    x = hits.unpivot("query_id", stages, "stage", "hit")
    return x.groupBy("stage").agg(_rows().alias("queries"), F.count_if("hit").alias("hits"), _share("hit").alias("rate"))


def failure_reasons(queries: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Per query the first reason why its answer may have failed, "correct" last of all."""
    x = queries.select("query_id").join(hits, "query_id", "left").join(answers.select("query_id", "verdict"), "query_id", "left")
    reason = F.when(F.col("stored").isNull(), "unknown_no_gold_refs").when(~F.col("stored"), "memory_absent").when(~F.col("routed"), "coarse_retrieval_miss").when(~F.col("selected"), "fine_retrieval_miss").when(~F.col("grounded"), "grounding_miss").when(F.col("verdict").isin("partial", "incorrect"), "answer_error").otherwise("other")
    return x.select("query_id", reason.alias("reason"))


def latest_claims(snapshots: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims of each trajectory's snapshot of the highest version."""
    last = snapshots.groupBy("trajectory_id").agg(F.max_by("snapshot_id", "version").alias("snapshot_id"))
    return claims.join(last, ["trajectory_id", "snapshot_id"], "left_semi").select("trajectory_id", "claim_id", "status")


def trajectory_documents(snapshots: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per trajectory with its snapshots in order and each one's claims, as text."""
    c = claims.groupBy("snapshot_id").agg(F.array_join(ordered(F.concat_ws("/", F.col("claim_id").cast("string"), "status"), "claim_id"), ",").alias("claims"))
    x = snapshots.join(c, "snapshot_id", "left")
    line = F.concat(F.col("snapshot_id").cast("string"), F.lit(":"), F.col("version").cast("string"), F.lit("="), F.coalesce("claims", F.lit("")))
    return x.groupBy("trajectory_id").agg(F.array_join(ordered(line, "version"), " ").alias("snapshots"))


def evidence_only(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per sample the lines of the wanted references (sample_id, source_ref), in order of turn, and those without a line."""
    line = F.concat(F.lit("["), F.col("source_ref"), F.lit("] "), F.col("role"), F.lit(": "), F.col("content"))
    x = wanted.join(messages.select("sample_id", "source_ref", "turn_index", line.alias("line")), ["sample_id", "source_ref"], "left")
    gone = F.array_sort(F.collect_list(F.when(F.col("line").isNull(), F.col("source_ref"))))
    lines = F.transform(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("turn_index", "line")))), lambda s: s.line)
    return x.groupBy("sample_id").agg(F.array_join(lines, "\n").alias("text"), shown(gone).alias("missing"))


def scoped(queries: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's queries (query_id, sample_id), one row each, with their state: kept, missing, duplicate or
    sample_mismatch. A run is allowed only if all are kept."""
    m = manifest.groupBy("query_id").agg(_rows().alias("n"), F.collect_set("sample_id").alias("samples"))
    x = m.join(queries.select("query_id", "sample_id"), "query_id", "left")
    strange = F.exists("samples", lambda s: s != F.col("sample_id"))
    state = F.when(F.col("sample_id").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(strange, "sample_mismatch").otherwise("kept")
    return x.select("query_id", "sample_id", state.alias("state"))


def mean_pool(vectors: DataFrame, group: str) -> DataFrame:
    """The renormalised mean of a group's normalised vectors; vectors of norm 0 do not count."""
    from ..functions.rules import l2_normalized

    x = vectors.select(group, F.posexplode(l2_normalized(F.col("embedding"))).alias("at", "x"))
    mean = x.groupBy(group, "at").agg(F.avg("x").alias("m")).groupBy(group).agg(ordered(F.col("m"), "at").alias("mean"))
    return mean.select(group, l2_normalized(F.col("mean")).alias("vector"))


def top_values(values: DataFrame, group: str, position: str, most: int) -> DataFrame:
    """A group's most frequent values without regard to case, ties by name, each in its first spelling; a top-k report."""
    x = values.groupBy(group, F.lower("value").alias("key")).agg(_rows().alias("n"), F.min_by("value", position).alias("surface"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "key"))).where(F.col("rank") <= most)


def entity_lexicon(messages: DataFrame, stop: list[str]) -> DataFrame:
    """(sample_id, key, surface): a sample's speakers, and the capitalised words that it has at least twice."""
    said = messages.select("sample_id", F.explode(F.regexp_extract_all("source_text", F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))).alias("surface")).where(~F.lower("surface").isin(stop))
    said = said.groupBy("sample_id", F.lower("surface").alias("key")).agg(F.min("surface").alias("surface"), _rows().alias("n")).where("n >= 2").drop("n")
    spoke = messages.where("speaker is not null").groupBy("sample_id", F.lower("speaker").alias("key")).agg(F.min("speaker").alias("surface"))
    return spoke.unionByName(said).groupBy("sample_id", "key").agg(F.min("surface").alias("surface"))


def entities_in(texts: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """(key, names): the lexicon's names that stand in a text as whole words, by place, the longer first."""
    at = F.regexp_instr(F.lower("text"), F.concat(F.lit(r"\b"), "key", F.lit(r"\b")))
    x = texts.select("sample_id", key, "text").join(lexicon, "sample_id").withColumn("at", at).where("at > 0")
    return x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", (-F.length("surface")).alias("l"), "surface"))), lambda s: s.surface).alias("names"))


def parse_transcript(samples: DataFrame) -> DataFrame:
    """(sample_id, text) -> messages. A line ``DATE: ...`` dates all that follow; ``[D1:2] Name: text`` is a message; other
    lines go. The first speaker is the user, all others are assistants."""
    form = r"^\[(D\d+:\d+)\] ([^:]+): (.*)$"
    x = samples.select("sample_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    part = lambda k: F.regexp_extract("line", form, k)
    before = Window.partitionBy("sample_id").orderBy("at")
    day = F.last(F.nullif(F.regexp_extract("line", "^DATE: (.*)$", 1), F.lit("")), ignorenulls=True).over(before)
    x = x.select("sample_id", "at", part(1).alias("source_ref"), part(2).alias("speaker"), part(3).alias("content"), day.alias("occurred_at")).where("source_ref <> ''")
    first = F.first("speaker").over(before)
    return x.select("sample_id", (F.row_number().over(before) - 1).cast("long").alias("turn_index"), "source_ref", "speaker", F.when(F.col("speaker") == first, "user").otherwise("assistant").alias("role"), "content", "occurred_at")
