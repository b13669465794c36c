"""Auditability of answers: what supports them, at which stage their evidence was lost, and reports about both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import is_abstention
from ..functions.text import estimate_tokens, judge_score
from .memory import ordered, shown, sorted_set, stage_hits

# Issues of the check after answering that make an answer unsupported.
UNSUPPORTED_ISSUES = ["unsupported_extra_items", "unsupported_count", "invalid_supporting_refs", "scope_mismatched_extra_item", "overgeneric_item"]
# Claim statuses that count as disputed and as out of date.
CONFLICTED, OUTDATED = ["contradictory", "needs-confirmation", "needs_confirmation", "conflicted"], ["deprecated", "obsolete", "superseded"]
#: What an answer's metadata may hold, as JSON.
METADATA = "supporting_refs array<string>, invalid_refs array<string>, list_items map<string,array<string>>, required_items map<string,array<string>>, bridge struct<used:boolean,refs:array<string>,target:string>, temporal_ref string, counted_events array<struct<event:string,refs:array<string>>>"
STAGES = {"source_stored": "stored", "linked_to_trajectory": "linked", "reachable_from_pages": "routed", "trajectory_selected": "selected", "snapshot_expanded": "expanded", "source_in_context": "retrieved", "used_in_support": "support"}


def _rows() -> Column:
    return F.count(F.lit(1))


def _mean(c) -> Column:
    return F.round(F.avg(c), 9)


def _share(c: Column) -> Column:
    return F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 9)


def _strings() -> Column:
    return F.array().cast("array<string>")


def support_items(answers: DataFrame, messages: DataFrame) -> DataFrame:
    """One row for the final answer and for every item that an answer's metadata names.

    ``answers``: query_id, sample_id, answer_text, issue, metadata (JSON, null if none). Rows: query_id, item_id, kind, text,
    refs, invalid_refs, message_ids, status, issue. An answer with invalid references is ``invalid_source_ref``, one without
    any ``no_visible_source``, one with an issue that counts ``unsupported_postcheck``, else it is ``supported``.
    """
    m = F.from_json(F.coalesce("metadata", F.lit("{}")), METADATA)
    x = answers.select("query_id", "sample_id", "answer_text", "issue", m.alias("m"))
    some = lambda c: F.coalesce(c, _strings())
    entries = lambda c: F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:array<string>>>"))
    events = F.coalesce("m.counted_events", F.array().cast("array<struct<event:string,refs:array<string>>>"))
    flat = lambda c: F.flatten(F.transform(entries(c), lambda e: some(e.value)))
    temporal = F.when(F.col("m.temporal_ref").isNotNull(), F.array("m.temporal_ref")).otherwise(_strings())
    every = F.array_distinct(F.concat(some("m.supporting_refs"), some("m.bridge.refs"), temporal, flat("m.list_items"), flat("m.required_items"), F.flatten(F.transform(events, lambda e: some(e.refs)))))
    x = x.withColumns({"every": every, "invalid": some("m.invalid_refs")})
    status = F.when(F.size("invalid") > 0, "invalid_source_ref").when(F.size("every") == 0, "no_visible_source").when(F.col("issue").isin(UNSUPPORTED_ISSUES), "unsupported_postcheck").otherwise("supported")
    seen = lambda refs: F.when(F.size(refs) > 0, "supported").otherwise("no_visible_source")
    item = lambda name, kind, text, refs, invalid, s: F.struct(F.concat_ws(":", F.col("query_id").cast("string"), name).alias("item_id"), F.lit(kind).alias("kind"), text.cast("string").alias("text"), refs.alias("refs"), invalid.alias("invalid_refs"), s.alias("status"))
    listed = lambda c, kind: F.transform(entries(c), lambda e: item(F.concat_ws(":", F.lit(kind), e.key), kind, e.key, some(e.value), _strings(), seen(some(e.value))))
    maybe = lambda c, one: F.when(c, F.array(one)).otherwise(F.filter(F.array(one), lambda _: F.lit(False)))
    rows = F.concat(
        F.array(item(F.lit("final_answer"), "final_answer", F.col("answer_text"), F.col("every"), F.col("invalid"), status)),
        listed("m.list_items", "supported_list_item"), listed("m.required_items", "supported_required_item"),
        maybe(F.coalesce("m.bridge.used", F.lit(False)) | (F.size(some("m.bridge.refs")) > 0), item(F.lit("bridge"), "bridge_finalization", F.col("m.bridge.target"), some("m.bridge.refs"), _strings(), seen(some("m.bridge.refs")))),
        maybe(F.size(temporal) > 0, item(F.lit("temporal"), "temporal_alignment", F.col("m.temporal_ref"), temporal, _strings(), seen(temporal))),
        F.transform(events, lambda e, i: item(F.concat_ws(":", F.lit("counted_event"), (i + 1).cast("string")), "counted_event", e.event, some(e.refs), _strings(), seen(some(e.refs)))),
    )
    x = x.select("query_id", "sample_id", "issue", F.inline(rows))
    ids = x.select("item_id", "sample_id", F.posexplode("refs").alias("at", "source_ref")).join(messages.select("sample_id", "source_ref", "message_id"), ["sample_id", "source_ref"])
    ids = ids.groupBy("item_id").agg(ordered(F.col("message_id"), "at").alias("message_ids"))
    return x.join(ids, "item_id", "left").withColumn("message_ids", F.coalesce("message_ids", F.array().cast("array<long>")))


def grounding(claims: DataFrame) -> DataFrame:
    """(claim_id, suspect, generic): whether a claim about somebody rests on a source in which another speaker talks of
    what is theirs, and whether it speaks of "the user" or "the assistant". ``claims``: claim_id, text, speaker, source_text."""
    about = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+)'s\b"), F.lit(1))
    mine = F.lower("source_text").rlike(r"\b(my|our|mine|ours)\b")
    strange = F.exists(about, lambda n: F.lower(n) != F.lower(F.col("speaker")))
    return claims.select("claim_id", F.coalesce(F.col("speaker").isNotNull() & mine & strange, F.lit(False)).alias("suspect"), F.lower("text").rlike(r"\b(the user|the assistant)\b").alias("generic"))


def context_claims(expanded: DataFrame, claims: DataFrame, suspects: DataFrame | None = None) -> DataFrame:
    """The claims of each query's expanded snapshots; outdated and suspect ones are kept from the context, with the reason."""
    x = expanded.select("query_id", "snapshot_id").join(claims, "snapshot_id")
    x = x.join(suspects.where("suspect").select("claim_id", "suspect"), "claim_id", "left") if suspects is not None else x.withColumn("suspect", F.lit(None).cast("boolean"))
    reason = F.when(F.col("status").isin(OUTDATED), "deprecated").when(F.col("suspect"), "speaker_suspect")
    return x.select("query_id", "claim_id", "status", "source_ref", "text", reason.alias("reason"), reason.isNull().alias("kept"))


def _spaced(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def auditability(answers: DataFrame, labels: DataFrame, events: DataFrame, index: DataFrame, pages: DataFrame, messages: DataFrame, items: DataFrame, context: DataFrame) -> DataFrame:
    """One row per answer: coverage of its gold references at seven stages, support, risk with its reason, the stage at
    which it failed, conflicts and outdated claims, and the size of its packet."""
    s = items.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("status") != "no_visible_source", F.col("refs"))))).alias("support"), F.max(F.size("invalid_refs")).alias("invalid"),
        F.array_join(ordered(F.coalesce("text", F.lit("")), "item_id"), "\n").alias("item_texts"), _rows().alias("n_items"),
    )
    old = F.col("status").isin(OUTDATED)
    c = context.groupBy("query_id").agg(
        _rows().alias("n_claims"), F.count_if(old).alias("outdated"), F.count_if(old & (F.col("reason") == "deprecated")).alias("suppressed"), F.bool_or(F.col("kept") & F.col("status").isin(CONFLICTED)).alias("conflict"),
        F.collect_set(F.when(old, F.col("source_ref"))).alias("old_refs"), F.collect_set(F.when(F.col("kept"), F.col("source_ref"))).alias("live_refs"), F.collect_set(F.when(old & (F.length(_spaced("text")) >= 12), _spaced("text"))).alias("old_texts"),
        F.array_join(ordered(F.when(F.col("kept"), F.col("text")), "claim_id"), "\n").alias("claim_texts"),
    )
    per_sample = messages.groupBy("sample_id").agg(F.collect_set("source_ref").alias("stored")).join(index.groupBy("sample_id").agg(F.array_distinct(F.flatten(F.collect_list("source_refs"))).alias("linked")), "sample_id", "left")
    own = index.select("trajectory_id", "source_refs")
    flat = F.array_distinct(F.flatten(F.collect_list("source_refs")))
    routed = events.select("query_id", F.explode("page_ids").alias("page_id")).join(pages.select("page_id", "trajectory_id").distinct(), "page_id").join(own, "trajectory_id").groupBy("query_id").agg(flat.alias("routed"))
    chosen = events.select("query_id", F.explode("trajectory_ids").alias("trajectory_id")).join(own, "trajectory_id").groupBy("query_id").agg(flat.alias("selected"))
    e = events.select("query_id", F.col("expanded_refs").alias("expanded"), F.col("source_refs").alias("retrieved"))
    x = answers.join(labels.select("query_id", F.col("source_refs").alias("gold")), "query_id").join(per_sample, "sample_id", "left")
    for part in (routed, chosen, e, s, c, stage_hits(labels, events, index, pages).select("query_id", "stored", "routed", "selected").toDF("query_id", "in_memory", "on_pages", "in_selection")):
        x = x.join(part, "query_id", "left")
    x = x.withColumns({k: F.coalesce(k, _strings()) for k in (*STAGES.values(), "old_refs", "live_refs", "old_texts")})
    met = lambda k: F.size(F.array_intersect("gold", k))
    has_gold = F.size("gold") > 0
    coverage = {f"{k}_coverage": F.when(has_gold, F.round(met(k) / F.size("gold"), 9)) for k in STAGES.values()}
    observed = (F.trim(F.coalesce("answer_text", F.lit(""))) != "") & (F.coalesce("verdict", F.lit("")) != "judge_error")
    x = x.withColumns({"observed": observed, "abstained": is_abstention(F.col("answer_text")), "bad_issue": F.coalesce(F.col("issue").isin(UNSUPPORTED_ISSUES), F.lit(False)), "bad_refs": F.coalesce(F.col("invalid") > 0, F.lit(False)), **coverage})
    unsupported = F.col("observed") & ~F.col("abstained") & (F.size("support") == 0)
    apart = has_gold & (F.size("support") > 0) & (met("support") == 0)
    reason = F.when(F.col("bad_refs"), "invalid_supporting_refs").when(F.col("bad_issue"), F.col("issue")).when(unsupported, "non_abstain_no_valid_support_refs").when(apart, "support_refs_no_gold_overlap")
    supported = F.col("observed") & ~F.col("abstained") & (F.size("support") > 0) & ~F.col("bad_refs") & ~F.col("bad_issue") & (~has_gold | (met("support") > 0))
    leak = F.exists("support", lambda r: F.array_contains("old_refs", r) & ~F.array_contains("live_refs", r)) | F.exists("old_texts", lambda t: F.contains(_spaced("answer_text"), t))
    x = x.withColumns({"reason": reason, "risk": reason.isNotNull(), "supported": supported, "leakage": leak})
    stage = (
        F.when((F.col("verdict") == "correct") & F.col("supported"), "correct").when(~has_gold, "unknown_no_gold_refs").when(~F.col("in_memory"), "memory_absent").when(~F.col("on_pages"), "page_routing_miss")
        .when(~F.col("in_selection"), "trajectory_selection_miss").when((met("expanded") > 0) & (met("retrieved") == 0), "source_compaction_miss")
        .when((met("retrieved") > 0) & F.col("risk"), "unsupported_overgeneration").when(met("retrieved") > 0, "answer_synthesis_error").otherwise("grounding_miss")
    )
    packet = F.concat_ws("\n", *(F.coalesce(k, F.lit("")) for k in ("question", "answer_text", "gold_answer", "item_texts", "claim_texts")))
    zero = lambda k: F.coalesce(k, F.lit(0))
    return x.select(
        "query_id", "sample_id", "verdict", "gold", "support", "retrieved", "observed", "abstained", *coverage, "supported", "risk", "reason", stage.alias("stage"), F.coalesce("conflict", F.lit(False)).alias("conflict"),
        zero("outdated").alias("outdated"), zero("suppressed").alias("suppressed"), "leakage", (zero("n_items") + zero("n_claims")).alias("packet_items"), F.size(F.array_union("support", "retrieved")).alias("packet_sources"), estimate_tokens(packet).alias("packet_tokens"),
    )


def error_funnel(audit: DataFrame) -> DataFrame:
    """Seven stages over the answers with gold references: mean coverage, any and all hits, and how many answers are
    correct where a stage had some or all of the evidence."""
    x = audit.where(F.size("gold") > 0).unpivot(["query_id", "verdict"], [f"{k}_coverage" for k in STAGES.values()], "field", "c")
    names = F.create_map(*(F.lit(v) for stage, k in STAGES.items() for v in (f"{k}_coverage", stage)))
    right = F.col("verdict") == "correct"
    given = lambda c: F.round(F.try_divide(F.count_if(c & right), F.count_if(c)), 9)
    some, all_ = F.col("c") > 0, F.col("c") >= 1
    return x.groupBy(names[F.col("field")].alias("stage")).agg(_rows().alias("queries"), _mean("c").alias("coverage"), F.count_if(some).alias("any_hit"), F.count_if(all_).alias("all_hit"), given(some).alias("correct_given_any"), given(all_).alias("correct_given_all"))


def audit_packets(audit: DataFrame, answers: DataFrame, items: DataFrame, context: DataFrame, messages: DataFrame) -> DataFrame:
    """Per answer what an auditor has to read: its support references (else the retrieved ones), their messages, the kept
    claims, and the tokens of all that."""
    a = audit.select("query_id", "sample_id", F.when(F.size("support") > 0, F.col("support")).otherwise(F.col("retrieved")).alias("refs"))
    m = a.select("query_id", "sample_id", F.posexplode("refs").alias("at", "source_ref")).join(messages.select("sample_id", "source_ref", "message_id", "content"), ["sample_id", "source_ref"])
    m = m.groupBy("query_id").agg(_rows().alias("sources"), F.array_join(ordered(F.col("content"), "at"), "\n").alias("texts"))
    kept = F.col("kept")
    c = context.groupBy("query_id").agg(ordered(F.when(kept, F.col("claim_id")), "claim_id").alias("ids"), F.array_join(ordered(F.when(kept, F.col("text")), "claim_id"), "\n").alias("claims"), F.count_if(kept & F.col("status").isin(CONFLICTED)).alias("conflicts"), F.count_if(F.col("status").isin(OUTDATED)).alias("outdated"))
    x = a.join(answers.select("query_id", "question", "answer_text", "gold_answer"), "query_id").join(m, "query_id", "left").join(c, "query_id", "left")
    ids = F.array_compact(F.coalesce("ids", F.array().cast("array<long>")))
    text = F.concat_ws("\n", *(F.coalesce(k, F.lit("")) for k in ("question", "answer_text", "gold_answer", "texts", "claims")))
    zero = lambda k: F.coalesce(k, F.lit(0))
    return x.select("query_id", "sample_id", shown("refs").alias("refs"), shown(ids).alias("claim_ids"), zero("sources").alias("sources"), F.size(ids).alias("claims"), zero("conflicts").alias("conflicts"), zero("outdated").alias("outdated"), estimate_tokens(text).alias("tokens"))


def _methods(table: DataFrame, methods: list[str]) -> DataFrame:
    """The one observed row beside rows of nulls for the methods that only have proxies."""
    spark = table.sparkSession
    named = spark.range(1).select(F.explode(F.array(*map(F.lit, methods))).alias("method"))
    return named.join(table.withColumn("method", F.lit(methods[0])), "method", "left").withColumn("queries", F.coalesce("queries", F.lit(0)))


def support_table(audit: DataFrame, methods: list[str]) -> DataFrame:
    """Per method: supported answers, mean coverages, invalid references and judge score; only the first is observed."""
    one = audit.agg(_rows().alias("queries"), _share(F.col("supported")).alias("supported_rate"), _mean("support_coverage").alias("support_coverage"), _mean("retrieved_coverage").alias("retrieved_coverage"), _share(F.col("reason") == "invalid_supporting_refs").alias("invalid_rate"), _mean(judge_score(F.col("verdict"))).alias("judge"))
    return _methods(one, methods)


def unsupported_table(audit: DataFrame, methods: list[str]) -> DataFrame:
    """Per method the rate of answers at risk and how many for each reason."""
    n = lambda r: F.count_if(F.col("reason") == r)
    one = audit.agg(_rows().alias("queries"), _share(F.col("risk")).alias("risk_rate"), n("unsupported_extra_items").alias("extra_items"), n("unsupported_count").alias("wrong_counts"), n("non_abstain_no_valid_support_refs").alias("no_support"), n("invalid_supporting_refs").alias("invalid_refs"), n("support_refs_no_gold_overlap").alias("no_overlap"))
    return _methods(one, methods)


def _binary(predicted: Column, truth: Column) -> tuple[Column, Column]:
    """Accuracy and F1 over the rows that have both."""
    both = predicted.isNotNull() & truth.isNotNull()
    tp, sides = F.count_if(both & predicted & truth), F.count_if(both & predicted) + F.count_if(both & truth)
    return F.round(F.try_divide(F.count_if(both & (predicted == truth)), F.count_if(both)), 9), F.when(tp > 0, F.round(F.try_divide(2 * tp, sides), 9))


def conflict_table(audit: DataFrame, labels: DataFrame, methods: list[str]) -> DataFrame:
    """Per method: conflicts shown, outdated claims suppressed and leaked, and how both agree with the labels."""
    x = audit.join(labels.drop("sample_id", "supported", "stage"), "query_id", "left")
    safe, need = ~F.col("leakage"), F.col("obsolete_required")
    conflict, obsolete = _binary(F.col("conflict"), F.col("conflict_required")), _binary(F.when(need, safe), F.col("obsolete_handled"))
    handled = lambda need, c: F.round(F.avg(F.when(F.col(need), F.col(c).cast("double"))), 9)
    one = x.agg(
        _rows().alias("queries"), _share(F.col("conflict")).alias("conflict_rate"), F.round(F.try_divide(F.sum("suppressed"), F.sum("outdated")), 9).alias("suppression_rate"), _share(F.col("leakage")).alias("leakage_rate"),
        conflict[0].alias("conflict_accuracy"), conflict[1].alias("conflict_f1"), obsolete[0].alias("obsolete_accuracy"), obsolete[1].alias("obsolete_f1"), handled("conflict_required", "conflict_handled").alias("conflict_handled_rate"), handled("obsolete_required", "obsolete_handled").alias("obsolete_handled_rate"),
    )
    return _methods(one, methods)


def packet_costs(packets: DataFrame, queries: DataFrame, messages: DataFrame, labels: DataFrame, grid: DataFrame, proxies: list[str]) -> DataFrame:
    """Mean and median sources and tokens to read: the packet, the full dialogue, and the proxies of the ablation grid."""
    middle = lambda c: F.round(F.expr(f"percentile({c}, 0.5)"), 9)
    sizes = lambda s, t: [_rows().alias("queries"), _mean(s).alias("mean_sources"), middle(s).alias("median_sources"), _mean(t).alias("mean_tokens"), middle(t).alias("median_tokens")]
    wrong = F.round(F.try_divide(F.count_if(~F.col("audit_correct")), F.count("audit_correct")), 9)
    own = packets.join(labels.select("query_id", "seconds", "audit_correct"), "query_id", "left").agg(*sizes("sources", "tokens"), _mean("claims").alias("mean_claims"), _mean("seconds").alias("seconds"), wrong.alias("error_rate")).withColumn("method", F.lit("packet"))
    per = messages.groupBy("sample_id").agg(F.count("source_ref").alias("s"), F.sum(estimate_tokens(F.col("content"))).alias("t"))
    none = F.lit(None).cast("double")
    full = queries.select("sample_id").join(per, "sample_id").agg(*sizes("s", "t")).withColumns({"mean_claims": F.lit(0.0), "seconds": none, "error_rate": none, "method": F.lit("full_dialogue")})
    rest = grid.where(F.col("variant").isin(proxies)).groupBy(F.col("variant").alias("method")).agg(*sizes("items", "tokens")).withColumns({"mean_claims": none, "seconds": none, "error_rate": none})
    return own.unionByName(full).unionByName(rest)


def audit_examples(audit: DataFrame, each: int) -> DataFrame:
    """The first ``each`` answers, by id, of every kind that needs a look: a bounded report."""
    kind = F.when(F.col("risk"), "unsupported_answer_risk").when(F.col("leakage"), "deprecated_leakage").when(F.col("conflict"), "conflict_visible").when(F.col("support_coverage") < 1, "low_support_overlap")
    x = audit.select("query_id", "stage", "support_coverage", "reason", kind.alias("kind")).where("kind is not null")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("query_id"))).where(F.col("place") <= each)


def case_categories(audit: DataFrame) -> DataFrame:
    """The kind of case that an answer is for an audit study."""
    stage = F.col("stage")
    kind = (
        F.when(F.col("leakage") | ((stage == "correct") & F.col("conflict")), "revision_conflict")
        .when(stage.isin("memory_absent", "page_routing_miss", "trajectory_selection_miss", "snapshot_compaction_miss", "source_compaction_miss"), "routing_selection")
        .when(stage.isin("grounding_miss", "answer_synthesis_error", "unsupported_overgeneration") | F.col("risk"), "answer_unsupported")
        .when((stage == "correct") & F.col("supported"), "correct_supported").otherwise("other")
    )
    return audit.select("query_id", kind.alias("category"))


def audit_sample(cases: DataFrame, size: int, kinds: list[str]) -> DataFrame:
    """``size`` cases: an equal quota of each category in a hashed order, the rest of the places at random from all others.
    A sampling operator."""
    order = [F.md5(F.concat_ws(":", "category", F.col("query_id").cast("string"))), "query_id"]
    x = cases.where(F.col("category").isin(kinds)).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
    quota = size // len(kinds)
    first = (F.col("place") <= quota).cast("int")
    x = x.withColumn("first", first).orderBy(F.desc("first"), *order).limit(size)
    return x.select("query_id", "category", (F.col("first") == 1).alias("by_quota"))


def stage_localization(audit: DataFrame, labels: DataFrame) -> DataFrame:
    """Per failure stage its answers, and one against the rest precision, recall and F1 where a label names the stage."""
    x = audit.select("query_id", "stage").join(labels.where("stage is not null").select("query_id", F.col("stage").alias("truth")), "query_id", "left")
    cell = x.groupBy("stage", "truth").agg(_rows().alias("n"))
    known, hit = F.col("truth").isNotNull(), F.col("truth") == F.col("stage")
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    a = cell.groupBy("stage").agg(F.sum("n").alias("queries"), sums(known).alias("predicted"), sums(hit).alias("tp"))
    b = cell.where(known).groupBy(F.col("truth").alias("stage")).agg(F.sum("n").alias("labelled"))
    whole = cell.agg(F.round(F.try_divide(sums(hit), sums(known)), 9).alias("accuracy"), F.sum("n").alias("all"))
    y = a.join(b, "stage", "left").crossJoin(F.broadcast(whole)).withColumn("labelled", F.coalesce("labelled", F.lit(0)))  # one row
    ratio = lambda u, v: F.round(F.try_divide(u, v), 9)
    f1 = F.when(F.col("tp") > 0, ratio(2 * F.col("tp"), F.col("predicted") + F.col("labelled")))
    return y.select("stage", "queries", ratio(F.col("queries"), F.col("all")).alias("rate"), ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("labelled")).alias("recall"), f1.alias("f1"), "accuracy")


def study_summary(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Per condition, over first exposures: time, decisions, and agreement with the labels.

    ``results``: query_id, condition, position (0 first), seconds, decision (yes, no, uncertain), stage, refs, gold.
    """
    x = results.join(labels.select("query_id", "supported", F.col("stage").alias("true_stage")), "query_id", "left")
    first = x.where("position = 0")
    d = F.col("decision")
    right = F.when(F.col("supported").isNotNull() & d.isin("yes", "no", "uncertain"), (d == F.when(F.col("supported"), "yes").otherwise("no")).cast("double"))
    common = F.size(F.array_intersect("refs", "gold"))
    located = lambda c: F.round(F.avg(F.when(F.size("gold") > 0, c)), 9)
    y = first.groupBy("condition").agg(
        _rows().alias("audits"), _mean("seconds").alias("mean_seconds"), F.round(F.expr("percentile(seconds, 0.5)"), 9).alias("median_seconds"), *(_share(d == k).alias(f"{k}_rate") for k in ("yes", "no", "uncertain")),
        _mean(right).alias("support_accuracy"), F.count(right).alias("support_labels"), _mean(F.when(F.col("true_stage").isNotNull(), (F.col("stage") == F.col("true_stage")).cast("double"))).alias("stage_accuracy"),
        located((common > 0).cast("double")).alias("any_overlap"), located(F.coalesce(F.try_divide(common, F.size("refs")), F.lit(0.0))).alias("precision"), located(common / F.size("gold")).alias("recall"),
    )
    return y.join(x.groupBy("condition").agg(_rows().alias("exposures")), "condition")


def disagreements(results: DataFrame) -> DataFrame:
    """Cases whose two annotators decide differently in a condition."""
    side = lambda k, name: results.where(F.col("annotator") == k).select("query_id", "condition", F.struct("decision", "stage").alias(name))
    x = side(0, "a").join(side(1, "b"), ["query_id", "condition"]).where("a <> b")
    return x.select("query_id", "condition", F.col("a.decision").alias("decision_0"), F.col("b.decision").alias("decision_1"), F.col("a.stage").alias("stage_0"), F.col("b.stage").alias("stage_1"))


def condition_kappa(results: DataFrame, field: str) -> DataFrame:
    """Cohen's kappa of the two annotators for each condition; null where they can only agree."""
    side = lambda k, name: results.where(F.col("annotator") == k).select("query_id", "condition", F.col(field).alias(name))
    cell = side(0, "a").join(side(1, "b"), ["query_id", "condition"]).groupBy("condition", "a", "b").agg(_rows().alias("n"))
    n = cell.groupBy("condition").agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = cell.groupBy("condition", F.col("a").alias("v")).agg(F.sum("n").alias("x")), cell.groupBy("condition", F.col("b").alias("v")).agg(F.sum("n").alias("y"))
    xy = rows.join(cols, ["condition", "v"]).groupBy("condition").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    z = n.join(xy, "condition", "left").withColumn("xy", F.coalesce("xy", F.lit(0)))
    po, pe = F.col("same") / F.col("pairs"), F.col("xy") / (F.col("pairs") * F.col("pairs"))
    return z.select("condition", "pairs", F.round(po, 9).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 9).alias("kappa"))
