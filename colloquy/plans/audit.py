"""Queries of the audit operators, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import memory as M
from ..operators import reports as P
from .memory import _CELLS, _GOLD, _HITS, _REFS, events, hits, index, items, labels
from .registry import _JUDGE, _TOKENS, query

METHODS = ["observed", "full_context_proxy", "flat_raw"]
STAGES = "source_stored linked_to_trajectory reachable_from_pages trajectory_selected snapshot_expanded source_in_context used_in_support".split()


def answers(v):
    """fx_answers with the metadata that their support rows give, as JSON."""
    valid, at = F.col("kind") == "valid", F.col("message_id")
    refs = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("message_id", "source_ref")))), lambda s: s.source_ref)
    pairs = lambda name, c: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("message_id", "source_ref")))), lambda s: F.struct(F.concat(F.lit(f"{name} "), s.message_id.cast("string")).alias("key"), F.when((s.message_id % 4 == 0) | F.lit(name == "need"), F.array(s.source_ref)).otherwise(F.array().cast("array<string>")).alias("value"))))
    counted = F.transform(F.array_sort(F.collect_list(F.when(valid & (at % 6 == 0), F.struct("message_id", "source_ref")))), lambda s: F.struct(F.concat(F.lit("event "), s.message_id.cast("string")).alias("event"), F.array(s.source_ref).alias("refs")))
    m = v("fx_support").groupBy("query_id").agg(
        refs(valid & (at % 4 == 0)).alias("supporting_refs"), refs(F.col("kind") == "invalid").alias("invalid_refs"), pairs("item", valid).alias("list_items"), pairs("need", valid & (at % 8 == 6)).alias("required_items"),
        F.struct((F.first("query_id") % 2 == 0).alias("used"), refs(valid & (at % 8 == 2)).alias("refs"), F.lit("bridge").alias("target")).alias("bridge"), F.min(F.when(valid & (at % 8 == 4), F.col("source_ref"))).alias("temporal_ref"), counted.alias("counted_events"),
    )
    return v("fx_answers").join(m.select("query_id", F.to_json(F.struct(*[c for c in m.columns if c != "query_id"])).alias("metadata")), "query_id", "left")


def support(v):
    return v.once("support_items", lambda: A.support_items(answers(v), v("fx_messages")))


def context(v):
    return v.once("context_claims", lambda: A.context_claims(v.table("fx_expanded"), v("fx_claims")))


def audit(v):
    return v.once("audit", lambda: A.auditability(v("fx_answers"), labels(v), events(v), index(v), v("fx_page_members"), v("fx_messages"), support(v), context(v)))


def packets(v):
    return A.audit_packets(audit(v), v("fx_answers"), support(v), context(v), v("fx_messages"))


PROXIES = ["flat_raw", "no_pages_direct"]


def proxy_grid(v):
    """The one cell of the ablation grid and the variants of it that packets are held against."""
    every = items(v)
    return M.ablation_grid(M.all_items([every[x] for x in PROXIES]), labels(v), [15], [400], PROXIES)


_ISSUES = "('unsupported_extra_items', 'unsupported_count', 'invalid_supporting_refs', 'scope_mismatched_extra_item', 'overgeneric_item')"
_SUPPORT = f"""sup AS (SELECT * FROM fx_support WHERE kind = 'valid'),
  parts AS (SELECT query_id, query_id || ':supported_list_item:item ' || message_id AS item_id, 'supported_list_item' AS kind, 'item ' || message_id AS text, CASE WHEN message_id % 4 = 0 THEN source_ref END AS ref, CASE WHEN message_id % 4 = 0 THEN message_id END AS mid FROM sup
    UNION ALL SELECT query_id, query_id || ':supported_required_item:need ' || message_id, 'supported_required_item', 'need ' || message_id, source_ref, message_id FROM sup WHERE message_id % 8 = 6
    UNION ALL SELECT query_id, query_id || ':bridge', 'bridge_finalization', 'bridge', CASE WHEN kind = 'valid' AND message_id % 8 = 2 THEN source_ref END, CASE WHEN kind = 'valid' AND message_id % 8 = 2 THEN message_id END FROM fx_support WHERE query_id % 2 = 0 OR (kind = 'valid' AND message_id % 8 = 2)
    UNION ALL SELECT query_id, query_id || ':temporal', 'temporal_alignment', min(source_ref), min(source_ref), arg_min(message_id, source_ref) FROM sup WHERE message_id % 8 = 4 GROUP BY query_id
    UNION ALL SELECT query_id, query_id || ':counted_event:' || row_number() OVER (PARTITION BY query_id ORDER BY message_id), 'counted_event', 'event ' || message_id, source_ref, message_id FROM sup WHERE message_id % 6 = 0
    UNION ALL SELECT a.query_id, a.query_id || ':final_answer', 'final_answer', a.answer_text, s.source_ref, s.message_id FROM fx_answers a LEFT JOIN sup s ON s.query_id = a.query_id),
  bad AS (SELECT query_id, count(*) AS n FROM fx_support WHERE kind = 'invalid' GROUP BY 1),
  si AS (SELECT p.query_id, p.item_id, p.kind, p.text, coalesce(string_agg(DISTINCT ref, ' ' ORDER BY ref), '') AS refs, count(ref) AS n, coalesce(array_to_string(list_sort(list_distinct(list(mid) FILTER (mid IS NOT NULL))), ' '), '') AS message_ids, a.issue,
    CASE WHEN p.kind = 'final_answer' AND max(bad.n) > 0 THEN 'invalid_source_ref' WHEN count(ref) = 0 THEN 'no_visible_source' WHEN p.kind = 'final_answer' AND a.issue IN {_ISSUES} THEN 'unsupported_postcheck' ELSE 'supported' END AS status
    FROM parts p JOIN fx_answers a ON a.query_id = p.query_id LEFT JOIN bad ON bad.query_id = p.query_id GROUP BY p.query_id, p.item_id, p.kind, p.text, a.issue)"""


@query("j1_answer_support_items", f"WITH {_SUPPORT} SELECT query_id, item_id, kind, text, refs, message_ids, status, issue FROM si")
def _(v):
    return support(v).select("query_id", "item_id", "kind", "text", M.shown(F.array_sort("refs")).alias("refs"), M.shown(F.array_sort("message_ids")).alias("message_ids"), "status", "issue")


_SPACE = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
_ABSTAIN = f"{_SPACE.format('answer_text')} = '' OR regexp_matches({_SPACE.format('answer_text')}, 'not enough|not supported|cannot answer|can''t answer|do not have enough|don''t have enough|insufficient|unknown|not available|no retrieved evidence')"
_AUDIT = f"""{_SUPPORT}, {_HITS}, refs_ AS ({_REFS}),
  used AS (SELECT DISTINCT query_id, ref AS source_ref FROM parts JOIN si USING (query_id, item_id) WHERE ref IS NOT NULL AND status <> 'no_visible_source'),
  got AS (SELECT e.query_id, tier, m.source_ref FROM fx_event_items e JOIN fx_messages m ON m.message_id = e.item_id WHERE tier IN ('expanded', 'source')),
  gg AS (SELECT DISTINCT query_id, sample_id, source_ref FROM fx_gold),
  cov AS (SELECT query_id, count(*) AS ng, avg(EXISTS (SELECT 1 FROM fx_messages m WHERE m.sample_id = gg.sample_id AND m.source_ref = gg.source_ref)::INT) AS stored_coverage,
    avg(EXISTS (SELECT 1 FROM refs_ r WHERE r.sample_id = gg.sample_id AND r.source_ref = gg.source_ref)::INT) AS linked_coverage,
    avg(EXISTS (SELECT 1 FROM refs_ r JOIN fx_page_members p ON p.trajectory_id = r.trajectory_id JOIN fx_event_items e ON e.tier = 'page' AND e.item_id = p.page_id WHERE e.query_id = gg.query_id AND r.source_ref = gg.source_ref)::INT) AS routed_coverage,
    avg(EXISTS (SELECT 1 FROM refs_ r JOIN fx_event_items e ON e.tier = 'trajectory' AND e.item_id = r.trajectory_id WHERE e.query_id = gg.query_id AND r.source_ref = gg.source_ref)::INT) AS selected_coverage,
    avg(EXISTS (SELECT 1 FROM got WHERE got.tier = 'expanded' AND got.query_id = gg.query_id AND got.source_ref = gg.source_ref)::INT) AS expanded_coverage,
    avg(EXISTS (SELECT 1 FROM got WHERE got.tier = 'source' AND got.query_id = gg.query_id AND got.source_ref = gg.source_ref)::INT) AS retrieved_coverage,
    avg(EXISTS (SELECT 1 FROM used WHERE used.query_id = gg.query_id AND used.source_ref = gg.source_ref)::INT) AS support_coverage FROM gg GROUP BY query_id),
  ctx AS (SELECT x.query_id, c.* FROM fx_expanded x JOIN fx_claims c ON c.snapshot_id = x.snapshot_id),
  cc AS (SELECT query_id, count(*) AS n, count(*) FILTER (status = 'deprecated') AS outdated, bool_or(status IN ('contradictory', 'needs-confirmation')) AS conflict, string_agg(text, chr(10) ORDER BY claim_id) FILTER (status <> 'deprecated') AS texts FROM ctx GROUP BY 1),
  st AS (SELECT query_id, count(*) AS n, string_agg(coalesce(text, ''), chr(10) ORDER BY item_id) AS texts FROM si GROUP BY 1),
  flags AS (SELECT a.*, cov.*, per.stored AS h_stored, per.routed AS h_routed, per.selected AS h_selected, trim(coalesce(answer_text, '')) <> '' AND verdict <> 'judge_error' AS observed, {_ABSTAIN} AS abstained, (SELECT count(*) FROM used WHERE used.query_id = a.query_id) AS ns, coalesce(bad.n, 0) > 0 AS bad_refs, coalesce(issue IN {_ISSUES}, FALSE) AS bad_issue,
    EXISTS (SELECT 1 FROM used WHERE used.query_id = a.query_id AND EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = a.query_id AND ctx.status = 'deprecated' AND ctx.source_ref = used.source_ref) AND NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = a.query_id AND ctx.status <> 'deprecated' AND ctx.source_ref = used.source_ref))
      OR EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = a.query_id AND ctx.status = 'deprecated' AND length({_SPACE.format('ctx.text')}) >= 12 AND contains({_SPACE.format('a.answer_text')}, {_SPACE.format('ctx.text')})) AS leakage,
    coalesce(cc.conflict, FALSE) AS conflict, coalesce(cc.outdated, 0) AS outdated, st.n + coalesce(cc.n, 0) AS packet_items, (SELECT count(*) FROM (SELECT source_ref FROM used WHERE used.query_id = a.query_id UNION SELECT source_ref FROM got WHERE got.tier = 'source' AND got.query_id = a.query_id)) AS packet_sources,
    {_TOKENS.format("concat_ws(chr(10), coalesce(question, ''), coalesce(answer_text, ''), coalesce(gold_answer, ''), st.texts, coalesce(cc.texts, ''))")} AS packet_tokens
    FROM fx_answers a LEFT JOIN cov ON cov.query_id = a.query_id LEFT JOIN per ON per.query_id = a.query_id LEFT JOIN bad ON bad.query_id = a.query_id LEFT JOIN cc ON cc.query_id = a.query_id LEFT JOIN st ON st.query_id = a.query_id),
  judged AS (SELECT *, observed AND NOT abstained AND ns > 0 AND NOT bad_refs AND NOT bad_issue AND (ng IS NULL OR support_coverage > 0) AS supported,
    CASE WHEN bad_refs THEN 'invalid_supporting_refs' WHEN bad_issue THEN issue WHEN observed AND NOT abstained AND ns = 0 THEN 'non_abstain_no_valid_support_refs' WHEN ng > 0 AND ns > 0 AND support_coverage = 0 THEN 'support_refs_no_gold_overlap' END AS reason FROM flags),
  audit AS (SELECT *, reason IS NOT NULL AS risk, CASE WHEN verdict = 'correct' AND supported THEN 'correct' WHEN ng IS NULL THEN 'unknown_no_gold_refs' WHEN NOT h_stored THEN 'memory_absent' WHEN NOT h_routed THEN 'page_routing_miss' WHEN NOT h_selected THEN 'trajectory_selection_miss'
    WHEN expanded_coverage > 0 AND retrieved_coverage = 0 THEN 'source_compaction_miss' WHEN retrieved_coverage > 0 AND reason IS NOT NULL THEN 'unsupported_overgeneration' WHEN retrieved_coverage > 0 THEN 'answer_synthesis_error' ELSE 'grounding_miss' END AS stage FROM judged)"""
_COVERAGES = "stored linked routed selected expanded retrieved support".split()
_ROUNDED = ", ".join(f"round({c}_coverage, 9) AS {c}_coverage" for c in _COVERAGES)
_KEPT = [f"{c}_coverage" for c in _COVERAGES]
query("j2_auditability_rows", f"WITH {_AUDIT} SELECT query_id, observed, abstained, {_ROUNDED}, supported, risk, reason, conflict, outdated, outdated AS suppressed, leakage, packet_items, packet_sources, packet_tokens FROM audit")(
    lambda v: audit(v).select("query_id", "observed", "abstained", *_KEPT, "supported", "risk", "reason", "conflict", "outdated", "suppressed", "leakage", "packet_items", "packet_sources", "packet_tokens")
)
query("j3_failure_stage", f"WITH {_AUDIT} SELECT query_id, stage FROM audit")(lambda v: audit(v).select("query_id", "stage"))
_FUNNEL = " UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) AS queries, round(avg({c}_coverage), 9) AS coverage, count(*) FILTER ({c}_coverage > 0) AS any_hit, count(*) FILTER ({c}_coverage >= 1) AS all_hit, round(count(*) FILTER ({c}_coverage > 0 AND verdict = 'correct') / nullif(count(*) FILTER ({c}_coverage > 0), 0), 9) AS correct_given_any, round(count(*) FILTER ({c}_coverage >= 1 AND verdict = 'correct') / nullif(count(*) FILTER ({c}_coverage >= 1), 0), 9) AS correct_given_all FROM audit WHERE ng > 0" for s, c in zip(STAGES, _COVERAGES, strict=True))
query("j4_error_propagation_funnel", f"WITH {_AUDIT} {_FUNNEL}")(lambda v: A.error_funnel(audit(v)))
_PACKETS = f"""{_AUDIT}, pr AS (SELECT query_id, source_ref FROM used UNION SELECT g.query_id, g.source_ref FROM got g WHERE g.tier = 'source' AND g.query_id NOT IN (SELECT query_id FROM used)),
  pm AS (SELECT pr.query_id, count(*) AS sources, string_agg(m.content, chr(10) ORDER BY m.message_id) AS texts, string_agg(pr.source_ref, ' ' ORDER BY pr.source_ref) AS refs FROM pr JOIN fx_queries q ON q.query_id = pr.query_id JOIN fx_messages m ON m.sample_id = q.sample_id AND m.source_ref = pr.source_ref GROUP BY 1),
  pc AS (SELECT query_id, string_agg(CAST(claim_id AS VARCHAR), ' ' ORDER BY claim_id) FILTER (status <> 'deprecated') AS ids, count(*) FILTER (status <> 'deprecated') AS claims, count(*) FILTER (status IN ('contradictory', 'needs-confirmation')) AS conflicts FROM ctx GROUP BY 1),
  packets AS (SELECT a.query_id, coalesce(pm.refs, '') AS refs, coalesce(pc.ids, '') AS claim_ids, coalesce(pm.sources, 0) AS sources, coalesce(pc.claims, 0) AS claims, coalesce(pc.conflicts, 0) AS conflicts, a.outdated, {_TOKENS.format("concat_ws(chr(10), coalesce(question, ''), coalesce(answer_text, ''), coalesce(gold_answer, ''), coalesce(pm.texts, ''), coalesce(cc.texts, ''))")} AS tokens
    FROM audit a LEFT JOIN pm ON pm.query_id = a.query_id LEFT JOIN pc ON pc.query_id = a.query_id LEFT JOIN cc ON cc.query_id = a.query_id)"""


@query("j5_audit_packets", f"WITH {_PACKETS} SELECT * FROM packets")
def _(v):
    return packets(v).drop("sample_id").withColumn("refs", F.array_join(F.array_sort(F.filter(F.split("refs", " "), lambda r: r != "")), " "))


def _table(name: str, one: str, nulls: str, op) -> None:
    rest = " UNION ALL ".join(f"SELECT '{m}', 0, {nulls}" for m in METHODS[1:])
    query(name, f"WITH {_AUDIT} SELECT 'observed' AS method, count(*) AS queries, {one} FROM audit UNION ALL {rest}")(op)


_RATE = "round(avg(coalesce({0}, FALSE)::INT), 9) AS {1}"
_table("j6_source_support_table", f"{_RATE.format('supported', 'supported_rate')}, round(avg(support_coverage), 9) AS support_coverage, round(avg(retrieved_coverage), 9) AS retrieved_coverage, {_RATE.format('bad_refs', 'invalid_rate')}, round(avg({_JUDGE}), 9) AS judge", "NULL, NULL, NULL, NULL, NULL", lambda v: A.support_table(audit(v), METHODS))
_COUNTS = {"unsupported_extra_items": "extra_items", "unsupported_count": "wrong_counts", "non_abstain_no_valid_support_refs": "no_support", "invalid_supporting_refs": "invalid_refs", "support_refs_no_gold_overlap": "no_overlap"}
_table("j6_unsupported_table", f"{_RATE.format('risk', 'risk_rate')}, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {c}" for r, c in _COUNTS.items()), "NULL, NULL, NULL, NULL, NULL, NULL", lambda v: A.unsupported_table(audit(v), METHODS))
_LABELLED = f"{_AUDIT}, lab AS (SELECT a.*, l.conflict_required, l.conflict_handled, l.obsolete_required, l.obsolete_handled, l.stage AS truth, l.seconds, l.audit_correct FROM audit a LEFT JOIN fx_audit_labels l ON l.query_id = a.query_id)"
_F1 = "CASE WHEN count(*) FILTER ({p} AND {t}) > 0 THEN round(2 * count(*) FILTER ({p} AND {t}) / (count(*) FILTER ({p} AND {t} IS NOT NULL) + count(*) FILTER ({t} AND {p} IS NOT NULL)), 9) END"
_SAFE = "CASE WHEN obsolete_required THEN NOT leakage END"
query("j9_conflict_obsolete_table", f"""WITH {_LABELLED} SELECT 'observed' AS method, count(*) AS queries, {_RATE.format('conflict', 'conflict_rate')}, CAST(1.0 AS DOUBLE) * sum(outdated) / nullif(sum(outdated), 0) AS suppression_rate, {_RATE.format('leakage', 'leakage_rate')},
  round(avg((conflict = conflict_required)::INT), 9) AS conflict_accuracy, {_F1.format(p='conflict', t='conflict_required')} AS conflict_f1, round(avg((({_SAFE}) = obsolete_handled)::INT), 9) AS obsolete_accuracy, {_F1.format(p=f'({_SAFE})', t='obsolete_handled')} AS obsolete_f1,
  round(avg(conflict_handled::INT) FILTER (conflict_required), 9) AS conflict_handled_rate, round(avg(obsolete_handled::INT) FILTER (obsolete_required), 9) AS obsolete_handled_rate FROM lab UNION ALL SELECT m, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest({METHODS[1:]}) AS m)""")(
    lambda v: A.conflict_table(audit(v), v("fx_audit_labels"), METHODS)
)
_CELLS_OWN = _CELLS.replace("refs_ AS (", "r2_ AS (").replace("refs_.", "r2_.").replace("JOIN refs_", "JOIN r2_").replace("used AS (", "u2 AS (").replace("JOIN used u", "JOIN u2 u")
query("j10_audit_packet_cost", f"""WITH {_PACKETS}, {_CELLS_OWN}, pk AS (SELECT 'packet' AS method, count(*) AS queries, round(avg(sources), 9) AS mean_sources, median(sources) AS median_sources, round(avg(p.tokens), 9) AS mean_tokens, median(p.tokens) AS median_tokens, round(avg(claims), 9) AS mean_claims, round(avg(seconds), 9) AS seconds, round(count(*) FILTER (NOT audit_correct) / nullif(count(audit_correct), 0), 9) AS error_rate FROM packets p LEFT JOIN fx_audit_labels l ON l.query_id = p.query_id),
  fd AS (SELECT q.query_id, count(m.source_ref) AS s, sum({_TOKENS.format('m.content')}) AS t FROM fx_queries q JOIN fx_messages m ON m.sample_id = q.sample_id GROUP BY 1)
  SELECT * FROM pk UNION ALL SELECT 'full_dialogue', count(*), round(avg(s), 9), median(s), round(avg(t), 9), median(t), 0, NULL, NULL FROM fd
  UNION ALL SELECT variant, count(*), round(avg(items), 9), median(items), round(avg(tokens), 9), median(tokens), NULL, NULL, NULL FROM grid WHERE cutoff = 15 AND budget = 400 AND variant IN ('flat_raw', 'no_pages_direct') GROUP BY variant""")(
    lambda v: A.packet_costs(packets(v), v("fx_queries"), v("fx_messages"), v("fx_audit_labels"), proxy_grid(v), PROXIES)
)
query("j11_audit_examples", f"WITH {_AUDIT}, k AS (SELECT query_id, stage, round(support_coverage, 9) AS support_coverage, reason, CASE WHEN risk THEN 'unsupported_answer_risk' WHEN leakage THEN 'deprecated_leakage' WHEN conflict THEN 'conflict_visible' WHEN support_coverage < 1 THEN 'low_support_overlap' END AS kind FROM audit) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY query_id) AS place FROM k WHERE kind IS NOT NULL QUALIFY place <= 50")(
    lambda v: A.audit_examples(audit(v), 50)
)
_CASES = f"{_AUDIT}, cases AS (SELECT query_id, CASE WHEN leakage OR (stage = 'correct' AND conflict) THEN 'revision_conflict' WHEN stage IN ('memory_absent', 'page_routing_miss', 'trajectory_selection_miss', 'snapshot_compaction_miss', 'source_compaction_miss') THEN 'routing_selection' WHEN stage IN ('grounding_miss', 'answer_synthesis_error', 'unsupported_overgeneration') OR risk THEN 'answer_unsupported' WHEN stage = 'correct' AND supported THEN 'correct_supported' ELSE 'other' END AS category FROM audit)"
KINDS = ["revision_conflict", "routing_selection", "answer_unsupported", "correct_supported"]
query("j12_audit_case_category", f"WITH {_CASES} SELECT * FROM cases")(lambda v: A.case_categories(audit(v)))
query("j12_audit_case_sample", f"WITH {_CASES}, p AS (SELECT *, md5(category || ':' || query_id) AS o, row_number() OVER (PARTITION BY category ORDER BY md5(category || ':' || query_id), query_id) <= 3 AS by_quota FROM cases WHERE category <> 'other') SELECT query_id, category, by_quota FROM p ORDER BY by_quota DESC, o, query_id LIMIT 15")(
    lambda v: A.audit_sample(A.case_categories(audit(v)), 15, KINDS)
)
query("j8_failure_localization", f"""WITH {_LABELLED}, c AS (SELECT stage, count(*) AS queries, count(truth) AS predicted, count(*) FILTER (truth = stage) AS tp, (SELECT count(*) FROM lab l WHERE l.truth = lab.stage) AS labelled FROM lab GROUP BY stage)
  SELECT stage, queries, round(queries / (SELECT count(*) FROM lab), 9) AS rate, round(tp / nullif(predicted, 0), 9) AS precision, round(tp / nullif(labelled, 0), 9) AS recall, CASE WHEN tp > 0 THEN round(2 * tp / (predicted + labelled), 9) END AS f1, (SELECT round(count(*) FILTER (truth = stage) / nullif(count(truth), 0), 9) FROM lab) AS accuracy FROM c""")(
    lambda v: A.stage_localization(audit(v), v("fx_audit_labels"))
)

_RESULTS = "tasks AS (SELECT query_id, annotator, position, CASE WHEN (query_id + annotator + position) % 2 = 0 THEN 'packet' ELSE 'dialogue' END AS condition, 30 + (query_id * 7 + annotator * 3 + position * 5) % 60 AS seconds, CASE (query_id + annotator * 2 + position) % 4 WHEN 2 THEN 'no' WHEN 3 THEN 'uncertain' ELSE 'yes' END AS decision, CASE (query_id + annotator) % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'trajectory_selection_miss' ELSE 'answer_synthesis_error' END AS stage FROM fx_queries, (SELECT unnest([0, 1]) AS annotator), (SELECT unnest([0, 1]) AS position))"


def results(v):
    t = P.counterbalanced_tasks(v("fx_queries"), "query_id").selectExpr(
        "query_id", "annotator", "position", "condition", "30 + (query_id * 7 + annotator * 3 + position * 5) % 60 AS seconds",
        "CASE (query_id + annotator * 2 + position) % 4 WHEN 2 THEN 'no' WHEN 3 THEN 'uncertain' ELSE 'yes' END AS decision", "CASE (query_id + annotator) % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'trajectory_selection_miss' ELSE 'answer_synthesis_error' END AS stage",
    )
    return t.join(events(v).select("query_id", F.col("source_refs").alias("refs")), "query_id", "left").join(labels(v).select("query_id", F.col("source_refs").alias("gold")), "query_id")


query("j14_audit_study_summary", f"""WITH {_RESULTS}, got AS (SELECT e.query_id, m.source_ref FROM fx_event_items e JOIN fx_messages m ON m.message_id = e.item_id WHERE tier = 'source'),
  loc AS (SELECT q.query_id, (SELECT count(*) FROM got WHERE got.query_id = q.query_id) AS np, (SELECT count(DISTINCT source_ref) FROM fx_gold g WHERE g.query_id = q.query_id) AS ng, (SELECT count(DISTINCT g.source_ref) FROM fx_gold g JOIN got ON got.query_id = g.query_id AND got.source_ref = g.source_ref WHERE g.query_id = q.query_id) AS both_ FROM fx_queries q),
  x AS (SELECT t.*, l.supported, l.stage AS true_stage, np, ng, both_ FROM tasks t LEFT JOIN fx_audit_labels l ON l.query_id = t.query_id JOIN loc ON loc.query_id = t.query_id)
  SELECT condition, count(*) FILTER (position = 0) AS audits, count(*) AS exposures, round(avg(seconds) FILTER (position = 0), 9) AS mean_seconds, median(seconds) FILTER (position = 0) AS median_seconds, round(avg((decision = 'yes')::INT) FILTER (position = 0), 9) AS yes_rate, round(avg((decision = 'no')::INT) FILTER (position = 0), 9) AS no_rate, round(avg((decision = 'uncertain')::INT) FILTER (position = 0), 9) AS uncertain_rate,
  round(avg((decision = CASE WHEN supported THEN 'yes' ELSE 'no' END)::INT) FILTER (position = 0 AND supported IS NOT NULL), 9) AS support_accuracy, count(supported) FILTER (position = 0) AS support_labels, round(avg((stage = true_stage)::INT) FILTER (position = 0), 9) AS stage_accuracy,
  round(avg((both_ > 0)::INT) FILTER (position = 0 AND ng > 0), 9) AS any_overlap, round(avg(coalesce(both_ / nullif(np, 0), 0)) FILTER (position = 0 AND ng > 0), 9) AS precision, round(avg(both_ / ng) FILTER (position = 0 AND ng > 0), 9) AS recall FROM x GROUP BY condition""")(
    lambda v: A.study_summary(results(v), v("fx_audit_labels"))
)
_SIDES = f"WITH {_RESULTS}, p AS (SELECT x.query_id, x.condition, x.decision AS a, y.decision AS b, x.stage AS s, y.stage AS t FROM tasks x JOIN tasks y ON x.query_id = y.query_id AND x.condition = y.condition AND x.annotator = 0 AND y.annotator = 1)"
query("j15_disagreements", f"{_SIDES} SELECT query_id, condition, a AS decision_0, b AS decision_1, s AS stage_0, t AS stage_1 FROM p WHERE a <> b OR s <> t")(lambda v: A.disagreements(results(v)))
query("j15_condition_kappa", f"{_SIDES}, n AS (SELECT condition, count(*) AS pairs, avg((a = b)::INT) AS po FROM p GROUP BY 1), r AS (SELECT condition, a AS v, count(*) AS x FROM p GROUP BY ALL), c AS (SELECT condition, b AS v, count(*) AS y FROM p GROUP BY ALL), e AS (SELECT r.condition, sum(x * y) AS xy FROM r JOIN c ON r.condition = c.condition AND r.v = c.v GROUP BY 1) SELECT n.condition, pairs, round(po, 9) AS agreement, round((po - coalesce(xy, 0) / (pairs * pairs)) / nullif(1 - coalesce(xy, 0) / (pairs * pairs), 0), 9) AS kappa FROM n LEFT JOIN e ON e.condition = n.condition")(
    lambda v: A.condition_kappa(results(v), "decision")
)

query("d11_speaker_grounding_audit", "SELECT claim_id, regexp_matches(lower(source_text), '\\b(my|our|mine|ours)\\b') AND len(list_filter(regexp_extract_all(text, '\\b([A-Z][a-z]+)''s\\b', 1), lambda n: lower(n) <> lower(speaker))) > 0 AS suspect, regexp_matches(lower(text), '\\b(the user|the assistant)\\b') AS generic FROM fx_note_claims")(
    lambda v: A.grounding(v.table("fx_note_claims"))
)
query("b7_suppressed_claim_filter", "SELECT claim_id, CASE WHEN status = 'deprecated' THEN 'deprecated' WHEN contains(lower(source_text), 'my ') AND regexp_extract(text, '([A-Z][a-z]+)''s', 1) NOT IN ('', speaker) THEN 'speaker_suspect' END AS reason, reason IS NULL AS kept FROM fx_note_claims")(
    lambda v: A.context_claims(v.table("fx_note_claims").selectExpr("sample_id AS query_id", "snapshot_id"), v.table("fx_note_claims").withColumn("source_ref", F.col("source_message_id")), A.grounding(v.table("fx_note_claims"))).select("claim_id", "reason", "kept")
)
