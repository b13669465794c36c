"""Queries of results, costs, failures and robustness, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as C
from ..functions.text import estimate_tokens
from ..operators import analysis as A
from ..operators import evaluation as E
from ..operators import memory as M
from ..operators import results as X
from ..operators import retrieval as R
from .audit import support
from .build import _CAND, claims, wanted
from .memory import _CELLS, _HITS, _REFS, events, grid, hits, index, labels
from .registry import _JUDGE, _NORM, _PHASE, _TOKENS, query
from .reports import _ITEM_TOKENS, _ITEMS
from .scoring import _OVER, _P, asked, ranked

PRICES = [("small", 0.15, 0.6), ("large", 1.0, 3.0), ("judge-1", 2.0, 8.0), ("unknown", None, None)]
UMBRELLAS = {"activities": ["hiking", "painting", "chess"], "books": ["3 books"]}


def _of(name: str, sql: str | None, view: str, op):
    query(name, sql)(lambda v: op(v(view)))


def _values(v):
    return v("fx_note_answers").select(F.col("query_id").alias("id"), X.canonical_values(F.col("answer_text")).alias("predicted"), X.canonical_values(F.col("gold_answer")).alias("gold"))


_VALS = f"list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace({{0}}, '\\s+(and|or)\\s+|[,;/\\n]+', chr(31), 'gi'), chr(31)), lambda p: {_NORM.format('p')}), lambda p: p <> ''))"
query("g6_split_values_canonical", f"SELECT query_id AS id, array_to_string(list_sort({_VALS.format('answer_text')}), '|') AS predicted, array_to_string(list_sort({_VALS.format('gold_answer')}), '|') AS gold FROM fx_note_answers")(lambda v: _values(v).select("id", F.array_join(F.array_sort("predicted"), "|").alias("predicted"), F.array_join(F.array_sort("gold"), "|").alias("gold")))
query("g5_exact_set_f1", f"WITH x AS (SELECT query_id AS id, {_VALS.format('answer_text')} AS p, {_VALS.format('gold_answer')} AS g FROM fx_note_answers), n AS (SELECT *, len(list_intersect(p, g)) AS n FROM x) SELECT id, round(n / len(p), 9) AS precision, round(n / len(g), 9) AS recall, round(2 * n / (len(p) + len(g)), 9) AS f1 FROM n")(lambda v: X.exact_set_f1(_values(v)))
query("g5_canonical_set_f1", None)(lambda v: X.canonical_f1(_values(v), {"books": "book"}, ["left", "right"]))


def _override(v):
    f = X.canonical_f1(_values(v), {}, []).select(F.col("id").alias("query_id"), "f1", F.size("extra").alias("extra"), F.size("missing").alias("missing"))
    a = v("fx_note_answers").select("query_id", "verdict", F.col("answer_text").alias("answer"), F.lower("question").rlike("how many").alias("counting"), (F.col("answer_text") == F.col("gold_answer")).alias("exact"))
    return X.judge_override(a.join(f, "query_id"))


query("g8_judge_semantic_override", None)(_override)
_SCENE = "CASE CAST(floor(query_id / 4) AS BIGINT) % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'work' ELSE 'travel' END"
query("g10_aggregate_subset_scene", f"WITH x AS (SELECT *, {_SCENE} AS scene, {_JUDGE} AS j FROM fx_outcomes), c AS (SELECT coalesce(variant, 'all') AS variant, coalesce(scene, 'all') AS scene, count(*) AS n, round(avg(j), 9) AS judge, round(avg(token_f1), 6) AS token_f1 FROM x GROUP BY CUBE (variant, scene)) SELECT v.variant, s.scene, coalesce(c.n, 0) AS n, c.judge, c.token_f1 FROM (SELECT DISTINCT variant FROM c) v CROSS JOIN (SELECT unnest(['home', 'work', 'travel', 'moon', 'all']) AS scene) s LEFT JOIN c ON c.variant = v.variant AND c.scene = s.scene")(
    lambda v: X.subset_scene_grid(v("fx_outcomes").withColumn("scene", F.expr(_SCENE)), ["home", "work", "travel", "moon"])
)
query("i2_cost_reconciliation", "WITH c AS (SELECT * FROM fx_calls WHERE call_item_uid > 0) SELECT (SELECT count(*) FROM fx_calls) AS raw_rows, (SELECT coalesce(sum(prompt_tokens), 0)::BIGINT FROM fx_calls) AS raw_prompt, (SELECT coalesce(sum(completion_tokens), 0)::BIGINT FROM fx_calls) AS raw_completion, count(*) AS compact_rows, count(DISTINCT provider_call_uid) AS provider_calls, 0::BIGINT AS missing_uid, coalesce(sum(prompt_tokens), 0)::BIGINT AS compact_prompt, coalesce(sum(completion_tokens), 0)::BIGINT AS compact_completion, round(avg((sample_id IS NOT NULL)::INT), 9) AS sample_rate, round(avg((query_id IS NOT NULL)::INT), 9) AS query_rate, count(*) - count(DISTINCT call_item_uid) AS duplicates, (SELECT coalesce(sum(prompt_tokens), 0) FROM fx_calls) = coalesce(sum(prompt_tokens), 0) AND (SELECT sum(completion_tokens) FROM fx_calls) = sum(completion_tokens) AS reconciled FROM c")(
    lambda v: X.reconciliation(v("fx_calls"), v("fx_calls").where("call_item_uid > 0"))
)
_of("i2_reconciliation_detail", "SELECT worker_id, role, task, count(*) AS items, count(DISTINCT provider_call_uid) AS provider_calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, round(sum(latency_ms), 3) AS latency_ms, count(sample_id) AS with_sample, count(query_id) AS with_query FROM fx_calls GROUP BY ALL", "fx_calls", X.reconciliation_detail)


def price_list(v):
    spark = v("fx_calls").sparkSession
    return spark.createDataFrame(PRICES, "model string, inward double, outward double")


_PRICED = "WITH p AS (SELECT * FROM (VALUES ('small', 0.15::DOUBLE, 0.6::DOUBLE), ('large', 1.0, 3.0), ('judge-1', 2.0, 8.0)) t(model, a, b)), c AS (SELECT c.*, (prompt_tokens * a + completion_tokens * b) / 1e6 AS dollars FROM fx_rich_calls c LEFT JOIN p ON lower(c.model) = p.model)"
query("i4_price_calls", f"{_PRICED} SELECT call_item_uid, model, round(dollars, 9) AS dollars FROM c")(lambda v: X.priced(v("fx_rich_calls"), price_list(v)).select("call_item_uid", "model", F.round("dollars", 9).alias("dollars")))
query("a13_load_price_table", f"{_PRICED} SELECT model, count(*) AS calls, count(dollars) AS priced FROM c GROUP BY model")(lambda v: X.priced(v("fx_rich_calls"), price_list(v)).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count("dollars").alias("priced")))
_ALL = "CASE WHEN count({0}) = count(*) THEN sum({0}) END"
query("i5_cost_phase_summary", f"{_PRICED} SELECT {_PHASE} AS phase, CASE WHEN contains(task, 'judge') THEN 'evaluation' ELSE 'deployment' END AS deployment, CASE WHEN {_PHASE} = 'memory' THEN 'reusable' ELSE 'per_query' END AS reuse, count(*) AS calls, count(DISTINCT provider_call_uid) AS provider_calls, CAST({_ALL.format('prompt_tokens')} AS BIGINT) AS prompt_tokens, CAST({_ALL.format('completion_tokens')} AS BIGINT) AS completion_tokens, round(sum(latency_ms), 3) AS latency_ms, round({_ALL.format('dollars')}, 6) AS dollars, count(dollars) AS priced FROM c GROUP BY 1, 2, 3")(
    lambda v: X.cost_phases(X.priced(v("fx_rich_calls"), price_list(v)))
)


def _method_table(v):
    full = v("fx_messages").groupBy("sample_id").agg(F.sum(estimate_tokens(F.col("content"))).alias("tokens")).join(v("fx_queries").select("sample_id", "query_id"), "sample_id")
    proxies = grid(v).where("cutoff = 15 AND budget = 400 AND variant in ('flat_raw', 'full')").select(F.col("variant").alias("method"), "query_id", "tokens")
    return X.cost_quality(v("fx_calls"), v("fx_answers"), full, proxies)


_METHODS = f"""WITH {_CELLS}, n AS (SELECT count(*) AS q, round(avg({_JUDGE}), 9) AS j FROM fx_answers), o AS (SELECT coalesce(sum(completion_tokens) FILTER ({_PHASE} = 'memory'), 0)::BIGINT AS u, coalesce(sum(completion_tokens) FILTER ({_PHASE} <> 'memory'), 0) AS t FROM fx_calls WHERE NOT contains(task, 'judge')),
  ct AS (SELECT q.query_id, sum({_TOKENS.format('m.content')}) AS t FROM fx_queries q JOIN fx_messages m ON m.sample_id = q.sample_id GROUP BY 1),
  me AS (SELECT 'observed' AS method, q AS queries, u AS upfront, round(t / q, 6) AS each_, j AS judge FROM o, n UNION ALL SELECT 'full_context', count(*), 0, round(avg(t), 6), NULL FROM ct UNION ALL SELECT variant, count(*), 0, round(avg(tokens), 6), NULL FROM grid WHERE cutoff = 15 AND budget = 400 AND variant IN ('flat_raw', 'full') GROUP BY variant)"""
query("i7_cost_quality_table", f'{_METHODS} SELECT method, queries, upfront, each_ AS "each", judge, round(upfront + each_ * queries, 3) AS total FROM me')(_method_table)
query("i8_break_even", f"{_METHODS} SELECT m.method, CASE WHEN b.each_ > m.each_ THEN CAST(greatest(0, ceil((m.upfront - b.upfront) / (b.each_ - m.each_))) AS BIGINT) END AS queries, CASE WHEN b.each_ > m.each_ THEN 'ok' ELSE 'no_saving' END AS reason FROM me m, (SELECT * FROM me WHERE method = 'full_context') b WHERE m.method <> 'full_context'")(lambda v: X.break_even(_method_table(v), "full_context"))


def cost(v):
    return X.cost_queries(v("fx_queries"), v("fx_messages"), events(v), index(v), v("fx_page_members"), v("fx_calls"))


_N = "(SELECT count(*) FROM fx_event_items e WHERE e.query_id = q.query_id AND tier = '{0}') AS {1}"
_COST = f"""WITH raw AS (SELECT sample_id, sum({_TOKENS.format('content')})::BIGINT AS t FROM fx_messages GROUP BY 1), rt AS (SELECT query_id, coalesce(sum(completion_tokens) FILTER (NOT contains(task, 'judge') AND {_PHASE} <> 'memory'), 0)::BIGINT AS t FROM fx_calls WHERE query_id IS NOT NULL GROUP BY 1),
  cq AS (SELECT q.query_id, q.sample_id, coalesce(raw.t, 0) AS raw_tokens, coalesce(raw.t, 0) + {_TOKENS.format('q.question')} AS full_tokens, (SELECT count(DISTINCT p.trajectory_id) FROM fx_event_items e JOIN fx_page_members p ON p.page_id = e.item_id WHERE e.tier = 'page' AND e.query_id = q.query_id) AS routed_universe, (SELECT count(DISTINCT trajectory_id) FROM fx_snapshots s WHERE s.sample_id = q.sample_id) AS direct_universe,
    {_N.format('page', 'pages')}, {_N.format('trajectory', 'trajectories')}, {_N.format('expanded', 'snapshots')}, {_N.format('source', 'sources')}, rt.t AS runtime_tokens, rt.t IS NOT NULL AS traced FROM fx_queries q LEFT JOIN raw ON raw.sample_id = q.sample_id LEFT JOIN rt ON rt.query_id = q.query_id)"""
query("i3_cost_query_rows", f"{_COST} SELECT * FROM cq")(cost)
query("i11_candidate_scaling", f"{_COST} SELECT c.sample_id, count(*) AS queries, round(avg(routed_universe), 9) AS routed, round(avg(direct_universe), 9) AS direct, m.messages, coalesce(s.t, 0) AS trajectories, coalesce(s.n, 0) AS snapshots, round(avg(direct_universe) / nullif(avg(routed_universe), 0), 9) AS reduction FROM cq c JOIN (SELECT sample_id, count(*) AS messages FROM fx_messages GROUP BY 1) m ON m.sample_id = c.sample_id LEFT JOIN (SELECT sample_id, count(DISTINCT trajectory_id) AS t, count(*) AS n FROM fx_snapshots GROUP BY 1) s ON s.sample_id = c.sample_id GROUP BY c.sample_id, m.messages, s.t, s.n")(
    lambda v: X.candidate_scaling(cost(v), A.memory_scaling(v("fx_messages"), v("fx_snapshots"), v("fx_claims"), v("fx_page_members")))
)
query("i12_call_summary", f"WITH x AS (SELECT *, {_PHASE} AS phase, count(*) OVER (PARTITION BY provider_call_uid) AS batch FROM fx_calls) SELECT CASE WHEN GROUPING(role) = 0 THEN 'role' WHEN GROUPING(phase) = 0 THEN 'phase' WHEN GROUPING(task) = 0 THEN 'task' ELSE 'all' END AS level, coalesce(role, phase, task, 'all') AS name, count(*) AS calls, count(DISTINCT provider_call_uid) AS provider_calls, round(avg(batch), 6) AS mean_batch, max(batch) AS max_batch, count(*) FILTER (contains(task, 'repair')) AS repairs, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(latency_ms), 3) AS latency_ms FROM x GROUP BY GROUPING SETS ((role), (phase), (task), ())")(lambda v: X.call_table(v("fx_calls")))
query("i13_runtime_share", "WITH t AS (SELECT task, sum(latency_ms) AS t FROM fx_calls GROUP BY task), r AS (SELECT *, row_number() OVER (ORDER BY round(t, 3) DESC, task) AS r, sum(t) OVER () AS a FROM t) SELECT CASE WHEN r <= 2 THEN task ELSE 'Other' END AS name, round(sum(t), 3) AS value, round(sum(t / a), 9) AS share FROM r GROUP BY 1")(lambda v: X.shares(v("fx_calls"), "task", "latency_ms", 2))
_EVENTS = "SELECT * FROM (SELECT *, CASE WHEN contains(task, 'repair') THEN 'repair' WHEN row_number() OVER (PARTITION BY provider_call_uid ORDER BY call_item_uid) > 1 THEN 'cache_hit' END AS kind FROM fx_calls WHERE query_id IS NOT NULL) WHERE kind IS NOT NULL"
query("i15_action_chains", f"SELECT query_id, count(*) AS events, string_agg(kind, '>' ORDER BY ts, call_item_uid) AS chain, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM ({_EVENTS}) GROUP BY query_id")(lambda v: X.repair_chains(v("fx_calls")))
query("i15_repair_contrast", f"SELECT variant, query_id IN (SELECT query_id FROM fx_calls WHERE contains(task, 'repair') AND query_id IS NOT NULL) AS repaired, count(*) AS n, round(avg({_JUDGE}), 9) AS judge FROM fx_outcomes GROUP BY ALL")(lambda v: X.repair_contrast(v("fx_outcomes"), v("fx_calls").where("task LIKE '%repair%' AND query_id IS NOT NULL")))
query("k3_min_covering_set", None)(lambda v: X.min_cover(labels(v).select("query_id", "sample_id", F.col("source_refs").alias("gold")).join(index(v).groupBy("sample_id").agg(F.collect_list("source_refs").alias("sets")), "sample_id")))
_GOT = f"list_filter({_ITEMS.format('gold_answer')}, lambda i: contains({_NORM.format('answer_text')}, {_NORM.format('i')}) OR coalesce(len(list_intersect({_ITEM_TOKENS.format('i')}, {_ITEM_TOKENS.format('answer_text')})) / nullif(len({_ITEM_TOKENS.format('i')}), 0) >= 0.67, FALSE))"
_ANS = f"x AS (SELECT *, {_ITEMS.format('gold_answer')} AS g, {_ITEMS.format('answer_text')} AS a, {_GOT} AS h FROM fx_note_answers)"
query("k5_grounded_failure_kind", f"WITH {_ANS} SELECT query_id, CASE WHEN len(h) = len(g) AND len(a) > len(g) THEN 'overgenerated' WHEN len(h) > 0 AND len(h) < len(g) THEN 'incomplete' WHEN len(regexp_extract_all(gold_answer, '\\d+')) > 0 AND len(list_intersect(regexp_extract_all(gold_answer, '\\d+'), regexp_extract_all(answer_text, '\\d+'))) = 0 THEN 'selection_error' WHEN len(h) = 0 THEN 'selection_error' ELSE 'other' END AS kind FROM x WHERE verdict IN ('partial', 'incorrect')")(lambda v: X.failure_kind(v("fx_note_answers")))
query("k6_judge_leniency", f"WITH {_ANS}, y AS (SELECT *, len(h) = len(g) AS covered, len(a) > len(g) AS extra, contains(lower(question), 'how many') AND contains(lower(answer_text), 'at least') AS lower_bound FROM x) SELECT query_id, covered, extra, lower_bound, verdict IN ('partial', 'incorrect') AND ((covered AND extra) OR lower_bound) AS candidate FROM y")(lambda v: X.judge_leniency(v("fx_note_answers")))


def _time_questions(v):
    return v("fx_queries").select("query_id", "sample_id", F.concat(F.lit("What day was it? "), "question").alias("question"))


query("k7_temporal_grounding", "WITH g AS (SELECT query_id, sample_id, source_ref, TRUE AS g FROM fx_gold), r AS (SELECT e.query_id, m.source_ref, e.item_id % 2 = 0 AS anchored FROM fx_event_items e JOIN fx_messages m ON m.message_id = e.item_id WHERE tier = 'source'), b AS (SELECT coalesce(g.query_id, r.query_id) AS query_id, coalesce(g.source_ref, r.source_ref) AS source_ref, g.g, r.anchored FROM g FULL JOIN r ON g.query_id = r.query_id AND g.source_ref = r.source_ref), y AS (SELECT b.query_id, bool_or(m.turn_index % 2 = 0) AS dated, coalesce(bool_or(anchored), FALSE) AS visible, coalesce(bool_and(anchored IS NOT NULL) FILTER (g), FALSE) AS whole FROM b JOIN fx_queries q ON q.query_id = b.query_id LEFT JOIN fx_messages m ON m.sample_id = q.sample_id AND m.source_ref = b.source_ref GROUP BY b.query_id) SELECT q.query_id, dated, visible, CASE WHEN dated IS NOT NULL THEN '' END AS terms, dated AND whole AND NOT visible AS anchor_missing FROM fx_queries q LEFT JOIN y ON y.query_id = q.query_id")(
    lambda v: X.temporal_grounding(_time_questions(v), v("fx_gold"), v.table("fx_event_items").where("tier = 'source'").join(v("fx_messages").select(F.col("message_id").alias("item_id"), "source_ref"), "item_id").select("query_id", "source_ref", (F.col("item_id") % 2 == 0).alias("anchored")), v("fx_messages").withColumn("occurred_at", F.when(F.col("turn_index") % 2 == 0, "1 May, 2023")))
)
_LAYER = lambda t: f"(SELECT coalesce(bool_or(contains({_NORM.format('t.text')}, {_NORM.format('a.gold_answer')})), FALSE) FROM ({t}) t WHERE t.sample_id = a.sample_id)"
query("k8_preservation_stage", f"WITH s AS (SELECT query_id, verdict, {_LAYER('SELECT sample_id, text FROM fx_claims')} AS claims, {_LAYER('SELECT sample_id, content AS text FROM fx_snapshots WHERE version = 1')} AS summaries FROM fx_answers a WHERE gold_answer IS NOT NULL) SELECT query_id, claims, summaries, CASE WHEN NOT claims THEN 'storage_miss' WHEN NOT summaries THEN 'compression_miss_summaries' WHEN verdict <> 'correct' THEN 'answer_error' ELSE 'kept' END AS lost_at FROM s")(
    lambda v: X.preservation_stages(v.table("fx_answers"), {"claims": v.table("fx_claims"), "summaries": v.table("fx_snapshots").where("version = 1").withColumnRenamed("content", "text")})
)
_IN = "count(*) FILTER (EXISTS (SELECT 1 FROM fx_note_claims c WHERE c.sample_id = sf.sample_id AND contains({0}, {1}){2}))".format(_NORM.format("c.text"), _NORM.format("sf.surface"), "{0}")
query("k9_source_surface_preservation", f"WITH {_CAND}, sf AS (SELECT DISTINCT sample_id, surface FROM ca) SELECT sample_id, count(*) AS surfaces, {_IN.format('')} AS in_claims, {_IN.format(' AND c.version >= 3')} AS in_trajectories, {_IN.format(chr(32) + 'AND c.status = ' + chr(39) + 'active' + chr(39))} AS in_pages FROM sf GROUP BY sample_id")(lambda v: X.surface_survival(wanted(v), claims(v), claims(v).where("version >= 3"), claims(v).where("status = 'active'")))


def _targets(v):
    """Trajectories of a question's sample that hold one of its names, as its gold."""
    return ranked(v).where("rank <= 2").select("query_id", "trajectory_id")


def _versus(v):
    x = ranked(v).select("query_id", "trajectory_id", F.col("rank"))
    return X.direct_vs_routed(_targets(v), x, x.where("trajectory_id % 3 <> query_id % 3"), 2)


_VERSUS = f"WITH {_P}, {_OVER}, y AS (SELECT query_id, count(*) AS gold, 1.0::DOUBLE AS direct, round(avg((trajectory_id % 3 <> query_id % 3)::INT), 9) AS routed FROM ranked WHERE rank <= 2 GROUP BY 1), vs AS (SELECT query_id, gold, direct, routed, round(direct - routed, 9) AS delta, CASE WHEN routed = 1 THEN 'none' ELSE 'page_routing' END AS bottleneck FROM y)"
query("k11_direct_vs_routed", f"{_VERSUS} SELECT * FROM vs")(_versus)
query("k11_shape_buckets", f"{_VERSUS}, b AS (SELECT query_id, unnest(CASE WHEN counting THEN ['count', 'any'] ELSE ['list', 'several', 'any'] END) AS bucket FROM q) SELECT bucket, count(*) AS queries, round(avg(direct), 9) AS direct, round(avg(routed), 9) AS routed, round(avg(delta), 9) AS delta, count(*) FILTER (bottleneck = 'page_routing') AS page_routing FROM vs JOIN b ON b.query_id = vs.query_id GROUP BY bucket")(
    lambda v: X.shape_buckets(_versus(v), asked(v).select("query_id", F.array_compact(F.array(F.when(F.col("counting"), "count"), F.when(F.col("listing"), "list"), F.when(F.size("entities") > 1, "several"), F.lit("any"))).alias("buckets")))
)
query("k21_umbrella_only_miss", "SELECT query_id, (query_id % 3 = 0 AND query_id % 5 = 4) OR (query_id % 3 = 1 AND FALSE) AS umbrella_only FROM fx_note_answers")(lambda v: X.umbrella_misses(v("fx_note_answers"), UMBRELLAS))
_of("k21_cluster_redundancy", "SELECT sample_id, count(*) AS n, round(1 - count(DISTINCT lower(phrase)) / count(*), 9) AS redundancy FROM fx_phrases GROUP BY 1", "fx_phrases", lambda x: X.redundancy(x.withColumn("k", F.lower("phrase")), "sample_id", "k"))


def reasons(v):
    return M.failure_reasons(v("fx_queries"), hits(v), v("fx_answers"))


_REASONS = f"WITH {_HITS}, rs AS (SELECT q.query_id, verdict, CASE WHEN stored IS NULL THEN 'unknown_no_gold_refs' WHEN NOT stored THEN 'memory_absent' WHEN NOT routed THEN 'coarse_retrieval_miss' WHEN NOT selected THEN 'fine_retrieval_miss' WHEN NOT grounded THEN 'grounding_miss' WHEN verdict IN ('partial', 'incorrect') THEN 'answer_error' ELSE 'other' END AS reason FROM fx_queries q LEFT JOIN per ON per.query_id = q.query_id LEFT JOIN fx_answers a ON a.query_id = q.query_id)"
query("k18_failure_report", f"{_REASONS}, p AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY query_id) AS place FROM rs) SELECT reason, count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct, string_agg(CAST(query_id AS VARCHAR), ' ' ORDER BY query_id) FILTER (place <= 3) AS examples, round(count(*) / (SELECT count(*) FROM rs), 9) AS rate FROM p GROUP BY reason")(lambda v: X.failure_report(reasons(v), v("fx_answers"), 3).withColumn("examples", M.shown("examples")))


def _flags(v):
    s = support(v).groupBy("query_id").agg(F.bool_or(F.col("kind") == "counted_event").alias("counted"), F.bool_or(F.col("kind") == "bridge_finalization").alias("bridged"))
    return v("fx_answers").select("query_id", "verdict", (F.col("issue") == "unsupported_count").alias("wrong_count")).join(s, "query_id", "left")


query("k16_answer_synthesis_diagnostics", "WITH s AS (SELECT query_id, bool_or(kind = 'valid' AND message_id % 6 = 0) AS counted, bool_or(query_id % 2 = 0 OR (kind = 'valid' AND message_id % 8 = 2)) AS bridged FROM fx_support GROUP BY 1), f AS (SELECT a.query_id, verdict, issue = 'unsupported_count' AS wrong_count, coalesce(counted, FALSE) AS counted, coalesce(bridged, FALSE) AS bridged FROM fx_answers a LEFT JOIN s ON s.query_id = a.query_id), u AS (UNPIVOT f ON wrong_count, counted, bridged INTO NAME flag VALUE on_) SELECT flag, count(on_) AS known, count(*) FILTER (on_) AS n, round(count(*) FILTER (on_) / nullif(count(on_), 0), 9) AS rate, round(avg((verdict = 'correct')::INT) FILTER (on_), 9) AS correct_with, round(avg((verdict = 'correct')::INT) FILTER (NOT on_), 9) AS correct_without FROM u GROUP BY flag")(
    lambda v: X.flag_rates(_flags(v), ["wrong_count", "counted", "bridged"])
)
query("k20_outcome_field_projection", "SELECT query_id, verdict, CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'incorrect' THEN 0.0 END::DOUBLE AS judge, starts_with(lower(question), 'how many') AS counting, contains(lower(question), ' both ') AS several FROM fx_note_answers")(
    lambda v: v("fx_note_answers").select("query_id", F.struct("verdict", X.judge_score(F.col("verdict")).alias("judge")).alias("j"), C.query_shape(F.col("question"), F.array().cast("array<string>"), {}).alias("s")).select("query_id", "j.verdict", "j.judge", "s.counting", "s.several")
)


def _v1(v):
    return v("fx_outcomes").where("variant = 'v1'")


query("l3_query_drift", "WITH d AS (SELECT trajectory_id, sample_id, (CASE WHEN count(*) = 1 THEN 1.0 ELSE list_cosine_similarity(arg_min(embedding::DOUBLE[], version), arg_max(embedding::DOUBLE[], version)) END)::DOUBLE AS ht FROM fx_vectors GROUP BY ALL), t AS (SELECT o.query_id, o.verdict, avg(round(ht, 6)) AS m, min(round(ht, 6)) AS l FROM fx_outcomes o JOIN d ON d.sample_id = o.query_id % 10 AND d.trajectory_id % 5 = o.query_id % 5 WHERE o.variant = 'v1' GROUP BY ALL) SELECT verdict, count(*) AS queries, round(avg(m), 6) AS mean_head_tail, round(min(l), 6) AS least_head_tail FROM t GROUP BY verdict")(
    lambda v: X.query_drift(_v1(v).select("query_id", (F.col("query_id") % 10).alias("sample_id"), (F.col("query_id") % 5).alias("part")), E.trajectory_drift(v("fx_vectors"), E.OWN).select(F.col("sample_id").cast("long").alias("sample_id"), (F.col("trajectory_id") % 5).alias("part"), "head_tail"), _v1(v), ["sample_id", "part"])
)
query("l2_drift_stats", "WITH d AS (SELECT trajectory_id, count(*) AS length, round((CASE WHEN count(*) = 1 THEN 1.0 ELSE list_cosine_similarity(arg_min(embedding::DOUBLE[], version), arg_max(embedding::DOUBLE[], version)) END)::DOUBLE, 6) AS ht FROM fx_vectors GROUP BY 1) SELECT CASE WHEN length = 1 THEN '1' WHEN length <= 3 THEN '2-3' ELSE '4+' END AS lengths, count(*) AS trajectories, count(ht) AS known, round(avg((length > 1 AND ht < 0.4)::INT), 9) AS drift_rate, round(avg(ht), 5) AS mean, quantile_disc(ht, 0.1) AS p10, quantile_disc(ht, 0.25) AS p25, quantile_disc(ht, 0.5) AS p50, quantile_disc(ht, 0.75) AS p75, quantile_disc(ht, 0.9) AS p90 FROM d GROUP BY 1")(lambda v: X.drift_stats(E.trajectory_drift(v("fx_vectors"))))
_of("l15_completion_truncation", "SELECT variant, role, count(*) AS calls, count(finish) AS known, round(count(*) FILTER (finish = 'length') / nullif(count(finish), 0), 9) AS length_rate FROM fx_rich_calls GROUP BY ALL", "fx_rich_calls", X.truncation)
_of("l15_provider_fingerprint", "SELECT role, fingerprint, origin, count(*) AS calls FROM fx_rich_calls GROUP BY ALL", "fx_rich_calls", X.fingerprints)
_of("l16_variant_cost_summary", "SELECT variant, count(*) AS calls, count(*) FILTER (origin = 'reused') AS reused, round(sum(latency_ms), 3) AS latency_ms, CAST(sum(completion_tokens) FILTER (role = 'backbone') AS BIGINT) AS backbone, CAST(sum(completion_tokens) FILTER (role = 'judge') AS BIGINT) AS judge FROM fx_rich_calls GROUP BY variant", "fx_rich_calls", lambda x: X.variant_costs(x, ["backbone", "judge"]))
_of("l14_matched_budget_compliance", "SELECT o.variant, count(*) AS n, count(*) FILTER (o.prompt_tokens <= b.prompt_tokens) AS passed, count(*) FILTER (o.prompt_tokens > b.prompt_tokens) AS failed, count(*) FILTER (o.prompt_tokens IS NULL OR b.prompt_tokens IS NULL) AS unavailable, round(avg(o.prompt_tokens / nullif(b.prompt_tokens, 0)), 6) AS utilisation FROM fx_outcomes o LEFT JOIN (SELECT * FROM fx_outcomes WHERE variant = 'v1') b ON b.query_id = o.query_id WHERE o.variant <> 'v1' GROUP BY o.variant", "fx_outcomes", lambda x: X.matched_budgets(x, "v1"))
_of("l13_derived_stage_answers", "SELECT query_id, 'initial' AS stage, answer_text AS answer, query_id % 2 = 0 AS observed FROM fx_note_answers UNION ALL SELECT query_id, 'before_retry', answer_text, FALSE FROM fx_note_answers UNION ALL SELECT query_id, 'final', answer_text, TRUE FROM fx_note_answers", "fx_note_answers", lambda x: X.stage_answers(x.withColumn("initial", F.when(F.col("query_id") % 2 == 0, F.col("answer_text"))).withColumn("before_retry", F.lit(None).cast("string"))))
_UNIT = "(('0x' || substr(md5('7:{0}:' || draw), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"
query("l18_weight_perturbation", f"""WITH {_P}, s AS (SELECT query_id, trajectory_id AS id, round(0.8::DOUBLE * fs + 0.75::DOUBLE * es, 9) AS score, fs, es FROM g), d AS (SELECT *, round(score + 0.8::DOUBLE * fs * (2 * {_UNIT.format('fs')} - 1) * 0.2::DOUBLE + 0.75::DOUBLE * es * (2 * {_UNIT.format('es')} - 1) * 0.2::DOUBLE, 9) AS moved FROM s, (SELECT unnest(range(1, 6)) AS draw)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, draw ORDER BY score DESC, id) <= 3 AS a, row_number() OVER (PARTITION BY query_id, draw ORDER BY moved DESC, id) <= 3 AS b FROM d), j AS (SELECT query_id, draw, count(*) FILTER (a AND b) / count(*) FILTER (a OR b) AS j FROM r GROUP BY ALL) SELECT draw::INT AS draw, count(*) AS queries, round(avg(j), 9) AS jaccard, round(avg((j = 1)::INT), 9) AS unchanged FROM j GROUP BY draw""")(
    lambda v: X.perturbed_ranks(_weighted(v), {"fs": 0.8, "es": 0.75}, 5, 0.2, 3)
)


def _weighted(v):
    from .scoring import matched

    return matched(v).select("query_id", F.col("trajectory_id").alias("id"), F.col("family_score").alias("fs"), F.col("event_score").alias("es")).withColumn("score", F.round(0.8 * F.col("fs") + 0.75 * F.col("es"), 9))


_GT = f"SELECT DISTINCT g.query_id, r.trajectory_id FROM fx_gold g JOIN ({_REFS}) r ON r.sample_id = g.sample_id AND r.source_ref = g.source_ref"
query("l19_cutoff_replay", f"WITH t AS ({_GT}), f AS (SELECT p.query_id, m.trajectory_id, min(p.rnk) AS pr FROM fx_page_ranks p JOIN fx_page_members m ON m.page_id = p.page_id GROUP BY ALL), d AS (SELECT query_id, max(rnk) AS deep FROM fx_page_ranks GROUP BY 1), x AS (SELECT t.query_id, pages, cutoff, max(deep) AS deep, avg(coalesce(pr <= pages AND k.rnk <= cutoff, FALSE)::INT) AS r FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.trajectory_id = t.trajectory_id LEFT JOIN fx_ranked k ON k.query_id = t.query_id AND k.trajectory_id = t.trajectory_id LEFT JOIN d ON d.query_id = t.query_id, (SELECT unnest([1, 2]) AS pages), (SELECT unnest([1, 2, 4]) AS cutoff) GROUP BY ALL) SELECT pages, cutoff, count(*) AS queries, count(*) FILTER (deep >= pages) AS replayable, round(avg(r) FILTER (deep >= pages), 9) AS recall FROM x GROUP BY ALL")(
    lambda v: X.cutoff_replay(v.table("fx_page_ranks"), v("fx_page_members"), v.table("fx_ranked"), R.gold_trajectories(v("fx_gold"), M.snapshot_refs(v("fx_snapshots"), v("fx_claims"))), [1, 2], [1, 2, 4])
)
query("h13_page_cutoff_curve", f"WITH t AS (SELECT DISTINCT t.query_id, m.page_id FROM ({_GT}) t JOIN fx_page_members m ON m.trajectory_id = t.trajectory_id AND m.page_type <> 'index'), d AS (SELECT query_id, max(rnk) AS deep FROM fx_page_ranks GROUP BY 1), x AS (SELECT cutoff, t.query_id, avg(coalesce(p.rnk <= cutoff, FALSE)::INT) AS r, max(deep) AS deep FROM t LEFT JOIN fx_page_ranks p ON p.query_id = t.query_id AND p.page_id = t.page_id LEFT JOIN d ON d.query_id = t.query_id, (SELECT unnest([1, 2, 3]) AS cutoff) GROUP BY ALL) SELECT cutoff, count(*) FILTER (deep >= cutoff) AS observed, round(avg(r) FILTER (deep >= cutoff), 9) AS recall, round(avg((r = 1)::INT) FILTER (deep >= cutoff), 9) AS all_gold_rate FROM x GROUP BY cutoff")(
    lambda v: X.page_curve(v.table("fx_page_ranks"), labels(v).select("query_id", F.explode("page_ids").alias("page_id")), [1, 2, 3])
)
