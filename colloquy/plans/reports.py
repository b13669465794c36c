"""Queries of the answer functions and report operators, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as T
from ..functions.text import cosine, estimate_tokens
from ..operators import reports as P
from ..operators import retrieval as R
from .registry import DRAWS, _JUDGE, _NORM, _PHASE, _RANKED, _TOKENS, query

VARIANTS = ["v1", "v2", "v3", "v4"]
_SPACED = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
_ITEMS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({_SPACED}, ' and ', ', ', 'gi'), '[,;]'), lambda x: trim(x)), lambda x: x <> '')"
# the words of the definitions, written for the comparison alone
_ABSTAINS = ["not enough", "not supported", "cannot answer", "can't answer", "do not have enough", "don't have enough", "insufficient", "unknown", "not available", "no retrieved evidence"]
_FILLERS = "a an and are as at be been for has have in is it of or the to was were with"
_MARKERS = " OR ".join("contains(lower({0}), '" + m.replace("'", "''") + "')" for m in _ABSTAINS)
_ALL_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9+]+'))"
_KEPT = f"list_filter({_ALL_TOKENS}, lambda w: w NOT IN ({', '.join(repr(w) for w in _FILLERS.split())}))"
_ITEM_TOKENS = f"CASE WHEN len({_KEPT}) > 0 THEN {_KEPT} ELSE {_ALL_TOKENS} END"
_V1, _V2 = "(SELECT * FROM fx_outcomes WHERE variant = 'v1')", "(SELECT * FROM fx_outcomes WHERE variant = 'v2')"


def _of(name: str, sql: str | None, view: str, op):
    query(name, sql)(lambda v: op(v(view)))


_of("b2_select_dialogue_groups", "WITH f AS (SELECT sample_id, min(message_id) AS f FROM fx_phrases GROUP BY 1), p AS (SELECT sample_id, row_number() OVER (ORDER BY f, sample_id) AS place FROM f) SELECT message_id, sample_id, place FROM fx_phrases JOIN p USING (sample_id) WHERE place <= 12", "fx_phrases", lambda x: P.first_groups(x, "sample_id", "message_id", 12).select("message_id", "sample_id", "place"))
_of("b3_select_round_robin", "SELECT variant, query_id, turn FROM (SELECT variant, query_id, row_number() OVER (PARTITION BY variant ORDER BY query_id) AS turn FROM fx_outcomes) ORDER BY turn, variant LIMIT 50", "fx_outcomes", lambda x: P.round_robin(x, "variant", "query_id", 50).select("variant", "query_id", "turn"))
_of("b4_select_sequential", "SELECT message_id FROM fx_messages WHERE role <> 'system' ORDER BY message_id LIMIT 40", "fx_messages", lambda x: x.where("role <> 'system'").orderBy("message_id").limit(40).select("message_id"))
_of("b5_exclusion_report", "SELECT CASE WHEN role = 'system' THEN 'system_turn' ELSE 'empty' END AS reason, count(*) AS n FROM fx_messages WHERE role = 'system' OR trim(coalesce(content, '')) = '' GROUP BY 1", "fx_messages", lambda x: P.exclusion_report(x, F.when(F.col("role") == "system", "system_turn").when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty")))
_of("c6_hash_embedding", "SELECT message_id, round(v[1], 9) AS first, round(v[32], 9) AS last, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm FROM (SELECT message_id, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS v FROM (SELECT message_id, list_transform(range(32), lambda i: ('0x' || substr(sha256(phrase), CAST(2 * i + 1 AS INT), 2))::INT / 255.0::DOUBLE - 0.5) AS r FROM fx_phrases))", "fx_phrases", lambda x: x.withColumn("v", T.hash_embedding(F.col("phrase"))).select("message_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[31], 9).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y), 6).alias("norm")))
_of("c21_abstention_flag", f"SELECT message_id, {_SPACED.format('content')} = '' OR {_MARKERS.format(_SPACED.format('content'))} AS abstains FROM fx_messages", "fx_messages", lambda x: x.select("message_id", T.is_abstention(F.col("content")).alias("abstains")))
_of("c23_split_answer_items", f"SELECT message_id, array_to_string({_ITEMS.format('phrase')}, '|') AS items FROM fx_phrases", "fx_phrases", lambda x: x.select("message_id", F.array_join(T.answer_items(F.col("phrase")), "|").alias("items")))
_of("e4_medium_chunks", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY trajectory_id) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM (SELECT DISTINCT sample_id, trajectory_id FROM fx_vectors)) SELECT sample_id, trajectory_id, CAST(CASE WHEN n <= 6 THEN 0 WHEN n % 4 IN (1, 2) AND i >= n - n % 4 THEN i // 4 - 1 ELSE i // 4 END AS BIGINT) AS chunk FROM x", "fx_vectors", lambda x: P.medium_chunks(x, "sample_id", "trajectory_id"))
_of("f32_ranked_row_log", "SELECT query_id, trajectory_id, rnk, count(*) OVER (PARTITION BY query_id) AS total, total > 2 AS truncated FROM fx_ranked QUALIFY rnk <= 2", "fx_ranked", lambda x: P.ranked_row_log(x, 2))
_of("f23_chunk_conversation", f"WITH t AS (SELECT *, sum(tokens) OVER (PARTITION BY sample_id ORDER BY turn_index, message_id ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, {_TOKENS.format('content')} AS tokens FROM fx_messages) WHERE tokens > 0), w AS (SELECT sample_id, unnest(range(0, max(e)::BIGINT, 320)) AS s FROM t GROUP BY sample_id) SELECT w.sample_id, s // 320 AS chunk, count(*) AS messages, min(message_id) AS first_message, max(message_id) AS last_message FROM w JOIN t ON t.sample_id = w.sample_id AND e - tokens < s + 384 AND e > s GROUP BY ALL", "fx_messages", lambda x: P.chunk_spans(x.withColumn("tokens", estimate_tokens(F.col("content"))), 384, 64))
_of("g10_stratum_grid", f"SELECT v.variant, g.stratum, count(o.variant) AS n, round(avg({_JUDGE}), 9) AS judge FROM (SELECT DISTINCT variant FROM fx_outcomes) v CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'X']) AS stratum) g LEFT JOIN fx_outcomes o ON o.variant = v.variant AND o.stratum = g.stratum GROUP BY ALL", "fx_outcomes", lambda x: P.stratum_grid(x, ["A", "N", "R", "X"]))
_of("g12_baseline_vote_majority", "SELECT query_id, count(*) FILTER (verdict = 'correct') AS yes, count(verdict) AS votes, CASE WHEN count(verdict) > 0 THEN yes >= votes / 2 END AS majority FROM fx_outcomes WHERE variant <> 'v1' GROUP BY query_id", "fx_outcomes", lambda x: P.vote_majority(x, "v1"))
_of("g13_judge_counts", f"SELECT variant, count({_JUDGE}) AS evaluable, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'incorrect') AS failed FROM fx_outcomes GROUP BY variant", "fx_outcomes", P.judge_counts)
_of("i15_fallback_repair_summary", f"SELECT {_PHASE} AS phase, role, count(*) FILTER (contains(task, 'repair')) AS repairs, CAST(coalesce(sum(completion_tokens) FILTER (contains(task, 'repair')), 0) AS BIGINT) AS tokens, round(count(*) FILTER (contains(task, 'repair')) / count(*), 9) AS share FROM fx_calls GROUP BY 1, 2", "fx_calls", P.repair_summary)
_of("i16_rebuild_calls_from_usage", "SELECT query_id, task, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM fx_calls WHERE query_id IS NOT NULL GROUP BY ALL", "fx_calls", P.calls_from_usage)
_of("j12_audit_sample", "SELECT stratum, query_id, row_number() OVER (PARTITION BY stratum ORDER BY md5(stratum || ':' || query_id), query_id) AS place FROM fx_outcomes WHERE variant = 'v1' QUALIFY place <= 20", "fx_outcomes", lambda x: P.quota_sample(x.where("variant = 'v1'"), "stratum", "query_id", 20))
_of("j13_counterbalanced_tasks", "SELECT query_id, annotator, position, CASE WHEN (query_id + annotator + position) % 2 = 0 THEN 'packet' ELSE 'dialogue' END AS condition FROM fx_queries, (SELECT unnest([0, 1]) AS annotator), (SELECT unnest([0, 1]) AS position)", "fx_queries", lambda x: P.counterbalanced_tasks(x, "query_id"))
_of("k13_page_granularity_fields", "SELECT page_type, width, count(*) AS pages FROM (SELECT page_type, page_id, count(DISTINCT trajectory_id) AS width FROM fx_page_members GROUP BY ALL) GROUP BY ALL", "fx_page_members", P.page_widths)
_of("l9_cluster_bootstrap", None, "fx_outcome_details", lambda x: P.cluster_bootstrap(x, "v1", DRAWS))
_of("l10_stratum_summary", f"SELECT variant, stratum, count(*) AS n, count({_JUDGE}) AS judged, round(avg({_JUDGE}), 9) AS judge, count(gold_ref_coverage) AS covered, round(avg(gold_ref_coverage), 6) AS coverage FROM fx_outcomes GROUP BY ALL", "fx_outcomes", P.stratum_summary)
_of("l17_balanced_failure_examples", f"SELECT a.query_id, a.verdict AS before, b.verdict AS after, row_number() OVER (PARTITION BY a.verdict, b.verdict ORDER BY a.query_id) AS place FROM {_V1} a JOIN {_V2} b ON a.query_id = b.query_id WHERE a.verdict <> b.verdict QUALIFY place <= 5", "fx_outcomes", lambda x: P.transition_examples(x, "v1", "v2", 5))
_of("l21_experiment_integrity", f"SELECT g.variant, count(*) AS missing FROM (SELECT DISTINCT query_id FROM fx_outcomes WHERE variant IN ('v1', 'v2', 'v3', 'v4')) q CROSS JOIN (SELECT unnest({VARIANTS}) AS variant) g LEFT JOIN fx_outcomes o ON o.query_id = q.query_id AND o.variant = g.variant WHERE o.query_id IS NULL GROUP BY g.variant", "fx_outcomes", lambda x: P.missing_cells(x, VARIANTS))
_of("l23_event_log_summary", f"SELECT sample_id, count(*) OVER (PARTITION BY sample_id) AS events, {_PHASE} AS last_phase FROM fx_calls WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ts DESC, call_item_uid DESC) = 1", "fx_calls", P.last_events)
_of("l24_call_ledger", "SELECT provider_call_uid, count(*) OVER (PARTITION BY provider_call_uid, CASE WHEN provider_call_uid IS NULL THEN call_item_uid END) AS attempts, task, completion_tokens FROM fx_calls QUALIFY row_number() OVER (PARTITION BY provider_call_uid, CASE WHEN provider_call_uid IS NULL THEN call_item_uid END ORDER BY ts DESC, call_item_uid DESC) = 1", "fx_calls", P.call_ledger)


@query("c20_deprecated_surface_hit", f"SELECT q.query_id, coalesce(bool_or(contains({_NORM.format('q.question')}, c.shown)), FALSE) AS hit FROM fx_queries q LEFT JOIN (SELECT sample_id, {_NORM.format('text')} AS shown FROM fx_claims WHERE status = 'deprecated' AND length({_NORM.format('text')}) >= 12) c ON c.sample_id = q.sample_id GROUP BY q.query_id")
def _(v):
    return P.deprecated_hits(v("fx_queries").withColumnRenamed("question", "answer"), v("fx_claims"))


@query("c23_covers_item", f"WITH x AS (SELECT h.message_id AS query_id, p.item, p.answer FROM (SELECT message_id, phrase AS answer, unnest({_ITEMS.format('phrase')}) AS item FROM fx_phrases) p JOIN fx_phrases h ON h.message_id = p.message_id), y AS (SELECT *, {_NORM.format('item')} AS n, {_ITEM_TOKENS.format('item')} AS t, {_ITEM_TOKENS.format('answer')} AS a FROM x), z AS (SELECT query_id, n <> '' AND (contains({_NORM.format('answer')}, n) OR coalesce(len(list_intersect(t, a)) / nullif(len(t), 0) >= 0.67, FALSE)) AS ok FROM y) SELECT query_id, count(*) AS items, count(*) FILTER (ok) AS covered, bool_and(ok) AS whole FROM z GROUP BY query_id")
def _(v):
    x = v("fx_phrases").select(F.col("message_id").alias("query_id"), F.col("phrase").alias("answer"))
    return P.item_coverage(x, x.select("query_id", F.explode(T.answer_items(F.col("answer"))).alias("item")))


@query("c26_render_snapshot_text", "SELECT s.snapshot_id, 'Episodic Snapshot ' || s.snapshot_id || coalesce(chr(10) || string_agg('- [' || status || '] ' || claim_id || ': ' || text, chr(10) ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'deprecated' THEN 2 ELSE 1 END, claim_id), '') AS block FROM fx_snapshots s LEFT JOIN fx_claims c ON c.snapshot_id = s.snapshot_id GROUP BY s.snapshot_id")
def _(v):
    return P.snapshot_texts(v("fx_snapshots"), v("fx_claims"))


@query("f6_rank_fill", "WITH g AS (SELECT DISTINCT g.query_id, s.trajectory_id FROM fx_gold g JOIN fx_snapshots s ON g.sample_id = s.sample_id AND g.source_ref = s.source_ref), a AS (SELECT query_id, trajectory_id, 0 AS tier, trajectory_id AS pos FROM g UNION ALL SELECT r.query_id, r.trajectory_id, 1, rnk FROM fx_ranked r ANTI JOIN g ON g.query_id = r.query_id AND g.trajectory_id = r.trajectory_id) SELECT query_id, trajectory_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, pos, trajectory_id) AS place FROM a QUALIFY place <= 3")
def _(v):
    return P.rank_fill(R.gold_trajectories(v("fx_gold"), v("fx_snapshots")), v.table("fx_ranked"), 3)


@query("f27_budget_items", f"SELECT query_id, message_id, rank, CAST(least(tokens, 60 - before) AS BIGINT) AS kept, tokens > 60 - before AS truncated FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_RANKED})) WHERE before < 60")
def _(v):
    return P.truncated_items(R.flat_lexical_rank(v("fx_queries"), v("fx_history")), 60)


@query("l20_run_integrity", "SELECT 'duplicate_call_id' AS finding, (SELECT count(*) FROM (SELECT 1 FROM fx_calls GROUP BY call_item_uid HAVING count(*) > 1)) AS n UNION ALL SELECT 'mixed_worker', (SELECT count(*) FROM (SELECT 1 FROM fx_calls GROUP BY provider_call_uid HAVING min(worker_id) <> max(worker_id))) UNION ALL SELECT 'foreign_source', (SELECT count(*) FROM fx_gold g ANTI JOIN fx_messages m ON m.sample_id = g.sample_id AND m.source_ref = g.source_ref)")
def _(v):
    return P.run_integrity(v("fx_calls"), v("fx_gold"), v("fx_messages"))


_of("i14_fallback_repair_events", f"SELECT call_item_uid, {_PHASE} AS phase, 'repair' AS kind FROM fx_calls WHERE contains(task, 'repair') UNION ALL SELECT call_item_uid, {_PHASE}, 'cache_hit' FROM fx_calls QUALIFY row_number() OVER (PARTITION BY provider_call_uid ORDER BY call_item_uid) > 1", "fx_calls", P.repair_events)
_of("l12_answer_ablation_table", f"SELECT variant, count(*) AS n, count({_JUDGE}) AS judge_n, round(avg({_JUDGE}), 6) AS judge, count(token_f1) AS token_f1_n, round(avg(token_f1), 6) AS token_f1, count(gold_ref_coverage) AS coverage_n, round(avg(gold_ref_coverage), 6) AS coverage, count(prompt_tokens) AS prompt_tokens_n, round(avg(prompt_tokens), 6) AS prompt_tokens FROM fx_outcomes GROUP BY variant", "fx_outcomes", P.answer_table)
_of("l6_stratified_sample", "SELECT o.stratum, query_id, place, prevalence FROM (SELECT stratum, query_id, row_number() OVER (PARTITION BY stratum ORDER BY md5(stratum || ':' || query_id), query_id) AS place FROM fx_outcomes WHERE variant = 'v1') o JOIN (SELECT stratum, round(count(*) / (SELECT count(*) FROM fx_outcomes WHERE variant = 'v1'), 9) AS prevalence FROM fx_outcomes WHERE variant = 'v1' GROUP BY 1) p ON o.stratum = p.stratum WHERE place <= CASE o.stratum WHEN 'A' THEN 30 WHEN 'R' THEN 86 WHEN 'N' THEN 84 ELSE 0 END", "fx_outcomes", lambda x: P.stratified_sample(x.where("variant = 'v1'"), "stratum", "query_id", {"A": 15, "R": 43, "N": 42}, 200))
_of("l8_prevalence_bootstrap", None, "fx_outcome_details", lambda x: P.prevalence_bootstrap(x, "v1", ["A", "N", "R"], DRAWS))


@query("f12_fine_snapshots", "WITH s AS (SELECT a.sample_id AS query_id, a.trajectory_id, a.snapshot_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM fx_vectors a JOIN (SELECT sample_id, arg_min(embedding, snapshot_id) AS embedding FROM fx_vectors GROUP BY sample_id) b ON a.sample_id = b.sample_id), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id, trajectory_id ORDER BY score DESC, snapshot_id) > 1)::INT AS rest FROM s) SELECT query_id, snapshot_id, row_number() OVER (PARTITION BY query_id ORDER BY rest, score DESC, snapshot_id) AS place FROM r QUALIFY place <= 12")
def _(v):
    asked = v("fx_vectors").groupBy("sample_id").agg(F.min_by("embedding", "snapshot_id").alias("asked"))
    x = v("fx_vectors").join(asked, "sample_id").withColumn("score", F.round(cosine(F.col("embedding"), F.col("asked")), 6))
    return P.fine_snapshots(x.withColumnRenamed("sample_id", "query_id"), 6)


@query("h7_supported_claims", "SELECT query_id, count(*) AS claims, count(DISTINCT source_message_id) AS sources FROM fx_ranked r JOIN fx_claims c ON c.trajectory_id = r.trajectory_id WHERE rnk <= 2 AND source_message_id IS NOT NULL GROUP BY query_id")
def _(v):
    return P.supported_claims(v("fx_claims"), v.table("fx_ranked").where("rnk <= 2"))


@query("k10_cutoff_diagnostics", "WITH t AS (SELECT DISTINCT g.query_id, s.trajectory_id FROM fx_gold g JOIN fx_snapshots s ON g.sample_id = s.sample_id AND g.source_ref = s.source_ref), r AS (SELECT cutoff, t.query_id, avg(CASE WHEN k.rnk <= cutoff THEN 1.0 ELSE 0.0 END) AS r FROM t LEFT JOIN fx_ranked k ON k.query_id = t.query_id AND k.trajectory_id = t.trajectory_id CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS cutoff) GROUP BY ALL), c AS (SELECT cutoff, avg(r) AS a, avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END) AS b FROM r GROUP BY cutoff) SELECT level, min(cutoff) FILTER (a >= level AND b >= level) AS cutoff FROM c, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS level) GROUP BY level")
def _(v):
    return P.cutoff_choice(R.rank_recall(v.table("fx_ranked"), R.gold_trajectories(v("fx_gold"), v("fx_snapshots")), [1, 2, 3, 5]), [0.5, 0.95, 0.99])
