"""Queries of the analysis operators, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import dense as N
from ..operators import evaluation as E
from ..operators import retrieval as R
from .registry import _JUDGE, _KEYS, _NORM, _PHASE, _RANKED, _TOKENS, query

_GOLD = "SELECT DISTINCT g.query_id, s.trajectory_id FROM fx_gold g JOIN fx_snapshots s ON g.sample_id = s.sample_id AND g.source_ref = s.source_ref"
_DRIFT = "SELECT *, round(raw, 6) AS ht FROM (SELECT sample_id, trajectory_id, count(*) AS length, (CASE WHEN count(*) = 1 THEN 1.0 ELSE list_cosine_similarity(arg_min(embedding::DOUBLE[], version), arg_max(embedding::DOUBLE[], version)) END)::DOUBLE AS raw FROM fx_vectors GROUP BY sample_id, trajectory_id)"
_BUCKET = "CASE WHEN length = 1 THEN 'singleton' WHEN raw >= 0.7 THEN 'stable' WHEN raw >= 0.55 THEN 'mild' WHEN raw >= 0.4 THEN 'moderate' ELSE 'possible_drift' END"
_TWO = "FROM (SELECT * FROM fx_outcomes WHERE variant = 'v1') x JOIN (SELECT * FROM fx_outcomes WHERE variant = 'v2') y ON x.query_id = y.query_id"
_NEEDED = "SELECT g.query_id, max(s.version)::BIGINT AS required_rank FROM fx_gold g JOIN fx_snapshots s ON g.sample_id = s.sample_id AND g.source_ref = s.source_ref GROUP BY g.query_id"
ENVELOPE = 2500


def _of(name: str, sql: str, view: str, op):
    query(name, sql)(lambda v: op(v(view)))


_of("a6_extract_source_refs", "SELECT message_id, array_to_string(list_distinct(regexp_extract_all(phrase, '\\bD\\d+:\\d+\\b')), ' ') AS refs FROM fx_phrases", "fx_phrases", lambda x: x.select("message_id", F.array_join(A.source_refs(F.col("phrase")), " ").alias("refs")))
_of("a18_history_fingerprint", "SELECT sample_id, sha256(string_agg(role || ':' || content, chr(10) ORDER BY turn_index)) AS fingerprint FROM fx_history GROUP BY sample_id", "fx_history", A.history_fingerprints)
_of("c12_parse_source_date", "SELECT message_id, CAST(strptime(occurred_at, '%d %B, %Y')::DATE AS VARCHAR) AS day FROM fx_phrases", "fx_phrases", lambda x: x.select("message_id", A.source_date(F.col("occurred_at")).cast("string").alias("day")))
_of("c22_parse_judge_verdict", "SELECT message_id, CASE WHEN starts_with(phrase, 'VERDICT: ') THEN lower(substr(phrase, 10)) ELSE 'judge_error' END AS verdict FROM fx_phrases", "fx_phrases", lambda x: x.select("message_id", A.judge_verdict(F.col("phrase")).alias("verdict")))
_of("f11_candidate_union", "SELECT sample_id, trajectory_id, page_id, row_number() OVER (PARTITION BY sample_id ORDER BY page_id, trajectory_id) AS position FROM (SELECT sample_id, trajectory_id, min(page_id) AS page_id FROM fx_page_members WHERE page_type <> 'index' GROUP BY ALL)", "fx_page_members", lambda x: A.candidate_union(x.where("page_type <> 'index'")))
_of("g7_judge_accuracy", f"SELECT variant, round(avg({_JUDGE}), 9) AS score, round(avg(CASE WHEN verdict = 'correct' THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM fx_outcomes GROUP BY variant", "fx_outcomes", A.judge_accuracy)
_of("g14_split_usage", f"SELECT sample_id, queries, round(c / queries, 9) AS calls, round(l / queries, 3) AS latency_ms, CAST(floor(t / queries) AS BIGINT) AS tokens FROM (SELECT sample_id, count(DISTINCT query_id) AS queries, count(*) FILTER ({_PHASE} = 'memory') AS c, sum(latency_ms) FILTER ({_PHASE} = 'memory') AS l, sum(completion_tokens) FILTER ({_PHASE} = 'memory') AS t FROM fx_calls WHERE sample_id IS NOT NULL GROUP BY sample_id) WHERE c > 0", "fx_calls", A.split_usage)
_of("i1_compact_calls", f"SELECT call_item_uid, {_PHASE} AS phase, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens FROM fx_calls", "fx_calls", A.compact_calls)
_of("i6_scope_cost_calls", "SELECT CASE WHEN query_id IS NOT NULL THEN 'query' WHEN sample_id IS NOT NULL THEN 'sample' ELSE 'shared' END AS scope, count(*) AS calls, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM fx_calls GROUP BY 1", "fx_calls", A.call_scopes)
_of("j7_binary_label_metrics", f"SELECT stratum, n, round(same / n, 9) AS accuracy, round(tp / nullif(pp, 0), 9) AS precision, round(tp / nullif(gp, 0), 9) AS recall, round(2 * tp / nullif(pp + gp, 0), 9) AS f1 FROM (SELECT x.stratum, count(*) AS n, count(*) FILTER (x.verdict = 'correct' AND y.verdict = 'correct') AS tp, count(*) FILTER (x.verdict = 'correct') AS pp, count(*) FILTER (y.verdict = 'correct') AS gp, count(*) FILTER ((x.verdict = 'correct') = (y.verdict = 'correct')) AS same {_TWO} GROUP BY x.stratum)", "fx_outcomes", lambda x: A.binary_metrics(x, "v1", "v2"))
_of("j15_cohen_kappa", f"WITH t AS (SELECT x.verdict AS a, y.verdict AS b {_TWO}), n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po FROM t), p AS (SELECT sum((SELECT count(*) FROM t WHERE a = v) * (SELECT count(*) FROM t WHERE b = v))::DOUBLE AS xy FROM (SELECT unnest(['correct', 'partial', 'incorrect']) AS v)) SELECT n AS pairs, round(po, 9) AS agreement, round((po - xy / (n * n)) / (1 - xy / (n * n)), 9) AS kappa FROM n, p", "fx_outcomes", lambda x: A.cohen_kappa(x, "v1", "v2"))
_of("k12_trajectory_length_stats", "WITH t AS (SELECT count(*) AS n FROM fx_vectors GROUP BY trajectory_id) SELECT count(*) AS trajectories, round(avg(n), 9) AS mean, quantile_disc(n, 0.5) AS median, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95, max(n) AS longest, round(avg(CASE WHEN n >= 6 THEN 1.0::DOUBLE ELSE 0 END), 9) AS at_limit FROM t", "fx_vectors", lambda x: A.length_stats(x, 6))
_of("l2_drift_summary", f"SELECT {_BUCKET} AS bucket, count(*) AS trajectories, round(avg(length), 9) AS mean_length, round(avg(ht), 5) AS head_tail FROM ({_DRIFT}) GROUP BY 1", "fx_vectors", lambda x: A.drift_summary(E.trajectory_drift(x, E.OWN)))
_of("l4_low_drift_examples", f"SELECT trajectory_id, ht AS head_tail FROM ({_DRIFT}) WHERE length > 1 AND ht IS NOT NULL ORDER BY ht, trajectory_id, sample_id LIMIT 10", "fx_vectors", lambda x: A.low_drift_examples(E.trajectory_drift(x, E.OWN)))
_of("l11_complete_weighted_metric", "SELECT variant, count(*) AS n, count(gold_ref_coverage) AS observed, CASE WHEN count(*) = count(gold_ref_coverage) THEN round(avg(gold_ref_coverage), 6) END AS coverage FROM fx_outcomes GROUP BY variant", "fx_outcomes", A.complete_weighted_metric)
_of("l14_token_budget_audit", f"SELECT variant, count(*) FILTER (prompt_tokens <= {ENVELOPE}) AS passed, count(*) FILTER (prompt_tokens > {ENVELOPE}) AS failed, count(*) FILTER (prompt_tokens IS NULL) AS unavailable, count(*) FILTER (prompt_tokens < {9 * ENVELOPE // 10}) AS underused FROM fx_outcomes GROUP BY variant", "fx_outcomes", lambda x: A.token_budget_audit(x, ENVELOPE))


@query("c3_keyword_overlap_score", f"SELECT query_id, message_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END::DOUBLE, 9) AS score FROM (SELECT query_id, message_id, {_KEYS.format('question')} AS a, {_KEYS.format('content')} AS b FROM fx_history h JOIN fx_queries q ON h.sample_id = q.sample_id)")
def _(v):
    return A.question_overlap(v("fx_queries"), v("fx_history"))


@query("d18_memory_build_summary", "WITH bad AS (SELECT DISTINCT snapshot_id AS b FROM fx_claims WHERE status IN ('contradictory', 'needs-confirmation')) SELECT sample_id, count(DISTINCT trajectory_id) AS trajectories, round(count(*) / count(DISTINCT trajectory_id), 9) AS mean_length, round(count(b) / count(*), 9) AS conflict_ratio FROM fx_snapshots LEFT JOIN bad ON snapshot_id = b GROUP BY sample_id")
def _(v):
    return A.build_summary(v("fx_snapshots"), v("fx_claims"))


@query("f18_backtrack_stats", f"SELECT query_id, count(*) FILTER (back) AS backtracks, round(coalesce(count(*) FILTER (back) / nullif(count(*) - 1, 0), 0)::DOUBLE, 9) AS rate FROM (SELECT query_id, turn_index < lag(turn_index) OVER (PARTITION BY query_id ORDER BY rank) AS back FROM ({_RANKED})) GROUP BY query_id")
def _(v):
    ranked = R.flat_lexical_rank(v("fx_queries"), v("fx_history"))
    return A.backtracks(ranked.join(v("fx_history").select("message_id", "turn_index"), "message_id"))


@query("f24_dense_topk", "SELECT q.trajectory_id AS query_id, s.snapshot_id, round(list_cosine_similarity(s.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.trajectory_id ORDER BY score DESC, s.snapshot_id) AS rank FROM fx_vectors q JOIN fx_vectors s ON q.sample_id = s.sample_id WHERE q.version = 1 QUALIFY rank <= 4")
def _(v):
    asked = v("fx_vectors").where("version = 1").select("sample_id", F.col("trajectory_id").alias("query_id"), F.col("embedding").alias("query"))
    return A.dense_topk(asked, v("fx_vectors"))


def _near(v, probes):
    asked = v("fx_vectors").where("version = 1").select(F.col("sample_id").alias("by"), F.col("trajectory_id").alias("query_id"), F.col("embedding").alias("query"))
    found = N.topk(asked, v("fx_vectors").select(F.col("sample_id").alias("by"), F.col("snapshot_id").alias("vec_id"), "embedding"), 4, 8, probes)
    return found.select("query_id", F.col("vec_id").alias("snapshot_id"), "score", "rank")


_TOP4 = "SELECT q.trajectory_id AS query_id, s.snapshot_id, round(list_cosine_similarity(s.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.trajectory_id ORDER BY score DESC, s.snapshot_id) AS rank FROM fx_vectors q JOIN fx_vectors s ON q.sample_id = s.sample_id WHERE q.version = 1 QUALIFY rank <= 4"
query("f24_block_topk", _TOP4)(lambda v: _near(v, None))
query("f24_cell_topk", None)(lambda v: _near(v, 6))  # approximate: its recall is tested


@query("g1_exact_match", f"SELECT query_id, message_id, CASE WHEN {_NORM.format('question')} = {_NORM.format('content')} THEN 1.0 ELSE 0.0 END::DOUBLE AS exact FROM fx_queries q JOIN fx_history h ON q.sample_id = h.sample_id")
def _(v):
    from ..functions.text import normalize_answer

    both = v("fx_queries").join(v("fx_history").select("sample_id", "message_id", "content"), "sample_id")
    return both.select("query_id", "message_id", (normalize_answer(F.col("question")) == normalize_answer(F.col("content"))).cast("double").alias("exact"))


@query("h14_required_snapshot_rank", _NEEDED)
def _(v):
    return A.required_rank(v("fx_gold"), v("fx_snapshots"))


@query("h15_snapshot_cdf", f"WITH n AS ({_NEEDED}), g AS (SELECT unnest(range(1, (SELECT max(required_rank) FROM n) + 1)) AS rank) SELECT rank, (SELECT count(*) FROM n WHERE required_rank = rank) AS newly, round((SELECT count(*) FROM n WHERE required_rank <= rank) / (SELECT count(*) FROM n), 9) AS covered FROM g")
def _(v):
    return A.snapshot_cdf(A.required_rank(v("fx_gold"), v("fx_snapshots")))


@query("i10_memory_scaling", f"SELECT m.*, coalesce(trajectories, 0) AS trajectories, coalesce(snapshots, 0) AS snapshots, coalesce(claims, 0) AS claims, coalesce(pages, 0) AS pages, round(snapshots / trajectories, 9) AS mean_length FROM (SELECT sample_id, count(*) AS messages, CAST(sum({_TOKENS.format('content')}) AS BIGINT) AS tokens FROM fx_messages GROUP BY 1) m LEFT JOIN (SELECT sample_id, count(DISTINCT trajectory_id) AS trajectories, count(*) AS snapshots FROM fx_snapshots GROUP BY 1) s ON m.sample_id = s.sample_id LEFT JOIN (SELECT sample_id, count(*) AS claims FROM fx_claims GROUP BY 1) c ON m.sample_id = c.sample_id LEFT JOIN (SELECT sample_id, count(DISTINCT page_id) AS pages FROM fx_page_members GROUP BY 1) p ON m.sample_id = p.sample_id")
def _(v):
    return A.memory_scaling(v("fx_messages"), v("fx_snapshots"), v("fx_claims"), v("fx_page_members"))


@query("k2_topk_coverage", f"SELECT t.query_id, count(*) AS gold, count(*) FILTER (rnk <= 2) AS in_top, count(rnk) AS in_pool, round(count(*) FILTER (rnk <= 2) / count(*), 9) AS recall, count(rnk) = count(*) AS coverable FROM ({_GOLD}) t LEFT JOIN fx_ranked r ON r.query_id = t.query_id AND r.trajectory_id = t.trajectory_id GROUP BY t.query_id")
def _(v):
    return A.topk_coverage(v.table("fx_ranked"), R.gold_trajectories(v("fx_gold"), v("fx_snapshots")), 2)


@query("d3_transition_shortlist", f"WITH c AS (SELECT fx_claims.*, version FROM fx_claims JOIN fx_snapshots USING (snapshot_id)) SELECT a.claim_id, b.claim_id AS previous_id, len(list_intersect({_KEYS.format('a.text')}, {_KEYS.format('b.text')})) AS shared, row_number() OVER (PARTITION BY a.claim_id ORDER BY shared DESC, b.claim_id) AS rank FROM c a JOIN c b ON a.trajectory_id = b.trajectory_id AND a.version = b.version + 1 WHERE shared > 0 QUALIFY rank <= 3")
def _(v):
    return A.transition_shortlist(v("fx_claims"), v("fx_snapshots"))
