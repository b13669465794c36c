"""The operators' queries over the fixture views, and DuckDB SQL for each, written from the definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cosine, estimate_tokens, keywords, normalize_answer
from ..operators import dialogue as D
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..sources.fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BUDGET, MOST, CUTOFFS = 400, 15, [1, 2, 3, 5]
#: Resamples of a bootstrap.
DRAWS = 10_000


def query(name: str, sql: str | None):
    """Registers ``f(v)``, v being the fixture ``Views``; ``sql`` is None where DuckDB can't express it."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return keep


_KEYS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-'']+')), lambda w: length(w) > 2)"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_JUDGE = "CASE verdict WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 WHEN 'incorrect' THEN 0.0 END"
_PHASE = "CASE WHEN contains(task,'judge') THEN 'evaluation' WHEN contains(task,'answer') THEN 'answering' WHEN contains(task,'rerank') THEN 'retrieval' WHEN contains(task,'extract') THEN 'memory' ELSE 'other' END"
_TOKENS = "CAST(ceil(len(regexp_extract_all({0}, '\\S+')) * 1.3) AS BIGINT)"
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn_index) AS rank FROM (
  SELECT query_id, h.sample_id, message_id, source_ref, turn_index, {_TOKENS.format("content")} AS tokens,
    greatest(0.001, hit + coalesce(hit / nullif(n, 0), 0)) AS score FROM (
      SELECT h.*, q.query_id, len(list_intersect({_KEYS.format("q.question")}, {_KEYS.format("h.content")})) AS hit, len({_KEYS.format("q.question")}) AS n
      FROM fx_history h JOIN fx_queries q ON h.sample_id = q.sample_id) h)"""


@query("a5_split_history_query", "SELECT sample_id, turn_index, CASE WHEN turn_index < max(turn_index) OVER (PARTITION BY sample_id) THEN 'history' WHEN role = 'user' THEN 'query' ELSE 'rejected' END AS part FROM fx_messages")
def _(v):
    return D.split_history_query(v("fx_messages"))


@query("b1_pair_exchanges", "SELECT sample_id, CASE WHEN p = 'user' THEN pid END AS user_message_id, message_id AS assistant_message_id FROM (SELECT *, lag(role) OVER w AS p, lag(message_id) OVER w AS pid FROM fx_messages WHERE role <> 'system' WINDOW w AS (PARTITION BY sample_id ORDER BY turn_index)) WHERE role = 'assistant'")
def _(v):
    return D.pair_exchanges(v("fx_messages"))


@query("b6_latest_snapshot", "SELECT sample_id, trajectory_id, arg_max(snapshot_id, version) AS snapshot_id, CAST(max(version) AS BIGINT) AS version FROM fx_snapshots GROUP BY ALL")
def _(v):
    return D.latest_snapshots(v("fx_snapshots"))


@query("b8_conflict_lines", "SELECT sample_id, snapshot_id, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY claim_id) AS claim_ids FROM fx_claims WHERE status IN ('contradictory', 'needs-confirmation') GROUP BY ALL")
def _(v):
    return D.conflict_lines(v("fx_claims"))


@query("c1_normalize_answer", f"SELECT message_id, {_NORM.format('content')} AS norm FROM fx_messages")
def _(v):
    return v("fx_messages").select("message_id", normalize_answer(F.col("content")).alias("norm"))


@query("c2_extract_keywords", f"SELECT message_id, array_to_string(list_sort({_KEYS.format('content')}), ' ') AS words FROM fx_messages")
def _(v):
    return v("fx_messages").select("message_id", F.array_join(F.sort_array(keywords(F.col("content"))), " ").alias("words"))


@query("c4_estimate_tokens", f"SELECT message_id, {_TOKENS.format('content')} AS tokens FROM fx_messages")
def _(v):
    return v("fx_messages").select("message_id", estimate_tokens(F.col("content")).alias("tokens"))


@query("c5_cosine", "SELECT a.snapshot_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM fx_vectors a JOIN fx_vectors b ON a.trajectory_id = b.trajectory_id AND b.version = 1")
def _(v):
    first = v("fx_vectors").where("version = 1").select("trajectory_id", F.col("embedding").alias("first"))
    return v("fx_vectors").join(first, "trajectory_id").select("snapshot_id", F.round(cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


@query("d1_dedupe_claims", f"SELECT sample_id, {_NORM.format('text')} AS norm, arg_max(status, CASE status WHEN 'contradictory' THEN 3 WHEN 'needs-confirmation' THEN 2 WHEN 'deprecated' THEN 1 ELSE 0 END) AS status, count(DISTINCT source_message_id) AS sources, min(claim_id) AS claim_id FROM fx_claims GROUP BY 1, 2")
def _(v):
    return D.dedupe_claims(v("fx_claims"))


@query("d6_bounded_chain_assignment", "SELECT sample_id, message_id, CAST(floor(n / 3) AS BIGINT) AS chain, n % 3 + 1 AS version FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY turn_index) - 1 AS n FROM fx_history)")
def _(v):
    return D.bounded_chains(v("fx_history"), 3)


@query("e12_fragmentation_stats", "SELECT sample_id, count(*) AS pages, avg(w) AS mean_width, max(w) AS max_width, avg(CASE WHEN w = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS singleton_rate FROM (SELECT sample_id, page_id, count(*) AS w FROM fx_page_members WHERE page_type <> 'index' GROUP BY ALL) GROUP BY sample_id")
def _(v):
    return D.fragmentation(v("fx_page_members"))


@query("f13_expand_neighbors", "SELECT DISTINCT a.snapshot_id, b.snapshot_id AS neighbor_id FROM fx_vectors a JOIN fx_vectors b ON a.trajectory_id = b.trajectory_id AND abs(a.version - b.version) <= 1")
def _(v):
    return D.expand_neighbors(v("fx_vectors"), v("fx_vectors"), 1)


@query("f21_flat_lexical_rank", f"SELECT query_id, sample_id, message_id, source_ref, score::DOUBLE AS score, tokens, rank FROM ({_RANKED})")
def _(v):
    return R.flat_lexical_rank(v("fx_queries"), v("fx_history"))


@query("f26_budget_prefix", f"SELECT query_id, message_id, rank, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM ({_RANKED})) WHERE used <= {BUDGET} AND rank <= {MOST}")
def _(v):
    return R.budget_prefix(R.flat_lexical_rank(v("fx_queries"), v("fx_history")), BUDGET, MOST).select("query_id", "message_id", "rank", "used")


@query("f29_cutoff_universe", "SELECT query_id, cutoff, count(DISTINCT trajectory_id) AS universe FROM fx_ranked JOIN (SELECT unnest([1, 2, 3, 5]) AS cutoff) ON rnk <= cutoff GROUP BY ALL")
def _(v):
    return R.cutoff_universe(v.table("fx_ranked"), CUTOFFS)


@query("g2_g3_token_overlap", f"""WITH p AS (SELECT q.query_id AS id, list_filter(string_split({_NORM.format('h.content')}, ' '), lambda w: w <> '') AS p, list_filter(string_split({_NORM.format('q.question')}, ' '), lambda w: w <> '') AS g FROM fx_queries q JOIN fx_history h ON q.sample_id = h.sample_id AND h.turn_index = 0),
  a AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(p) AS w FROM p) GROUP BY ALL), b AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(g) AS w FROM p) GROUP BY ALL),
  c AS (SELECT id, sum(least(a.n, b.n)) AS common FROM a JOIN b USING (id, w) GROUP BY id)
  SELECT p.id, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN len(p) = 0 THEN 0 ELSE coalesce(common, 0) / len(p) END::DOUBLE, 9) AS bleu1, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN coalesce(common, 0) = 0 THEN 0 ELSE 2 * common / (len(p) + len(g)) END::DOUBLE, 9) AS token_f1 FROM p LEFT JOIN c ON p.id = c.id""")
def _(v):
    first = v("fx_history").where("turn_index = 0").select("sample_id", F.col("content").alias("predicted"))
    return E.token_overlap(v("fx_queries").join(first, "sample_id").select(F.col("query_id").alias("id"), "predicted", F.col("question").alias("gold")))


@query("g4_evidence_recall", f"WITH s AS (SELECT DISTINCT query_id, source_ref FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM ({_RANKED})) WHERE used <= {BUDGET} AND rank <= {MOST}) SELECT q.query_id, count(g.source_ref) AS gold, count(s.source_ref) AS found, CASE WHEN count(g.source_ref) = 0 THEN 1.0 ELSE count(s.source_ref) / count(g.source_ref) END::DOUBLE AS recall FROM fx_queries q LEFT JOIN fx_gold g ON q.query_id = g.query_id LEFT JOIN s ON s.query_id = g.query_id AND s.source_ref = g.source_ref GROUP BY q.query_id")
def evidence_recall(v):
    kept = R.budget_prefix(R.flat_lexical_rank(v("fx_queries"), v("fx_history")), BUDGET, MOST)
    return R.evidence_recall(kept, v("fx_gold"), v("fx_queries"))


_TABLE = f"SELECT coalesce(variant, 'all') AS variant, coalesce(stratum, 'all') AS stratum, count(*) AS n, count(gold_ref_coverage) AS observed, round(avg({_JUDGE}), 9) AS judge, round(avg(token_f1), 6) AS token_f1, round(avg(gold_ref_coverage), 6) AS coverage FROM fx_outcomes GROUP BY GROUPING SETS ((variant, stratum), (variant), ())"


@query("g9_aggregate_by_subset", _TABLE)
def _(v):
    return E.aggregate_by_stratum(v("fx_outcomes"))


@query("g11_unpivot_metrics", f"SELECT variant, stratum, metric, value FROM (UNPIVOT ({_TABLE}) ON judge, token_f1, coverage INTO NAME metric VALUE value)")
def _(v):
    return E.unpivot_metrics(E.aggregate_by_stratum(v("fx_outcomes")))


@query("h13_trajectory_cutoff_curve", "WITH t AS (SELECT DISTINCT g.query_id, s.trajectory_id FROM fx_gold g JOIN fx_snapshots s ON g.sample_id = s.sample_id AND g.source_ref = s.source_ref), r AS (SELECT cutoff, t.query_id, avg(CASE WHEN k.rnk <= cutoff THEN 1.0 ELSE 0.0 END) AS r FROM t LEFT JOIN fx_ranked k ON k.query_id = t.query_id AND k.trajectory_id = t.trajectory_id CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS cutoff) GROUP BY ALL) SELECT cutoff, round(avg(r), 9) AS recall, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 9) AS all_gold_rate, count(*) AS queries FROM r GROUP BY cutoff")
def _(v):
    return R.rank_recall(v.table("fx_ranked"), R.gold_trajectories(v("fx_gold"), v("fx_snapshots")), CUTOFFS)


@query("i9_amortized_curve", f"WITH o AS (SELECT sum(CASE WHEN {_PHASE} = 'memory' THEN completion_tokens END) AS upfront, sum(CASE WHEN {_PHASE} <> 'memory' THEN completion_tokens END) / count(DISTINCT query_id) AS each_one FROM fx_calls) SELECT n, round((upfront + each_one * n) / n, 6) AS cost FROM o, (SELECT unnest([1, 10, 100]) AS n)")
def _(v):
    return E.amortized_cost(v("fx_calls"), [1, 10, 100])


@query("i13_token_share", "WITH t AS (SELECT task, sum(completion_tokens) AS t FROM fx_calls GROUP BY task), r AS (SELECT *, row_number() OVER (ORDER BY t DESC, task) AS r, sum(t) OVER () AS a FROM t) SELECT CASE WHEN r <= 3 THEN task ELSE 'Other' END AS task, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t / a), 9) AS share FROM r GROUP BY 1")
def _(v):
    return E.token_share(v("fx_calls"), 3)


@query("k4_first_hit_rank", "SELECT t.query_id, min(r.rnk) AS first_rank FROM (SELECT DISTINCT g.query_id, s.trajectory_id FROM fx_gold g JOIN fx_snapshots s ON g.sample_id = s.sample_id AND g.source_ref = s.source_ref) t LEFT JOIN fx_ranked r ON r.query_id = t.query_id AND r.trajectory_id = t.trajectory_id GROUP BY t.query_id")
def _(v):
    return R.first_hit_rank(v.table("fx_ranked"), R.gold_trajectories(v("fx_gold"), v("fx_snapshots")))


@query("k19_run_diff", "SELECT coalesce(a.verdict, 'missing') AS before, coalesce(b.verdict, 'missing') AS after, count(*) AS n FROM (SELECT * FROM fx_outcomes WHERE variant = 'v1') a FULL JOIN (SELECT * FROM fx_outcomes WHERE variant = 'v2') b ON a.query_id = b.query_id GROUP BY 1, 2")
def _(v):
    return E.run_diff(v("fx_outcomes"), "v1", "v2")


@query("l1_trajectory_drift", "WITH x AS (SELECT *, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY sample_id, trajectory_id ORDER BY version) AS p FROM fx_vectors), d AS (SELECT sample_id, trajectory_id, count(*) AS length, CASE WHEN count(*) = 1 THEN 1.0 ELSE list_cosine_similarity(arg_min(e, version), arg_max(e, version)) END AS ht, avg(list_cosine_similarity(p, e)) AS m, min(list_cosine_similarity(p, e)) AS l FROM x GROUP BY sample_id, trajectory_id) SELECT trajectory_id, length, round(ht::DOUBLE, 6) AS head_tail, round(m, 6) AS adjacent_mean, round(l, 6) AS adjacent_min, CASE WHEN length = 1 THEN 'singleton' WHEN ht >= 0.7 THEN 'stable' WHEN ht >= 0.55 THEN 'mild' WHEN ht >= 0.4 THEN 'moderate' ELSE 'possible_drift' END AS bucket FROM d")
def _(v):
    return E.trajectory_drift(v("fx_vectors"), E.OWN).drop("sample_id")


@query("l5_query_strata", "WITH l AS (SELECT sample_id, source_ref FROM (SELECT *, max(version) OVER (PARTITION BY trajectory_id) AS top FROM fx_snapshots) WHERE version = top), g AS (SELECT g.query_id, bool_or(l.source_ref IS NULL) AS deep, bool_or(g.message_id IN (SELECT source_message_id FROM fx_claims WHERE status = 'deprecated')) AS upd FROM fx_gold g LEFT JOIN l ON l.sample_id = g.sample_id AND l.source_ref = g.source_ref GROUP BY g.query_id) SELECT query_id, CASE WHEN deep THEN 'strict_deep_history' WHEN upd THEN 'update_sensitive' ELSE 'ordinary' END AS stratum FROM g")
def _(v):
    return E.query_strata(v("fx_gold"), v("fx_snapshots"), v("fx_claims"))


_PAIRS = f"SELECT a.variant, a.query_id, a.s - b.s AS d FROM (SELECT *, {_JUDGE} AS s FROM fx_outcomes WHERE variant <> 'v1') a JOIN (SELECT query_id, {_JUDGE} AS s FROM fx_outcomes WHERE variant = 'v1') b ON a.query_id = b.query_id"


@query("l7_paired_win_tie_loss", f"SELECT variant, count(d) AS pairs, round(avg(d), 9) AS delta, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM ({_PAIRS}) GROUP BY variant")
def _(v):
    return E.paired_deltas(v("fx_outcomes"), "v1")


@query("l7_paired_bootstrap", None)  # random draws
def _(v):
    return E.bootstrap_interval(v("fx_outcome_details"), "v1", DRAWS)
