"""Queries of the memory index, events, labels and ablations, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import retrieval as R
from .registry import _KEYS, _RANKED, _TOKENS, query

GRID_CUTOFFS, GRID_BUDGETS = [1, 2, 15], [40, 400]

_REFS = "SELECT sample_id, trajectory_id, snapshot_id, source_ref FROM fx_snapshots UNION SELECT sample_id, trajectory_id, snapshot_id, source_ref FROM fx_claims"
_LIST = "coalesce(string_agg(DISTINCT CAST({0} AS VARCHAR), ' ' ORDER BY CAST({0} AS VARCHAR)), '')"
_NUMBERS = "coalesce(array_to_string(list_sort(list_distinct(list({0}))), ' '), '')"


def index(v):
    return v.once("memory_index", lambda: M.memory_index(v("fx_snapshots"), v("fx_claims"), v("fx_page_members")))


def events(v):
    return v.once("retrieval_events", lambda: M.retrieval_events(M.saved_events(v.table("fx_event_items")), v("fx_messages")))


def labels(v):
    return v.once("gold_labels", lambda: M.gold_labels(v("fx_queries"), v("fx_gold"), v("fx_snapshots"), v("fx_claims"), v("fx_page_members")))


@query("a9_build_memory_index", f"WITH refs AS ({_REFS}), r AS (SELECT trajectory_id, {_LIST.format('source_ref')} AS source_refs FROM refs GROUP BY 1), p AS (SELECT trajectory_id, {_NUMBERS.format('page_id')} AS page_ids FROM fx_page_members WHERE page_type <> 'index' GROUP BY 1) SELECT sample_id, s.trajectory_id, count(*) AS length, string_agg(CAST(snapshot_id AS VARCHAR), ' ' ORDER BY version) AS snapshot_ids, source_refs, coalesce(page_ids, '') AS page_ids, string_agg(content, chr(10) ORDER BY version) AS text FROM fx_snapshots s JOIN r ON r.trajectory_id = s.trajectory_id LEFT JOIN p ON p.trajectory_id = s.trajectory_id GROUP BY sample_id, s.trajectory_id, source_refs, page_ids")
def _(v):
    return index(v).select("sample_id", "trajectory_id", "length", M.shown("snapshot_ids").alias("snapshot_ids"), M.shown("source_refs").alias("source_refs"), M.shown("page_ids").alias("page_ids"), "text")


_EVENT_IDS = "coalesce(string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rnk) FILTER (tier = '{0}'), '')"


@query("a19_load_retrieval_events", f"SELECT query_id, {_EVENT_IDS.format('page')} AS page_ids, {_EVENT_IDS.format('trajectory')} AS trajectory_ids, {_EVENT_IDS.format('expanded')} AS expanded_ids, {_EVENT_IDS.format('source')} AS source_ids, coalesce(string_agg(source_ref, ' ' ORDER BY rnk) FILTER (tier = 'expanded'), '') AS expanded_refs, coalesce(string_agg(source_ref, ' ' ORDER BY rnk) FILTER (tier = 'source'), '') AS source_refs FROM fx_event_items e LEFT JOIN fx_messages m ON tier IN ('expanded', 'source') AND m.sample_id = e.sample_id AND m.message_id = item_id GROUP BY query_id")
def _(v):
    return events(v).select("query_id", *(M.shown(c).alias(c) for c in ("page_ids", "trajectory_ids", "expanded_ids", "source_ids", "expanded_refs", "source_refs")))


query("a8_load_json_columns", "SELECT query_id, tier, CASE WHEN rnk % 2 = 1 THEN CAST(item_id AS VARCHAR) ELSE '' END AS ids FROM fx_event_items")(
    lambda v: v.table("fx_event_items").select("query_id", "tier", M.shown(M.json_ids(F.when(F.col("rnk") % 2 == 1, F.concat(F.lit("["), F.col("item_id"), F.lit("]"))).otherwise("{not json"))).alias("ids"))
)
query("b6_latest_claims", "SELECT trajectory_id, claim_id, status FROM fx_claims c WHERE snapshot_id = (SELECT arg_max(s.snapshot_id, s.version) FROM fx_snapshots s WHERE s.trajectory_id = c.trajectory_id)")(
    lambda v: M.latest_claims(v("fx_snapshots"), v("fx_claims"))
)
query("a17_inspect_trajectory", "SELECT s.trajectory_id, string_agg(s.snapshot_id || ':' || s.version || '=' || coalesce(c.claims, ''), ' ' ORDER BY version) AS snapshots FROM fx_snapshots s LEFT JOIN (SELECT snapshot_id, string_agg(claim_id || '/' || status, ',' ORDER BY claim_id) AS claims FROM fx_claims GROUP BY 1) c ON c.snapshot_id = s.snapshot_id GROUP BY s.trajectory_id")(
    lambda v: M.trajectory_documents(v("fx_snapshots"), v("fx_claims"))
)
query("a7_evidence_only_conversation", "WITH w AS (SELECT sample_id, source_ref FROM fx_gold UNION ALL SELECT sample_id, 'D9:' || sample_id FROM fx_queries) SELECT w.sample_id, coalesce(string_agg('[' || m.source_ref || '] ' || m.role || ': ' || m.content, chr(10) ORDER BY m.turn_index), '') AS text, coalesce(string_agg(w.source_ref, ' ' ORDER BY w.source_ref) FILTER (m.source_ref IS NULL), '') AS missing FROM w LEFT JOIN fx_messages m ON m.sample_id = w.sample_id AND m.source_ref = w.source_ref GROUP BY w.sample_id")(
    lambda v: M.evidence_only(v("fx_messages"), v("fx_gold").select("sample_id", "source_ref").unionByName(v("fx_queries").select("sample_id", F.concat(F.lit("D9:"), F.col("sample_id").cast("string")).alias("source_ref"))))
)
query("a10_query_scope_filter", "WITH m AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN sample_id + 1 ELSE sample_id END AS sample_id FROM fx_queries WHERE query_id % 3 <> 0 UNION ALL SELECT query_id, sample_id FROM fx_queries WHERE query_id % 11 = 0 UNION ALL SELECT max(query_id) + 1, 0 FROM fx_queries) SELECT m.query_id, CASE WHEN q.query_id IS NULL THEN 'missing' WHEN count(*) > 1 THEN 'duplicate' WHEN bool_or(q.sample_id <> m.sample_id) THEN 'sample_mismatch' ELSE 'kept' END AS state FROM m LEFT JOIN fx_queries q ON q.query_id = m.query_id GROUP BY m.query_id, q.query_id")(
    lambda v: M.scoped(v("fx_queries"), _manifest(v("fx_queries"))).select("query_id", "state")
)


def _manifest(q):
    some = q.where("query_id % 3 <> 0").selectExpr("query_id", "CASE WHEN query_id % 7 = 0 THEN sample_id + 1 ELSE sample_id END AS sample_id")
    return some.unionByName(q.where("query_id % 11 = 0").select("query_id", "sample_id")).unionByName(q.selectExpr("max(query_id) + 1 AS query_id", "0L AS sample_id"))


_GOLD = f"SELECT q.query_id, q.sample_id, g.source_ref, g.message_id, r.trajectory_id, r.snapshot_id, p.page_id FROM fx_queries q LEFT JOIN fx_gold g ON g.query_id = q.query_id LEFT JOIN ({_REFS}) r ON r.sample_id = g.sample_id AND r.source_ref = g.source_ref LEFT JOIN fx_page_members p ON p.trajectory_id = r.trajectory_id AND p.page_type <> 'index'"


@query("h1_gold_labels", f"SELECT query_id, {_LIST.format('source_ref')} AS source_refs, {', '.join(_NUMBERS.format(f'{c}) FILTER ({c} IS NOT NULL') + f' AS {c}s' for c in ('message_id', 'trajectory_id', 'page_id', 'snapshot_id'))} FROM ({_GOLD}) GROUP BY query_id")
def _(v):
    return labels(v).select("query_id", *(M.shown(c).alias(c) for c in ("source_refs", "message_ids", "trajectory_ids", "page_ids", "snapshot_ids")))


_TEXT = "SELECT sample_id, trajectory_id, string_agg(content, chr(10) ORDER BY version) AS text FROM fx_snapshots GROUP BY ALL"
_DIRECT = f"SELECT query_id, trajectory_id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, trajectory_id) AS rank FROM (SELECT query_id, trajectory_id, text, round(hit + coalesce(2 * hit / nullif(n, 0), 0) - CASE WHEN hit > 0 THEN 0.25 ELSE 0 END, 9)::DOUBLE AS score FROM (SELECT q.query_id, t.trajectory_id, text, len(list_intersect({_KEYS.format('q.question')}, {_KEYS.format('text')})) AS hit, len({_KEYS.format('q.question')}) AS n FROM fx_queries q JOIN ({_TEXT}) t ON t.sample_id = q.sample_id))"
# items (query_id, variant, rank, cut, item_id, tokens), refs and tids (query_id, variant, rank, what)
_ITEMS = f"""refs_ AS ({_REFS}),
  e AS (SELECT x.*, {_TOKENS.format('content')} AS t, s.item_id IS NOT NULL AS kept FROM fx_expanded x LEFT JOIN fx_event_items s ON s.tier = 'source' AND s.query_id = x.query_id AND s.item_id = x.snapshot_id),
  f AS (SELECT query_id, trajectory_id, min(rnk) AS first, coalesce(nullif(sum(t) FILTER (kept), 0), sum(t)) AS tokens FROM e GROUP BY ALL),
  ff AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM f),
  pg AS (SELECT r.query_id, r.page_id, r.rnk AS rank, p.trajectory_id FROM fx_page_ranks r JOIN fx_page_members p ON p.page_id = r.page_id AND p.page_type <> 'index'),
  fl AS ({_RANKED}), di AS ({_DIRECT}),
  de AS (SELECT r.query_id, d AS depth, r.rnk AS cut, s.* FROM fx_ranked r JOIN (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY version DESC) AS back FROM fx_snapshots) s ON s.trajectory_id = r.trajectory_id JOIN (SELECT unnest([1, 2]) AS d) ON s.back <= d WHERE r.rnk <= 2),
  dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, depth ORDER BY cut, version) AS rank FROM de),
  cl AS (SELECT x.query_id, c.*, row_number() OVER (PARTITION BY x.query_id ORDER BY x.rnk, c.claim_id) AS rank FROM fx_expanded x JOIN fx_claims c ON c.snapshot_id = x.snapshot_id WHERE c.source_ref IS NOT NULL),
  items AS (SELECT query_id, 'full' AS variant, rank, rank AS cut, CAST(trajectory_id AS VARCHAR) AS item_id, CAST(tokens AS BIGINT) AS tokens FROM ff
    UNION ALL SELECT query_id, 'no_pages_direct', rank, rank, CAST(trajectory_id AS VARCHAR), {_TOKENS.format('text')} FROM di
    UNION ALL SELECT query_id, 'pages_only', rank, rank, CAST(page_id AS VARCHAR), CAST(sum({_TOKENS.format('t.text')}) AS BIGINT) FROM pg JOIN ({_TEXT}) t ON t.trajectory_id = pg.trajectory_id GROUP BY query_id, rank, page_id
    UNION ALL SELECT query_id, 'flat_raw', rank, 0, CAST(message_id AS VARCHAR), tokens FROM fl
    UNION ALL SELECT query_id, 'snapshot_m' || depth, rank, cut, CAST(snapshot_id AS VARCHAR), {_TOKENS.format('content')} FROM dd
    UNION ALL SELECT query_id, 'source_supported_only', rank, rank, CAST(claim_id AS VARCHAR), {_TOKENS.format('text')} FROM cl),
  refs AS (SELECT e.query_id, 'full' AS variant, ff.rank, source_ref AS what FROM e JOIN ff ON ff.query_id = e.query_id AND ff.trajectory_id = e.trajectory_id WHERE kept
    UNION SELECT query_id, 'no_pages_direct', rank, source_ref FROM di JOIN refs_ ON refs_.trajectory_id = di.trajectory_id UNION SELECT query_id, 'pages_only', rank, source_ref FROM pg JOIN refs_ ON refs_.trajectory_id = pg.trajectory_id
    UNION SELECT query_id, 'flat_raw', rank, source_ref FROM fl UNION SELECT query_id, 'snapshot_m' || depth, rank, refs_.source_ref FROM dd JOIN refs_ ON refs_.snapshot_id = dd.snapshot_id UNION SELECT query_id, 'source_supported_only', rank, source_ref FROM cl),
  tids AS (SELECT query_id, 'full' AS variant, rank, trajectory_id AS what FROM ff UNION SELECT query_id, 'no_pages_direct', rank, trajectory_id FROM di UNION SELECT query_id, 'pages_only', rank, trajectory_id FROM pg
    UNION SELECT query_id, 'flat_raw', rank, s.trajectory_id FROM fl JOIN fx_snapshots s ON s.sample_id = fl.sample_id AND s.source_ref = fl.source_ref UNION SELECT query_id, 'snapshot_m' || depth, rank, trajectory_id FROM dd UNION SELECT query_id, 'source_supported_only', rank, trajectory_id FROM cl)"""
_SHOW = "SELECT i.query_id, i.rank, i.item_id, i.tokens, coalesce((SELECT string_agg(what, ' ' ORDER BY what) FROM refs r WHERE r.query_id = i.query_id AND r.variant = i.variant AND r.rank = i.rank), '') AS refs FROM items i WHERE i.variant = '{0}'"
_CELLS = f"""{_ITEMS}, used AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id, variant ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM items),
  cells AS (SELECT query_id, variant, cutoff, budget FROM fx_queries, (SELECT unnest(['full', 'no_pages_direct', 'pages_only', 'flat_raw', 'snapshot_m1', 'snapshot_m2', 'source_supported_only']) AS variant), (SELECT unnest({GRID_CUTOFFS}) AS cutoff), (SELECT unnest({GRID_BUDGETS}) AS budget)),
  sel AS (SELECT c.*, u.rank, u.tokens FROM cells c JOIN used u ON u.query_id = c.query_id AND u.variant = c.variant AND u.cut <= c.cutoff AND u.used <= c.budget),
  gr AS (SELECT DISTINCT query_id, source_ref AS what FROM ({_GOLD}) WHERE source_ref IS NOT NULL), gt AS (SELECT DISTINCT query_id, trajectory_id AS what FROM ({_GOLD}) WHERE trajectory_id IS NOT NULL),
  hr AS (SELECT s.query_id, s.variant, s.cutoff, s.budget, count(DISTINCT gr.what) AS n FROM sel s JOIN refs r ON r.query_id = s.query_id AND r.variant = s.variant AND r.rank = s.rank JOIN gr ON gr.query_id = r.query_id AND gr.what = r.what GROUP BY ALL),
  ht AS (SELECT s.query_id, s.variant, s.cutoff, s.budget, count(DISTINCT gt.what) AS n FROM sel s JOIN tids r ON r.query_id = s.query_id AND r.variant = s.variant AND r.rank = s.rank JOIN gt ON gt.query_id = r.query_id AND gt.what = r.what GROUP BY ALL),
  base AS (SELECT c.*, (SELECT count(*) FROM items i WHERE i.query_id = c.query_id AND i.variant = c.variant) AS universe, (SELECT count(*) FROM gr WHERE gr.query_id = c.query_id) AS ng, (SELECT count(*) FROM gt WHERE gt.query_id = c.query_id) AS nt FROM cells c),
  picked AS (SELECT query_id, variant, cutoff, budget, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens FROM sel GROUP BY ALL),
  grid AS (SELECT b.query_id, b.variant, b.cutoff, b.budget, b.universe, coalesce(p.items, 0) AS items, coalesce(p.tokens, 0) AS tokens, CASE WHEN b.variant <> 'pages_only' AND ng > 0 THEN round(coalesce(hr.n, 0) / ng, 9) END AS ref_coverage,
    CASE WHEN b.variant <> 'pages_only' THEN ng > 0 AND coalesce(hr.n, 0) = ng END AS all_refs, CASE WHEN nt > 0 THEN round(coalesce(ht.n, 0) / nt, 9) END AS trajectory_recall, nt > 0 AND coalesce(ht.n, 0) = nt AS all_trajectories, CASE WHEN b.variant <> 'pages_only' THEN NOT (ng > 0 AND coalesce(hr.n, 0) = ng) END AS risk
    FROM base b LEFT JOIN picked p ON p.query_id = b.query_id AND p.variant = b.variant AND p.cutoff = b.cutoff AND p.budget = b.budget LEFT JOIN hr ON hr.query_id = b.query_id AND hr.variant = b.variant AND hr.cutoff = b.cutoff AND hr.budget = b.budget LEFT JOIN ht ON ht.query_id = b.query_id AND ht.variant = b.variant AND ht.cutoff = b.cutoff AND ht.budget = b.budget)"""


def direct(v):
    texts = v("fx_snapshots").groupBy("sample_id", "trajectory_id").agg(F.array_join(M.ordered(F.col("content"), "version"), "\n").alias("text"))
    return R.direct_rank(R.plain_questions(v("fx_queries")), texts.withColumn("specific", F.array().cast("array<string>")))


def items(v) -> dict:
    sources = v.table("fx_event_items").where("tier = 'source'")
    selected, ix = v.table("fx_ranked").where("rnk <= 2"), index(v)
    refs = M.snapshot_refs(v("fx_snapshots"), v("fx_claims"))
    depth = lambda m: M.depth_items(selected, v("fx_snapshots"), refs, m)
    return {
        "full": M.full_items(v.table("fx_expanded"), sources), "no_pages_direct": M.direct_items(direct(v), ix), "pages_only": M.page_items(v.table("fx_page_ranks"), v("fx_page_members"), ix),
        "flat_raw": M.flat_items(R.flat_lexical_rank(v("fx_queries"), v("fx_history")), v("fx_snapshots")), "snapshot_m1": depth(1), "snapshot_m2": depth(2), "source_supported_only": M.claim_items(v.table("fx_expanded"), v("fx_claims")),
    }


def _items_query(name: str, variant: str):
    query(name, f"WITH {_ITEMS} " + _SHOW.format(variant))(lambda v: items(v)[variant].select("query_id", "rank", "item_id", "tokens", M.shown("refs").alias("refs")))


for _name, _variant in (("h2_ablation_full", "full"), ("h3_ablation_direct", "no_pages_direct"), ("h4_ablation_pages_only", "pages_only"), ("h5_ablation_flat_raw", "flat_raw"), ("h6_ablation_snapshot_depth", "snapshot_m2"), ("h7_ablation_supported_claims", "source_supported_only")):
    _items_query(_name, _variant)


def grid(v):
    every = v.once("ablation_items", lambda: M.all_items(list(items(v).values())))
    return v.once("ablation_grid", lambda: M.ablation_grid(every, labels(v), GRID_CUTOFFS, GRID_BUDGETS))


_RATE = "round(count(*) FILTER ({0}) / nullif(count({0}), 0), 9)"
query("h8_ablation_grid", f"WITH {_CELLS} SELECT * FROM grid")(grid)
query("h9_ablation_summary", f"WITH {_CELLS} SELECT variant, budget, count(*) AS queries, round(avg(ref_coverage), 6) AS ref_coverage, round(avg(trajectory_recall), 6) AS trajectory_recall, {_RATE.format('all_refs')} AS all_refs_rate, {_RATE.format('all_trajectories')} AS all_trajectories_rate, round(avg(universe), 6) AS universe, round(avg(tokens), 6) AS tokens, {_RATE.format('risk')} AS risk_rate FROM grid WHERE cutoff = 15 GROUP BY variant, budget")(lambda v: M.ablation_summary(grid(v), 15))
query("h10_cost_recall_curve", f"WITH {_CELLS} SELECT variant, budget, cutoff, count(*) AS queries, round(avg(ref_coverage), 6) AS ref_coverage, round(avg(trajectory_recall), 6) AS trajectory_recall, round(avg(tokens), 6) AS tokens FROM grid GROUP BY variant, budget, cutoff")(lambda v: M.cost_recall_curve(grid(v)))
query("h12_variant_examples", f"WITH {_CELLS}, p AS (SELECT query_id, budget, coalesce(max(ref_coverage) FILTER (variant = 'full'), 0) AS f, coalesce(max(ref_coverage) FILTER (variant = 'no_pages_direct'), 0) AS d, coalesce(max(ref_coverage) FILTER (variant = 'pages_only'), 0) AS w, coalesce(bool_or(all_refs) FILTER (variant = 'flat_raw'), FALSE) AS flat FROM grid WHERE cutoff = 15 GROUP BY ALL), k AS (SELECT query_id, budget, 'direct_beats_full' AS kind FROM p WHERE d > f UNION ALL SELECT query_id, budget, 'full_beats_direct' FROM p WHERE f > d UNION ALL SELECT query_id, budget, 'pages_lose_evidence' FROM p WHERE w < f UNION ALL SELECT query_id, budget, 'flat_hits_at_high_cost' FROM p WHERE flat) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY query_id, budget) AS place FROM k QUALIFY place <= 10")(lambda v: M.variant_examples(grid(v), 15, 10))

_HITS = f"""g AS ({_GOLD}), per AS (SELECT query_id, bool_or(trajectory_id IS NOT NULL) AS stored,
  bool_or(EXISTS (SELECT 1 FROM fx_event_items e JOIN fx_page_members p ON e.tier = 'page' AND p.page_id = e.item_id WHERE e.query_id = g.query_id AND p.trajectory_id = g.trajectory_id)) AS routed,
  bool_or(EXISTS (SELECT 1 FROM fx_event_items e WHERE e.tier = 'trajectory' AND e.query_id = g.query_id AND e.item_id = g.trajectory_id)) AS selected,
  bool_or(EXISTS (SELECT 1 FROM fx_event_items e WHERE e.tier = 'expanded' AND e.query_id = g.query_id AND e.item_id = g.snapshot_id)) AS expanded,
  bool_or(EXISTS (SELECT 1 FROM fx_event_items e JOIN fx_messages m ON m.message_id = e.item_id WHERE e.tier = 'source' AND e.query_id = g.query_id AND m.source_ref = g.source_ref)) AS grounded
  FROM g WHERE source_ref IS NOT NULL GROUP BY query_id)"""


def hits(v):
    return M.stage_hits(labels(v), events(v), index(v), v("fx_page_members"))


query("h11_evidence_funnel", f"WITH {_HITS} SELECT stage, count(*) AS queries, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 9) AS rate FROM (UNPIVOT per ON stored, routed, selected, expanded, grounded INTO NAME stage VALUE hit) GROUP BY stage")(lambda v: M.evidence_funnel(hits(v)))
query("k1_classify_failure", f"WITH {_HITS} SELECT q.query_id, CASE WHEN stored IS NULL THEN 'unknown_no_gold_refs' WHEN NOT stored THEN 'memory_absent' WHEN NOT routed THEN 'coarse_retrieval_miss' WHEN NOT selected THEN 'fine_retrieval_miss' WHEN NOT grounded THEN 'grounding_miss' WHEN verdict IN ('partial', 'incorrect') THEN 'answer_error' ELSE 'other' END AS reason FROM fx_queries q LEFT JOIN per ON per.query_id = q.query_id LEFT JOIN fx_answers a ON a.query_id = q.query_id")(lambda v: M.failure_reasons(v("fx_queries"), hits(v), v("fx_answers")))
