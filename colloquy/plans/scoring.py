"""Queries of the candidate scores, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.answers import hash_embedding
from ..functions.text import unit_cosine
from ..operators import contexts as C
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import retrieve as T
from ..operators import scoring as S
from .registry import _KEYS, query

_STOP = "'did', 'does', 'have', 'has', 'how', 'many', 'the', 'what', 'when', 'where', 'which', 'who', 'with'"
_ACTS = "['went', 'met', 'visit', 'visited', 'read', 'bought', 'hosted', 'joined']"
_NAMES = "list_filter(list_distinct(list_transform(regexp_extract_all({0}, '\\b[A-Z][a-z]+\\b'), lambda w: lower(w))), lambda w: w NOT IN ('the', 'my', 'how', 'which', 'thanks'))"
_VEC = "list_transform(range(32), lambda i: ('0x' || substr(sha256({0}), CAST(2 * i + 1 AS INT), 2))::INT / 255.0::DOUBLE - 0.5)"
_COS = f"round(list_cosine_similarity({_VEC.format('{0}')}, {_VEC.format('{1}')}), 9)"
_JAC = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END)"
_Q = f"""q AS (SELECT query_id, sample_id, question, list_filter({_KEYS.format('question')}, lambda w: w NOT IN ({_STOP})) AS terms, {_NAMES.format('substr(question, 2)')} AS entities,
    CASE WHEN regexp_matches(lower(question), '\\b(books?|read|reading|novel)\\b') THEN 'book' WHEN regexp_matches(lower(question), '\\b(city|cities|visited|country)\\b') THEN 'city' END AS family,
    CASE WHEN regexp_matches(lower(question), '\\b(books?|read|reading|novel)\\b') THEN ['book', 'books', 'read', 'reading', 'novel'] WHEN regexp_matches(lower(question), '\\b(city|cities|visited|country)\\b') THEN ['city', 'cities', 'visited', 'country'] END AS fam,
    starts_with(lower(question), 'how many') AS counting, starts_with(lower(question), 'which') AS listing, regexp_matches(lower(question), '\\b(when|date|year|last)\\b') AS temporal FROM fx_asks)"""
_T = f"""t0 AS (SELECT sample_id, trajectory_id, string_agg(text, ' ' ORDER BY version) AS text, arg_max(text, version) AS latest, count(*) AS claims FROM fx_note_claims GROUP BY ALL),
  t AS (SELECT *, {_KEYS.format('text')} AS have, {_NAMES.format('text')} AS names, list_distinct(regexp_extract_all(text, 'favorite color is ([a-z]+)', 1)) AS vals, list_filter({_KEYS.format("array_to_string(regexp_extract_all(text, 'enjoy ([a-z, ]+)', 1), ' ')")}, lambda w: w <> 'and') AS items FROM t0)"""
_P = f"""{_Q}, {_T}, p AS (SELECT q.*, t.trajectory_id, t.text, t.latest, t.have, t.names, t.vals, t.items, len(list_intersect(fam, have)) AS fh, len(list_intersect(terms, have)) AS qh, len(list_intersect(list_filter(terms, lambda w: NOT list_contains(entities, w)), have)) AS oh, len(items) + len(vals) > 0 AS concrete FROM q JOIN t ON t.sample_id = q.sample_id),
  f AS (SELECT *, CASE WHEN family IS NULL THEN 0 ELSE round(least(1, least(0.48::DOUBLE, fh / len(fam) * 1.10::DOUBLE) + least(0.30::DOUBLE, qh * 0.08::DOUBLE) + least(0.30::DOUBLE, oh * 0.12::DOUBLE) + CASE WHEN concrete AND (fh > 0 OR oh > 0) THEN 0.10::DOUBLE ELSE 0 END), 9) END AS fs,
    CASE WHEN family IS NOT NULL AND fh = 0 AND qh = 0 AND oh = 0 THEN CASE WHEN concrete THEN 0.12::DOUBLE ELSE 0.25::DOUBLE END ELSE 0 END AS mm FROM p),
  ev AS (SELECT trajectory_id, {_KEYS.format('text')} AS terms, regexp_matches(lower(text), 'days ago|yesterday') AS tmp FROM fx_note_claims WHERE regexp_matches(lower(text), '\\b(went|met)\\b')),
  es AS (SELECT f.query_id, f.trajectory_id, max(least(1, 0.70::DOUBLE + 0.10::DOUBLE * o + 0.10::DOUBLE * a + CASE WHEN tmp THEN 0.05::DOUBLE ELSE 0 END)) AS s FROM (SELECT f.query_id, f.trajectory_id, ev.tmp, len(list_intersect(list_filter(f.terms, lambda w: NOT list_contains({_ACTS}, w)), ev.terms)) AS o, len(list_intersect(list_intersect(f.terms, {_ACTS}), ev.terms)) AS a, f.temporal OR len(list_intersect(f.terms, {_ACTS})) > 0 AS about FROM f JOIN ev ON ev.trajectory_id = f.trajectory_id) f WHERE o > 0 AND about GROUP BY ALL),
  g AS (SELECT f.*, round(coalesce(es.s, 0), 9) AS es FROM f LEFT JOIN es ON es.query_id = f.query_id AND es.trajectory_id = f.trajectory_id)"""
_MET = "coalesce(list_has_any({0}, {1}), FALSE)"
_OVER = f"over_ AS (SELECT query_id, trajectory_id, round({_JAC.format('asked', 'have')} + CASE WHEN {_MET.format('entities', 'names')} THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN {_MET.format('terms', 'vals')} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN listing AND len(items) > 0 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN counting AND regexp_matches(text, '[0-9]') THEN 0.10::DOUBLE ELSE 0 END + 0.80::DOUBLE * fs - 0.30::DOUBLE * mm, 9) AS score FROM (SELECT *, CASE WHEN family IS NULL THEN terms ELSE list_distinct(list_append(terms, family)) END AS asked FROM g)), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, trajectory_id DESC) AS rank FROM over_)"
_FUSE = "SELECT query_id, id, dense, sparse, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense DESC, sparse DESC, id DESC) AS rank FROM (SELECT *, 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id DESC)) + 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, id DESC)) AS fused FROM {0})"


def claims(v):
    return v.table("fx_note_claims")


def asked(v):
    return v.once("questions", lambda: S.question_profiles(v("fx_asks")))


def signals(v):
    return v.once("trajectory_signals", lambda: S.trajectory_signals(claims(v)))


def matched(v):
    return S.with_event(S.with_family(S.pairs(asked(v), signals(v))))


def ranked(v):
    return S.overlap_rank(matched(v))


_SHOW = "array_to_string(list_sort({0}), ' ')"


@query("f31_retrieval_signals", f"WITH {_T} SELECT trajectory_id, {_SHOW.format('have')} AS terms, {_SHOW.format('names')} AS names, {_SHOW.format('vals')} AS vals, {_SHOW.format('items')} AS items, (SELECT count(*) FROM fx_note_claims c WHERE c.trajectory_id = t.trajectory_id AND regexp_matches(lower(c.text), '\\b(went|met)\\b')) AS events, latest FROM t")
def _(v):
    show = lambda c: M.shown(F.array_sort(c))
    return signals(v).select("trajectory_id", show("have").alias("terms"), show("names").alias("names"), show("values").alias("vals"), show("items").alias("items"), F.size("events").cast("long").alias("events"), "latest")


query("f3_family_match_profile", f"WITH {_P} SELECT query_id, trajectory_id, fs::DOUBLE AS family_score, mm::DOUBLE AS mismatch FROM f")(lambda v: matched(v).select("query_id", "trajectory_id", "family_score", "mismatch"))
query("f4_source_event_match", f"WITH {_P} SELECT query_id, trajectory_id, es::DOUBLE AS event_score FROM g WHERE es > 0")(lambda v: matched(v).where("event_score > 0").select("query_id", "trajectory_id", "event_score"))
query("f8_metadata_overlap_rank", f"WITH {_P}, {_OVER} SELECT query_id, trajectory_id, score::DOUBLE AS score, rank FROM ranked")(lambda v: ranked(v).select("query_id", "trajectory_id", "score", "rank"))
_F5 = f"d AS (SELECT query_id, trajectory_id AS id, round(greatest(0, 0.75::DOUBLE * {_COS.format('question', 'text')} + 0.15::DOUBLE * {_COS.format('question', 'latest')} + 0.10::DOUBLE * least(1, (CASE WHEN {_MET.format('entities', 'names')} THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN {_MET.format('terms', 'vals')} THEN 0.05::DOUBLE ELSE 0 END) / 0.20::DOUBLE) + 0.08::DOUBLE * fs + 0.10::DOUBLE * es - 0.04::DOUBLE * soft), 6) AS dense, round(greatest(0, {_JAC.format('terms', 'have')} + 0.60::DOUBLE * fs + 0.75::DOUBLE * es - 0.25::DOUBLE * soft), 6) AS sparse FROM (SELECT *, CASE WHEN es >= 0.70 THEN least(mm, 0.05::DOUBLE) ELSE mm END AS soft FROM g))"
query("f5_trajectory_score", f"WITH {_P}, {_F5} SELECT query_id, id AS trajectory_id, dense, sparse, rank FROM ({_FUSE.format('d')})")(lambda v: S.trajectory_scores(matched(v)))


def pages(v):
    n = claims(v).withColumn("page_type", F.explode(F.array(F.lit("index"), F.lit("topic"))))
    n = n.withColumn("page_id", F.when(F.col("page_type") == "index", F.col("sample_id") * 10).otherwise(F.col("sample_id") * 10 + 1 + F.col("trajectory_id") % 3))
    return n.groupBy("sample_id", "page_id", "page_type").agg(F.array_join(M.ordered(F.col("text"), "claim_id"), " ").alias("text"), F.countDistinct("trajectory_id").alias("width"))


_PAGES = "pg AS (SELECT sample_id, sample_id * 10 + 1 + trajectory_id % 3 AS page_id, string_agg(text, ' ' ORDER BY claim_id) AS text, count(DISTINCT trajectory_id) AS width FROM fx_note_claims GROUP BY 1, 2)"
query("f2_page_score", f"""WITH {_Q}, {_PAGES}, p AS (SELECT q.*, pg.page_id, pg.text, pg.width, {_KEYS.format('pg.text')} AS have, {_NAMES.format('pg.text')} AS names FROM q JOIN pg ON pg.sample_id = q.sample_id),
  h AS (SELECT *, len(list_intersect(fam, have)) AS fh, len(list_intersect(terms, have)) AS qh, len(list_intersect(list_filter(terms, lambda w: NOT list_contains(entities, w)), have)) AS oh FROM p),
  f AS (SELECT *, CASE WHEN family IS NULL THEN 0 ELSE round(least(1, least(0.48::DOUBLE, fh / len(fam) * 1.10::DOUBLE) + least(0.30::DOUBLE, qh * 0.08::DOUBLE) + least(0.30::DOUBLE, oh * 0.12::DOUBLE)), 9) END AS fs, CASE WHEN family IS NOT NULL AND fh = 0 AND qh = 0 AND oh = 0 THEN 0.25::DOUBLE ELSE 0 END AS mm FROM h),
  d AS (SELECT query_id, page_id AS id, round({_COS.format('question', 'text')} + CASE WHEN {_MET.format('entities', 'names')} THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN width <= 6 THEN 0.05::DOUBLE ELSE 0 END + 0.08::DOUBLE * fs, 6) AS dense, round(greatest(0, {_JAC.format('terms', 'have')} + 0.60::DOUBLE * fs - 0.25::DOUBLE * mm), 6) AS sparse FROM f)
  SELECT query_id, id AS page_id, dense, sparse, rank FROM ({_FUSE.format('d')})""")(lambda v: S.page_scores(asked(v), pages(v)))


def members(v):
    """Which topic pages list which trajectories."""
    return claims(v).select("trajectory_id", (F.col("sample_id") * 10 + 1 + F.col("trajectory_id") % 3).alias("page_id")).distinct()


def index_table(v, name):
    """One table of the index that retrieval reads, written once."""
    return v.once(f"index_{name}", lambda: T.build_index(claims(v), pages(v), members(v), v("fx_claim_edges"), v("fx_note_sources"), notes(v), 4)[name])


def index_tables(v):
    return {name: index_table(v, name) for name in ("trajectories", "pages", "members", "snapshots", "linked", "sources", "messages")}


def chosen(v):
    """The best page of each question."""
    return v.once("chosen_pages", lambda: T.ranked_pages(asked(v), index_table(v, "pages"), BROAD).where("rank = 1"))


def routed(v):
    return chosen(v).join(members(v), "page_id").select("query_id", "trajectory_id", (F.col("width") > BROAD).alias("broad"))


#: In these queries a question takes one page, a page is broad beyond three trajectories, and broad pages give two: so that each
#: of the ways to a candidate is taken.
BROAD = 3
_CHOSEN = f"""{_PAGES}, pp AS (SELECT q.*, pg.page_id, pg.width, {_KEYS.format('pg.text')} AS have, {_NAMES.format('pg.text')} AS names, pg.text AS page FROM q JOIN pg ON pg.sample_id = q.sample_id),
  ph AS (SELECT *, len(list_intersect(fam, have)) AS fh, len(list_intersect(terms, have)) AS qh, len(list_intersect(list_filter(terms, lambda w: NOT list_contains(entities, w)), have)) AS oh FROM pp),
  pf AS (SELECT *, CASE WHEN family IS NULL THEN 0 ELSE round(least(1, least(0.48::DOUBLE, fh / len(fam) * 1.10::DOUBLE) + least(0.30::DOUBLE, qh * 0.08::DOUBLE) + least(0.30::DOUBLE, oh * 0.12::DOUBLE)), 9) END AS fs, CASE WHEN family IS NOT NULL AND fh = 0 AND qh = 0 AND oh = 0 THEN 0.25::DOUBLE ELSE 0 END AS mm FROM ph),
  pd AS (SELECT query_id, page_id AS id, round({_COS.format('question', 'page')} + CASE WHEN {_MET.format('entities', 'names')} THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN width <= {BROAD} THEN 0.05::DOUBLE ELSE 0 END + 0.08::DOUBLE * fs, 6) AS dense, round(greatest(0, {_JAC.format('terms', 'have')} + 0.60::DOUBLE * fs - 0.25::DOUBLE * mm), 6) AS sparse FROM pf),
  sel AS (SELECT query_id, id AS page_id, rank FROM ({_FUSE.format('pd')}) WHERE rank = 1), mem AS (SELECT DISTINCT trajectory_id, sample_id * 10 + 1 + trajectory_id % 3 AS page_id FROM fx_note_claims),
  rt AS (SELECT s.query_id, m.trajectory_id, bool_and(pg.width > {BROAD}) AS broad FROM sel s JOIN mem m ON m.page_id = s.page_id JOIN pg ON pg.page_id = s.page_id GROUP BY 1, 2)"""
query("f9_index_fallback_expand", f"WITH {_P}, {_OVER}, {_CHOSEN}, n AS (SELECT query_id, count(*) AS n FROM rt GROUP BY 1), rest AS (SELECT r.query_id, r.trajectory_id, row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, r.trajectory_id DESC) AS k FROM ranked r LEFT JOIN n ON n.query_id = r.query_id ANTI JOIN rt ON rt.query_id = r.query_id AND rt.trajectory_id = r.trajectory_id WHERE score > 0 AND coalesce(n, 0) < 3) SELECT query_id, trajectory_id, 'page' AS origin FROM rt UNION ALL SELECT query_id, trajectory_id, 'index' FROM rest WHERE k <= 24")(
    lambda v: S.index_fallback(S.overlap_rank(S.with_family(S.pairs(S.with_few(asked(v), routed(v), 3), signals(v)))), routed(v), 3, 24)
)
query("f10_broad_entity_cap", f"WITH {_P}, {_OVER}, {_CHOSEN}, own AS (SELECT r.query_id, r.trajectory_id, r.score, rt.broad AS only_broad FROM ranked r JOIN rt ON rt.query_id = r.query_id AND rt.trajectory_id = r.trajectory_id) SELECT query_id, trajectory_id, only_broad FROM own QUALIFY NOT only_broad OR row_number() OVER (PARTITION BY query_id, only_broad ORDER BY score DESC, trajectory_id DESC) <= 2")(
    lambda v: S.broad_cap(ranked(v), routed(v), 2)
)


def _direct_questions(v):
    return asked(v).select("query_id", "sample_id", "terms", "entities", F.array().cast("array<string>").alias("facets"), "family", "counting", "listing")


_LOWER = "regexp_matches(lower(text), '{0}')"
query("f25_direct_trajectory_rank", f"""WITH {_P}, x AS (SELECT query_id, trajectory_id, len(list_intersect(terms, have)) AS common, len(terms) AS n, coalesce(list_sum(list_transform(entities, lambda e: CASE WHEN list_contains(have, e) THEN 3.0::DOUBLE WHEN contains(lower(text), e) THEN 1.5 ELSE 0 END)), 0) AS ent, (CASE WHEN list_contains(have, family) THEN 1.5 ELSE 0 END + CASE WHEN listing AND {_LOWER.format('items|list|visited|participated|bought|read')} THEN 0.5 ELSE 0 END)::DOUBLE AS fam_s,
  CASE WHEN counting AND {_LOWER.format('(^|[^a-z0-9])(count|number|times?|once|twice|[0-9]+)([^a-z0-9]|$)')} THEN 0.75 ELSE 0 END::DOUBLE AS cnt, len(list_intersect(terms, list_concat(items, vals))) AS own FROM p),
  y AS (SELECT query_id, trajectory_id, round(common + coalesce(2.0::DOUBLE * common / nullif(n, 0), 0) + ent + fam_s + cnt + coalesce(1.25::DOUBLE * own / nullif(n, 0), 0) - CASE WHEN common > 0 AND own = 0 AND ent = 0 THEN 0.25 ELSE 0 END, 9) AS score FROM x)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, trajectory_id) AS rank FROM y""")(
    lambda v: R.direct_rank(_direct_questions(v), signals(v).withColumn("specific", F.array_union("items", "values")))
)


def seeds(v, among=None):
    """The latest snapshot of each query's two best trajectories, of those ``among`` which it may choose, with their place."""
    x = matched(v) if among is None else matched(v).join(among, ["query_id", "trajectory_id"], "left_semi")
    best = (S.trajectory_scores(x) if among is not None else v.once("trajectory_scores", lambda: S.trajectory_scores(x))).where("rank <= 2")
    return best.join(signals(v).select("trajectory_id", F.col("latest_snapshot_id").alias("snapshot_id")), "trajectory_id").select("query_id", "trajectory_id", "snapshot_id", F.col("rank").alias("place"))


_SEEDS = f"{_P}, {_F5}, best AS (SELECT query_id, id AS trajectory_id, rank AS place FROM ({_FUSE.format('d')}) WHERE rank <= 2), seeds AS (SELECT b.*, (SELECT arg_max(c.snapshot_id, c.version) FROM fx_note_claims c WHERE c.trajectory_id = b.trajectory_id) AS snapshot_id FROM best b)"
_LINKED = f"""{_SEEDS}, ed AS (SELECT trajectory_id, claim_id AS a, other_id AS b FROM fx_claim_edges UNION SELECT trajectory_id, other_id, claim_id FROM fx_claim_edges),
  reach(query_id, trajectory_id, claim_id, n) AS (SELECT s.query_id, s.trajectory_id, c.claim_id, 0 FROM seeds s JOIN fx_note_claims c ON c.snapshot_id = s.snapshot_id UNION SELECT r.query_id, r.trajectory_id, ed.b, n + 1 FROM reach r JOIN ed ON ed.trajectory_id = r.trajectory_id AND ed.a = r.claim_id WHERE n < 4),
  linked AS (SELECT DISTINCT r.query_id, r.trajectory_id, c.snapshot_id FROM reach r JOIN fx_note_claims c ON c.claim_id = r.claim_id ANTI JOIN seeds s ON s.query_id = r.query_id AND s.snapshot_id = c.snapshot_id)"""


def linked(v, among=None):
    return S.update_linked(seeds(v, among), claims(v), v("fx_claim_edges"), 4)


query("f14_expand_update_linked", f"WITH RECURSIVE {_LINKED} SELECT query_id, trajectory_id, snapshot_id FROM linked")(linked)


def expanded(v, among=None):
    """Seeds, update-linked snapshots and neighbours within one version, each with its kind and score."""
    return v.once("expanded", lambda: _expanded(v)) if among is None else _expanded(v, among)


def _expanded(v, among=None):
    s, n = seeds(v, among), claims(v)
    own = n.select("trajectory_id", "snapshot_id", "version")
    near = s.join(own.select("trajectory_id", "snapshot_id", F.col("version").alias("at")), ["trajectory_id", "snapshot_id"]).select("query_id", "trajectory_id", "at")
    near = near.join(own, "trajectory_id").where("abs(version - at) <= 1").select("query_id", "trajectory_id", "snapshot_id")
    kinds = {0: s, 1: linked(v, among), 2: near}
    rows = [df.select("query_id", "trajectory_id", "snapshot_id", F.lit(k).alias("k"), (F.col("place") if k == 0 else F.lit(0)).cast("long").alias("place")) for k, df in kinds.items()]
    one = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("query_id", "trajectory_id", "snapshot_id").agg(F.min("k").alias("k"), F.max("place").alias("place"))
    x = one.join(n.select("snapshot_id", "version", "text", hash_embedding(F.col("text")).alias("text_vector")), "snapshot_id").join(asked(v), "query_id")
    x = x.withColumns({"names": S.names_in(F.col("text")), "values": F.regexp_extract_all("text", F.lit("favorite color is ([a-z]+)"), F.lit(1))})
    kind = F.when(F.col("k") == 0, "seed").when(F.col("k") == 1, "update_linked").otherwise("neighbor")
    return S.snapshot_scores(x).join(one.select("query_id", "snapshot_id", kind.alias("kind"), "place"), ["query_id", "snapshot_id"]).join(asked(v).select("query_id", "listing"), "query_id")


_SCORED = f"""{_LINKED}, near AS (SELECT DISTINCT s.query_id, s.trajectory_id, b.snapshot_id FROM seeds s JOIN fx_note_claims a ON a.snapshot_id = s.snapshot_id JOIN fx_note_claims b ON b.trajectory_id = a.trajectory_id AND abs(a.version - b.version) <= 1),
  al AS (SELECT query_id, trajectory_id, snapshot_id, 0 AS k, place FROM seeds UNION ALL SELECT query_id, trajectory_id, snapshot_id, 1, 0 FROM linked UNION ALL SELECT query_id, trajectory_id, snapshot_id, 2, 0 FROM near),
  one AS (SELECT query_id, trajectory_id, snapshot_id, min(k) AS k, max(place) AS place FROM al GROUP BY ALL),
  sc AS (SELECT o.*, c.version, q.listing, round(0.75::DOUBLE * {_COS.format('question', 'c.text')} + 0.15::DOUBLE * {_JAC.format('terms', f"({_KEYS.format('c.text')})")} + 0.10::DOUBLE * least(1, least(0.10::DOUBLE, CASE WHEN {_MET.format('entities', f"({_NAMES.format('c.text')})")} THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN {_MET.format('terms', "regexp_extract_all(c.text, 'favorite color is ([a-z]+)', 1)")} THEN 0.05::DOUBLE ELSE 0 END) / 0.10::DOUBLE), 6) AS score FROM one o JOIN fx_note_claims c ON c.snapshot_id = o.snapshot_id JOIN q ON q.query_id = o.query_id)"""
query("f15_snapshot_score", f"WITH RECURSIVE {_SCORED} SELECT query_id, snapshot_id, score FROM sc")(lambda v: expanded(v).select("query_id", "snapshot_id", "score"))
_COMPACT = f"""{_SCORED}, ti AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = 1 AND row_number() OVER (PARTITION BY query_id, trajectory_id, k ORDER BY score DESC, version, snapshot_id DESC) = 1 THEN 1 WHEN k = 1 THEN 2 ELSE 3 END AS tier, count(*) FILTER (k = 0) OVER (PARTITION BY query_id) AS ns FROM sc),
  co AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, place, score DESC, version, snapshot_id DESC) AS o, greatest(ns, CASE WHEN listing THEN least(greatest(ns + 8, 12), 18) ELSE least(greatest(ns + 6, 10), 14) END) AS budget FROM ti)"""
query("f16_compact_snapshots", f"WITH RECURSIVE {_COMPACT} SELECT query_id, snapshot_id, tier, o AS place, o <= budget AS kept FROM co")(lambda v: S.compact_snapshots(expanded(v)).select("query_id", "snapshot_id", "tier", F.col("order").alias("place"), "kept"))
query("f17_compact_sources", f"""WITH RECURSIVE {_COMPACT}, so AS (SELECT c.query_id, c.trajectory_id, c.version, c.snapshot_id, c.listing, c.k AS grp, s.message_id, s.position FROM co c JOIN fx_note_sources s ON s.snapshot_id = c.snapshot_id WHERE o <= budget),
  u AS (SELECT *, row_number() OVER (PARTITION BY query_id, message_id ORDER BY grp, trajectory_id, version, snapshot_id, position) AS first FROM so), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, snapshot_id ORDER BY position, message_id) AS nth FROM u WHERE first = 1),
  m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, trajectory_id, version, snapshot_id, position) AS place FROM n WHERE grp = 0 OR (grp = 1 AND nth <= 2) OR nth <= 1)
  SELECT query_id, message_id, grp AS "group", row_number() OVER (PARTITION BY query_id ORDER BY grp, message_id) AS rank FROM m WHERE grp = 0 OR place <= CASE WHEN listing THEN 40 ELSE 28 END""")(
    lambda v: S.compact_sources(S.compact_snapshots(expanded(v)), v("fx_note_sources"))
)


def notes(v):
    return v("fx_notes").select("sample_id", "message_id", F.col("phrase").alias("content"), F.col("message_id").alias("turn_index"), F.when(F.col("message_id") % 3 == 0, "system").otherwise("user").alias("role"))


_LEX = f"{_JAC.format('terms', '(' + _KEYS.format('content') + ')')} + least(1, len(list_filter(terms, lambda w: contains(lower(content), w))) / 4)"
query("f19_raw_rescue", f"""WITH {_Q}, n AS (SELECT sample_id, message_id, phrase AS content, CASE WHEN message_id % 3 = 0 THEN 'system' ELSE 'user' END AS role FROM fx_notes), x AS (SELECT q.query_id, q.question, q.listing, n.*, {_LEX} AS lexical FROM q JOIN n ON n.sample_id = q.sample_id),
  y AS (SELECT *, max((role <> 'system')::INT) OVER (PARTITION BY query_id) AS plain FROM x WHERE lexical > 0), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, message_id) AS k FROM y WHERE role <> 'system' OR plain = 0),
  s AS (SELECT *, round(0.65::DOUBLE * {_COS.format('question', 'content')} + 0.35::DOUBLE * lexical, 6) AS score FROM z WHERE k <= 80) SELECT query_id, message_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, message_id) AS rank FROM s QUALIFY rank <= CASE WHEN listing THEN 12 ELSE 8 END""")(
    lambda v: S.raw_rescue(asked(v), notes(v))
)


def evidence(v):
    s = seeds(v).join(claims(v).where("status <> 'deprecated'").select("snapshot_id", "claim_id", "text"), "snapshot_id", "left")
    return s.groupBy("query_id").agg(F.array_join(M.ordered(F.col("text"), "place"), " ").alias("texts"), F.count("text").alias("sources"), F.countDistinct("trajectory_id").alias("trajectories"), F.count("snapshot_id").alias("snapshots"), F.count("claim_id").alias("claims"))


query("f20_evidence_weak", f"WITH {_SEEDS}, e AS (SELECT s.query_id, string_agg(c.text, ' ' ORDER BY place) AS texts, count(c.claim_id) AS claims FROM seeds s LEFT JOIN fx_note_claims c ON c.snapshot_id = s.snapshot_id AND c.status <> 'deprecated' GROUP BY 1), n AS (SELECT q.query_id, coalesce(claims, 0) AS claims, list_distinct(list_concat(terms, entities)) AS need, lower(coalesce(texts, '')) AS hay FROM q LEFT JOIN e ON e.query_id = q.query_id), c AS (SELECT *, len(list_filter(need, lambda w: contains(hay, w))) / nullif(len(need), 0) AS share FROM n) SELECT query_id, claims = 0 AS weak, round(share, 9) AS coverage, coalesce(share < 0.34, FALSE) AS semantic_weak FROM c")(
    lambda v: S.evidence_state(asked(v), evidence(v))
)
_HYBRID = f"WITH b AS (SELECT query_id, question, message_id, turn_index, content, len(list_intersect({_KEYS.format('question')}, {_KEYS.format('content')})) AS hit, len({_KEYS.format('question')}) AS n FROM (SELECT q.query_id, q.question, h.message_id, h.turn_index, h.content FROM fx_queries q JOIN fx_history h ON h.sample_id = q.sample_id)), x AS (SELECT query_id, message_id, turn_index, round(hit + coalesce(hit / nullif(n, 0), 0), 9)::DOUBLE AS lexical, round({_COS.format('question', 'content')}, 6) AS dense FROM b)"
query("f22_hybrid_message_rank", f"{_HYBRID}, y AS (SELECT *, round(1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, turn_index)) + 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, message_id)), 12) AS fused FROM x) SELECT query_id, message_id, lexical, dense, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense DESC, lexical DESC, message_id) AS rank FROM y")(
    lambda v: S.hybrid_messages(v("fx_queries"), v("fx_history").select("sample_id", "message_id", "turn_index", "content"))
)


@query("f1_rrf_fuse", f"{_HYBRID}, d AS (SELECT query_id, message_id AS id, dense, lexical AS sparse FROM x) SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense DESC, sparse DESC, id DESC) AS rank FROM (SELECT *, 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id DESC)) + 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, id DESC)) AS fused FROM d)")
def _(v):
    x = v("fx_queries").withColumn("qv", hash_embedding(F.col("question"))).join(v("fx_history").select("sample_id", "message_id", hash_embedding(F.col("content")).alias("mv")), "sample_id")
    x = x.withColumn("dense", F.round(unit_cosine(F.col("qv"), F.col("mv")), 6))
    lexical = R.flat_lexical_rank(v("fx_queries"), v("fx_history")).select("query_id", "message_id", F.when(F.col("score") > 0.001, F.round("score", 9)).otherwise(0.0).alias("sparse"))
    return R.rrf_fuse(x.join(lexical, ["query_id", "message_id"]).select("query_id", F.col("message_id").alias("id"), "dense", "sparse"))


# the greedy loop has no SQL form; tests hold it against a plain loop
query("f7_coverage_greedy", None)(lambda v: S.coverage_greedy(S.trajectory_scores(matched(v)).join(signals(v).select("trajectory_id", "names", "values", "items", "have"), "trajectory_id"), 3))


_CANDIDATES = f"""{_P}, {_OVER}, {_CHOSEN}, ct AS (SELECT query_id, count(*) FILTER (NOT broad) + least(count(*) FILTER (broad), 2) AS n FROM rt GROUP BY 1),
  ca AS (SELECT o.query_id, o.trajectory_id, o.score, CASE WHEN broad IS NULL THEN 'index' WHEN broad THEN 'broad' ELSE 'page' END AS origin FROM over_ o LEFT JOIN rt ON rt.query_id = o.query_id AND rt.trajectory_id = o.trajectory_id LEFT JOIN ct ON ct.query_id = o.query_id WHERE broad IS NOT NULL OR coalesce(n, 0) < 3),
  cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, origin ORDER BY score DESC, trajectory_id DESC) AS k FROM ca) WHERE k <= CASE origin WHEN 'page' THEN 1000000000 WHEN 'broad' THEN 2 ELSE 24 END AND (origin <> 'index' OR score > 0)),
  {_F5}, dc AS (SELECT d.* FROM d JOIN cb ON cb.query_id = d.query_id AND cb.trajectory_id = d.id), rk AS ({_FUSE.format('dc')}), best AS (SELECT query_id, id AS trajectory_id, rank AS place FROM rk WHERE rank <= 2),
  seeds AS (SELECT b.*, (SELECT arg_max(c.snapshot_id, c.version) FROM fx_note_claims c WHERE c.trajectory_id = b.trajectory_id) AS snapshot_id FROM best b)"""
_EVENTS = f"""{_CANDIDATES}{_COMPACT[len(_SEEDS):]}, so AS (SELECT c.query_id, c.trajectory_id, c.version, c.snapshot_id, c.listing, c.k AS grp, s.message_id, s.position FROM co c JOIN fx_note_sources s ON s.snapshot_id = c.snapshot_id WHERE o <= budget),
  u1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, message_id ORDER BY grp, trajectory_id, version, snapshot_id, position) AS first FROM so), u2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, snapshot_id ORDER BY position, message_id) AS nth FROM u1 WHERE first = 1),
  u3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, trajectory_id, version, snapshot_id, position) AS place FROM u2 WHERE grp = 0 OR (grp = 1 AND nth <= 2) OR nth <= 1),
  src AS (SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY grp, message_id) AS rank FROM u3 WHERE grp = 0 OR place <= CASE WHEN listing THEN 40 ELSE 28 END),
  ev1 AS (SELECT s.query_id, string_agg(c.text, ' ' ORDER BY place) AS texts, count(c.claim_id) AS claims FROM seeds s LEFT JOIN fx_note_claims c ON c.snapshot_id = s.snapshot_id AND c.status <> 'deprecated' GROUP BY 1),
  ev2 AS (SELECT q.query_id, coalesce(claims, 0) AS claims, list_distinct(list_concat(terms, entities)) AS need, lower(coalesce(texts, '')) AS hay FROM q LEFT JOIN ev1 ON ev1.query_id = q.query_id),
  wk AS (SELECT query_id, claims = 0 OR coalesce(len(list_filter(need, lambda w: contains(hay, w))) / nullif(len(need), 0) < 0.34, FALSE) AS weak FROM ev2),
  nt AS (SELECT sample_id, message_id, phrase AS content, CASE WHEN message_id % 3 = 0 THEN 'system' ELSE 'user' END AS role FROM fx_notes), r1 AS (SELECT q.query_id, q.question, q.listing, nt.*, {_LEX} AS lexical FROM q JOIN wk ON wk.query_id = q.query_id AND weak JOIN nt ON nt.sample_id = q.sample_id),
  r2 AS (SELECT *, max((role <> 'system')::INT) OVER (PARTITION BY query_id) AS plain FROM r1 WHERE lexical > 0), r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, message_id) AS k FROM r2 WHERE role <> 'system' OR plain = 0),
  r4 AS (SELECT *, round(0.65::DOUBLE * {_COS.format('question', 'content')} + 0.35::DOUBLE * lexical, 6) AS score FROM r3 WHERE k <= 80), res AS (SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, message_id) AS rank FROM r4 QUALIFY rank <= CASE WHEN listing THEN 12 ELSE 8 END)"""
_JOINED = "coalesce((SELECT string_agg({0}, ' ' ORDER BY {1}) FROM {2} z WHERE z.query_id = q.query_id{3}), '') AS {4}"
_EVENT_LISTS = ", ".join(_JOINED.format(*x) for x in (("page_id", "rank", "sel", "", "page_ids"), ("id", "id", "rk", "", "candidate_ids"), ("trajectory_id", "place", "best", "", "trajectory_ids"), ("snapshot_id", "o", "co", " AND o <= budget", "expanded_ids"), ("message_id", "rank", "src", "", "source_ids"), ("message_id", "rank", "res", "", "rescued_ids")))
EVENT_LISTS = ["page_ids", "candidate_ids", "trajectory_ids", "expanded_ids", "source_ids", "rescued_ids"]


def retrieved(v):
    """The events of all questions."""
    return v.once("retrieved", lambda: T.retrieve(asked(v), index_tables(v), T.Settings(pages=1, broad=BROAD, broad_most=2), lambda name, df: v.once(f"retrieve_{name}", lambda: df)))


query("f30_retrieve", f"WITH RECURSIVE {_EVENTS} SELECT q.sample_id, q.query_id, {_EVENT_LISTS}, wk.weak FROM q JOIN wk ON wk.query_id = q.query_id")(
    lambda v: retrieved(v).select("sample_id", "query_id", *(M.shown(c).alias(c) for c in EVENT_LISTS), "weak")
)


def contexts(v, policies=None):
    """Contexts of all policies, or of some."""
    p = C.policy_table(v.spark, policies)
    return C.variant_contexts(asked(v), index_tables(v), claims(v), pages(v), p, T.Settings(pages=1, broad=BROAD, broad_most=2), (lambda name, df: v.once(f"f28_{name}", lambda: df)) if policies is None else (lambda name, df: df))


query("f28_variant_contexts", None)(contexts)
