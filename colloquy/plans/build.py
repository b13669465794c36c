"""Queries of memory building and pages, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import keywords
from ..operators import audit as A
from ..operators import build as B
from ..operators import memory as M
from ..operators import pages as G
from ..operators import scoring as S
from .registry import _KEYS, _NORM, query
from .scoring import _NAMES, signals

_CAND = r"""x AS (SELECT sample_id, message_id, phrase, nullif(regexp_extract(lower(phrase), '\b(\d+ (?:day|week|month|year)s? ago|yesterday|today|last (?:week|month|year))\b', 1), '') AS temporal FROM fx_notes),
  s AS (SELECT sample_id, message_id, temporal, 'activity' AS category, 'went_to' AS relation, unnest(regexp_extract_all(phrase, 'went to (?:a |an |the )?([a-z]+(?: [a-z]+)?)', 1)) AS surface FROM x
    UNION ALL SELECT sample_id, message_id, temporal, 'list', 'enjoys', unnest(string_split(replace(regexp_extract(phrase, 'enjoy ([a-z, ]+)', 1), ' and ', ', '), ', ')) FROM x
    UNION ALL SELECT sample_id, message_id, temporal, 'preference', 'favorite', unnest(regexp_extract_all(phrase, 'favorite [a-z]+ is ([a-z]+)', 1)) FROM x
    UNION ALL SELECT sample_id, message_id, temporal, 'count', 'number', unnest(regexp_extract_all(phrase, '\b(\d+ [a-z]+)\b', 1)) FROM x
    UNION ALL SELECT sample_id, message_id, temporal, 'event', 'met', lower(unnest(regexp_extract_all(phrase, '\bmet ([A-Z][a-z]+)', 1))) FROM x),
  ca AS (SELECT sample_id, category, relation, surface, min(temporal) AS temporal, list_sort(list(DISTINCT message_id)) AS ids FROM s WHERE surface <> '' GROUP BY ALL)"""


def wanted(v):
    return v.once("candidates", lambda: B.candidates(v.table("fx_notes").select("sample_id", "message_id", F.col("phrase").alias("text"))))


def claims(v):
    return v.table("fx_note_claims")


_IDS = "array_to_string(ids, ' ')"
query("c19_must_preserve_candidates", f"WITH {_CAND} SELECT sample_id, category, relation, surface, temporal, {_IDS} AS messages FROM ca")(lambda v: wanted(v).withColumn("messages", M.shown("message_ids")).drop("message_ids"))
_PAD = "contains(' ' || {0} || ' ', ' ' || {1} || ' ')"
query("d8_audit_claim_preservation", f"""WITH {_CAND}, h AS (SELECT ca.sample_id, ca.category, ca.relation, ca.surface, len(ids) AS sources, ids, list(DISTINCT c.source_message_id) FILTER ({_PAD.format(_NORM.format('c.text'), _NORM.format('ca.surface'))} AND (temporal IS NULL OR {_PAD.format(_NORM.format('c.text'), 'temporal')})) AS found FROM ca LEFT JOIN fx_note_claims c ON c.sample_id = ca.sample_id GROUP BY ca.sample_id, ca.category, ca.relation, ca.surface, ids)
  SELECT sample_id, category, relation, surface, sources, CASE WHEN found IS NULL THEN 'missing' WHEN len(list_filter(ids, lambda i: NOT list_contains(found, i))) > 0 THEN 'weak' ELSE 'covered' END AS state FROM h""")(lambda v: B.preservation(wanted(v), claims(v)))
query("d9_merge_source_surfaces", f"WITH {_CAND}, u AS (SELECT sample_id, surface, unnest(ids) AS m FROM ca) SELECT claim_id, coalesce(string_agg(DISTINCT surface, '|' ORDER BY surface), '') AS surfaces FROM fx_note_claims c LEFT JOIN u ON u.sample_id = c.sample_id AND u.m = c.source_message_id GROUP BY claim_id")(
    lambda v: B.merged_surfaces(wanted(v), claims(v)).select("claim_id", F.array_join("surfaces", "|").alias("surfaces"))
)
query("d10_assign_claim_facets", f"""WITH {_CAND}, u AS (SELECT sample_id, category, surface, unnest(ids) AS m FROM ca), j AS (SELECT u.sample_id, u.category, u.surface, c.claim_id, c.status, 2 * {_PAD.format(_NORM.format('c.text'), _NORM.format('u.surface'))}::INT + (c.status = 'active')::INT AS s FROM u JOIN fx_note_claims c ON c.sample_id = u.sample_id AND c.source_message_id = u.m),
  b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, category, surface ORDER BY s DESC, claim_id) AS r FROM j) SELECT b.sample_id, b.category, b.surface, b.claim_id, (SELECT count(DISTINCT j.claim_id) FROM j WHERE j.sample_id = b.sample_id AND j.category = b.category AND j.surface = b.surface AND j.status = 'active' AND j.claim_id <> b.claim_id) AS copied FROM b WHERE r = 1""")(lambda v: B.facet_owners(claims(v), wanted(v)))
query("d16_fallback_claims", f"WITH {_CAND}, g AS (SELECT sample_id, surface, min(category) AS category, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM ca GROUP BY ALL) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY surface) AS claim_no, surface, category, 'active' AS status, {_IDS} AS messages FROM g")(
    lambda v: B.fallback_claims(wanted(v)).withColumn("messages", M.shown("message_ids")).drop("message_ids")
)
query("d17_match_features", f"WITH {_CAND}, u AS (SELECT sample_id, surface, category, unnest(ids) AS m FROM ca) SELECT n.message_id, array_to_string(list_sort({_KEYS.format('n.phrase')}), ' ') AS terms, array_to_string(list_sort({_NAMES.format('n.phrase')}), ' ') AS names, coalesce(string_agg(DISTINCT surface, '|' ORDER BY surface), '') AS surfaces, coalesce(string_agg(DISTINCT category, '|' ORDER BY category), '') AS tags FROM fx_notes n LEFT JOIN u ON u.sample_id = n.sample_id AND u.m = n.message_id GROUP BY n.message_id, n.phrase")(
    lambda v: B.match_features(v.table("fx_notes").withColumnRenamed("phrase", "text"), wanted(v), S.names_in(F.col("text"))).select("message_id", M.shown("terms").alias("terms"), M.shown("names").alias("names"), F.coalesce(F.array_join("surfaces", "|"), F.lit("")).alias("surfaces"), F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"))
)


def changes(v):
    parts = iter("ab")
    return v.once("claim_changes", lambda: B.claim_changes(claims(v), stage=lambda df: v.once(f"claim_changes_{next(parts)}", lambda: df)))


_CHANGES = f"""n AS (SELECT trajectory_id, version, claim_id, status, {_NORM.format('text')} AS norm, {_KEYS.format('text')} AS k, row_number() OVER (PARTITION BY trajectory_id, version, {_NORM.format('text')} ORDER BY claim_id) AS nth FROM fx_note_claims),
  o AS (SELECT trajectory_id, version + 1 AS version, claim_id AS old_id, status AS old_status, norm, nth, k AS old_k FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.trajectory_id = n.trajectory_id AND m.version = n.version + 1)),
  e AS (SELECT coalesce(n.trajectory_id, o.trajectory_id) AS trajectory_id, coalesce(n.version, o.version) AS version, claim_id, old_id, status, old_status, n.k, o.old_k FROM n FULL JOIN o ON n.trajectory_id = o.trajectory_id AND n.version = o.version AND n.norm = o.norm AND n.nth = o.nth),
  p AS (SELECT f.trajectory_id, f.version, f.claim_id, g.old_id, len(list_intersect(f.k, g.old_k)) AS shared FROM e f JOIN e g ON f.trajectory_id = g.trajectory_id AND f.version = g.version WHERE f.old_id IS NULL AND g.claim_id IS NULL AND len(list_intersect(f.k, g.old_k)) >= 2),
  r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY shared DESC, old_id) = 1 AND row_number() OVER (PARTITION BY old_id ORDER BY shared DESC, claim_id) = 1),
  ch AS (SELECT trajectory_id, version, claim_id, old_id, CASE WHEN status = old_status THEN 'KEEP' WHEN status = 'deprecated' THEN 'DEPRECATE' ELSE 'REVISE' END AS op FROM e WHERE claim_id IS NOT NULL AND old_id IS NOT NULL UNION ALL SELECT trajectory_id, version, claim_id, old_id, 'REVISE' FROM r
    UNION ALL SELECT trajectory_id, version, claim_id, NULL, 'ADD' FROM e WHERE old_id IS NULL AND claim_id NOT IN (SELECT claim_id FROM r) UNION ALL SELECT trajectory_id, version, NULL, old_id, 'CARRY' FROM e WHERE claim_id IS NULL AND old_id NOT IN (SELECT old_id FROM r))"""
query("d2_claim_diff", f"WITH {_CHANGES} SELECT * FROM ch")(changes)
query("d15_claim_lifecycle", f"WITH {_CHANGES} SELECT c.sample_id, ch.trajectory_id, ch.version, ch.claim_id, op, old_id, c.source_message_id, substr(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), 1, 40) AS rationale FROM ch JOIN fx_note_claims c ON c.claim_id = ch.claim_id WHERE op IN ('ADD', 'REVISE', 'DEPRECATE')")(lambda v: B.lifecycle(changes(v), claims(v)))
_OPS = ", ".join(f"count(*) FILTER (op = '{k}') AS {k.lower()}" for k in ("ADD", "REVISE", "DEPRECATE", "KEEP", "CARRY"))
query("d18_op_counts", f"WITH {_CHANGES} SELECT t.sample_id, {_OPS} FROM (SELECT DISTINCT sample_id, trajectory_id FROM fx_note_claims) t LEFT JOIN ch ON ch.trajectory_id = t.trajectory_id GROUP BY t.sample_id")(lambda v: B.op_counts(changes(v), claims(v)))
query("d7_zero_claim_policy", "SELECT message_id AS snapshot_id, CASE WHEN phrase = 'Thanks, bye!' THEN 'none' WHEN regexp_matches(lower(phrase), '\\b(books?|read|reading|favorites?)\\b') THEN 'media_title_or_recommendation_fact' WHEN contains(phrase, 'hiking') THEN 'activity_or_practice_fact' ELSE 'none' END AS reason, reason <> 'none' AS kept FROM fx_phrases p ANTI JOIN fx_note_claims c ON c.snapshot_id = p.message_id")(
    lambda v: B.zero_claim_policy(v("fx_phrases").select(F.col("message_id").alias("snapshot_id"), F.col("phrase").alias("text")), claims(v))
)


def summary(v):
    return B.signal_summary(claims(v), A.grounding(claims(v)), wanted(v), S.names_in(F.col("text")))


_SUSPECT = "regexp_matches(lower(source_text), '\\b(my|our|mine|ours)\\b') AND len(list_filter(regexp_extract_all(text, '\\b([A-Z][a-z]+)''s\\b', 1), lambda n: lower(n) <> lower(speaker))) > 0"
_SUMMARY = f"""{_CAND}, u AS (SELECT sample_id, surface, category, unnest(ids) AS m FROM ca), good AS (SELECT * FROM fx_note_claims WHERE status = 'active' AND NOT ({_SUSPECT})), nm AS (SELECT trajectory_id, unnest({_NAMES.format('text')}) AS w FROM good),
  su AS (SELECT g.trajectory_id, count(DISTINCT g.claim_id) AS claims, coalesce((SELECT string_agg(DISTINCT w, '|' ORDER BY w) FROM nm WHERE nm.trajectory_id = g.trajectory_id), '') AS names, coalesce(string_agg(DISTINCT surface, '|' ORDER BY surface), '') AS surfaces, coalesce(string_agg(DISTINCT category, '|' ORDER BY category), '') AS tags FROM good g LEFT JOIN u ON u.sample_id = g.sample_id AND u.m = g.source_message_id GROUP BY g.trajectory_id)"""
query("d12_trajectory_signal_summary", f"WITH {_SUMMARY} SELECT * FROM su")(lambda v: summary(v).select("trajectory_id", "claims", *(F.array_join(c, "|").alias(c) for c in ("names", "surfaces", "tags"))))
TEMPLATE = ["who", "what", "kinds", "latest"]
_SUMTEXT = "'Who: ' || replace(names, '|', ', ') || chr(10) || 'What: ' || replace(surfaces, '|', ', ') || chr(10) || 'Kinds: ' || replace(tags, '|', ', ') || chr(10) || 'Latest: ' || latest"
query("d13_retrieval_summary", f"WITH {_SUMMARY}, l AS (SELECT trajectory_id, arg_max(text, version) AS latest FROM fx_note_claims GROUP BY 1), t AS (SELECT su.trajectory_id, {_SUMTEXT} AS text FROM su JOIN l ON l.trajectory_id = su.trajectory_id) SELECT trajectory_id, text, array_to_string(list_sort(list_filter({_KEYS.format('text')}, lambda w: w NOT IN ('who', 'what', 'kinds', 'latest'))), ' ') AS keywords FROM t")(
    lambda v: B.retrieval_summary(summary(v), signals(v).select("trajectory_id", "latest"), TEMPLATE)
)


def cards(v):
    return B.historical_cards(claims(v), wanted(v))


_CARDS = f"""{_CAND}, u AS (SELECT sample_id, surface, unnest(ids) AS m FROM ca), top AS (SELECT *, max(version) OVER (PARTITION BY trajectory_id) AS top FROM fx_note_claims), cu AS (SELECT t.sample_id, t.trajectory_id, t.version = top AS now, surface, source_message_id FROM top t JOIN u ON u.sample_id = t.sample_id AND u.m = t.source_message_id),
  dr AS (SELECT sample_id, trajectory_id, surface FROM cu GROUP BY ALL HAVING NOT bool_or(now))"""
query("d14_historical_evidence_card", f"WITH {_CARDS} SELECT cu.trajectory_id, string_agg(DISTINCT surface, '|' ORDER BY surface) AS surfaces, coalesce((SELECT string_agg(dr.surface, '|' ORDER BY dr.surface) FROM dr WHERE dr.trajectory_id = cu.trajectory_id), '') AS drifted, array_to_string(list_sort(list(DISTINCT source_message_id)), ' ') AS anchors FROM cu GROUP BY cu.trajectory_id")(
    lambda v: cards(v).select("trajectory_id", F.array_join("surfaces", "|").alias("surfaces"), F.array_join("drifted", "|").alias("drifted"), M.shown("anchors").alias("anchors"))
)


def incoming(v):
    text = F.col("phrase")
    return v.table("fx_notes").select("sample_id", "message_id", keywords(text).alias("terms"), S.names_in(text).alias("names"))


query("d5_build_trajectories", None)(lambda v: B.build_trajectories(incoming(v), 6))
query("d4_match_trajectory", f"""WITH o AS (SELECT sample_id, trajectory_id, {_KEYS.format("string_agg(phrase, ' ' ORDER BY version)")} AS words, {_KEYS.format("arg_max(phrase, version)")} AS latest FROM fx_notes WHERE version <= 3 GROUP BY ALL), i AS (SELECT sample_id, message_id, {_KEYS.format('phrase')} AS terms, {_NAMES.format('phrase')} AS names FROM fx_notes WHERE version = 4),
  x AS (SELECT i.message_id, o.trajectory_id, round(0.6::DOUBLE * len(list_intersect(terms, words)) / len(list_distinct(list_concat(terms, words))) + 0.2::DOUBLE * coalesce(len(list_intersect(terms, latest)) / nullif(len(list_distinct(list_concat(terms, latest))), 0), 0) + 0.2::DOUBLE * len(list_intersect(terms, words)) / len(terms) + CASE WHEN len(list_intersect(names, words)) > 0 THEN 0.10::DOUBLE ELSE 0 END, 9) AS score, row_number() OVER (PARTITION BY i.message_id ORDER BY len(list_intersect(terms, words)) + 2 * len(list_intersect(names, words)) DESC, o.trajectory_id) AS place FROM i JOIN o ON o.sample_id = i.sample_id WHERE len(list_intersect(terms, words)) > 0),
  b AS (SELECT message_id, trajectory_id, score FROM x WHERE place <= 32 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY score DESC, trajectory_id) = 1) SELECT i.message_id, CASE WHEN score >= 0.72 THEN trajectory_id END AS trajectory_id, score FROM i LEFT JOIN b ON b.message_id = i.message_id""")(
    lambda v: B.matched_trajectory(incoming(v).join(v.table("fx_notes").where("version = 4").select("message_id"), "message_id", "left_semi"), _open(v))
)


def _open(v):
    n = v.table("fx_notes").where("version <= 3").groupBy("sample_id", "trajectory_id").agg(F.array_join(M.ordered(F.col("phrase"), "version"), " ").alias("t"), F.max_by("phrase", "version").alias("l"))
    return n.select("sample_id", "trajectory_id", keywords(F.col("t")).alias("words"), keywords(F.col("l")).alias("latest"))


def page_signals(v):
    return signals(v).select("sample_id", "trajectory_id", "names", "values", "items", F.array_sort("have").alias("terms"))


def seeds(v):
    return G.page_seeds(page_signals(v))


_SIG = f"""t0 AS (SELECT sample_id, trajectory_id, string_agg(text, ' ' ORDER BY version) AS text FROM fx_note_claims GROUP BY ALL),
  sg AS (SELECT sample_id, trajectory_id, list_sort({_KEYS.format('text')}) AS terms, {_NAMES.format('text')} AS names, list_distinct(regexp_extract_all(text, 'favorite color is ([a-z]+)', 1)) AS vals, list_filter({_KEYS.format("array_to_string(regexp_extract_all(text, 'enjoy ([a-z, ]+)', 1), ' ')")}, lambda w: w <> 'and') AS items FROM t0)"""
_SEED = f"""{_SIG}, raw AS (SELECT sample_id, 'index' AS seed_type, 'all' AS seed_key, trajectory_id FROM sg UNION SELECT sample_id, 'entity', unnest(names), trajectory_id FROM sg UNION SELECT sample_id, 'inventory', unnest(names), trajectory_id FROM sg WHERE len(items) > 0 UNION SELECT sample_id, 'topic', unnest(terms[1:3]), trajectory_id FROM sg),
  sz AS (SELECT sample_id, seed_type, seed_key, count(*) AS n FROM raw GROUP BY ALL), sd AS (SELECT raw.*, raw.seed_type = 'entity' AND n > 24 AS broad FROM raw JOIN sz ON raw.sample_id = sz.sample_id AND raw.seed_type = sz.seed_type AND raw.seed_key = sz.seed_key WHERE raw.seed_type IN ('index', 'inventory') OR n >= 2)"""
_KEYED = "sample_id, seed_type, seed_key"
query("e1_page_seeds", f"WITH {_SEED} SELECT {_KEYED}, trajectory_id, broad FROM sd")(lambda v: seeds(v).select("sample_id", "seed_type", "seed_key", "trajectory_id", "broad"))
_FAM = "fm AS (SELECT trajectory_id, CASE WHEN len(items) > 0 THEN 'activity' WHEN len(vals) > 0 THEN 'color' ELSE 'other' END AS family FROM sg)"


def families(v):
    return page_signals(v).select("trajectory_id", F.when(F.size("items") > 0, "activity").when(F.size("values") > 0, "color").otherwise("other").alias("family"))


query("e2_entity_facet_pages", f"WITH {_SEED}, {_FAM}, wide AS (SELECT sample_id, seed_key FROM sd WHERE seed_type = 'entity' GROUP BY ALL HAVING count(*) > 6), x AS (SELECT DISTINCT sd.sample_id, sd.seed_key || '/' || family AS seed_key, sd.trajectory_id FROM sd JOIN wide ON wide.sample_id = sd.sample_id AND wide.seed_key = sd.seed_key JOIN fm ON fm.trajectory_id = sd.trajectory_id WHERE sd.seed_type = 'entity') SELECT sample_id, 'entity_family' AS seed_type, seed_key, trajectory_id FROM x QUALIFY count(*) OVER (PARTITION BY sample_id, seed_key) >= 2")(
    lambda v: G.split_by_family(seeds(v), families(v), 6)
)
_RED = f"{_SEED}, red AS (SELECT DISTINCT t.sample_id, t.seed_key FROM (SELECT t.sample_id, t.seed_key, o.seed_type, o.seed_key AS other, count(*) AS m FROM sd t JOIN sd o ON o.sample_id = t.sample_id AND o.trajectory_id = t.trajectory_id AND o.seed_type IN ('entity', 'inventory') WHERE t.seed_type = 'topic' GROUP BY ALL) t JOIN sz ON sz.sample_id = t.sample_id AND sz.seed_type = 'topic' AND sz.seed_key = t.seed_key WHERE m >= 0.8 * n), sp AS (SELECT sd.* FROM sd ANTI JOIN red ON sd.seed_type = 'topic' AND red.sample_id = sd.sample_id AND red.seed_key = sd.seed_key)"
query("e3_suppress_redundant_topics", f"WITH {_RED} SELECT {_KEYED}, count(*) AS width FROM sp GROUP BY ALL")(lambda v: G.without_redundant_topics(seeds(v)).groupBy("sample_id", "seed_type", "seed_key").agg(F.count(F.lit(1)).alias("width")))
query("e6_singleton_policy", f"WITH {_SEED} SELECT {_KEYED}, CASE WHEN length(seed_key) > 3 AND seed_key NOT IN ('user') THEN 'allowed' ELSE 'must_merge' END AS policy FROM raw WHERE seed_type <> 'index' GROUP BY ALL HAVING count(*) = 1")(lambda v: G.singleton_policy(G.page_seeds(page_signals(v), least=1), ["user"]))
_CHUNK = "CASE WHEN n <= 6 THEN 0 WHEN n % 4 IN (1, 2) AND i >= n - n % 4 THEN i // 4 - 1 ELSE i // 4 END"
_AUD = f"""{_SEED}, ent AS (SELECT * FROM sd WHERE seed_type IN ('index', 'inventory')), al AS (SELECT e.sample_id, e.trajectory_id FROM ent e WHERE seed_type = 'index' AND NOT EXISTS (SELECT 1 FROM ent o WHERE o.seed_type <> 'index' AND o.sample_id = e.sample_id AND o.trajectory_id = e.trajectory_id)),
  ac AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY trajectory_id) - 1 AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM al), pc AS (SELECT *, row_number() OVER (PARTITION BY {_KEYED} ORDER BY trajectory_id) - 1 AS i, count(*) OVER (PARTITION BY {_KEYED}) AS n FROM ent WHERE seed_type <> 'index'),
  au AS (SELECT {_KEYED}, CAST({_CHUNK} AS BIGINT) AS chunk, trajectory_id FROM pc UNION ALL SELECT sample_id, 'rescue', 'rescue', CAST({_CHUNK} AS BIGINT), trajectory_id FROM ac)"""


def _narrow(v):
    return seeds(v).where(F.col("seed_type").isin("index", "inventory"))


query("e8_page_coverage_audit", f"WITH {_AUD} SELECT * FROM au")(lambda v: G.coverage_audit(_narrow(v)))
query("e8_page_coverage_counts", f"WITH {_AUD}, w AS (SELECT {_KEYED}, chunk, count(*) AS w FROM au GROUP BY ALL), n AS (SELECT sample_id, count(DISTINCT trajectory_id) AS trajectories FROM ent WHERE seed_type = 'index' GROUP BY 1), b AS (SELECT sample_id, count(DISTINCT seed_key) AS pages_before FROM ent WHERE seed_type <> 'index' GROUP BY 1), o AS (SELECT sample_id, count(*) AS k FROM al GROUP BY 1) SELECT n.sample_id, trajectories, coalesce(k, 0) AS index_only, coalesce(pages_before, 0) AS pages_before, (SELECT count(*) FROM w WHERE w.sample_id = n.sample_id) AS pages_after, (SELECT max(w) FROM w WHERE w.sample_id = n.sample_id) AS widest FROM n LEFT JOIN b ON b.sample_id = n.sample_id LEFT JOIN o ON o.sample_id = n.sample_id")(
    lambda v: G.coverage_counts(_narrow(v), G.coverage_audit(_narrow(v)))
)
_CAP = f"{_SEED}, kp AS (SELECT {_KEYED}, n AS width, row_number() OVER (PARTITION BY sample_id ORDER BY CASE seed_type WHEN 'index' THEN 0 WHEN 'entity' THEN 1 WHEN 'inventory' THEN 2 ELSE 4 END, n DESC, seed_key) AS place FROM sz WHERE seed_type IN ('index', 'inventory') OR n >= 2), ck AS (SELECT * FROM kp WHERE place <= 24)"
query("e9_seed_cap", f"WITH {_CAP} SELECT * FROM ck")(lambda v: G.capped_seeds(seeds(v)))
query("e9_page_links", f"WITH {_CAP}, m AS (SELECT sd.sample_id, sd.trajectory_id, ck.place FROM sd JOIN ck ON ck.sample_id = sd.sample_id AND ck.seed_type = sd.seed_type AND ck.seed_key = sd.seed_key WHERE sd.seed_type <> 'index') SELECT a.sample_id, a.place, b.place AS linked, count(*) AS shared FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.trajectory_id = b.trajectory_id AND a.place < b.place GROUP BY ALL")(
    lambda v: G.page_links(seeds(v), G.capped_seeds(seeds(v)))
)
_META = f"""{_SEED}, mm AS (SELECT sd.sample_id, sd.seed_type, sd.seed_key, sd.trajectory_id, sg.names, sg.vals, sg.terms, len(names) + len(vals) + len(items) + len(terms) AS rich FROM sd JOIN sg ON sg.trajectory_id = sd.trajectory_id),
  tn AS (SELECT {_KEYED}, w, count(*) AS n, row_number() OVER (PARTITION BY {_KEYED} ORDER BY count(*) DESC, w) AS r FROM (SELECT {_KEYED}, unnest(names) AS w FROM mm) GROUP BY {_KEYED}, w), tv AS (SELECT {_KEYED}, w, count(*) AS n, row_number() OVER (PARTITION BY {_KEYED} ORDER BY count(*) DESC, w) AS r FROM (SELECT {_KEYED}, unnest(vals) AS w FROM mm) GROUP BY {_KEYED}, w),
  tt AS (SELECT {_KEYED}, w, count(*) AS n, row_number() OVER (PARTITION BY {_KEYED} ORDER BY count(*) DESC, w) AS r FROM (SELECT {_KEYED}, unnest(terms) AS w FROM mm) GROUP BY {_KEYED}, w), rr AS (SELECT *, row_number() OVER (PARTITION BY {_KEYED} ORDER BY rich DESC, trajectory_id) AS r FROM mm),
  gn AS (SELECT {_KEYED}, string_agg(w, ' ' ORDER BY r) AS names FROM tn WHERE r <= 3 GROUP BY ALL), gv AS (SELECT {_KEYED}, string_agg(w, ' ' ORDER BY r) AS vals FROM tv WHERE r <= 3 GROUP BY ALL), gt AS (SELECT {_KEYED}, string_agg(w, ' ' ORDER BY r) AS terms FROM tt WHERE r <= 3 GROUP BY ALL), gr AS (SELECT {_KEYED}, string_agg(CAST(trajectory_id AS VARCHAR), ' ' ORDER BY r) AS representatives FROM rr WHERE r <= 4 GROUP BY ALL),
  md AS (SELECT sample_id, seed_type, seed_key, count(*) AS width, representatives, coalesce(names, '') AS names, coalesce(vals, '') AS vals, coalesce(terms, '') AS terms FROM sd JOIN gr USING ({_KEYED}) LEFT JOIN gn USING ({_KEYED}) LEFT JOIN gv USING ({_KEYED}) LEFT JOIN gt USING ({_KEYED}) GROUP BY ALL)"""


def metadata(v):
    return G.page_metadata(seeds(v), page_signals(v))


query("e10_page_evidence_metadata", f"WITH {_META} SELECT * FROM md")(lambda v: G.show_page(metadata(v), "names", "values", "terms", "representatives").withColumnRenamed("values", "vals"))
query("e11_page_markdown", f"WITH {_META} SELECT {_KEYED}, '# ' || seed_type || ': ' || seed_key || chr(10) || '- width: ' || width || chr(10) || '- names: ' || replace(names, ' ', ', ') || chr(10) || '- values: ' || replace(vals, ' ', ', ') || chr(10) || '- terms: ' || replace(terms, ' ', ', ') || chr(10) || '- trajectories: ' || replace(representatives, ' ', ', ') AS text FROM md")(lambda v: G.page_texts(metadata(v)).drop("routing"))
query("e12_fragmentation_by_type", f"WITH {_SEED}, w AS (SELECT {_KEYED}, count(*) AS w FROM sd WHERE seed_type <> 'index' GROUP BY ALL) SELECT sample_id, seed_type, count(*) AS pages, round(avg((w = 1)::INT), 9) AS singleton_rate, round(avg(w), 9) AS mean_width, max(w) AS max_width, count(*) FILTER (w > 6) AS overwide FROM w GROUP BY ALL")(lambda v: G.fragmentation_by_type(seeds(v)))
query("e13_historical_backup_pages", f"WITH {_CARDS}, {_SEED} SELECT DISTINCT dr.sample_id, 'history' AS seed_type, dr.surface AS seed_key, dr.trajectory_id FROM dr WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.sample_id = dr.sample_id AND sd.seed_key = dr.surface)")(
    lambda v: G.history_pages(cards(v).join(signals(v).select("sample_id", "trajectory_id"), "trajectory_id"), seeds(v))
)
query("e5_split_broad_pages", None)(lambda v: G.split_by_vectors(v("fx_vectors").groupBy("sample_id", "trajectory_id").agg(F.count(F.lit(1)).alias("richness"), F.max_by("embedding", "version").alias("vector")).select(F.col("sample_id").cast("long").alias("page"), F.col("trajectory_id").alias("member"), "richness", "vector")))
query("e7_merge_small_groups", None)(lambda v: G.merge_small(_groups(v)))


def _groups(v):
    """Every trajectory in the page of its first name."""
    x = page_signals(v).where(F.size("names") > 0).withColumn("page", F.abs(F.hash(F.element_at("names", 1), F.col("trajectory_id") % 5)).cast("long"))
    return x.select("sample_id", "page", F.col("trajectory_id").alias("member"), "terms")

