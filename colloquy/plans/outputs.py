"""Query of parsed model outputs, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from ..operators import outputs as O
from ..operators.memory import shown
from .registry import query

_REC = "list_transform({0}, lambda p: [trim(split_part(p, '=', 1)), trim(substr(p, strpos(p, '=') + 1))])"
_GET = "list_filter(pairs, lambda p: p[1] = '{0}')[-1][2]"
_ALIAS = "CASE {0} WHEN 'confirmed' THEN 'active' WHEN 'confirm' THEN 'active' WHEN 'needs confirmation' THEN 'needs-confirmation' WHEN 'needs_confirmation' THEN 'needs-confirmation' WHEN 'pending confirmation' THEN 'needs-confirmation' WHEN 'pending_confirmation' THEN 'needs-confirmation' WHEN 'pending-confirmation' THEN 'needs-confirmation' WHEN 'contradiction' THEN 'contradictory' WHEN 'conflicted' THEN 'contradictory' ELSE {0} END"
_SQL = rf"""
WITH l AS (SELECT output_id, trim(coalesce(text, '')) AS whole, unnest(list) AS raw, generate_subscripts(list, 1) AS line FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS list FROM fx_model_outputs)),
  s AS (SELECT *, rtrim(regexp_replace(raw, '(?i)<think\b[^>]*>.*?</think>', '', 'g')) AS said FROM l),
  e AS (SELECT *, CASE WHEN contains(lower(said), '</think>') THEN 'close' WHEN starts_with(lower(trim(said)), '<think') THEN 'open' WHEN regexp_matches(said, '^\s*\[.*\]\s*$') OR regexp_matches(said, '^\s*[A-Z][A-Z0-9_ ]*\s*:') THEN 'start' END AS event FROM s),
  t AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER w = 'open' OR event = 'close', FALSE) AS thinks FROM e WINDOW w AS (PARTITION BY output_id ORDER BY line)),
  v AS (SELECT *, CASE WHEN whole = 'NO_MEMORY' THEN 'no_memory' WHEN trim(said) = '' THEN 'blank' WHEN thinks THEN 'reasoning' WHEN NOT coalesce(bool_or(event = 'start' AND NOT thinks) OVER (PARTITION BY output_id ORDER BY line), FALSE) THEN 'preamble' END AS skip FROM t),
  h AS (SELECT *, CASE WHEN skip IS NULL AND regexp_matches(said, '^\[.*\]$') THEN said[2:-2] END AS header FROM v),
  c AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY line) AS section FROM h),
  r AS (SELECT *, section IN ('CLAIMS', 'OPS') AND skip IS NULL AND header IS NULL AS rec, string_split(substr(said, 3), ' | ') AS own, list_transform(regexp_split_to_array(regexp_replace(said, '^\s*(?:[-*•]|\d+[.)])\s*', ''), '\s*\|\s*'), lambda p: CASE WHEN contains(p, '=') THEN p ELSE regexp_replace(p, '^([A-Za-z_]+)\s*:\s*', '\1=') END) AS fixed FROM c),
  p AS (SELECT *, rec AND starts_with(said, '- ') AND len(list_filter(own, lambda x: NOT contains(x, '='))) = 0 AS strict, rec AND len(list_filter(fixed, lambda x: NOT contains(x, '='))) = 0 AS fixable FROM r),
  q AS (SELECT *, CASE WHEN strict THEN {_REC.format('own')} WHEN fixable THEN {_REC.format('fixed')} END AS pairs FROM p),
  g AS (SELECT *, {_ALIAS.format(f"lower({_GET.format('status')})")} AS st, {_GET.format('text')} AS tx, upper({_GET.format('op')}) AS o, {_GET.format('target_claim_id')} AS tg, {_GET.format('rationale')} AS ra, {_GET.format('source_message_ids')} AS so FROM q),
  z AS (SELECT *, CASE WHEN skip IS NOT NULL THEN skip WHEN header IS NOT NULL THEN NULL WHEN section IS NULL THEN CASE WHEN NOT contains(said, ':') THEN 'malformed_top_field' END WHEN rec AND pairs IS NULL THEN CASE WHEN starts_with(said, '- ') THEN 'malformed_pipe_record' ELSE 'malformed_list_record' END
    WHEN section = 'CLAIMS' THEN CASE WHEN st IS NULL THEN 'missing_record_key:status' WHEN tx IS NULL THEN 'missing_record_key:text' WHEN st NOT IN ('active', 'deprecated', 'contradictory', 'needs-confirmation') THEN 'invalid_claim_status' END
    WHEN section = 'OPS' THEN CASE WHEN o IS NULL THEN 'missing_record_key:op' WHEN tg IS NULL THEN 'missing_record_key:target_claim_id' WHEN o NOT IN ('ADD', 'REVISE', 'DEPRECATE') THEN 'invalid_op_type' END WHEN NOT starts_with(said, '- ') THEN 'malformed_list_record' END AS reason FROM g),
  k AS (SELECT *, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN header IS NOT NULL THEN 'header' WHEN reason IS NOT NULL THEN 'reject' WHEN section IS NULL THEN 'field' WHEN section = 'CLAIMS' THEN 'claim' WHEN section = 'OPS' THEN 'op' ELSE 'item' END AS kind FROM z),
  lost AS (SELECT output_id, key FROM (SELECT output_id, bool_and(reason IS DISTINCT FROM 'no_memory') AS says, list(trim(split_part(said, ':', 1))) FILTER (kind = 'field') AS have FROM k GROUP BY 1), (SELECT unnest(['SUMMARY_CONTENT', 'CONTEXT', 'KEYWORDS']) AS key) WHERE says AND NOT coalesce(list_contains(have, key), FALSE))
SELECT output_id, line, kind, section, CASE WHEN kind = 'field' THEN trim(split_part(said, ':', 1)) END AS key, CASE kind WHEN 'field' THEN trim(substr(said, strpos(said, ':') + 1)) WHEN 'claim' THEN tx WHEN 'op' THEN coalesce(ra, 'none given') WHEN 'item' THEN trim(substr(said, 3)) ELSE raw END AS value, CASE WHEN kind = 'claim' THEN st END AS status,
  CASE WHEN kind IN ('claim', 'op') AND so IS NOT NULL AND lower(so) <> 'none' THEN array_to_string(list_transform(string_split(so, ','), lambda x: trim(x)), ' ') ELSE '' END AS sources, CASE WHEN kind = 'op' THEN o END AS op, CASE WHEN kind = 'op' THEN tg END AS target, reason, kind IN ('claim', 'op') AND NOT strict AS repaired FROM k
UNION ALL SELECT output_id, 0, 'reject', NULL, key, NULL, NULL, '', NULL, NULL, 'missing_field', FALSE FROM lost"""
query("c28_parse_memory_text", _SQL)(lambda v: O.parsed_outputs(v("fx_model_outputs")).withColumn("sources", shown("sources")))
