"""Queries of what texts say: exact terms, facets of claims, and what a memory must keep, over freely combined sayings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as E
from ..operators.memory import shown
from .registry import _KEYS, query

# the words of the definitions, written for the comparison alone
_INSTRUMENTS = ["bass", "cello", "clarinet", "drums", "flute", "guitar", "harp", "piano", "saxophone", "trumpet", "ukulele", "viola", "violin"]
_SYMBOLS = ["heart", "lotus", "moon", "peace sign", "rainbow", "rainbow flag", "star", "sun", "tree of life"]
_FOODS = ["cake", "cakes", "cookie", "cookies", "pie", "pies", "bread", "pasta", "pizza", "soup", "salad", "curry", "stew", "lasagna", "muffin", "muffins", "brownie", "brownies", "sandwich", "sandwiches", "taco", "tacos"]
_CAPS = "the a an and are as at because been before being between but by could did do does during for from had has have how if in into is it its last more most my next of on or our really should since that the their there these this those to we were what when where which while who why with would you your"
_NOISE = "ah anything anyway cool definitely hello hey hi hmm just nope okay ok really right sure thanks thank welcome well yeah yep"
_WHO = "he her hers him his i it its me mine my myself our ours she their theirs them they us we you your yours"
_DATES = "april august december february friday january july june march monday november october saturday september sunday thursday tuesday wednesday"
_VAGUE = "afternoon day days evening later morning night recently soon time times today tomorrow tonight week weeks yesterday"
_OPEN = "actually amazing any because before being great more most next some"
_list = lambda *words: str([w for x in words for w in x.split()])
_TOKENS = "regexp_extract_all(lower({0}), '[a-zA-Z0-9][a-zA-Z0-9\\-'']+')"
_EMPTY = f"len(list_filter({_KEYS.format('{0}')}, lambda w: NOT list_contains({_list(_NOISE, _WHO, _DATES, _VAGUE, _OPEN, _CAPS)}, w))) = 0"
_ONE = f"len({_TOKENS}) = 1 AND list_has_any({_TOKENS}, {_list(_NOISE, _WHO, _DATES, _VAGUE, _OPEN, _CAPS)})"
_LOW = f"(len({_TOKENS}) = 0 OR ({_ONE}) OR contains({{0}}, '''') OR {_EMPTY})"
_SPLIT = "string_split({0}, ' ')"
_STOP = f"(list_has_any({_SPLIT}, {str([w.capitalize() for w in _CAPS.split()])}) OR list_has_any(list_transform({_SPLIT}, lambda w: lower(w)), {_list(_NOISE, _WHO, _DATES, _OPEN)}) OR regexp_matches({{0}}, '[''’]') OR (len({_SPLIT}) = 1 AND length({{0}}) < 3))"
_TITLE = r"\b(?:[A-Z][A-Za-z0-9''’-]*(?::[A-Z][A-Za-z0-9''’-]*)?)(?:\s+(?:[A-Z][A-Za-z0-9''’-]*(?::[A-Z][A-Za-z0-9''’-]*)?|of|the|and|a|an|to|with|for|in|on|at))*\b"
_COUNTRY = r"(?i)\bhome country[, ]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
_OWNED = "t AS (SELECT owner_id, 0 AS position, text FROM fx_saying_claims UNION ALL SELECT owner_id, position, text FROM fx_saying_sources), who AS (SELECT owner_id, list(lower(speaker)) AS names, arg_min(speaker, position) AS first FROM fx_saying_sources WHERE speaker IS NOT NULL GROUP BY 1)"
_FOUND = " UNION ALL ".join(
    [f"SELECT owner_id, position, {k + n} AS place, '{kind}' AS kind, '{w}' AS term FROM t WHERE regexp_matches(lower(text), '\\b{w}\\b')" for kind, k, words in (("instrument", 0, _INSTRUMENTS), ("symbol", 13, _SYMBOLS)) for n, w in enumerate(words)]
    + [f"SELECT owner_id, position, {22 + n}, 'food_suffix', unnest(regexp_extract_all(lower(text), '\\b(?:[a-z]+(?:-[a-z]+)?\\s+){{0,3}}{w}\\b')) FROM t" for n, w in enumerate(_FOODS)]
    + ["SELECT owner_id, position, 44, 'quoted', unnest(regexp_extract_all(text, '[\"“](.{2,80}?)[\"”]', 1)) FROM t", f"SELECT owner_id, position, 45, 'title_case', unnest(regexp_extract_all(text, '{_TITLE}')) FROM t"]
    + [f"SELECT owner_id, position, {n}, '{kind}', nullif(regexp_extract(text, '{p}', 1), '') FROM t" for n, kind, p in ((46, "place", r"\b(?:in|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), (47, "home_country", _COUNTRY))]
)
_SURE = "kind IN ('food_suffix', 'home_country', 'instrument', 'place', 'quoted', 'symbol')"
_TERMS = f"""{_OWNED}, f AS ({_FOUND}), c AS (SELECT f.owner_id, position, place, kind, regexp_replace(trim(regexp_replace(term, '\\s+', ' ', 'g')), '(?i)(?:''s|’s)\\b', '', 'g') AS term, names FROM f LEFT JOIN who ON who.owner_id = f.owner_id WHERE term IS NOT NULL),
  j AS (SELECT *, CASE WHEN kind = 'title_case' AND {_STOP.format('term')} THEN 'stop_span' WHEN len({_TOKENS.format('term')}) = 0 THEN 'no_word' WHEN list_contains(names, lower(term)) THEN 'speaker'
    WHEN list_has_any({_TOKENS.format('term')}, {_list(_WHO, _NOISE)}) THEN 'pronoun_or_noise' WHEN list_has_any({_TOKENS.format('term')}, {_list(_DATES, _VAGUE)}) THEN 'calendar_or_vague' WHEN contains(term, '''') THEN 'apostrophe'
    WHEN NOT ({_SURE}) AND {_LOW.format('term')} THEN 'low_value' WHEN NOT ({_SURE}) AND len({_TOKENS.format('term')}) = 1 AND regexp_matches(term, '^[A-Z]') THEN 'single_title_word' END AS reason FROM c WHERE term <> ''),
  o AS (SELECT *, row_number() OVER (PARTITION BY owner_id, lower(term) ORDER BY reason IS NOT NULL, position, place) AS n FROM j)"""


def claims(v):
    return v("fx_saying_claims")


def terms(v):
    return E.exact_terms(claims(v), v("fx_saying_sources"))


query("c17_extract_exact_terms", f"WITH {_TERMS} SELECT owner_id, lower(term) AS term, kind FROM o WHERE n = 1 AND reason IS NULL")(lambda v: terms(v).where("reason is null").select("owner_id", F.lower("term").alias("term"), "kind"))
query("c17_discarded_terms", f"WITH {_TERMS} SELECT owner_id, lower(term) AS term, reason FROM o WHERE n = 1 AND reason IS NOT NULL")(lambda v: terms(v).where("reason is not null").select("owner_id", F.lower("term").alias("term"), "reason"))

_LEXICON = f"""sp AS (SELECT sample_id, message_id, unnest(list) AS surface, generate_subscripts(list, 1) AS i FROM (SELECT sample_id, message_id, regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b') AS list FROM fx_sayings)),
  lx AS (SELECT sample_id, key, arg_min(surface, rank) AS surface FROM (SELECT sample_id, lower(surface) AS key, arg_min(surface, (message_id, i)) AS surface, 1 AS rank FROM sp WHERE NOT {_STOP.format('surface')} GROUP BY 1, 2 HAVING count(*) >= 2
    UNION ALL SELECT sample_id, lower(speaker), arg_min(speaker, message_id), 0 FROM fx_sayings WHERE speaker IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2)"""
query("c15_span_lexicon", f"WITH {_LEXICON} SELECT sample_id, key, surface FROM lx")(lambda v: E.span_lexicon(v("fx_sayings")))
_NAMED = "SELECT {0}, surface, length(regexp_extract(lower({1}.text), '^(.*?)\\b' || key || '\\b', 1)) AS start, length(key) AS length FROM {1} JOIN lx ON lx.sample_id = {1}.sample_id AND regexp_matches(lower({1}.text), '\\b' || key || '\\b')"
query("c16_entity_mentions", f"WITH {_LEXICON} {_NAMED.format('message_id', 'fx_sayings')}")(lambda v: E.entity_mentions(v("fx_sayings").select("sample_id", "message_id", "text"), E.span_lexicon(v("fx_sayings"))).drop("sample_id"))

_RULES = [
    ("single_parent", "relationship_status", "single", "identity_status", 0.98, "single parent"), ("transgender_woman", "gender_identity", "transgender woman", "identity_status", 0.99, "transgender woman"), ("home_country", "home_country", None, "origin", 0.97, None),
    ("adoption_agencies", "research_topic", "adoption agencies", "topic", 0.96, "research.*adoption agenc|adoption agenc.*research"), ("abstract_art", "art_style", "abstract art", "creative_style", 0.98, "abstract art"),
    ("car_modification", "event_type", "car modification workshop", "event", 0.96, "car modification workshop"), ("san_francisco", "activity_location", None, "location", 0.95, r"\b(?:returned from|in)\s+(San Francisco)\b"),
]
_HIT = " UNION ALL ".join(
    f"SELECT owner_id, position, {n} AS place, '{rule}' AS rule_id, '{relation}' AS relation, '{kind}' AS kind, {sure}::DOUBLE AS confidence, "
    + (f"'{value}' AS value FROM t WHERE regexp_matches(text, '(?is){p}')" if value else f"nullif(regexp_extract(text, '{_COUNTRY}', 1), '') AS value FROM t" if not p else f"unnest(regexp_extract_all(text, '(?i){p}', 1)) AS value FROM t")
    for n, (rule, relation, value, kind, sure, p) in enumerate(_RULES)
)
_FACETS = f"""{_OWNED}, {_LEXICON}, hit AS (SELECT DISTINCT * FROM ({_HIT}) WHERE value IS NOT NULL), x AS (SELECT t.*, c.sample_id FROM t JOIN fx_saying_claims c ON c.owner_id = t.owner_id WHERE t.owner_id IN (SELECT owner_id FROM hit)),
  nm AS ({_NAMED.format('owner_id, position', 'x')}), e AS (SELECT owner_id, arg_min(surface, (start, -length, lower(surface))) FILTER (position = 0) AS own, arg_min(surface, (position, start, -length, lower(surface))) FILTER (position > 0) AS other FROM nm GROUP BY 1),
  ent AS (SELECT c.owner_id, coalesce(names, []) AS names, coalesce(CASE WHEN regexp_matches(c.text, '(?i)^\\s*(?:the\\s+)?user\\b') THEN first END, own, first, other) AS who FROM fx_saying_claims c LEFT JOIN who ON who.owner_id = c.owner_id LEFT JOIN e ON e.owner_id = c.owner_id),
  bad AS (SELECT *, who IS NOT NULL AND NOT list_contains(names, lower(who)) AND ({_STOP.format('who')} OR len({_TOKENS.format('who')}) = 0 OR list_has_any({_TOKENS.format('who')}, {_list(_WHO, _NOISE, _DATES, _VAGUE)}) OR (len({_TOKENS.format('who')}) = 1 AND (length({_TOKENS.format('who')}[1]) < 3 OR list_has_any({_TOKENS.format('who')}, {_list(_OPEN)})))) AS cleared FROM ent),
  r AS (SELECT hit.*, CASE WHEN cleared THEN NULL ELSE who END AS entity, CASE WHEN relation IN ('home_country', 'activity_location') AND ({_STOP.format('value')} OR len({_TOKENS.format('value')}) = 0 OR list_has_any({_TOKENS.format('value')}, {_list(_NOISE, _WHO, _DATES, _VAGUE)}) OR {_EMPTY.format('value')}) THEN 'invalid_place_like_value'
    WHEN relation IN ('research_topic', 'art_style', 'event_type') AND {_LOW.format('value')} THEN 'low_value_relation_value' END AS fault, cleared FROM hit JOIN bad ON bad.owner_id = hit.owner_id),
  o AS (SELECT *, coalesce(fault, CASE WHEN cleared THEN 'facet_entity_cleared' END) AS reason, row_number() OVER (PARTITION BY owner_id, lower(entity), relation, lower(value), fault IS NOT NULL ORDER BY position, place) AS n FROM r)"""
query("c18_extract_claim_facets", f"WITH {_FACETS} SELECT owner_id, entity, relation, value, kind, confidence, rule_id, reason FROM o WHERE n = 1")(lambda v: E.claim_facets(claims(v), v("fx_saying_sources"), E.span_lexicon(v("fx_sayings"))).drop("span"))
query("c19_rule_table", None)(lambda v: E.must_preserve(v("fx_sayings")).withColumn("message_ids", shown("message_ids")))
