"""Queries of the rule functions, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as T
from ..functions import rules as C
from ..operators import analysis as A
from ..operators import memory as M
from ..operators import scoring as S
from .registry import query
from .scoring import _NAMES

# phrases with every unit of a relative time
_VARIED = "SELECT message_id, sample_id, occurred_at, replace(phrase, 'days ago', CASE CAST(floor(message_id / 8) AS BIGINT) % 4 WHEN 0 THEN 'days ago' WHEN 1 THEN 'weeks ago' WHEN 2 THEN 'months ago' ELSE 'years ago' END) AS phrase FROM fx_phrases"


def varied(v):
    unit = F.element_at(F.array(*map(F.lit, ("days ago", "weeks ago", "months ago", "years ago"))), (F.floor(F.col("message_id") / 8) % 4 + 1).cast("int"))
    return v("fx_phrases").withColumn("phrase", F.replace("phrase", F.lit("days ago"), unit))


_SP = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
query("c5_mean_pool", "WITH u AS (SELECT trajectory_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM fx_vectors), p AS (SELECT trajectory_id, i, avg(e[i]) AS m FROM u, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT trajectory_id, sqrt(sum(m * m)) AS n FROM p GROUP BY 1) SELECT p.trajectory_id, round(max(m) FILTER (i = 1) / max(n), 6) AS first, round(max(m) FILTER (i = 64) / max(n), 6) AS last FROM p JOIN n ON n.trajectory_id = p.trajectory_id GROUP BY p.trajectory_id")(
    lambda v: M.mean_pool(v("fx_vectors"), "trajectory_id").select("trajectory_id", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))
)
query("c7_dedupe_preserve", "WITH w AS (SELECT message_id, unnest(list) AS w, generate_subscripts(list, 1) AS i FROM (SELECT message_id, string_split(phrase || ' ' || upper(phrase), ' ') AS list FROM fx_phrases)), d AS (SELECT message_id, min(i) AS i, arg_min(trim(w), i) AS w FROM w WHERE trim(w) <> '' GROUP BY message_id, lower(trim(w))) SELECT message_id, string_agg(w, ' ' ORDER BY i) AS words FROM d GROUP BY message_id")(
    lambda v: v("fx_phrases").select("message_id", M.shown(C.dedupe_preserve(F.split(F.concat("phrase", F.lit(" "), F.upper("phrase")), " "))).alias("words"))
)
query("c7_top_ranked_values", "WITH w AS (SELECT sample_id, message_id, unnest(regexp_extract_all(phrase, '[A-Za-z]+')) AS w FROM fx_phrases), c AS (SELECT sample_id, lower(w) AS k, count(*) AS n, arg_min(w, message_id * 1000) AS surface FROM w GROUP BY ALL) SELECT sample_id, k, n, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, k) AS rank FROM c QUALIFY rank <= 5")(
    lambda v: M.top_values(v("fx_phrases").select("sample_id", "message_id", F.explode(F.regexp_extract_all("phrase", F.lit("[A-Za-z]+"), F.lit(0))).alias("value")), "sample_id", "message_id", 5).select("sample_id", F.col("key").alias("k"), "n", "rank")
)
_READ = "({0} <> '' AND {0} NOT IN ('thing', 'things', 'something', 'stuff', 'it', 'that') AND string_split({0}, ' ')[-1] NOT IN ('the', 'a', 'of', 'and', 'to', 'in') AND length({0}) > 2)"
_LOW = f"lower({_SP.format('phrase')})"
query("c8_readable_value_filter", f"SELECT message_id, {_READ.format(_LOW)} AS value_ok, {_READ.format(_LOW)} AND len(string_split({_LOW}, ' ')) >= 3 AS claim_ok FROM (SELECT message_id, CASE message_id % 3 WHEN 0 THEN phrase WHEN 1 THEN substr(phrase, 1, 5) ELSE phrase || ' and the' END AS phrase FROM fx_phrases)")(
    lambda v: v("fx_phrases").select("message_id", F.when(F.col("message_id") % 3 == 0, F.col("phrase")).when(F.col("message_id") % 3 == 1, F.substring("phrase", 1, 5)).otherwise(F.concat("phrase", F.lit(" and the"))).alias("p")).select("message_id", C.readable_value(F.col("p")).alias("value_ok"), C.readable_claim(F.col("p")).alias("claim_ok"))
)
FAMILY_WORDS = {"book": r"\bbooks?\b", "city": r"\bcit(y|ies)\b", "count": r"\bhow many\b"}
query("c9_classify_query_shape", f"WITH x AS (SELECT *, lower({_SP.format('question')}) AS q, {_NAMES.format('substr(question, 2)')} AS names FROM fx_asks) SELECT query_id, starts_with(q, 'how many') OR contains(q, ' number of ') AS counting, regexp_matches(q, '\\bhow\\s+many\\s+(seconds?|minutes?|hours?|days?|weeks?|months?|years?)\\b.*\\b(passed|took|since|between|after|before|until|from)\\b') AS duration, regexp_matches(q, ' (both|compared|compare|same|different|together|shared) ') AS comparison, len(names) >= 2 OR contains(q, ' both ') AS several, regexp_matches(q, ' (both|all) |\\bbooks?\\b|\\bcit(y|ies)\\b') AS listing, CASE WHEN regexp_matches(q, '\\bbooks?\\b') THEN 'book' WHEN regexp_matches(q, '\\bcit(y|ies)\\b') THEN 'city' END AS family FROM x")(
    lambda v: v("fx_asks").select("query_id", C.query_shape(F.col("question"), S.names_in(F.substring("question", 2, 10000)), FAMILY_WORDS).alias("s")).select("query_id", "s.*")
)
query("c10_extract_query_facets", "SELECT query_id, trim(CASE WHEN contains(q, 'where ') OR regexp_matches(question, '\\b(in|from) [A-Z][a-z]+') THEN 'activity_location ' ELSE '' END || CASE WHEN contains(q, 'workshop') OR contains(q, 'event') THEN 'event_type ' ELSE '' END || CASE WHEN contains(q, 'moved from') THEN 'home_country' ELSE '' END) AS tags, nullif(regexp_extract(question, '\\b(?:in|from) ([A-Z][a-z]+)', 1), '') AS place FROM (SELECT query_id, question, lower(question) AS q FROM (SELECT query_id, replace(replace(question, 'last year', 'at the workshop in Paris'), 'both Anna and Ben visited', 'they moved from') AS question FROM fx_asks))")(
    lambda v: v("fx_asks").select("query_id", F.expr("replace(replace(question, 'last year', 'at the workshop in Paris'), 'both Anna and Ben visited', 'they moved from')").alias("q")).select("query_id", M.shown(C.query_facets(F.col("q"))).alias("tags"), C.location_value(F.col("q")).alias("place"))
)
query("c11_salience_flag", "SELECT message_id, CASE WHEN phrase = 'Thanks, bye!' THEN 'none' WHEN regexp_matches(lower(phrase), '\\b(books?|read|reading|favorites?)\\b') THEN 'media_title_or_recommendation_fact' WHEN contains(phrase, 'hiking') THEN 'activity_or_practice_fact' ELSE 'none' END AS reason FROM fx_phrases")(
    lambda v: v("fx_phrases").select("message_id", C.salience(F.col("phrase")).alias("reason"))
)
_DAY = "strptime(occurred_at, '%d %B, %Y')::DATE"
query("c13_resolve_relative_dates", f"""WITH x AS (SELECT message_id, lower(phrase) AS t, {_DAY} AS d, regexp_extract(lower(phrase), '([0-9]+) (day|week|month|year)s ago', 1) AS n, regexp_extract(lower(phrase), '([0-9]+) (day|week|month|year)s ago', 2) AS u FROM ({_VARIED})),
  c AS (SELECT *, make_date(year(d), month(d), least(day(d), 28)) AS c FROM x)
  SELECT message_id, 'yesterday' AS term, strftime(d - 1, '%-d %B %Y') AS resolved, 'exact_date' AS kind, 'day' AS granularity FROM c WHERE regexp_matches(t, '\\byesterday\\b')
  UNION ALL SELECT message_id, 'last year', CAST(year(d) - 1 AS VARCHAR), 'year', 'year' FROM c WHERE regexp_matches(t, '\\blast year\\b')
  UNION ALL SELECT message_id, n || ' ' || u || 's ago', CASE u WHEN 'day' THEN strftime(d - n::INT, '%-d %B %Y') WHEN 'week' THEN n || ' weeks before ' || strftime(d, '%-d %B %Y') WHEN 'month' THEN strftime(c - to_months(n::INT), '%B %Y') ELSE strftime(c - to_months(12 * n::INT), '%B %Y') END,
    CASE u WHEN 'day' THEN 'exact_date' WHEN 'week' THEN 'relative_span' ELSE 'month_year' END, CASE u WHEN 'day' THEN 'day' WHEN 'week' THEN 'week_span' ELSE 'month' END FROM c WHERE n <> ''""")(
    lambda v: varied(v).select("message_id", F.inline(C.relative_anchors(F.col("phrase"), A.source_date(F.col("occurred_at")))))
)
query("c14_temporal_expression_match", f"WITH x AS (SELECT message_id, regexp_extract(lower(phrase), '([0-9]+ (day|week|month|year)s ago)|last year|yesterday') AS e, lower(phrase) AS p FROM ({_VARIED})), y AS (SELECT message_id, e, CASE message_id % 3 WHEN 0 THEN replace(p, ' ago', ' before') WHEN 1 THEN replace(replace(p, 'last', 'previous'), 'yesterday', 'today') ELSE replace(p, e, '') END AS t FROM x) SELECT message_id, e = '' OR contains(t, e) OR (e LIKE '% ago' AND contains(t, replace(e, ' ago', ' before'))) OR (e = 'last year' AND contains(t, 'previous year')) AS same FROM y")(
    lambda v: _matches(varied(v))
)


def _matches(x):
    e = F.regexp_extract(F.lower("phrase"), "([0-9]+ (day|week|month|year)s ago)|last year|yesterday", 0)
    p = F.lower("phrase")
    t = F.when(F.col("message_id") % 3 == 0, F.replace(p, F.lit(" ago"), F.lit(" before"))).when(F.col("message_id") % 3 == 1, F.replace(F.replace(p, F.lit("last"), F.lit("previous")), F.lit("yesterday"), F.lit("today"))).otherwise(F.replace(p, e, F.lit("")))
    return x.select("message_id", C.temporal_match(e, t).alias("same"))


_LEXICON = "SELECT sample_id, lower(speaker) AS key, min(speaker) AS surface FROM fx_note_claims GROUP BY 1, 2 UNION SELECT sample_id, lower(w) AS key, min(w) FROM (SELECT sample_id, unnest(regexp_extract_all(source_text, '\\b[A-Z][a-z]+\\b')) AS w FROM fx_note_claims) WHERE lower(w) NOT IN ('the', 'my', 'how', 'which', 'thanks') GROUP BY 1, 2 HAVING count(*) >= 2"
query("c15_entity_lexicon", _LEXICON)(lambda v: M.entity_lexicon(v("fx_note_claims"), S.NO_NAMES))
query("c16_extract_entities", f"WITH l AS ({_LEXICON}), m AS (SELECT c.claim_id, l.surface, strpos(lower(text), key) AS pos FROM fx_note_claims c JOIN l ON l.sample_id = c.sample_id WHERE regexp_matches(lower(text), '\\b' || key || '\\b')) SELECT claim_id, string_agg(surface, ' ' ORDER BY pos, length(surface) DESC, surface) AS names FROM m GROUP BY claim_id")(
    lambda v: M.entities_in(v("fx_note_claims"), M.entity_lexicon(v("fx_note_claims"), S.NO_NAMES), "claim_id").select("claim_id", M.shown("names").alias("names"))
)
query("c21_scoreable_answer_text", "SELECT message_id, phrase AS text FROM fx_phrases")(
    lambda v: v("fx_phrases").select("message_id", C.scoreable_answer(F.concat(F.lit("Sources: D1:2\n"), "phrase", F.lit("\n supporting source : D3:4"))).alias("text"))
)
query("c27_answer_type_check", "SELECT message_id, CASE WHEN regexp_matches(lower(phrase), '\\bhow many\\b') THEN 'count' WHEN regexp_matches(lower(phrase), '^(which|what) \\w+s\\b') THEN 'list' ELSE 'other' END AS kind, CASE WHEN regexp_matches(lower(phrase), '\\bhow many\\b') THEN message_id % 2 = 0 WHEN regexp_matches(lower(phrase), '^(which|what) \\w+s\\b') THEN message_id % 4 = 0 ELSE TRUE END AS fits FROM (SELECT message_id, phrase FROM fx_phrases)")(
    lambda v: v("fx_phrases").select("message_id", C.expected_type(F.col("phrase")).alias("kind"), F.when(F.col("message_id") % 4 == 0, "Oslo and 3 others").when(F.col("message_id") % 2 == 0, "twice").otherwise("some").alias("a")).select("message_id", "kind", C.type_matches(F.col("kind"), F.col("a")).alias("fits"))
)
query("c25_time_question", f"WITH x AS (SELECT message_id, lower({_SP.format('phrase')}) AS p FROM ({_VARIED})) SELECT message_id, regexp_matches(p, '^when\\b|\\bwhat (date|month|year|day)\\b|\\bwhich day\\b') AS asks, array_to_string(list_distinct(list_concat(regexp_extract_all(p, '\\btoday\\b'), regexp_extract_all(p, '\\byesterday\\b'), regexp_extract_all(p, '\\btomorrow\\b'), regexp_extract_all(p, '\\b[0-9]{{1,2}}\\s+days?\\s+ago\\b'), regexp_extract_all(p, '\\blast week\\b'))), '|') AS terms FROM x".replace("{{", "{").replace("}}", "}"))(
    lambda v: varied(v).select("message_id", T.is_time_question(F.col("phrase")).alias("asks"), F.array_join(T.relative_times(F.col("phrase")), "|").alias("terms"))
)
query("a6_gold_refs", "SELECT message_id, array_to_string(CASE WHEN message_id % 8 = 5 THEN list_distinct(regexp_extract_all(phrase, '\\bD\\d+:\\d+\\b')) WHEN message_id % 8 = 0 THEN ['D9:9'] ELSE [] END, ' ') AS refs FROM fx_phrases")(
    lambda v: v("fx_phrases").select("message_id", M.shown(A.first_refs(F.col("phrase"), F.when(F.col("message_id") % 8 == 0, "evidence D9:9, D9:9"), F.lit(None).cast("string"))).alias("refs"))
)
query("a4_parse_transcript", """WITH l AS (SELECT sample_id, message_id AS pos, 'DATE: ' || occurred_at AS line FROM fx_phrases WHERE message_id % 16 = 0 UNION ALL SELECT sample_id, message_id, phrase FROM fx_phrases WHERE message_id % 8 = 5),
  h AS (SELECT *, regexp_extract(line, '^DATE: (.*)$', 1) AS d, regexp_extract(line, '^\\[(D\\d+:\\d+)\\] ([^:]+): (.*)$', 1) AS ref, regexp_extract(line, '^\\[(D\\d+:\\d+)\\] ([^:]+): (.*)$', 2) AS who, regexp_extract(line, '^\\[(D\\d+:\\d+)\\] ([^:]+): (.*)$', 3) AS said FROM l),
  c AS (SELECT *, last_value(nullif(d, '') IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS day FROM h) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS turn_index, ref AS source_ref, who AS speaker, 'user' AS role, said AS content, day AS occurred_at FROM c WHERE ref <> ''""")(
    lambda v: M.parse_transcript(_lines(v))
)


def _lines(v):
    p = v("fx_phrases")
    lines = p.where("message_id % 16 = 0").select("sample_id", F.col("message_id").alias("at"), F.concat(F.lit("DATE: "), "occurred_at").alias("line")).unionByName(p.where("message_id % 8 = 5").select("sample_id", F.col("message_id").alias("at"), F.col("phrase").alias("line")))
    return lines.groupBy("sample_id").agg(F.array_join(M.ordered(F.col("line"), "at"), "\n").alias("text"))

