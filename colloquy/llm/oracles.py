r"""DuckDB SQL for the queries that SQL can express, written from the definitions: exact quantiles where the operator
merges sketches, all pairs of shingle sets where it filters candidates."""

_WORD = r"[^\x20\x09-\x0D]+"

_BEYOND = "{x} > q.{m}[3] * pow(greatest(q.{m}[3] / q.{m}[1], 1.02::DOUBLE), {k})"
_FOUR = "quantile_disc(ms, [0.25, 0.5, 0.75]) AS ms, quantile_disc(ml, [0.25, 0.5, 0.75]) AS ml, quantile_disc(mr, [0.25, 0.5, 0.75]) AS mr, quantile_disc(mc, [0.25, 0.5, 0.75]) AS mc"
_FITS = "CASE WHEN {t}.{m}[1] < {t}.{m}[3] THEN {t}.{m} END"
_BLEND = "CASE WHEN {own} IS NULL THEN {up} WHEN {up} IS NULL THEN {own} ELSE [pow({own}[1], {n} / ({n} + 16)) * pow({up}[1], 16 / ({n} + 16)), pow({own}[2], {n} / ({n} + 16)) * pow({up}[2], 16 / ({n} + 16)), pow({own}[3], {n} / ({n} + 16)) * pow({up}[3], 16 / ({n} + 16))] END"
_LEVELS = ", ".join(f"{_FITS.format(t=t, m=m)} AS {t}_{m}" for t in ("own", "up", "a") for m in ("ms", "ml", "mr", "mc"))
_UPPER = ", ".join(f"{_BLEND.format(own=f'up_{m}', up=f'a_{m}', n='n_up')} AS l_{m}" for m in ("ms", "ml", "mr", "mc"))
_PICK = ", ".join(f"{_BLEND.format(own=f'own_{m}', up=f'l_{m}', n='n_own')} AS {m}" for m in ("ms", "ml", "mr", "mc"))

_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT r, unnest(list) AS word, generate_subscripts(list, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{_WORD}') AS list FROM d)),
  g AS (SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five, lead(word, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
  again AS (SELECT r, i FROM g WHERE whole QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
  rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS t(k) GROUP BY r),
  m AS (SELECT r, doc_id, lang, source, len(regexp_extract_all(t, '{_WORD}')) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
  f AS (SELECT r, doc_id, lang, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      (n_symbols + 0.5::DOUBLE) / (n_words + 1) AS ms, (len(lines) - len(list_distinct(lines)) + 0.5::DOUBLE) / (len(list_distinct(lines)) + 0.5::DOUBLE) AS ml,
      (n_repeat_words + 0.5::DOUBLE) / (n_words - n_repeat_words + 0.5::DOUBLE) AS mr, word_chars / nullif(n_words, 0) AS mc FROM m),
  seen AS (SELECT * FROM f WHERE n_words >= 10),
  own AS (SELECT lang, source, count(*) AS n, {_FOUR} FROM seen GROUP BY lang, source),
  up AS (SELECT lang, count(*) AS n, {_FOUR} FROM seen GROUP BY lang),
  a AS (SELECT {_FOUR} FROM seen),
  lv AS (SELECT own.lang, own.source, own.n AS n_own, up.n AS n_up, {_LEVELS} FROM own JOIN up ON own.lang IS NOT DISTINCT FROM up.lang CROSS JOIN a),
  q AS (SELECT lang, source, {_PICK} FROM (SELECT *, {_UPPER} FROM lv))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(
    {_BEYOND.format(x="(word_chars + 10 * q.mc[2]) / (n_words + 10)", m="mc", k=3)} OR (word_chars + 10 * q.mc[2]) / (n_words + 10) < q.mc[1] / pow(greatest(q.mc[3] / q.mc[1], 1.02::DOUBLE), 3), false)
    AND NOT coalesce(n_symbols > 0 AND {_BEYOND.format(x="f.ms", m="ms", k=3)}, false) AND NOT coalesce(n_dup_lines > 0 AND {_BEYOND.format(x="f.ml", m="ml", k=2)}, false) AND NOT coalesce(n_repeat_words > 0 AND {_BEYOND.format(x="f.mr", m="mr", k=3)}, false) AS kept
FROM f LEFT JOIN q ON f.lang IS NOT DISTINCT FROM q.lang AND f.source IS NOT DISTINCT FROM q.source"""


def _level(name: str, parents: str, key: str) -> str:
    """Common table expressions: ``name`` shrunk towards ``parents``, which ``key`` names; one weight for the level."""
    return f"""
  {name}_in AS (SELECT c.*, p.rate AS mu FROM {name}_sums c JOIN {parents} p ON c."{key}" = p."{key}"),
  {name}_part AS (SELECT count(*) - 1 AS free, sum(n) AS t, sum(k) / sum(n) AS p, sum(n * n) AS t2, sum(k * k / n) - sum(k) * sum(k) / sum(n) AS s FROM {name}_in WHERE n > 0 GROUP BY "{key}"),
  {name}_sum AS (SELECT sum(t) AS t, sum(t * p * (1 - p)) / sum(t) AS spread, (sum(s) - sum(free * p * (1 - p))) / nullif(sum(t - t2 / t), 0) AS between_ FROM {name}_part),
  {name}_prior AS (SELECT coalesce(CASE WHEN between_ > 0 THEN greatest(1::DOUBLE, least(t, spread / between_ - 1)) ELSE t END, 1::DOUBLE) AS weight FROM {name}_sum),
  {name} AS (SELECT x.*, weight * mu + k AS alpha, weight * (1 - mu) + n - k AS beta, (weight * mu + k) / (weight + n) AS rate FROM {name}_in x, {name}_prior)"""


_URLS = rf"""
WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
  rest AS (SELECT row_number() OVER () AS r, page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
  x AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
  ruled AS (SELECT r, h || p AS rule, verdict FROM x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) = 1),
  labelled AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
  counted AS (SELECT regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site, count(bad) AS n, count(*) FILTER (bad) AS k FROM x LEFT JOIN labelled ON page_id = doc_id GROUP BY 1),
  parts AS (SELECT *, string_split(site, '.') AS l, regexp_matches(site, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|\[.*\])$') AS ip FROM counted),
  tails AS (SELECT *, array_to_string(l[greatest(1, len(l) - 1):], '.') AS two, array_to_string(l[greatest(1, len(l) - 2):], '.') AS three, regexp_matches(site, '(^|[.])(ac|co|com|edu|go|gob|gov|ltd|me|mil|ne|net|nom|or|org|plc|sch)[.][a-z]{{2}}$') AS deep FROM parts),
  hosts_sums AS (SELECT site, CASE WHEN ip THEN site WHEN deep THEN three ELSE two END AS domain, CASE WHEN ip THEN 'ip' WHEN deep THEN two ELSE l[len(l)] END AS suffix, n, k FROM tails),
  domains_sums AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts_sums GROUP BY ALL),
  suffixes_sums AS (SELECT suffix, '' AS "all", sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains_sums GROUP BY ALL),
  whole AS (SELECT '' AS "all", (sum(k) + 1) / (sum(n) + 2) AS rate FROM suffixes_sums),{_level("suffixes", "whole", "all")},{_level("domains", "suffixes", "suffix")},{_level("hosts", "domains", "domain")},
  known AS (SELECT site, hosts.rate, hosts.rate - 1.645::DOUBLE * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS bound, whole.rate AS usual FROM hosts, whole)
SELECT page_id, x.host, path, rule, coalesce(verdict, CASE WHEN bound > usual THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 9) AS block_rate, round(bound, 9) AS block_bound, round(usual, 9) AS usual_rate
FROM x LEFT JOIN ruled USING (r) LEFT JOIN known ON regexp_replace(regexp_replace(x.host, '^.*@', ''), ':[0-9]*$', '') = known.site"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS list FROM documents),
  w AS (SELECT r, unnest(list) AS word, generate_subscripts(list, 1) AS i, len(list) AS n FROM d),
  g AS (SELECT r, i, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
  s AS (SELECT DISTINCT r, hash(five) AS five FROM g WHERE i = 1 OR i <= n - 4),
  size AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b ON a.five = b.five AND a.r <> b.r GROUP BY ALL),
  links AS (SELECT a, b FROM common c JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
  reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, min(other.doc_id) AS component_id
FROM d JOIN reach ON reach.a = d.r JOIN d other ON other.r = reach.b LEFT JOIN size ON size.r = d.r GROUP BY d.r, d.doc_id, size.n"""

# Plain rounds over rows of one component each; the queries' vectors have 64 components.
_VECTORS = """
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  x AS (SELECT r, d // 4 AS part, d % 4 AS pos, CAST(floor(256 * e[d + 1]::DOUBLE) AS BIGINT) AS x FROM kept, range(64) AS t(d)),
  c0 AS (SELECT part, r AS entry, pos, x AS y FROM x WHERE r < 64),
""" + "".join(f"""  d{k} AS (SELECT x.r, x.part, c.entry, sum((x.x - c.y) * (x.x - c.y)) AS d FROM x JOIN c{k} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL),
  a{k} AS (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY r, part),
""" + (f"""  s{k} AS (SELECT x.part, a.entry, x.pos, sum(x.x) AS s, count(*) AS n FROM x JOIN a{k} a ON a.r = x.r AND a.part = x.part GROUP BY ALL),
  c{k + 1} AS (SELECT c.part, c.entry, c.pos, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), y) AS y FROM c{k} c LEFT JOIN s{k} s ON s.part = c.part AND s.entry = c.entry AND s.pos = c.pos),
""" if k < 2 else "") for k in range(3)) + """  f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256 FROM f JOIN kept USING (r)"""

# The CRC-32 bit by bit, then every pair of equal six-word windows, joined into stretches of one lag.
_BYTES = "list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INT), 1)))"
_RUNS = rf"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, {_BYTES} AS bytes, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * len(bytes)), lambda k: k)), lambda c, k: CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(c, bytes[CAST(k // 8 + 1 AS INT)]::BIGINT) ELSE c END) & 1 = 1
      THEN xor((CASE WHEN k % 8 = 0 THEN xor(c, bytes[CAST(k // 8 + 1 AS INT)]::BIGINT) ELSE c END) >> 1, 3988292384::BIGINT) ELSE (CASE WHEN k % 8 = 0 THEN xor(c, bytes[CAST(k // 8 + 1 AS INT)]::BIGINT) ELSE c END) >> 1 END), 4294967295::BIGINT) AS h FROM b),
  g AS (SELECT *, (h // 10) % len(w) AS a, h // 10 AS g FROM h),
  e AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM g),
  x AS (SELECT r, i, w[i + 1] AS word FROM (SELECT r, w, unnest(range(len(w))) AS i FROM e)),
  six AS (SELECT r, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o) AS k, lead(word, 5) OVER o IS NOT NULL AS whole FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
  p AS (SELECT s.r, s.i, t.i - s.i AS q FROM six s JOIN six t ON t.r = s.r AND t.k = s.k AND t.i > s.i WHERE s.whole AND t.whole AND t.i - s.i <= (SELECT len(w) FROM e WHERE e.r = s.r) // 2),
  st AS (SELECT r, q, min(i) AS s, max(i) + 6 AS t FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM p) GROUP BY r, q, isle),
  ru AS (SELECT r, s, t + q - s AS n, min(q) AS q FROM st WHERE t - s >= greatest(12 - q, q) GROUP BY r, s, t + q - s),
  gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM ru),
  kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN gone ON gone.r = x.r AND gone.i = x.i GROUP BY x.r),
  di AS (SELECT r, count(*) AS n_runs, arg_min((s, n, q), (-n, s, q)) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM ru GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, CAST(1000 * best[2] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, CAST(len(w) AS BIGINT) AS n_words
FROM e LEFT JOIN di ON di.r = e.r LEFT JOIN kept ON kept.r = e.r"""

SQL: dict[str, str] = {"op6_quality_rules": _QUALITY, "op7_url_reputation": _URLS, "op8_ngram_jaccard": _JACCARD, "op11_vector_codes": _VECTORS, "op12_periodic_runs": _RUNS}
