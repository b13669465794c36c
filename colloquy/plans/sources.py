"""Queries of the readers over lines made from the tables, with DuckDB SQL written from the definitions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import functions as F

from ..functions.answers import answer_items
from ..functions.text import keywords
from ..operators import memory as M
from ..operators import results as X
from ..sources import readers as S
from .build import _SUMMARY, _SUMTEXT, TEMPLATE, summary
from .registry import _JUDGE, _KEYS, query
from .reports import _ITEMS
from .scoring import _OVER, _P, ranked, signals


def dialogue_lines(v):
    """Lines of JSON with categories, images and some that are broken."""
    a = v("fx_asks")
    fields = F.struct(F.col("sample_id").cast("string").alias("sample_id"), F.col("query_id").cast("string").alias("qa_uid"), "question", F.lit("x").alias("answer"), F.array(F.lit("D1:1"), F.lit("D2:2")).alias("evidence"), (F.floor(F.col("query_id") / 4) % 7).cast("int").alias("category"), F.when(F.col("query_id") % 3 == 0, "odd").otherwise("even").alias("category_name"), F.when(F.col("query_id") % 5 == 0, F.struct(F.lit("u").alias("image_url"))).alias("extra"))
    return a.select(F.when(F.col("query_id") % 11 == 0, "{broken").otherwise(F.to_json(fields)).alias("value"))


query("a1_scan_dialogue_jsonl", "SELECT CASE WHEN query_id % 11 <> 0 THEN CAST(query_id AS VARCHAR) END AS qa_uid, CASE WHEN query_id % 11 <> 0 THEN 2 END AS evidence, CASE WHEN query_id % 11 = 0 THEN 'unreadable' WHEN query_id % 5 = 0 THEN 'structured_image' END AS excluded FROM fx_asks WHERE query_id % 11 = 0 OR CAST(floor(query_id / 4) AS BIGINT) % 7 <> 5")(
    lambda v: S.dialogue_samples(dialogue_lines(v)).select("qa_uid", F.when(F.col("evidence").isNotNull(), F.size("evidence")).alias("evidence"), "excluded")
)


def items(v):
    m = v("fx_messages").groupBy("sample_id").agg(M.ordered(F.struct("role", "content"), "turn_index").alias("messages"))
    return m.select(F.to_json(F.struct(F.col("sample_id").cast("string").alias("id"), "messages", F.struct((F.col("sample_id") % 4).cast("string").alias("scene")).alias("meta"), F.when(F.col("sample_id") % 6 == 1, "input_image").alias("type"))).alias("value"))


query("a2_scan_multiturn_json", "SELECT CAST(sample_id AS VARCHAR) AS id, count(*) AS messages, CASE sample_id % 4 WHEN 1 THEN 'home' WHEN 2 THEN 'work' WHEN 3 THEN 'travel' END AS scene, CASE WHEN sample_id % 4 = 0 THEN 'unknown_scene' WHEN sample_id % 6 = 1 THEN 'structured_image' END AS excluded FROM fx_messages GROUP BY sample_id")(
    lambda v: S.multiturn_items(items(v)).select("id", F.size("messages").alias("messages"), "scene", "excluded")
)
_KEYS_OF_IMAGES = "'image', 'images', 'image_url', 'image_urls', 'image_path', 'image_paths', 'photo', 'photos', 'picture', 'pictures', 'attachment', 'attachments'"
_TREE = f"SELECT DISTINCT p.query_id FROM (SELECT query_id, CASE WHEN json_valid(payload) THEN payload ELSE 'null' END AS j FROM fx_payloads) p, json_tree(p.j) t WHERE CAST(t.key AS VARCHAR) IN ({_KEYS_OF_IMAGES}) OR (CAST(t.key AS VARCHAR) = 'type' AND t.type = 'VARCHAR' AND lower(t.atom ->> '$') IN ('image', 'image_url', 'input_image', 'input_image_url', 'image_path', 'photo', 'picture'))"
query("a3_structured_image_filter", f"SELECT query_id, query_id IN ({_TREE}) AS image FROM fx_payloads")(
    lambda v: S.image_payloads(v.table("fx_payloads"), "query_id", "payload", _levels(v)).withColumnRenamed("id", "query_id")
)


def _levels(v):
    n = count()
    return lambda df: v.once(f"payload_level_{next(n)}", lambda: df)


def predictions(v):
    a = v("fx_note_answers").where("query_id % 7 <> 0")
    p = a.selectExpr("query_id AS id", "concat(' ', answer_text) AS prediction", "CASE WHEN query_id % 13 = 0 THEN 'other' ELSE question END AS query")
    return p.unionByName(p.where("id % 11 = 0")).unionByName(p.where("id % 17 = 0").withColumn("id", -F.col("id")))


query("a11_import_baseline_answers", "SELECT query_id, CASE WHEN query_id % 7 <> 0 THEN answer_text END AS answer, CASE WHEN query_id % 7 = 0 THEN 'missing' WHEN query_id % 11 = 0 THEN 'duplicate' WHEN query_id % 13 = 0 THEN 'question_mismatch' ELSE 'ok' END AS state FROM fx_note_answers UNION ALL SELECT -query_id, answer_text, 'unknown' FROM fx_note_answers WHERE query_id % 7 <> 0 AND query_id % 17 = 0")(
    lambda v: S.baseline_answers(predictions(v), v("fx_note_answers"))
)
query("a12_load_audit_labels", "SELECT message_id, CASE message_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS label FROM fx_phrases")(lambda v: v("fx_phrases").select("message_id", S.tri_state(F.element_at(F.array(F.lit(" Yes "), F.lit("no"), F.lit(""), F.lit("maybe")), (F.col("message_id") % 4 + 1).cast("int"))).alias("label")))


def _report(v):
    o = v("fx_outcomes")
    runs = o.groupBy(F.col("variant").alias("run_id")).agg(F.count(F.lit(1)).alias("queries"), F.when(F.substring(F.first("variant"), 2, 1).cast("int") % 2 == 0, "even").otherwise("odd").alias("mode"))
    wide = o.groupBy(F.col("variant").alias("run_id")).agg(F.round(F.avg(X.judge_score(F.col("verdict"))), 9).alias("judge"), F.round(F.avg("token_f1"), 6).alias("f1"))
    return S.run_report(runs, wide.unpivot("run_id", ["judge", "f1"], "metric", "value").withColumn("level", F.lit("overall")), {"mode": "odd"}, ["judge", "f1"], "judge", most=3)


query("a16_run_registry_report", f"SELECT variant AS run_id, count(*) AS queries, 'odd' AS mode, round(avg({_JUDGE}), 9) AS judge, round(avg(token_f1), 6) AS f1 FROM fx_outcomes WHERE substr(variant, 2, 1)::INT % 2 = 1 GROUP BY variant ORDER BY judge DESC NULLS LAST, run_id LIMIT 3")(_report)


def text_only(v):
    a = v("fx_note_answers")
    q = F.element_at(F.array(F.lit("What does the sign say?"), F.lit("How many cats are in the photo?"), F.lit("What color is it?"), F.lit("Who came?")), (F.floor(F.col("query_id") / 2) % 4 + 1).cast("int"))
    return S.text_only_flags(a.select("query_id", q.alias("question"), answer_items(F.col("gold_answer")).alias("gold_items"), F.col("answer_text").alias("evidence"), (F.floor(F.col("query_id") / 8) % 2 == 0).alias("has_image")))


_TEXT = f"WITH x AS (SELECT query_id, CASE CAST(floor(query_id / 2) AS BIGINT) % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'count' WHEN 2 THEN 'attribute' END AS visual, CAST(floor(query_id / 8) AS BIGINT) % 2 = 0 AS img, len(list_filter({_ITEMS.format('gold_answer')}, lambda i: NOT contains(lower(answer_text), lower(i)))) > 0 AS gone FROM fx_note_answers), f AS (SELECT query_id, CASE WHEN gone AND img AND visual IS NOT NULL THEN 'excluded' WHEN gone AND img THEN 'ambiguous' ELSE 'kept' END AS state, visual FROM x)"
query("b9_text_only_filter", f"{_TEXT} SELECT * FROM f")(text_only)
query("b10_text_only_summary", f"{_TEXT} SELECT state, visual, count(*) AS n, coalesce(string_agg(CAST(query_id AS VARCHAR), ' ' ORDER BY query_id) FILTER (state = 'excluded'), '') AS ids FROM f GROUP BY state, visual")(lambda v: S.text_only_summary(text_only(v)).withColumn("ids", M.shown("ids")))

query("k14_family_ranking_fields", f"WITH {_P}, {_OVER} SELECT r.query_id, round(max(g.fs) FILTER (rank <= 3), 9)::DOUBLE AS best_selected, round(avg(g.fs) FILTER (rank <= 3), 9)::DOUBLE AS mean_selected, round(max(g.fs), 9)::DOUBLE AS best_of_all, count(*) FILTER (rank <= 3 AND g.mm > 0) AS mismatched FROM ranked r JOIN g ON g.query_id = r.query_id AND g.trajectory_id = r.trajectory_id GROUP BY r.query_id")(
    lambda v: X.family_fields(ranked(v), 3)
)
query("k15_metadata_term_diagnostics", f"WITH {_SUMMARY}, l AS (SELECT trajectory_id, arg_max(text, version) AS latest FROM fx_note_claims GROUP BY 1), t AS (SELECT su.trajectory_id, {_SUMTEXT} AS text FROM su JOIN l ON l.trajectory_id = su.trajectory_id) SELECT term, count(*) FILTER (list_contains(regexp_extract_all(lower(text), '[a-z]+'), term)) AS in_text, count(*) FILTER (list_contains({_KEYS.format('text')}, term)) AS in_keywords FROM t, (SELECT unnest(['who', 'what', 'kinds', 'latest', 'anna', 'is']) AS term) GROUP BY term")(
    # keywords as they are before the template's words are taken out
    lambda v: X.template_leaks(_summaries(v).withColumn("keywords", M.shown(keywords(F.col("text")))), [*TEMPLATE, "anna", "is"])
)


def _summaries(v):
    from ..operators.build import retrieval_summary

    return retrieval_summary(summary(v), signals(v).select("trajectory_id", "latest"), TEMPLATE)


query("k17_reflection_diagnostics", "WITH r AS (SELECT query_id, bool_or(task = 'answer_repair') AS tried, bool_or(task = 'answer_repair' AND completion_tokens > 50) AS used FROM fx_calls WHERE query_id IS NOT NULL GROUP BY 1), x AS (SELECT o.variant, o.verdict, coalesce(tried, FALSE) AS tried, coalesce(used, FALSE) AS used FROM fx_outcomes o LEFT JOIN r ON r.query_id = o.query_id) SELECT variant, count(*) AS queries, count(*) FILTER (tried) AS attempted, count(*) FILTER (used) AS used, count(*) FILTER (used AND verdict = 'correct') AS rescued, round(avg((verdict = 'correct')::INT) FILTER (tried), 9) AS correct_if_attempted, round(avg((verdict = 'correct')::INT) FILTER (NOT tried), 9) AS correct_otherwise FROM x GROUP BY variant")(
    lambda v: X.reflection(v("fx_outcomes"), v("fx_calls"))
)
