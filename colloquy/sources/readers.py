"""Readers of dialogue files, predictions, labels and run registries, and writers of results.

Each reader takes lines or rows as a DataFrame, so that files of any number are read by Spark; ``*_files`` read paths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The category of a dialogue question that is left out, and scene codes with their tags.
DROPPED_CATEGORY = 5
SCENES = {"1": "home", "2": "work", "3": "travel"}
DIALOGUE = "sample_id string, qa_uid string, question string, answer string, evidence array<string>, category int, category_name string, full_conversation string"
MULTITURN = "id string, messages array<struct<role:string,content:string>>, test_point string, meta struct<scene:string>"
# Keys and types that make a JSON object an image.
IMAGE_KEYS = ["image", "images", "image_url", "image_urls", "image_path", "image_paths", "photo", "photos", "picture", "pictures", "attachment", "attachments"]
IMAGE_TYPES = ["image", "image_url", "input_image", "input_image_url", "image_path", "photo", "picture"]


def image_payloads(payloads: DataFrame, id_col: str, text_col: str, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(id, image): whether a JSON text has, at any depth, an object with an image key or an image type; strings are not looked
    into, and a text that is null or no JSON has none. Rows of one id count together; a null id has no image.

    Texts are parsed to VARIANT; each round looks at one level of what is left and opens the next, until nothing is left to
    open. A text with an image leaves at once. ``stage`` may write a level, so that deep texts don't make long plans.
    """
    ids = payloads.select(F.col(id_col).alias("id"))
    level = payloads.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(text_col).cast("string")).alias("v"))
    found = None
    v = F.col("v")
    while True:
        kind = F.schema_of_variant(v)
        object_ = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
        keyed = reduce(lambda a, b: a | b, (F.variant_get(v, f"$.{k}", "variant").isNotNull() for k in IMAGE_KEYS))
        typed = F.coalesce(F.schema_of_variant(F.variant_get(v, "$.type", "variant")) == "STRING", F.lit(False)) & F.lower(F.try_variant_get(v, "$.type", "string")).isin(list(IMAGE_TYPES))
        level = stage(level.where(v.isNotNull() & F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False))).withColumn("hit", object_ & F.coalesce(keyed | typed, F.lit(False))))
        hits = level.where("hit").select("id").distinct()
        found = hits if found is None else found.unionByName(hits)
        if level.isEmpty():
            break
        rest = level.join(hits, "id", "left_anti")
        level = rest.lateralJoin(rest.sparkSession.tvf.variant_explode(F.col("v").outer())).select("id", F.col("value").alias("v"))
    return ids.join(found.distinct().withColumn("image", F.lit(True)), "id", "left").select("id", F.coalesce("image", F.lit(False)).alias("image"))


def holds_image(text: Column) -> Column:
    """True if a JSON text has, at any depth, an object with an image key or an image type; strings are not looked into."""
    quoted = F.regexp_replace(text, r'\\.', "")  # escaped quotes would end a string too early
    bare = F.regexp_replace(quoted, r':\s*"(?!(?:' + "|".join(IMAGE_TYPES) + r')")[^"]*"', ':""')
    return F.coalesce(bare.rlike('"(?:' + "|".join(IMAGE_KEYS) + r')"\s*:') | bare.rlike(r'"type"\s*:\s*"(?:' + "|".join(IMAGE_TYPES) + ')"'), F.lit(False))


def dialogue_samples(lines: DataFrame, subset: str | None = None) -> DataFrame:
    """(value) lines of JSON -> samples without the dropped category, of one subset if it is named, with ``excluded``, the
    reason why a row cannot be asked: an image in it, or a line that is no JSON."""
    x = lines.select("value", F.from_json("value", DIALOGUE).alias("j"))
    reason = F.when(F.col("j.sample_id").isNull(), "unreadable").when(holds_image(F.col("value")), "structured_image")
    x = x.select("j.*", reason.alias("excluded")).where(F.coalesce(F.col("category") != DROPPED_CATEGORY, F.lit(True)))
    return x.where(F.col("category_name") == subset) if subset else x


def dialogue_files(spark: SparkSession, paths: list[str], subset: str | None = None) -> DataFrame:
    return dialogue_samples(spark.read.text(paths), subset)


def multiturn_items(items: DataFrame) -> DataFrame:
    """(value) JSON items -> (id, messages, scene, excluded): the scene's tag; unknown scenes and images are excluded."""
    tags = F.create_map(*(x for k, v in SCENES.items() for x in (F.lit(k), F.lit(v))))
    x = items.select("value", F.from_json("value", MULTITURN).alias("j")).select("value", "j.*")
    scene = tags[F.col("meta.scene")]
    reason = F.when(F.col("id").isNull(), "unreadable").when(scene.isNull(), "unknown_scene").when(holds_image(F.col("value")), "structured_image")
    return x.select("id", "messages", scene.alias("scene"), reason.alias("excluded"))


def multiturn_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON array files, item by item."""
    whole = spark.read.text(paths, wholetext=True)
    return multiturn_items(whole.select(F.explode(F.from_json("value", "array<string>")).alias("value")))


def baseline_answers(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Predictions under any of the usual column names, aligned with the queries (query_id, question, gold_answer): one row per
    query or prediction with its state: ok, missing, unknown, duplicate, question_mismatch or gold_mismatch."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in have), F.lit(None).cast("string"))
    p = rows.select(first("query_id", "id", "qid").cast("long").alias("query_id"), first("answer", "prediction", "output").alias("answer"), first("question", "query").alias("asked"), first("gold", "reference", "gold_answer").alias("told"))
    p = p.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("answer").alias("answer"), F.min("asked").alias("asked"), F.min("told").alias("told"))
    x = queries.select("query_id", "question", "gold_answer").withColumn("known", F.lit(True)).join(p, "query_id", "full_outer")
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("asked") != F.col("question"), "question_mismatch").when(F.col("told") != F.col("gold_answer"), "gold_mismatch").otherwise("ok")
    return x.select("query_id", F.trim("answer").alias("answer"), state.alias("state"))


def tri_state(text: Column) -> Column:
    """True, false or null of a label's text."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes", "y", "supported", "correct"), True).when(t.isin("false", "0", "no", "n", "unsupported", "incorrect"), False)


def run_report(runs: DataFrame, metrics: DataFrame, where: dict[str, object], names: list[str], sort: str, descending: bool = True, most: int = 20) -> DataFrame:
    """Runs that equal all of ``where``, with their overall metrics as columns, sorted by one; the limit is the report's."""
    x = runs
    for column, value in where.items():
        x = x.where(F.col(column) == value)
    wide = metrics.where("level = 'overall'").groupBy("run_id").pivot("metric", names).agg(F.max("value"))
    by = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return x.join(wide, "run_id", "left").orderBy(by, "run_id").limit(most)


def write_rows(frame: DataFrame, path: str, columns: list[str], kind: str = "json", append: bool = False) -> None:
    """A table in a fixed order of columns as JSON lines, CSV or Parquet, replaced or added to."""
    frame.select(*columns).write.mode("append" if append else "overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def write_memories(snapshots: DataFrame, claims: DataFrame, path: str) -> None:
    """One JSON document per trajectory with its snapshots and their claims, in a folder for each sample."""
    c = claims.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "status", "text"))).alias("claims"))
    s = F.struct("version", "snapshot_id", F.col("content").alias("text"), "claims")
    x = snapshots.join(c, "snapshot_id", "left").groupBy("sample_id", "trajectory_id").agg(F.sort_array(F.collect_list(s)).alias("snapshots"))
    x.write.mode("overwrite").partitionBy("sample_id").json(path)


def text_only_flags(rows: DataFrame) -> DataFrame:
    """(query_id, question, gold_items, evidence, has_image): whether a question cannot be answered from text: excluded if a
    gold item is missing from the evidence, an image is shared there, and it asks for what is seen; else ambiguous or kept."""
    q = F.lower("question")
    visual = F.when(q.rlike(r"\b(sign|written|says|text on)\b"), "ocr").when(q.rlike(r"\bhow many\b.*\b(photo|picture|image)\b"), "count").when(q.rlike(r"\b(color|shape|wearing)\b"), "attribute").when(q.rlike(r"\b(photo|picture|image|painting)\b"), "object")
    gone = F.exists("gold_items", lambda i: ~F.contains(F.lower("evidence"), F.lower(i)))
    state = F.when(gone & F.col("has_image") & visual.isNotNull(), "excluded").when(gone & F.col("has_image"), "ambiguous").otherwise("kept")
    return rows.select("query_id", state.alias("state"), visual.alias("visual"))


def text_only_summary(flags: DataFrame) -> DataFrame:
    """Per state and visual type its queries, and the ids of those excluded."""
    return flags.groupBy("state", "visual").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("state") == "excluded", F.col("query_id")))).alias("ids"))
