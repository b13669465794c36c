"""Sectioned model outputs as rows: top fields, claims, operations and list items, and a reject table with line and reason.

A text is cut into lines; which block of reasoning and which section a line belongs to is carried forward by windows over the lines
of its output, so that one pass classifies every line of every output. A record that does not parse gets one repair (another
bullet, colons for equals signs); what still does not is a reject. No line is lost: each line has exactly one row.

Kinds: ``field``, ``claim``, ``op``, ``item``, ``header``, ``skipped`` (reason blank, reasoning, preamble, no_memory) and ``reject``; an output
that lacks a required field has a reject more on line 0 for each. Null and empty texts are one blank line; repeated ids with
different texts count as one output each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that an output must have, states of a claim with their other names, and kinds of operations.
REQUIRED = ["SUMMARY_CONTENT", "CONTEXT", "KEYWORDS"]
STATUSES = ["active", "deprecated", "contradictory", "needs-confirmation"]
ALIASES = {
    "confirmed": "active", "confirm": "active", "needs confirmation": "needs-confirmation", "needs_confirmation": "needs-confirmation", "pending confirmation": "needs-confirmation",
    "pending_confirmation": "needs-confirmation", "pending-confirmation": "needs-confirmation", "contradiction": "contradictory", "conflicted": "contradictory",
}
OPS = ["ADD", "REVISE", "DEPRECATE"]
_TOP = r"^\s*[A-Z][A-Z0-9_ ]*\s*:"
_PAIRS = "array<struct<key: string, value: string>>"


def _pairs(parts: Column) -> Column:
    """key=value parts as pairs; null if one has no equals sign."""
    cut = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"(?s)^([^=]*)=(.*)$", 1)).alias("key"), F.trim(F.regexp_extract(p, r"(?s)^([^=]*)=(.*)$", 2)).alias("value")))
    return F.when(F.forall(parts, lambda p: p.contains("=")), cut)


def _value(key: str) -> Column:
    """The last value that a record gives for a key; null without it."""
    return F.get(F.transform(F.filter("pairs", lambda p: p["key"] == key), lambda p: p["value"]), F.size(F.filter("pairs", lambda p: p["key"] == key)) - 1)


def _list(text: Column) -> Column:
    """Comma-separated names; none for "none"."""
    return F.when(text.isNull() | (F.lower(text) == "none"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def parsed_lines(outputs: DataFrame, id_col: str = "output_id", text_col: str = "text") -> DataFrame:
    """(output_id, line, kind, section, key, value, status, sources, op, target, reason, repaired) of every line.

    ``line`` counts from 1; ``key`` and ``value`` hold a field, ``value`` the text of a claim, an item or a skipped or rejected
    line, or the rationale of an operation.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = outputs.select(F.col(id_col).alias("output_id"), F.xxhash64(text).alias("of"), F.trim(text).alias("whole"), F.posexplode(F.split(text, r"\r?\n")).alias("at", "raw"))
    line = F.rtrim(F.regexp_replace("raw", r"(?i)<think\b[^>]*>.*?</think>", ""))
    x = x.withColumn("said", line)
    bare = F.lower(F.trim("said"))
    begins = F.col("said").rlike(r"^\s*\[.*\]\s*$") | F.col("said").rlike(_TOP)
    event = F.when(bare.contains("</think>"), "close").when(bare.startswith("<think"), "open").when(begins, "start")
    so_far = Window.partitionBy("output_id", "of").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("event", event).withColumn("state", F.last("event", ignorenulls=True).over(so_far))
    thinks = F.coalesce((F.col("state") == "open") | (F.col("event") == "close"), F.lit(False))
    x = x.withColumn("thinks", thinks).withColumn("seen", F.coalesce(F.max(F.when(~F.col("thinks"), (F.col("event") == "start").cast("int"))).over(so_far), F.lit(0)) == 1)
    skip = F.when(F.col("whole") == "NO_MEMORY", "no_memory").when(bare == "", "blank").when(F.col("thinks"), "reasoning").when(~F.col("seen"), "preamble")
    x = x.withColumn("skip", skip)
    header = F.when(F.col("skip").isNull() & F.col("said").rlike(r"^\[.*\]$"), F.regexp_extract("said", r"^\[(.*)\]$", 1))
    x = x.withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(so_far))
    # a record as it should be, and as one repair makes it
    strict = F.when(F.col("said").startswith("- "), _pairs(F.split(F.substring("said", 3, 1 << 30), r" \| ")))
    body = F.regexp_replace("said", r"^\s*(?:[-*•]|\d+[.)])\s*", "")
    mended = _pairs(F.transform(F.split(body, r"\s*\|\s*"), lambda p: F.when(p.contains("="), p).otherwise(F.regexp_replace(p, r"^([A-Za-z_]+)\s*:\s*", "$1="))))
    record = F.col("skip").isNull() & F.col("header").isNull() & F.col("section").isin("CLAIMS", "OPS")
    x = x.withColumn("strict", F.when(record, strict)).withColumn("mended", F.when(record & F.col("strict").isNull(), mended)).withColumn("pairs", F.coalesce("strict", "mended").cast(_PAIRS))
    given = F.lower(F.trim(_value("status")))
    status = given
    for name, means in ALIASES.items():
        status = F.when(given == name, means).otherwise(status)
    x = x.withColumns({"status": F.when(F.col("section") == "CLAIMS", status), "op": F.when(F.col("section") == "OPS", F.upper(_value("op"))), "said_text": _value("text"), "target": _value("target_claim_id"), "rationale": _value("rationale"), "sources": _list(_value("source_message_ids"))})
    claim, op = F.col("section") == "CLAIMS", F.col("section") == "OPS"
    colon = F.instr("said", ":") > 0
    reason = (
        F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("header").isNotNull(), None)
        .when(F.col("section").isNull(), F.when(~colon, "malformed_top_field"))
        .when(record & F.col("pairs").isNull(), F.when(F.col("said").startswith("- "), "malformed_pipe_record").otherwise("malformed_list_record"))
        .when(claim & F.col("status").isNull(), "missing_record_key:status").when(claim & F.col("said_text").isNull(), "missing_record_key:text").when(claim & ~F.col("status").isin(STATUSES), "invalid_claim_status")
        .when(op & F.col("op").isNull(), "missing_record_key:op").when(op & F.col("target").isNull(), "missing_record_key:target_claim_id").when(op & ~F.col("op").isin(OPS), "invalid_op_type")
        .when(~claim & ~op & ~F.col("said").startswith("- "), "malformed_list_record")
    )
    x = x.withColumn("reason", reason)
    kind = F.when(F.col("skip").isNotNull(), "skipped").when(F.col("header").isNotNull(), "header").when(F.col("reason").isNotNull(), "reject").when(F.col("section").isNull(), "field").when(claim, "claim").when(op, "op").otherwise("item")
    x = x.withColumn("kind", kind)
    k = F.col("kind")
    value = F.when(k == "field", F.trim(F.regexp_extract("said", r"^[^:]*:(.*)$", 1))).when(k == "claim", F.col("said_text")).when(k == "op", F.coalesce("rationale", F.lit("none given"))).when(k == "item", F.trim(F.substring("said", 3, 1 << 30))).otherwise(F.col("raw"))
    good = k.isin("claim", "op")
    return x.select(
        "output_id", "of", (F.col("at") + 1).alias("line"), "kind", "section", F.when(k == "field", F.trim(F.regexp_extract("said", r"^([^:]*):", 1))).alias("key"), value.alias("value"), F.when(k == "claim", F.col("status")).alias("status"),
        F.when(good, F.col("sources")).alias("sources"), F.when(k == "op", F.col("op")).alias("op"), F.when(k == "op", F.col("target")).alias("target"), "reason", (good & F.col("strict").isNull()).alias("repaired"),
    )


def parsed_outputs(outputs: DataFrame, id_col: str = "output_id", text_col: str = "text", required: list[str] = REQUIRED) -> DataFrame:
    """``parsed_lines`` and, for outputs that say something, a reject on line 0 for each required field that is missing."""
    x = parsed_lines(outputs, id_col, text_col)
    per = x.groupBy("output_id", "of").agg(F.bool_or(~F.coalesce(F.col("reason") == "no_memory", F.lit(False))).alias("says"), F.collect_set(F.when(F.col("kind") == "field", F.col("key"))).alias("have"))
    lost = per.where("says").select("output_id", "of", F.explode(F.array_except(F.array(*map(F.lit, required)), "have")).alias("key"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = lost.select("output_id", "of", F.lit(0).alias("line"), F.lit("reject").alias("kind"), none("string").alias("section"), "key", none("string").alias("value"), none("string").alias("status"), none("array<string>").alias("sources"), none("string").alias("op"), none("string").alias("target"), F.lit("missing_field").alias("reason"), F.lit(False).alias("repaired"))
    return x.unionByName(rows).drop("of")
