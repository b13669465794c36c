"""What texts say, by a table of rules: exact terms, facets of claims, and what a faithful memory must keep.

All rules of a table meet a text in one pass: an Aho-Corasick automaton over the rules' literals tells which of them can match
at all, and only their patterns are tried. The automaton is made once a task from the collected table, whose size is checked;
texts are never joined with rules, and what is found is cleaned, sorted out and merged by column expressions and groupings.

Null texts say nothing; an empty table gives no row; of equal findings in one text the first stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extraction as X

#: Bytes of a rule table, at most: it is held by every task.
RULE_BYTES = 8 << 20
#: Characters of texts whose findings a task remembers, about: a saying that is said again is not searched again.
KNOWN_CHARS = 2 << 20


class Matcher:
    """All rules of a table, behind an automaton over their literals."""

    def __init__(self, rules: list):
        import ahocorasick

        self.rules, self.always, by = rules, [], {}
        for k, r in enumerate(rules):
            for literal in r["literals"]:
                by.setdefault(literal, []).append(k)
            if not r["literals"]:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, which in by.items():
            self.automaton.add_word(literal, which)
        if by:
            self.automaton.make_automaton()
        self.some = bool(by)
        self.patterns = [re.compile(r["pattern"] or "|".join(rf"\b{re.escape(x)}\b" for x in r["literals"])) for r in rules]

    def hits(self, text: str) -> Iterator[tuple[int, str, str, int]]:
        """(rule, value, span, start) of every match, by rule and place."""
        folded = text.lower()
        tried = set(self.always)
        if self.some:
            for _, which in self.automaton.iter(folded):
                tried.update(which)
        for k in sorted(tried):
            rule = self.rules[k]
            for m in self.patterns[k].finditer(folded if rule["folded"] else text):
                if m.end() > m.start():
                    yield k, rule["value"] if rule["value"] is not None else (m[1] or "") if m.re.groups else m[0], m[0], m.start()
                    if rule["first"]:
                        break


class Remembered:
    """What ``find`` says of a text, asked once for each text among about ``room`` characters of them."""

    def __init__(self, find: Callable[[str], list], room: int = KNOWN_CHARS):
        self.find, self.room, self.left, self.known = find, room, room, {}

    def __call__(self, text: str) -> list:
        if text in self.known:
            return self.known[text]
        said = self.find(text)
        cost = 64 + len(text)
        if cost > self.left:
            self.known, self.left = {}, self.room
        if cost <= self.left:
            self.known[text], self.left = said, self.left - cost
        return said


def rule_hits(texts: DataFrame, rules: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``texts`` but the text, with (rule_id, place, family, category, relation, clean, found, said, span, start, n)
    of every match of every rule: what is found is cleaned as the rule says, ``said`` is the value before that, and ``n`` counts
    the items of a list."""
    size = rules.agg(F.sum(F.length(F.to_json(F.struct(*rules.columns))))).first()[0] or 0
    if size > RULE_BYTES:
        raise ValueError(f"a rule table of {size} bytes is too large for every task to hold: at most {RULE_BYTES}")
    table = [r.asDict() for r in rules.orderBy("place", "rule_id").collect()]
    own = [c for c in texts.columns if c != text_col]
    made = ["rule_id", "place", "family", "category", "relation", "clean", "found", "said", "span", "start", "n"]
    numbers = ("place", "start", "n")

    def found(matcher: Matcher, text: str) -> list[tuple]:
        out = []
        for k, value, span, start in matcher.hits(text):
            r = table[k]
            out += [(r["rule_id"], r["place"], r["family"], kind or r["category"], r["relation"], r["clean"], surface, value, span, start, n) for n, (surface, kind) in enumerate(X.surfaces(r["clean"] or "", value, span, start, text))]
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(table)
        findings = Remembered(lambda text: found(matcher, text))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows, told = [], []
                for row, text in enumerate(part.column(text_col).to_pylist()):
                    now = findings(text) if text else []
                    rows += [row] * len(now)
                    told += now
                held = part.select(own).take(pa.array(rows, pa.int64()))
                columns = [pa.array([t[k] for t in told], pa.int32() if c in numbers else pa.string()) for k, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*held.columns, *columns], [*own, *made])

    schema = T.StructType([texts.schema[c] for c in own] + [T.StructField(c, T.IntegerType() if c in numbers else T.StringType()) for c in made])
    return texts.select(*own, F.col(text_col).cast("string").alias(text_col)).mapInArrow(scan, schema)


def _speakers(sources: DataFrame) -> DataFrame:
    """(owner_id, speakers, first_speaker): lower-cased names, and the first by position as written."""
    name = X.collapsed("speaker")
    named = sources.where(name != "").groupBy("owner_id")
    return named.agg(F.array_sort(F.collect_set(F.lower(name))).alias("speakers"), F.min_by(name, "position").alias("first_speaker"))


def owned_texts(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(owner_id, position, text): a claim's own text at 0, then its source messages."""
    return claims.select("owner_id", F.lit(0).alias("position"), "text").unionByName(sources.select("owner_id", "position", "text"))


def exact_terms(claims: DataFrame, sources: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(owner_id, term, kind, reason): each distinct term (by lower case) of a claim and its sources, the first that says it;
    ``reason`` says why it is discarded, and is null for a kept one.

    ``claims`` has (owner_id, text), ``sources`` (owner_id, position from 1, speaker, text).
    """
    rules = rules if rules is not None else X.rule_table(claims.sparkSession, X.term_rules())
    hits = rule_hits(owned_texts(claims, sources), rules)
    term = F.regexp_replace(X.collapsed("found"), "(?i)(?:'s|’s)\\b", "")
    seen = hits.join(_speakers(sources), "owner_id", "left").select("owner_id", "position", "place", "start", F.col("category").alias("kind"), term.alias("term"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"))
    judged = seen.where(F.col("term") != "").withColumn("reason", X.term_fault(F.col("term"), F.col("kind"), F.col("speakers")))
    # a term that is kept by one rule is kept; else the first finding tells why not
    first = F.struct(F.col("reason").isNotNull(), "position", "place", "start")
    per = judged.groupBy("owner_id", F.lower("term").alias("key")).agg(*(F.min_by(F.struct(c), first)[c].alias(c) for c in ("term", "kind", "reason")))
    return per.select("owner_id", "term", "kind", "reason")


def span_lexicon(messages: DataFrame, least: int = 2) -> DataFrame:
    """(sample_id, key, surface): speakers and capitalised spans that are said ``least`` times or more in a sample, stop spans apart.
    ``messages`` has (sample_id, message_id, speaker, text)."""
    spans = messages.select("sample_id", "message_id", F.posexplode(F.regexp_extract_all("text", F.lit(X.SPAN), F.lit(0))).alias("at", "surface"))
    spans = spans.withColumn("surface", X.collapsed("surface")).where(~X.stop_span(F.col("surface")))
    said = spans.groupBy("sample_id", F.lower("surface").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min_by("surface", F.struct("message_id", "at")).alias("surface")).where(F.col("n") >= least)
    name = X.collapsed("speaker")
    spoke = messages.where((name != "") & ~X.stop_span(name)).groupBy("sample_id", F.lower(name).alias("key")).agg(F.min_by(name, "message_id").alias("surface"))
    both = spoke.withColumn("rank", F.lit(0)).unionByName(said.select("sample_id", "key", "surface").withColumn("rank", F.lit(1)))
    return both.groupBy("sample_id", "key").agg(F.min_by("surface", "rank").alias("surface"))


def entity_mentions(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The columns of ``texts`` but the text, with (surface, start, length): the first place of each entity of the sample's
    lexicon that a text names as whole words, whatever the case.

    Texts meet the lexicon by the first word of an entity, never all by all; the rest is compared at that word's place. Neither
    side is broadcast: words are many times larger than the texts that their size is estimated from.
    """
    own = [c for c in texts.columns if c != "text"]
    word = r"[\p{L}\p{N}_]+"
    first = lexicon.select("sample_id", "key", "surface", F.regexp_extract("key", word, 0).alias("word"))
    lower = F.lower("text")
    # the words of a text with their places: what stands before word i is i words and i gaps
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  computed once a row, not once a word
    both = F.struct(F.regexp_extract_all(lower, F.lit(word), F.lit(0)).alias("words"), F.split(lower, word).alias("gaps"))
    ends = lambda x: F.struct(x["words"].alias("words"), x["gaps"].alias("gaps"), F.aggregate(F.zip_with(x["gaps"], x["words"], lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0))), F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n))).alias("at"))
    placed = let(let(both, ends), lambda x: F.transform(x["words"], lambda w, i: F.struct(w.alias("word"), x["at"][i].alias("at"), x["gaps"][i].alias("gap"))))
    seen = texts.select(*own, lower.alias("lower"), F.explode(placed).alias("p")).select(*own, "lower", F.col("p.word").alias("word"), (F.col("p.at") + F.length("p.gap")).alias("start"))
    met = seen.join(first.hint("merge"), ["sample_id", "word"])
    n = F.length("key")
    after = F.substring(F.col("lower"), F.col("start") + n + 1, F.lit(1))
    hit = met.where((F.substring(F.col("lower"), F.col("start") + 1, n) == F.col("key")) & ~after.rlike(r"[\p{L}\p{N}_]"))
    return hit.groupBy(*own, "surface").agg(F.min("start").alias("start"), F.first(n).alias("length"))


def claim_facets(claims: DataFrame, sources: DataFrame, lexicon: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(owner_id, entity, relation, value, kind, confidence, rule_id, span, reason): facets of claims and their sources, the first of
    each (entity, relation, value). ``reason`` says why one is discarded, or that its entity is (``facet_entity_cleared``).

    The entity is the speaker of a claim about "the user", else the first one that the claim names, else the first speaker,
    else the first that a source names. ``claims`` has (sample_id, owner_id, text).
    """
    rules = rules if rules is not None else X.rule_table(claims.sparkSession, X.facet_rules())
    hits = rule_hits(owned_texts(claims, sources), rules)
    # entities are needed for claims with a facet alone
    some = hits.select("owner_id").distinct()
    texts = owned_texts(claims, sources).join(some, "owner_id", "left_semi").join(claims.select("owner_id", "sample_id"), "owner_id")
    named = entity_mentions(texts, lexicon)
    order = F.struct("position", "start", -F.col("length"), F.lower("surface"))
    by = named.groupBy("owner_id").agg(F.min_by("surface", F.when(F.col("position") == 0, order)).alias("in_claim"), F.min_by("surface", F.when(F.col("position") > 0, order)).alias("in_source"))
    user = F.col("text").rlike(r"(?i)^\s*(?:the\s+)?user\b")
    about = claims.join(some, "owner_id", "left_semi").join(_speakers(sources), "owner_id", "left").join(by, "owner_id", "left")
    about = about.select("owner_id", F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), "first_speaker", F.coalesce(F.when(user, F.col("first_speaker")), "in_claim", "first_speaker", "in_source").alias("who"))
    value = F.regexp_replace(X.collapsed("found"), r"^[ ,.;:!?]+|[ ,.;:!?]+$", "")
    x = hits.join(about, "owner_id").select("owner_id", "position", "place", "start", "rule_id", "relation", F.col("category").alias("kind"), F.col("clean").cast("double").alias("confidence"), value.alias("value"), X.collapsed("span").alias("span"), "speakers", F.regexp_replace("who", "(?i)(?:'s|’s)\\b", "").alias("who"))
    v = F.col("value")
    fault = (
        F.when(v == "", "missing_relation_or_value").when((F.col("relation") == "relationship_status") & (F.lower(v) != "single") | (F.col("relation") == "gender_identity") & (F.lower(v) != "transgender woman"), "unsupported_relation_value")
        .when(F.col("relation").isin("home_country", "activity_location") & ~X.place_like(v), "invalid_place_like_value").when(F.col("relation").isin("research_topic", "art_style", "event_type") & X.low_value(v), "low_value_relation_value")
    )
    cleared = F.col("who").isNotNull() & X.entity_fault(F.col("who"), F.col("speakers"))
    x = x.withColumn("fault", fault).withColumn("reason", F.coalesce("fault", F.when(cleared, "facet_entity_cleared"))).withColumn("entity", F.when(~F.coalesce(cleared, F.lit(False)), F.col("who")))
    first = F.struct("position", "place", "start")
    kept = ["entity", "value", "kind", "confidence", "rule_id", "span", "reason"]
    per = x.groupBy("owner_id", F.lower("entity").alias("e"), "relation", F.lower("value").alias("v"), F.col("fault").isNotNull().alias("f")).agg(*(F.min_by(F.struct(c), first)[c].alias(c) for c in kept))
    return per.select("owner_id", "entity", "relation", *kept[1:])


def must_preserve(messages: DataFrame, by: str = "sample_id") -> DataFrame:
    """What the messages of each group (``by``) say that a memory must keep, one row for each (surface in lower case, category, relation):
    (group, surface, category, relation, message_ids, rule, raw_surface, canonical, action, temporal).

    Rules are those of KEEP, the exact terms and the facets of each message. Findings are merged in the order of messages and
    rules: the first one's words stay, sources are united, and the rule is the first that is no term or facet rule.
    ``messages`` has (group, message_id, speaker, text).
    """
    spark = messages.sparkSession
    texts = messages.select(by, "message_id", "speaker", X.collapsed("text").alias("text")).where(F.col("text") != "")
    when = F.nullif(X.collapsed(F.regexp_extract("whole", X.TEMPORAL, 1)), F.lit(""))
    found = rule_hits(texts.select(by, "message_id", F.col("text").alias("whole"), "text"), X.rule_table(spark, X.keep_rules()))
    found = found.withColumn("temporal", when)
    c, none = F.col("clean"), F.lit(None).cast("string")
    raw = F.regexp_replace(X.collapsed("said"), r"^[ \-:,.!?\"'“”‘’]+|[ \-:,.!?\"'“”‘’]+$", "")
    later = F.nullif(X.collapsed(F.regexp_extract("said", X.TEMPORAL, 1)), F.lit(""))
    listed = c.startswith("list")
    single = found.where(c != "signal").select(
        by, "message_id", "place", "start", "n", F.when(listed, "list_item_pattern").otherwise(F.col("rule_id")).alias("rule_id"), "category", "relation", F.col("found").alias("surface"),
        F.when(c == "roadtrip", X.collapsed(F.regexp_extract("span", r"(?i)^(road\s*trip)", 1))).when(c.isin("accident", "school") | listed | c.startswith("title"), F.col("found")).otherwise(raw).alias("raw"),
        F.when(c.isin("event8", "timed", "roadtrip", "accident", "school"), F.lit(1)).alias("named"),
        F.when(c == "roadtrip", "roadtrip").when(c == "accident", "accident").when(c.isin("event8", "timed6"), F.regexp_extract("span", r"(?i)^(chose\s+to\s+go|\S+)", 1)).alias("action"),
        F.when(c == "roadtrip", F.coalesce(later, "temporal")).when(c.isin("event8", "timed", "timed6", "accident", "school"), F.col("temporal")).alias("temporal"),
    )
    canonical = F.when(F.col("named") == 1, F.col("surface"))
    single = single.withColumn("canonical", canonical).drop("named")
    # a class without its last word; one name for mentoring
    plain = F.trim(F.regexp_replace("surface", r"(?i)\s+(?:class|course|workshop|lesson)$", ""))
    base = single.where("rule_id = 'registered_activity_pattern'").withColumn("base", plain).where((F.col("base") != "") & (F.lower("base") != F.lower("surface")))
    base = base.withColumn("surface", F.col("base")).withColumn("raw", F.col("base")).withColumn("rule_id", F.lit("registered_activity_base_pattern")).drop("base")
    mentor = single.where(F.col("rule_id") == "event_phrase_pattern").where(F.col("surface").rlike(r"(?i)^(?:mentorship|mentoring|mentor)\s+program$") & (F.lower("surface") != "mentoring program"))
    mentor = mentor.withColumns({"surface": F.lit("mentoring program"), "canonical": F.lit("mentoring program"), "rule_id": F.lit("mentoring_program_canonical_alias")})
    # a school event and a talk in one group are a school speech
    school = found.where(F.col("clean").isin("school", "signal")).groupBy(by).agg(F.array_sort(F.collect_set("message_id")).alias("ids"), F.countDistinct("clean").alias("both"), F.min_by("temporal", F.when(F.col("temporal").isNotNull(), F.struct("message_id", "start"))).alias("temporal")).where("both = 2")
    alias = F.explode(F.array(*(F.struct(F.lit(s).alias("surface"), F.lit(r).alias("rule_id"), F.lit(k).alias("n")) for k, (s, r) in enumerate((("school speech", "school_speech_event_alias_pattern"), ("school talk", "school_talk_event_alias_pattern"))))))
    speech = school.select(by, "ids", "temporal", alias.alias("a")).select(by, F.explode("ids").alias("message_id"), F.lit(1 << 20).alias("place"), F.lit(0).alias("start"), F.col("a.n").alias("n"), F.col("a.rule_id").alias("rule_id"), F.lit("event_type").alias("category"), F.lit("event_type").alias("relation"), F.col("a.surface").alias("surface"), F.lit("school event / giving my talk").alias("raw"), F.lit("talk").alias("action"), "temporal", F.col("a.surface").alias("canonical"))

    owners = texts.select(F.struct(by, "message_id").alias("owner_id"), F.lit(1).alias("position"), "speaker", "text")
    nothing = owners.select("owner_id", F.lit(None).cast("string").alias("text"))
    plain_row = lambda x, surface, category, relation, rule, place: x.select(F.col(f"owner_id.{by}").alias(by), F.col("owner_id.message_id").alias("message_id"), F.lit(place).alias("place"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(rule).alias("rule_id"), category.alias("category"), relation.alias("relation"), surface.alias("surface"), surface.alias("raw"), none.alias("action"), none.alias("temporal"), none.alias("canonical"))
    terms = plain_row(exact_terms(nothing, owners).where("reason is null"), F.col("term"), F.col("kind"), none, "exact_term_candidate", -2)
    facet_hits = rule_hits(owners.select("owner_id", "text"), X.rule_table(spark, X.facet_rules()))
    value = F.regexp_replace(X.collapsed("found"), r"^[ ,.;:!?]+|[ ,.;:!?]+$", "")
    good = (value != "") & F.when(F.col("relation").isin("home_country", "activity_location"), X.place_like(value)).when(F.col("relation").isin("research_topic", "art_style", "event_type"), ~X.low_value(value)).otherwise(True)
    facets = plain_row(facet_hits.where(good).withColumn("value", value), F.col("value"), F.col("relation"), F.col("relation"), "facet_candidate", -1)

    every = single.unionByName(base).unionByName(mentor).unionByName(speech).unionByName(terms).unionByName(facets)
    order = F.struct("message_id", "place", "start", "n", "rule_id")
    weak = F.col("rule_id").isin("exact_term_candidate", "facet_candidate")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    merged = every.groupBy(by, F.lower("surface").alias("key"), "category", "relation").agg(
        F.min_by("surface", order).alias("surface"), F.array_sort(F.collect_set("message_id")).alias("message_ids"), F.min_by("rule_id", F.struct(weak, order)).alias("rule"),
        F.min_by("raw", order).alias("raw_surface"), first("canonical"), first("action"), first("temporal"),
    )
    return merged.select(by, "surface", "category", "relation", "message_ids", "rule", "raw_surface", "canonical", "action", "temporal")
