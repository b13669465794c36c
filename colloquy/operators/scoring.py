"""Scores of candidates for many questions at once: signals, families, events, fusion, selection and compaction.

Every score is a row of (query, candidate) inside a sample; arrays hold sets of terms, and no pair leaves its sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import hash_embedding
from ..functions.text import hashed, keywords, overlap, rounded, unit_cosine
from .memory import ordered
from .retrieval import SEARCH_STOP_WORDS, rrf_fuse

#: Terms of the item families that a question may ask for; a small configuration.
FAMILIES = {"book": ["book", "books", "read", "reading", "novel"], "city": ["city", "cities", "visited", "country"], "activity": ["activity", "activities", "hiking", "painting", "chess", "pottery", "workshop"], "color": ["color", "colors", "green", "blue"]}
#: Words of an action, and capitalised words that are no names.
ACTIONS, NO_NAMES = ["went", "met", "visit", "visited", "read", "bought", "hosted", "joined"], ["the", "my", "how", "which", "thanks"]


def _strings() -> Column:
    return F.array().cast("array<string>")


def _literal(words: list[str], hashes: bool = False) -> Column:
    return F.array(*(F.xxhash64(F.lit(w)) if hashes else F.lit(w) for w in words))


def _hashes(x: DataFrame, column: str) -> bool:
    return x.schema[column].dataType == T.ArrayType(T.LongType(), x.schema[column].dataType.containsNull)


def _apart(flag: Column) -> Column:
    """A flag through a function of an element. The column list that it stands in is then compiled by itself and cut into small methods: a
    list with several set operations that is fused with its join makes a method beyond what a JVM compiles, which is many times slower."""
    return F.exists(F.array(flag), lambda b: b)


def with_hashes(x: DataFrame) -> DataFrame:
    """Questions or candidates with their sets of words as 64-bit hashes, so that a pair compares numbers."""
    sets = {c: hashed(F.col(c)) for c in ("terms", "entities", "have", "names", "values", "items") if c in x.columns}
    if "events" in x.columns:
        sets["events"] = F.transform("events", lambda e: F.struct(hashed(e.terms).alias("terms"), e.temporal.alias("temporal")))
    return x.withColumns(sets)


def names_in(text: Column) -> Column:
    """Distinct capitalised words in lower case, without those that are no names."""
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0)), lambda w: F.lower(w))), lambda w: ~w.isin(NO_NAMES))


def question_profiles(asks: DataFrame) -> DataFrame:
    """(query_id, sample_id, question, terms, entities, family, counting, listing, temporal) of questions."""
    q = F.lower("question")
    family = F.lit(None).cast("string")
    for name, words in reversed(FAMILIES.items()):
        family = F.when(F.arrays_overlap("_words", _literal(words)), name).otherwise(family)
    terms = F.filter("_words", lambda w: ~w.isin(SEARCH_STOP_WORDS))
    return asks.withColumn("_words", keywords(F.col("question"))).select("query_id", "sample_id", "question", terms.alias("terms"), names_in(F.substring("question", 2, 1 << 20)).alias("entities"), family.alias("family"), q.rlike("^how many").alias("counting"), q.rlike("^which").alias("listing"), q.rlike(r"\b(when|date|year|last)\b").alias("temporal"), hash_embedding(F.col("question")).alias("question_vector"))


def trajectory_signals(claims: DataFrame) -> DataFrame:
    """Per trajectory what every scorer reads: its text and latest text, terms, names, values and items, and the events
    (text, temporal) that its claims tell of."""
    happened = F.lower("text").rlike(r"\b(went|met)\b")
    event = F.struct("claim_id", keywords(F.col("text")).alias("terms"), F.lower("text").rlike("days ago|yesterday").alias("temporal"))
    x = claims.groupBy("sample_id", "trajectory_id").agg(
        F.array_join(ordered(F.col("text"), "version", "claim_id"), " ").alias("text"), F.max_by("text", F.struct("version", "claim_id")).alias("latest"), F.max_by("snapshot_id", "version").alias("latest_snapshot_id"),
        F.sort_array(F.collect_list(F.when(happened, event))).alias("events"), F.count(F.lit(1)).alias("claims"),
    )
    listed = F.filter(keywords(F.array_join(F.regexp_extract_all("text", F.lit("enjoy ([a-z, ]+)"), F.lit(1)), " ")), lambda w: w != "and")
    return x.withColumns({"have": keywords(F.col("text")), "names": names_in(F.col("text")), "values": F.array_distinct(F.regexp_extract_all("text", F.lit("favorite color is ([a-z]+)"), F.lit(1))), "items": listed, "text_vector": hash_embedding(F.col("text")), "latest_vector": hash_embedding(F.col("latest"))})


def pairs(questions: DataFrame, signals: DataFrame) -> DataFrame:
    """Each question with the candidates of its sample; their sets of words are hashes."""
    return with_hashes(questions).join(with_hashes(signals), "sample_id")


def with_family(x: DataFrame) -> DataFrame:
    """Adds ``family_score`` (at most 1) and ``mismatch`` (0.25, or 0.12 where the candidate has items or values at all):
    how well a candidate's terms fit the item family that a question asks for; both 0 without a family."""
    hashes = _hashes(x, "have")
    words = F.create_map(*(y for name, w in FAMILIES.items() for y in (F.lit(name), _literal(w, hashes))))[F.col("family")]
    size = lambda a, b: F.when(F.col("family").isNotNull(), F.size(F.array_intersect(a, b)))
    # columns of their own, so that a pair's sets are met once each, and only where a family is asked for
    x = x.withColumns({"_hits": size(words, "have"), "_asked": size("terms", "have"), "_objects": size(F.array_except("terms", "entities"), "have"), "_known": _apart(F.col("family").isNotNull())})
    hits, asked, objects = F.col("_hits"), F.col("_asked"), F.col("_objects")
    concrete = (F.size("items") + F.size("values")) > 0
    score = F.least(F.lit(0.48), hits / F.size(words) * 1.10) + F.least(F.lit(0.30), asked * 0.08) + F.least(F.lit(0.30), objects * 0.12) + F.when(concrete & ((hits > 0) | (objects > 0)), 0.10).otherwise(0.0)
    none = (hits == 0) & (asked == 0) & (objects == 0)
    known = F.col("_known")
    x = x.withColumns({"_fits": F.when(known, F.least(F.lit(1.0), score)).otherwise(0.0), "mismatch": F.when(known & none, F.when(concrete, 0.12).otherwise(0.25)).otherwise(0.0)})
    return x.withColumn("family_score", rounded(F.col("_fits"), 9)).drop("_hits", "_asked", "_objects", "_known", "_fits")


def with_event(x: DataFrame) -> DataFrame:
    """Adds ``event_score``: the best of a candidate's events that a question's object terms hit; 0 unless the question is
    about time or an action and has an object."""
    known = _literal(ACTIONS, _hashes(x, "terms"))
    x = x.withColumns({"_acts": F.array_intersect("terms", known), "_things": F.array_except("terms", known), "_dated": _apart(F.col("temporal"))})
    hit = lambda e, terms: F.size(F.array_intersect(e.terms, terms))
    acts = lambda e: F.when(F.size("_acts") > 0, hit(e, F.col("_acts"))).otherwise(0)
    score = lambda e, n: F.when(n > 0, F.least(F.lit(1.0), 0.70 + 0.10 * n + 0.10 * acts(e) + F.when(e.temporal, 0.05).otherwise(0.0))).otherwise(0.0)
    # an event's hits are counted once
    one = lambda e: F.transform(F.array(hit(e, F.col("_things"))), lambda n: score(e, n))[0]
    about = (F.col("_dated") | (F.size("_acts") > 0)) & (F.size("_things") > 0)
    x = x.withColumn("_best", F.when(about, F.coalesce(F.array_max(F.transform("events", one)), F.lit(0.0))).otherwise(0.0))
    return x.withColumn("event_score", rounded(F.col("_best"), 9)).drop("_acts", "_things", "_dated", "_best")


def with_overlap(x: DataFrame) -> DataFrame:
    """``pairs`` with family scores, and ``score`` by what questions and candidates share: Jaccard, names 0.25, values 0.15, a
    list or count 0.10, 0.80 times the family score, less 0.30 times its mismatch."""
    family = F.xxhash64("family") if _hashes(x, "terms") else F.col("family")
    asked = F.when(F.col("family").isNotNull(), F.array_union("terms", F.array(family))).otherwise(F.col("terms"))
    met = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    listed = _apart(F.col("listing") & (F.size("items") > 0))
    score = overlap(asked, F.col("have")) + F.when(met("entities", "names"), 0.25).otherwise(0.0) + F.when(met("terms", "values"), 0.15).otherwise(0.0) + F.when(listed, 0.10).otherwise(0.0) + F.when(F.col("counting") & F.col("text").rlike("[0-9]"), 0.10).otherwise(0.0)
    x = x.withColumn("_score", score + 0.80 * F.col("family_score") - 0.30 * F.col("mismatch"))
    return x.withColumn("score", rounded(F.col("_score"), 9)).drop("_score")


def overlap_rank(x: DataFrame) -> DataFrame:
    """``pairs`` with family scores, ranked by ``with_overlap``; ties by id, descending."""
    return with_overlap(x).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("trajectory_id"))))


def with_scores(x: DataFrame) -> DataFrame:
    """``pairs`` with family and event scores, and ``dense`` and ``sparse``.

    The text vectors are the deterministic hash embeddings; an event that fits strongly softens a family's mismatch.
    """
    met = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    bonus = F.when(met("entities", "names"), 0.10).otherwise(0.0) + F.when(met("terms", "values"), 0.05).otherwise(0.0)
    # beside the cosines, and so out of the join's method
    x = x.withColumns({"_bonus": bonus, "_shared": overlap(F.col("terms"), F.col("have"))} | {c: unit_cosine(F.col("question_vector"), F.col(v)) for c, v in (("s", "text_vector"), ("l", "latest_vector"))})
    x = x.withColumns({c: rounded(F.col(c), 9) for c in ("s", "l")})
    soft = F.when(F.col("event_score") >= 0.70, F.least("mismatch", F.lit(0.05))).otherwise(F.col("mismatch"))
    dense = 0.75 * F.col("s") + 0.15 * F.col("l") + 0.10 * F.least(F.lit(1.0), F.col("_bonus") / 0.20) + 0.08 * F.col("family_score") + 0.10 * F.col("event_score") - 0.04 * soft
    sparse = F.col("_shared") + 0.60 * F.col("family_score") + 0.75 * F.col("event_score") - 0.25 * soft
    x = x.withColumns({"dense": F.greatest(F.lit(0.0), dense), "sparse": F.greatest(F.lit(0.0), sparse)})
    return x.withColumns({c: rounded(F.col(c), 6) for c in ("dense", "sparse")}).drop("s", "l", "_bonus", "_shared")


def trajectory_scores(x: DataFrame) -> DataFrame:
    """``pairs`` with family and event scores -> (query_id, trajectory_id, dense, sparse, fused rank)."""
    y = with_scores(x).select("query_id", F.col("trajectory_id").alias("id"), "dense", "sparse")
    return rrf_fuse(y, keep=("dense", "sparse")).withColumnRenamed("id", "trajectory_id").drop("fused")


def page_pairs(questions: DataFrame, pages: DataFrame, widest: int) -> DataFrame:
    """Each question with the pages of its sample, which have their signals, and their ``dense`` and ``sparse`` (``page_scores``)."""
    x = with_family(pairs(questions, pages))
    x = x.withColumns({"_close": unit_cosine(F.col("question_vector"), F.col("text_vector")), "_named": F.coalesce(F.arrays_overlap("entities", "names"), F.lit(False)), "_shared": overlap(F.col("terms"), F.col("have"))})
    dense = rounded(F.col("_close"), 9) + F.when(F.col("_named"), 0.10).otherwise(0.0) + F.when(F.col("width") <= widest, 0.05).otherwise(0.0) + 0.08 * F.col("family_score")
    sparse = F.greatest(F.lit(0.0), F.col("_shared") + 0.60 * F.col("family_score") - 0.25 * F.col("mismatch"))
    x = x.select("query_id", "page_id", "width", dense.alias("dense"), sparse.alias("sparse"))
    return x.withColumns({c: rounded(F.col(c), 6) for c in ("dense", "sparse")})


def page_scores(questions: DataFrame, pages: DataFrame, widest: int = 6) -> DataFrame:
    """(query_id, page_id, dense, sparse, rank) of the pages of a question's sample.

    ``pages``: sample_id, page_id, page_type, text, width. Dense is the vectors' cosine, 0.10 for a shared name, 0.05 for a
    page of at most ``widest`` trajectories, and 0.08 times the family score; sparse the Jaccard and 0.60 times the family
    score, less 0.25 times its mismatch, 0 at least. Index pages count only where a sample has no other.
    """
    others = F.max((F.col("page_type") != "index").cast("int")).over(Window.partitionBy("sample_id"))
    p = pages.withColumn("others", others).where((F.col("page_type") != "index") | (F.col("others") == 0)).drop("others")
    p = p.withColumns({"have": keywords(F.col("text")), "names": names_in(F.col("text")), "items": _strings(), "values": _strings(), "text_vector": hash_embedding(F.col("text"))})
    y = page_pairs(questions, p, widest).select("query_id", F.col("page_id").alias("id"), "dense", "sparse")
    return rrf_fuse(y, keep=("dense", "sparse")).withColumnRenamed("id", "page_id").drop("fused")


def with_few(rows: DataFrame, routed: DataFrame, enough: int) -> DataFrame:
    """The rows of queries with fewer than ``enough`` routed trajectories, none included."""
    n = routed.select("query_id", "trajectory_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n.where(F.col("n") >= enough).select("query_id"), "query_id", "left_anti")


def index_fallback(ranked: DataFrame, routed: DataFrame, enough: int, most: int) -> DataFrame:
    """The routed trajectories (query_id, trajectory_id), and for queries with fewer than ``enough`` of them the best
    ``most`` others by ``overlap_rank`` that share anything; ``origin`` says which."""
    own = routed.select("query_id", "trajectory_id").distinct()
    rest = with_few(ranked.select("query_id", "trajectory_id", "score"), own, enough).join(own, ["query_id", "trajectory_id"], "left_anti")
    # the best come first, so that a score of 0 is looked for behind the ranking and no score is made twice
    rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("trajectory_id")))).where((F.col("k") <= most) & (F.col("score") > 0))
    return own.withColumn("origin", F.lit("page")).unionByName(rest.select("query_id", "trajectory_id", F.lit("index").alias("origin")))


def broad_cap(ranked: DataFrame, routed: DataFrame, cap: int) -> DataFrame:
    """(query_id, trajectory_id, broad) -> what is left when trajectories that only broad pages give are cut to the best
    ``cap`` of a query; the cap is the feature, the routing of broad pages being loose."""
    x = routed.groupBy("query_id", "trajectory_id").agg(F.bool_and("broad").alias("only_broad")).join(ranked.select("query_id", "trajectory_id", "score"), ["query_id", "trajectory_id"])
    k = F.row_number().over(Window.partitionBy("query_id", "only_broad").orderBy(F.desc("score"), F.desc("trajectory_id")))
    return x.withColumn("k", k).where(~F.col("only_broad") | (F.col("k") <= cap)).select("query_id", "trajectory_id", "only_broad")


def snapshot_scores(x: DataFrame, *more: str) -> DataFrame:
    """(query_id, question_vector, terms, entities, snapshot_id, trajectory_id, version, text, text_vector, names, values) ->
    score: 0.75 dense + 0.15 lexical + 0.10 symbolic; ``more`` columns stay. ``have`` may bring the text's keywords; sets of words may
    be hashes (``with_hashes``), if those of both sides are."""
    met = lambda a, b: F.when(F.coalesce(F.arrays_overlap(a, b), F.lit(False)), 0.05).otherwise(0.0)
    symbolic = F.least(F.lit(0.10), met("entities", "names") + met("terms", "values"))
    have = F.col("have") if "have" in x.columns else keywords(F.col("text"))
    x = x.withColumns({"_dense": unit_cosine(F.col("question_vector"), F.col("text_vector")), "_shared": overlap(F.col("terms"), have), "_symbolic": symbolic})
    score = 0.75 * rounded(F.col("_dense"), 9) + 0.15 * F.col("_shared") + 0.10 * F.least(F.lit(1.0), F.col("_symbolic") / 0.10)
    x = x.select("query_id", "trajectory_id", "snapshot_id", "version", score.alias("score"), *more)
    return x.withColumn("score", rounded(F.col("score"), 6))


def update_linked(seeds: DataFrame, claims: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(query_id, trajectory_id, snapshot_id) seeds -> the other snapshots of their trajectories that their claims reach over
    revisions. A trajectory of ``depth`` versions has no longer way, so the closure of its edges is squared until it covers
    that many steps, before any query is looked at."""
    own = claims.select("trajectory_id", "snapshot_id", "claim_id")
    pair = lambda a, b: edges.select("trajectory_id", F.col(a).alias("a"), F.col(b).alias("b"))
    reach = pair("claim_id", "other_id").unionByName(pair("other_id", "claim_id")).unionByName(own.select("trajectory_id", F.col("claim_id").alias("a"), F.col("claim_id").alias("b"))).distinct()
    for _ in range(max(1, (depth - 1).bit_length())):
        reach = reach.join(reach.toDF("trajectory_id", "b", "c"), ["trajectory_id", "b"]).select("trajectory_id", "a", F.col("c").alias("b")).distinct()
    near = own.withColumnRenamed("claim_id", "a").join(reach, ["trajectory_id", "a"]).join(own.select("trajectory_id", F.col("claim_id").alias("b"), F.col("snapshot_id").alias("other")), ["trajectory_id", "b"]).select("trajectory_id", "snapshot_id", "other").distinct()
    found = seeds.select("query_id", "trajectory_id", "snapshot_id").join(near, ["trajectory_id", "snapshot_id"]).select("query_id", "trajectory_id", F.col("other").alias("snapshot_id")).distinct()
    return found.join(seeds.select("query_id", "snapshot_id"), ["query_id", "snapshot_id"], "left_anti")


def snapshot_budget(seeds: Column, listing: Column) -> Column:
    """Snapshots that a context holds: seeds and six more within 10 to 14, for a list seeds and eight within 12 to 18; the
    seeds always."""
    fit = lambda more, low, high: F.least(F.greatest(seeds + more, F.lit(low)), F.lit(high))
    return F.greatest(F.when(listing, fit(8, 12, 18)).otherwise(fit(6, 10, 14)), seeds)


def compact_snapshots(scored: DataFrame, *more: str) -> DataFrame:
    """(query_id, trajectory_id, snapshot_id, version, score, kind, place, listing): seeds in their place, then the best
    update-linked of each trajectory, other update-linked, and neighbours, within the budget. All rows come back, those
    beyond it with ``kept`` false."""
    best = F.row_number().over(Window.partitionBy("query_id", "trajectory_id", "kind").orderBy(F.desc("score"), "version", F.desc("snapshot_id")))
    tier = F.when(F.col("kind") == "seed", 0).when((F.col("kind") == "update_linked") & (best == 1), 1).when(F.col("kind") == "update_linked", 2).otherwise(3)
    x = scored.withColumn("tier", tier).withColumn("seeds", F.count_if(F.col("kind") == "seed").over(Window.partitionBy("query_id")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "place", F.desc("score"), "version", F.desc("snapshot_id")))
    x = x.withColumn("order", order)
    return x.withColumn("kept", F.col("order") <= snapshot_budget(F.col("seeds"), F.col("listing"))).select("query_id", "trajectory_id", "snapshot_id", "version", "kind", "tier", "order", "kept", "listing", *more)


def compact_sources(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """The messages of the kept snapshots: all of seeds, two of an update-linked snapshot, one of a neighbour, each message
    in its first group, 28 in all (40 for a list), seeds always; ordered by group, then by message."""
    group = F.when(F.col("kind") == "seed", 0).when(F.col("kind") == "update_linked", 1).otherwise(2)
    # one exchange for all that follows: a query's sources are few
    x = kept.where("kept").withColumn("group", group).join(sources, "snapshot_id").repartition("query_id")
    # a message belongs to the first snapshot that names it, in the order of groups, trajectories and versions
    first = F.row_number().over(Window.partitionBy("query_id", "message_id").orderBy("group", "trajectory_id", "version", "snapshot_id", "position"))
    x = x.withColumn("first", first).where("first = 1")
    nth = F.row_number().over(Window.partitionBy("query_id", "snapshot_id").orderBy("position", "message_id"))
    x = x.withColumn("nth", nth).where((F.col("group") == 0) | ((F.col("group") == 1) & (F.col("nth") <= 2)) | (F.col("nth") <= 1))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("group", "trajectory_id", "version", "snapshot_id", "position"))
    x = x.withColumn("place", place).where((F.col("group") == 0) | (F.col("place") <= F.when(F.col("listing"), 40).otherwise(28)))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("group", "message_id"))
    return x.select("query_id", "message_id", "group", last.alias("rank"))


def with_words(messages: DataFrame) -> DataFrame:
    """Messages with their keywords (``have``) and vectors, made once each where they are not there yet."""
    made = {"have": keywords(F.col("content")), "text_vector": hash_embedding(F.col("content"))}
    return messages.withColumns({c: value for c, value in made.items() if c not in messages.columns})


def raw_rescue(questions: DataFrame, messages: DataFrame, prefilter: int = 80, few: int = 8, many: int = 12) -> DataFrame:
    """The messages of a question's sample that the words alone find: the ``prefilter`` best by shared keywords and terms in
    the text, then the best ``few`` (``many`` for a list) with the vectors' cosine; system turns only if nothing else is found."""
    known = with_words(messages)
    known = known.select("sample_id", "message_id", "turn_index", "role", "text_vector", F.lower("content").alias("hay"), hashed(F.col("have")).alias("have"))
    x = questions.withColumn("asked", hashed(F.col("terms"))).join(known, "sample_id")
    x = x.withColumn("hits", F.size(F.filter("terms", lambda t: F.contains(F.col("hay"), t))))
    x = x.withColumn("lexical", overlap(F.col("asked"), F.col("have")) + F.least(F.lit(1.0), F.col("hits") / 4)).where("lexical > 0")
    # scored where question and message meet: vectors and texts of a pair are not sent to its question's ranking
    x = x.withColumn("close", unit_cosine(F.col("question_vector"), F.col("text_vector")))
    score = 0.65 * rounded(F.col("close"), 9) + 0.35 * F.col("lexical")
    x = x.select("query_id", "message_id", "turn_index", "role", "listing", "lexical", score.alias("score"))
    x = x.withColumns({"lexical": rounded(F.col("lexical"), 9), "score": rounded(F.col("score"), 6)})
    x = x.withColumn("plain", F.max((F.col("role") != "system").cast("int")).over(Window.partitionBy("query_id"))).where((F.col("role") != "system") | (F.col("plain") == 0))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "turn_index"))).where(F.col("k") <= prefilter)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "turn_index")))
    return x.where(F.col("rank") <= F.when(F.col("listing"), many).otherwise(few)).select("query_id", "message_id", "score", "rank")


def evidence_state(questions: DataFrame, evidence: DataFrame, weak: float = 0.34) -> DataFrame:
    """(query_id, texts, sources, trajectories, snapshots, claims) -> whether evidence is weak: a tier is empty, or less than
    ``weak`` of the terms and names that a question needs stand in the texts; the share is null if it needs none."""
    x = questions.join(evidence, "query_id", "left").withColumn("need", F.array_union("terms", "entities"))
    hay = F.lower(F.coalesce("texts", F.lit("")))
    share = F.try_divide(F.size(F.filter("need", lambda t: F.contains(hay, t))), F.size("need"))
    empty = F.least(*(F.coalesce(c, F.lit(0)) for c in ("sources", "trajectories", "snapshots", "claims"))) <= 0
    return x.select("query_id", empty.alias("weak"), F.round(share, 9).alias("coverage"), F.coalesce(share < weak, F.lit(False)).alias("semantic_weak"))


def hybrid_messages(questions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of a question's sample by reciprocal ranks: shared keywords (ties by turn) and cosine of the hash embeddings
    (ties by id). Keywords and vectors are made once a question and once a message, and only scores go on to the ranking."""
    q = questions if "question_vector" in questions.columns else questions.withColumn("question_vector", hash_embedding(F.col("question")))
    q = q.select("query_id", "sample_id", "question_vector", hashed(keywords(F.col("question"))).alias("asked"))
    m = with_words(messages).select("sample_id", "message_id", "turn_index", "text_vector", hashed(F.col("have")).alias("have"))
    x = q.join(m, "sample_id").withColumn("hit", F.size(F.array_intersect("asked", "have")))
    lexical = F.col("hit") + F.coalesce(F.try_divide("hit", F.size("asked")), F.lit(0.0))
    x = x.select("query_id", "message_id", "turn_index", lexical.alias("lexical"), unit_cosine(F.col("question_vector"), F.col("text_vector")).alias("dense"))
    x = x.withColumns({"lexical": rounded(F.col("lexical"), 9), "dense": rounded(F.col("dense"), 6)})
    by = lambda *c: F.row_number().over(Window.partitionBy("query_id").orderBy(*c))
    fused = 1 / (60 + by(F.desc("lexical"), "turn_index")) + 1 / (60 + by(F.desc("dense"), "message_id"))
    x = x.withColumn("fused", fused).withColumn("fused", rounded(F.col("fused"), 12))
    return x.select("query_id", "message_id", "lexical", "dense", "fused", by(F.desc("fused"), F.desc("dense"), F.desc("lexical"), "message_id").alias("rank"))


#: A greedy choice weighs new names, values, items and terms so, and repeats of what is chosen against them.
GAINS, REPEAT, POOL = {"names": 1.0, "values": 0.8, "items": 0.6, "have": 0.1}, 0.5, 64


def coverage_greedy(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, trajectory_id, rank, names, values, items, have) -> ``k`` trajectories of each query that cover the most.

    The best-ranked is the anchor; then the one of the best ``POOL`` whose new names, values, items and terms weigh most,
    less ``REPEAT`` times the share of its terms that are covered already; ties by rank. A query's pool is bounded.
    """

    def choose(pool: list[dict]) -> list[tuple]:
        pool.sort(key=lambda r: r["rank"])
        sets = {c: [set(r[c]) for r in pool] for c in GAINS}
        covered, left, out = {c: set() for c in GAINS}, list(range(len(pool))), []

        def gain(i):
            new = sum(w * len(sets[c][i] - covered[c]) for c, w in GAINS.items())
            return new - REPEAT * len(sets["have"][i] & covered["have"]) / max(1, len(sets["have"][i]))

        while left and len(out) < k:
            best = left[0] if not out else max(left, key=lambda i: (round(gain(i), 9), -i))
            out.append((pool[best]["trajectory_id"], len(out) + 1, round(float(gain(best)), 9)))
            left.remove(best)
            for c in GAINS:
                covered[c] |= sets[c][best]
        return out

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(q, *x) for q, pool in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in choose(pool)]
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], shape)

    # many queries' pools travel in one batch: a call for each query would cost more than its choice
    shape = pa.schema([("query_id", pa.int64()), ("trajectory_id", pa.int64()), ("place", pa.int64()), ("gain", pa.float64())])
    pool = candidates.where(F.col("rank") <= POOL).groupBy("query_id").agg(F.collect_list(F.struct("trajectory_id", "rank", *GAINS)).alias("pool"))
    return pool.mapInArrow(chosen, "query_id long, trajectory_id long, place long, gain double")
