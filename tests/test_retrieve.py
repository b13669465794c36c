"""Retrieval over a written index, and contexts of policies."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import contexts as C
from colloquy.operators import retrieve as T
from colloquy.operators import scoring as S
from colloquy.plans import scoring as P
from colloquy.plans.registry import QUERIES
from colloquy.sources.fixtures import Views
from colloquy.sources.staging import written_once

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, DATA)


def test_a_written_index_answers_alike_and_versions_stay_apart(spark, views, tmp_path):
    index, path = P.index_tables(views), str(tmp_path / "index")
    first = T.write_index(index, path, parts=3)
    few = {name: df.where("sample_id < 3") for name, df in index.items()}
    second = T.write_index(few, path, parts=3)
    assert first != second and (tmp_path / "index" / first / "trajectories" / "part=0").exists()
    asked = P.asked(views).where("sample_id < 6")
    settings = T.Settings(pages=1, broad=3, broad_most=2)
    rows = lambda ix: Counter(map(str, T.retrieve(asked, ix, settings).collect()))
    assert rows(T.read_index(spark, path, first)) == rows(index)
    newest = T.retrieve(asked, T.read_index(spark, path), settings).collect()
    assert {r.sample_id for r in newest if r.trajectory_ids} <= {0, 1, 2} < {r.sample_id for r in newest}
    with pytest.raises(ValueError):
        T.read_index(spark, path, "none")


def test_every_question_has_an_event(spark, views):
    asked = P.asked(views).limit(3)
    lost = spark.createDataFrame([(10**9, 10**9, "Where did Anna go?")], "query_id long, sample_id long, question string")
    both = asked.unionByName(S.question_profiles(lost).select(asked.columns))
    got = {r.query_id: r for r in T.retrieve(both, P.index_tables(views)).collect()}
    assert len(got) == 4
    none = got[10**9]
    assert (none.page_ids, none.trajectory_ids, none.expanded_ids, none.source_ids, none.rescued_ids, none.weak) == ([], [], [], [], [], True)
    assert T.retrieve(asked.limit(0), P.index_tables(views)).count() == 0


def test_retrieval_is_one_small_plan(views):
    plan = T.retrieve(P.asked(views), P.index_tables(views), stage=lambda name, df: views.once(f"test_{name}", lambda: df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") < 30


def test_all_policies_at_once_give_what_each_gives_alone(spark, views):
    rows = {}
    for r in QUERIES["f28_variant_contexts"](spark, DATA).collect():
        rows.setdefault(r.variant, Counter())[tuple(r)] += 1
    assert set(rows) == {p[0] for p in C.POLICIES}
    for policy in C.POLICIES:
        if policy[0] in ("direct_trajectory", "latest_snapshot", "no_source_constraint", "full_context_matched", "naive_dense_rag"):
            some = [C.POLICIES[0], policy] if policy[7] else [policy]
            alone = C.variant_contexts(P.asked(views), P.index_tables(views), P.claims(views), P.pages(views), C.policy_table(spark, some), T.Settings(pages=1, broad=P.BROAD, broad_most=2), lambda name, df, of=policy[0]: views.once(f"{of}_{name}", lambda: df))
            assert Counter(map(tuple, alone.where(F.col("variant") == policy[0]).collect())) == rows[policy[0]], policy[0]


def test_contexts_show_what_their_policy_says(spark, views):
    every = P.contexts(views)
    told = {(r.variant, r.section) for r in every.select("variant", "section").distinct().collect()}
    assert {s for v, s in told if v == "full"} == {"page", "trajectory", "snapshot", "source"}
    assert {s for v, s in told if v == "direct_trajectory"} == {"trajectory", "snapshot", "source"}
    assert {s for v, s in told if v == "wiki_summaries"} == {"page"}
    assert {s for v, s in told if v == "naive_dense_rag"} == {"chunk"}
    assert all({s for v, s in told if v == x} == {"message"} for x in ("hybrid_raw_rag", "full_context", "hybrid_raw_rag_matched", "full_context_matched"))
    texts = {(r.variant, r.query_id, r.item_id): r.text for r in every.where("section = 'snapshot'").collect()}
    full = {(q, i): t for (v, q, i), t in texts.items() if v == "full"}
    assert all(t.startswith("[") for t in full.values())
    assert {(q, i): f"] {t}" for (v, q, i), t in texts.items() if v == "no_claim_state"}.keys() == full.keys()
    latest = {(q, i) for v, q, i in texts if v == "latest_snapshot"}
    assert latest < set(full)
    used = {(r.variant, r.query_id): r.n for r in every.groupBy("variant", "query_id").agg(F.sum("tokens").alias("n")).collect()}
    assert all(n <= used["full", q] for (v, q), n in used.items() if v.endswith("_matched"))
    assert any(used.get(("full_context_matched", q), 0) < n for (v, q), n in used.items() if v == "full_context")


def test_whole_dialogues_are_not_written_for_each_question(spark, views):
    some, staged = [p for p in C.POLICIES if p[0] in ("hybrid_raw_rag", "full_context", "full_context_matched")], {}

    def stage(name, df):
        staged[name] = df
        return df

    asked = P.asked(views).limit(5)
    got = Counter((r.variant, r.query_id, r.item_id, r.tokens) for r in C.variant_contexts(asked, P.index_tables(views), P.claims(views), P.pages(views), C.policy_table(spark, some), stage=stage).collect())
    assert {r.routing for r in staged["context_items"].select("routing").distinct().collect()} == {"hybrid_raw_messages"}
    # without a full context nothing is cut: every message of the question's sample, once
    every = {(r.query_id, r.message_id) for r in asked.join(P.notes(views), "sample_id").collect()}
    for variant in ("full_context", "full_context_matched"):
        assert {(q, i): n for (v, q, i, _), n in got.items() if v == variant} == dict.fromkeys(every, 1)


def test_routes_need_the_pages_of_the_index_alone(spark):
    made = []

    class Told(Views):
        def once(self, name, make):
            made.append(name)
            return make()

    P.routed(Told(spark, DATA))
    assert [n for n in made if n.startswith("index_")] == ["index_pages"]


def test_staged_tables_follow_their_version(spark):
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    assert [written_once(spark, v, "t", lambda n=n: make(n)).count() for v, n in (("v1", 3), ("v1", 4), ("v2", 5))] == [3, 3, 5] and calls == [3, 5]


def test_pairs_are_scored_where_they_meet_and_only_their_scores_go_on(views):
    asked, index, settings = P.asked(views), P.index_tables(views), T.Settings(pages=1, broad=3, broad_most=2)
    chosen = T.ranked_pages(asked, index["pages"], settings.broad).where("rank = 1")
    found = T.candidates(asked, chosen, index, settings)
    assert found.columns == ["query_id", "trajectory_id", "latest_snapshot_id", "origin", "score", "dense", "sparse"]
    assert {r.origin for r in found.select("origin").distinct().collect()} >= {"page", "index"}
    staged = {}

    def stage(name, df):
        staged[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df

    T.traced(asked, index, settings, stage)
    # signals of trajectories are read by one join, not once more to rank what it found
    assert sum("Relation" in line and "latest_snapshot_id" in line for line in staged["ranked_trajectories"].splitlines()) == 1


def test_a_pair_is_scored_once_for_all_routings(views):
    asked, index, settings = P.asked(views), P.index_tables(views), T.Settings(pages=1, broad=3, broad_most=2)
    chosen = T.ranked_pages(asked, index["pages"], settings.broad).where("rank = 1")
    both = T.candidates(asked, chosen, index, settings, [("wiki", False), ("all", True)])
    split = both.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.routing").alias("routing"), "trajectory_id", "origin", "score", "dense", "sparse")
    plain = T.candidates(asked, chosen, index, settings).select("query_id", "trajectory_id", "origin", "score", "dense", "sparse")
    assert Counter(map(tuple, split.where("routing = 'wiki'").drop("routing").collect())) == Counter(map(tuple, plain.collect()))
    direct = split.where("routing = 'all'").collect()
    assert {r.origin for r in direct} == {"direct"}
    assert {(r.query_id, r.trajectory_id) for r in direct} == {(r.query_id, r.trajectory_id) for r in asked.join(index["trajectories"], "sample_id").collect()}
    # trajectories are read once, below what deals a pair out to routings
    lines = both._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in line and "latest_vector" in line for line in lines) == 1


def test_pairs_meet_prepared_words(views):
    # no text is cut into words, and no vector made, where a question has met a message
    index = P.index_tables(views)
    for plan in (S.raw_rescue(P.asked(views), index["messages"]), S.hybrid_messages(P.asked(views), index["messages"])):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
        assert not any(word in line for line in lines[:join] for word in ("regexp_extract_all", "sha2", "_embedded"))


def test_pair_scores_are_compiled(spark, views):
    # a method of more than 8000 bytes is never compiled by a JVM
    x = S.with_scores(S.with_overlap(P.matched(views)))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = x.select("query_id", "trajectory_id", "score", "dense", "sparse")._jdf.queryExecution().debug().codegenToSeq()
        assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_rounding_and_vectors_are_those_of_spark(spark):
    import hashlib
    import math
    import random

    from colloquy.functions.answers import hash_embedding
    from colloquy.functions.text import rounded, unit_cosine

    rng = random.Random(5)
    values = [rng.uniform(-2, 2) for _ in range(2000)] + [rng.randint(-(10**7), 10**7) / 2e6 for _ in range(2000)] + [0.1234565, -0.0000005, float("nan"), float("inf"), 1e300, -0.0, None]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (6, 9, 12):
        assert d.where(~rounded(F.col("v"), n).eqNullSafe(F.round("v", n))).count() == 0
    raw = [b / 255 - 0.5 for b in hashlib.sha256("tëa".encode()).digest()]
    norm = 0.0
    for v in raw:
        norm += v * v
    t = spark.createDataFrame([("tëa", [1.0, 0.0], [0.6, 0.8]), (None, None, [1.0])], "t string, a array<double>, b array<double>")
    got = t.select(hash_embedding(F.col("t")).alias("v"), unit_cosine(F.col("a"), F.col("b")).alias("short"), unit_cosine(hash_embedding(F.col("t")), hash_embedding(F.col("t"))).alias("self")).collect()
    assert got[0].v == [v / math.sqrt(norm) for v in raw] and got[0].short == 0.6 and abs(got[0].self - 1) < 1e-12
    assert got[1].v == [None] * 32


def test_tokens_are_counted_before_questions_meet_texts(spark, views):
    staged = {}

    def stage(name, df):
        staged[name] = df
        return df

    some = [p for p in C.POLICIES if p[0] in ("hybrid_raw_rag", "hybrid_raw_rag_matched")]
    plan = C.variant_contexts(P.asked(views), P.index_tables(views), P.claims(views), P.pages(views), C.policy_table(spark, some), stage=lambda name, df: stage(name, views.once(f"counted_{name}", lambda: df)))
    assert {"tokens", "flat_tokens"} <= set(staged["context_items"].columns)
    assert "regexp_extract_all" not in plan._jdf.queryExecution().optimizedPlan().toString()
