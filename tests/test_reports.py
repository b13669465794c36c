"""Toy cases of the answer functions and report operators, with values worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import answers as T
from colloquy.operators import evaluation as E
from colloquy.operators import reports as P
from colloquy.plans.registry import DRAWS


def test_answers_are_cut_and_trimmed(spark):
    x = spark.createDataFrame([(1, "tea, jam  and bread; "), (2, "Anderson"), (3, None)], "id long, t string")
    got = {r.id: r["items"] for r in x.select("id", T.answer_items(F.col("t")).alias("items")).collect()}
    assert got == {1: ["tea", "jam", "bread"], 2: ["Anderson"], 3: []}


@pytest.mark.parametrize(
    "text, abstains, asks, terms",
    [("", True, False, []), (None, True, False, []), ("It is  UNKNOWN.", True, False, []), ("When was it?", False, True, []), ("10 days ago, yesterday, 10 days ago", False, False, ["yesterday", "10 days ago"])],
)
def test_flags_of_a_text(spark, text, abstains, asks, terms):
    x = spark.createDataFrame([(text,)], "t string").select(T.is_abstention(F.col("t")), T.is_time_question(F.col("t")), T.relative_times(F.col("t")))
    assert tuple(x.first()) == (abstains, asks, terms)


def test_an_item_is_covered_by_most_of_its_words(spark):
    rows = [(1, "a red and blue kite", "the blue kite"), (2, "a kite", "blue kite"), (3, "a kite", "???")]
    x = spark.createDataFrame(rows, "id long, a string, i string")
    assert {r.id: r.c for r in x.select("id", T.covers_item(F.col("a"), F.col("i")).alias("c")).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("n, sizes", [(6, [6]), (7, [4, 3]), (8, [4, 4]), (9, [4, 5]), (10, [4, 6]), (11, [4, 4, 3])])
def test_chunks_of_medium_width(spark, n, sizes):
    x = spark.createDataFrame([(1, i) for i in range(n)], "g long, m long")
    got = P.medium_chunks(x, "g", "m").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == sizes


def test_windows_overlap_and_cover_a_long_message(spark):
    x = spark.createDataFrame([(1, 0, 10, 5), (1, 1, 11, 12), (1, 2, 12, 0)], "sample_id long, turn_index long, message_id long, tokens long")
    got = {r.chunk: (r.first_message, r.last_message) for r in P.chunk_spans(x, 6, 2).collect()}
    # 17 tokens, windows of 6 starting at 0, 4, 8, 12 and 16; the first message holds tokens 0 to 4
    assert got == {0: (10, 11), 1: (10, 11), 2: (11, 11), 3: (11, 11), 4: (11, 11)}


def test_the_first_overflow_is_kept_in_part(spark):
    x = spark.createDataFrame([(1, 7, 1, 5), (1, 8, 2, 10), (1, 9, 3, 1)], "query_id long, message_id long, rank long, tokens long")
    got = [(r.message_id, r.kept, r.truncated) for r in P.truncated_items(x, 9).orderBy("rank").collect()]
    assert got == [(7, 5, False), (8, 4, True)]


def test_ties_are_correct_and_no_votes_are_null(spark):
    x = spark.createDataFrame([("v1", 1, "correct"), ("v2", 1, "correct"), ("v3", 1, "partial"), ("v2", 2, None)], "variant string, query_id long, verdict string")
    got = {r.query_id: r.majority for r in P.vote_majority(x, "v1").collect()}
    assert got == {1: True, 2: None}


def outcomes_of(spark, better, strata=("A",)):
    """Outcomes of 100 queries, ten in a sample, all wrong in v1 and right in v2 where ``better`` says so."""
    rows = [(v, k, k // 10, strata[k % len(strata)], "correct" if v == "v2" and better(k) else "incorrect", None if v == "v2" else 1.0) for v in ("v1", "v2") for k in range(100)]
    return spark.createDataFrame(rows, "variant string, query_id long, sample_id long, stratum string, verdict string, token_f1 double")


def test_bootstraps_are_as_wide_as_resamples(spark):
    def ends(df):
        return {r.metric: (r.low, r.high) for r in df.collect()}

    half = outcomes_of(spark, lambda k: k % 2 == 0, ("A", "A", "N", "N"))
    assert DRAWS == 10_000
    paired = ends(E.bootstrap_interval(half, "v1", DRAWS))  # the quantiles of Bin(100, 0.5) / 100
    assert paired["judge"] == pytest.approx((0.40, 0.60), abs=0.0101) and paired["token_f1"] == (None, None)
    weighted = ends(P.prevalence_bootstrap(half, "v1", ["A", "N"], DRAWS))
    assert weighted["judge"] == pytest.approx((0.40, 0.60), abs=0.0101) and weighted["token_f1"] == (None, None)
    assert ends(P.prevalence_bootstrap(half, "v1", ["A", "N", "R"], DRAWS))["judge"] == (None, None)
    assert ends(P.cluster_bootstrap(half, "v1", DRAWS))["judge"] == (0.5, 0.5)  # each sample is half right
    whole = outcomes_of(spark, lambda k: k // 10 % 2 == 0)
    assert ends(P.cluster_bootstrap(whole, "v1", DRAWS))["judge"] == (0.2, 0.8)  # the quantiles of Bin(10, 0.5) / 10


def test_a_deprecated_claim_is_looked_for_as_a_whole(spark):
    start = "the red kite hangs in the hall " * 4
    claims = spark.createDataFrame([(1, "deprecated", start + "and is torn"), (2, "deprecated", start + "and is torn")], "sample_id long, status string, text string")
    answers = spark.createDataFrame([(1, 1, start + "and is whole"), (2, 2, "Yes, " + start + "and is torn.")], "query_id long, sample_id long, answer string")
    assert {r.query_id: r.hit for r in P.deprecated_hits(answers, claims).collect()} == {1: False, 2: True}


def test_buckets_of_units_give_multinomial_resamples(spark, monkeypatch):
    """Many buckets, few units each: counts of every resample add up, and its mean varies as resamples do."""
    import numpy as np

    values = np.random.default_rng(3).normal(size=400).round(6).tolist()
    cells = spark.createDataFrame([("v", "m", "", v, 1, 1) for v in values] + [("v", "m", "p", 1.0, 1, 3), ("w", "m", "", 2.0, 2, 5)], "variant string, metric string, part string, d double, n int, times int")
    monkeypatch.setattr(E, "CELLS", 20)
    got = E.resampled(cells, 4000, 1).toPandas()
    mine = got[(got.variant == "v") & (got.part == "")].sort_values("draw").m.to_numpy()
    assert len(got) == 3 * 4000 and set(got[got.part == "p"].m) == {1.0} and set(got[got.variant == "w"].m) == {1.0}
    plain = np.random.default_rng(9).choice(values, size=(4000, 400)).mean(1)
    assert abs(mine.mean() - plain.mean()) < 0.005 and abs(mine.std() / plain.std() - 1) < 0.05
    wide = lambda x: np.quantile(x, 0.975) - np.quantile(x, 0.025)
    assert abs(wide(mine) / (2 * 1.96 * np.std(values) / 20) - 1) < 0.05
    again = E.resampled(cells, 4000, 1).toPandas().sort_values(["variant", "part", "draw"]).m.to_numpy()
    assert np.allclose(again, got.sort_values(["variant", "part", "draw"]).m.to_numpy())


def test_least_cover_is_exact():
    import random
    from itertools import combinations

    from colloquy.operators.results import least_cover

    rng = random.Random(4)
    for _ in range(400):
        bits, n = rng.randint(1, 10), rng.randint(0, 14)
        parts = [rng.getrandbits(bits) & rng.getrandbits(bits) for _ in range(n)]
        need = (1 << bits) - 1
        union = lambda c: sum(1 << b for b in range(bits) if any(p >> b & 1 for p in c))
        want = next((k for k in range(1, n + 1) if any(union(c) == need for c in combinations(parts, k))), None)
        assert least_cover(need, parts) == want
    assert least_cover(0, [1, 2]) == 0
    big = [sum(1 << (b % 60) for b in range(k, k + 7)) for k in range(60)]  # windows of 7 around a circle of 60
    assert least_cover((1 << 60) - 1, big) == 9


def test_calls_without_a_provider_are_counted_one_by_one(spark):
    rows = [(1, None, 5, "repair_x"), (2, None, 5, "answer"), (3, 7, 5, "answer"), (4, 7, 6, "answer")]
    calls = spark.createDataFrame([(i, u, w, t, i, 1, 1.0, i) for i, u, w, t in rows], "call_item_uid long, provider_call_uid long, worker_id long, task string, ts long, completion_tokens long, latency_ms double, query_id long").withColumn("role", F.lit("r"))
    assert sorted((r.provider_call_uid or 0, r.attempts) for r in P.call_ledger(calls).collect()) == [(0, 1), (0, 1), (7, 2)]
    assert {(r.call_item_uid, r.kind) for r in P.repair_events(calls).collect()} == {(1, "repair"), (4, "cache_hit")}


def test_a_page_counts_its_words_without_dealing_each_of_them(spark):
    from colloquy.operators import pages as G

    seeds = spark.createDataFrame([(1, "topic", "a", k, False) for k in (1, 2, 3)] + [(1, "index", "all", 1, False), (2, "topic", "a", 4, False)], "sample_id long, seed_type string, seed_key string, trajectory_id long, broad boolean")
    lists = [(1, ["n1", "n2"], ["v"], [], ["t1", "t2", "t3", "t4"]), (2, ["n2"], [], ["i"], ["t4", "t3"]), (3, [], [], [], ["t4"]), (4, [], [], [], [])]
    found = G.page_metadata(seeds, spark.createDataFrame(lists, "trajectory_id long, names array<string>, values array<string>, items array<string>, terms array<string>"), 2, 2)
    got = {(r.sample_id, r.seed_type): (r.width, r.representatives, r.names, r["values"], r.terms) for r in found.collect()}
    assert got[(1, "topic")] == (3, [1, 2], ["n2", "n1"], ["v"], ["t4", "t3"])
    assert got[(1, "index")] == (1, [1], ["n1", "n2"], ["v"], ["t1", "t2"])
    assert got[(2, "topic")] == (1, [4], None, None, None)
    assert not re.search(r"hashpartitioning\([^)]*\bv#", found._jdf.queryExecution().executedPlan().toString())
