"""Toy cases of building, pages, scores, results, readers and streams, worked out by hand or by a plain loop."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import rules as C
from colloquy.operators import build as B
from colloquy.operators import memory as M
from colloquy.operators import pages as G
from colloquy.operators import results as X
from colloquy.operators import scoring as S
from colloquy.plans.registry import QUERIES
from colloquy.plans import build as _b, streams as _s  # noqa: F401  (add their queries)
from colloquy.sources import readers as RD

DATA = "/root/testdata/sf0.001"


def test_a_claim_keeps_revises_adds_and_carries(spark):
    rows = [(1, 1, 1, "I like red kites a lot", "active"), (1, 1, 2, "tea", "active"), (1, 1, 3, "gone now", "active"), (1, 2, 4, "I like blue kites a lot", "active"), (1, 2, 5, "Tea!", "deprecated"), (1, 2, 6, "new words here", "active")]
    c = spark.createDataFrame(rows, "trajectory_id long, version long, claim_id long, text string, status string")
    got = {(r.version, r.claim_id, r.old_id, r.op) for r in B.claim_changes(c).collect()}
    assert got == {(1, 1, None, "ADD"), (1, 2, None, "ADD"), (1, 3, None, "ADD"), (2, 5, 2, "DEPRECATE"), (2, 4, 1, "REVISE"), (2, 6, None, "ADD"), (2, None, 3, "CARRY")}


def test_chains_continue_close_and_reopen():
    chains = B.Chains(2)
    a = chains.add({"red", "kite"}, set())
    b = chains.add({"red", "kite"}, set())
    c = chains.add({"red", "kite"}, set())
    assert [x[:2] for x in (a, b, c)] == [(0, 1), (0, 2), (1, 1)] and b[2] == 1.0
    again = B.Chains(2, json.loads(json.dumps(chains.state())), chains.next)
    assert again.add({"red", "kite"}, set())[:2] == (1, 2)


def test_the_stream_builds_what_the_batch_builds(spark):
    batch = {tuple(r) for r in QUERIES["d5_build_trajectories"](spark, DATA).collect()}
    assert batch and {tuple(r) for r in QUERIES["s1_stream_build_trajectories"](spark, DATA).collect()} == batch


def test_relative_times_of_every_kind(spark):
    text = "Today, a week ago, 2 weeks ago, last Monday, last month, about two years ago, 3 years ago, 14 months ago and tomorrow"
    x = spark.createDataFrame([(text, "2023-05-31")], "t string, d string").select(F.inline(C.relative_anchors(F.col("t"), F.col("d").cast("date"))))
    got = {r.term: (r.resolved, r.kind) for r in x.collect()}
    assert got == {
        "today": ("31 May 2023", "exact_date"), "tomorrow": ("1 June 2023", "exact_date"), "last monday": ("the Monday before 31 May 2023", "relative_span"), "last month": ("April 2023", "month_year"), "about two years ago": ("about two years ago", "fuzzy_relative"),
        "14 months ago": ("March 2022", "month_year"), "3 years ago": ("May 2020", "month_year"), "a week ago": ("a week before 31 May 2023".replace("a week", "a week", 1), "relative_span"), "2 weeks ago": ("2 weeks before 31 May 2023", "relative_span"),
    }


@pytest.mark.parametrize("e, t, same", [("last week", "the week before", True), ("last monday", "previous Monday", True), ("two days ago", "2 days before that", True), ("two days ago", "3 days ago", False), ("", "x", True), ("last year", "", False), ("a few years ago", "about 3 years ago", True)])
def test_a_time_restated(spark, e, t, same):
    assert spark.createDataFrame([(e, t)], "e string, t string").select(C.temporal_match(F.col("e"), F.col("t"))).first()[0] is same


def test_acknowledgements_are_not_salient(spark):
    rows = [("Thanks, talk soon!",), ("We moved to a new place",), ("I want to improve",), ("",), ("See Green Park",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(C.salience(F.col("t"))).collect()] == ["none", "place_or_area_fact", "plan_goal_or_state_change", "none", "capitalized_place_like_term"]


def test_least_sets_that_cover(spark):
    rows = [(1, ["a", "b", "c"], [["a"], ["b"], ["c"], ["a", "b"]]), (2, ["a", "z"], [["a"]]), (3, [], [["a"]]), (4, ["a", "b", "c", "d"], [["a", "b"], ["c", "d"], ["b", "c"]])]
    x = X.min_cover(spark.createDataFrame(rows, "query_id long, gold array<string>, sets array<array<string>>"))
    assert {r.query_id: (r.needed, r.exact) for r in x.collect()} == {1: (2, True), 2: (None, True), 3: (0, True), 4: (2, True)}


def test_soft_values_match_one_to_one(spark):
    rows = [(1, ["left knee"], ["right knee"]), (2, ["red car", "bus"], ["car", "bus"]), (3, [], []), (4, ["books"], ["book"]), (5, ["a"], [])]
    x = X.canonical_f1(spark.createDataFrame(rows, "id long, predicted array<string>, gold array<string>"), {"books": "book"}, ["left", "right"])
    assert {r.id: (r.f1, r.extra, r.missing) for r in x.collect()} == {1: (0.0, ["left knee"], ["right knee"]), 2: (1.0, [], []), 3: (1.0, [], []), 4: (1.0, [], []), 5: (0.0, ["a"], [])}


def test_greedy_cover_takes_what_is_new(spark):
    rows = [(1, 10, 1, ["anna"], [], [], ["x"]), (1, 11, 2, ["anna"], [], [], ["x"]), (1, 12, 3, ["ben"], [], ["chess"], ["y"])]
    x = S.coverage_greedy(spark.createDataFrame(rows, "query_id long, trajectory_id long, rank long, names array<string>, values array<string>, items array<string>, have array<string>"), 2)
    assert [(r.trajectory_id, r.place) for r in x.orderBy("place").collect()] == [(10, 1), (12, 2)]


def test_greedy_covers_of_many_queries_share_a_call(spark):
    rows = [(q, 10 * q + k, k + 1, ["anna", f"n{k}"][: 1 + k % 2], [], ["chess"] * (k == 3), [f"w{k}"]) for q in range(600) for k in range(5)]
    x = S.coverage_greedy(spark.createDataFrame(rows, "query_id long, trajectory_id long, rank long, names array<string>, values array<string>, items array<string>, have array<string>"), 2)
    assert "InPandas" not in x._jdf.queryExecution().executedPlan().toString()  # a call for each query
    got = {(r.query_id, r.place): r.trajectory_id - 10 * r.query_id for r in x.collect()}
    assert got == {(q, p): k for q in range(600) for p, k in ((1, 0), (2, 3))}


def test_broad_pages_split_around_the_farthest(spark):
    rows = [(1, k, 1, [1.0, 0.0] if k < 4 else [0.0, 1.0]) for k in range(8)]
    got = {}
    for r in G.split_by_vectors(spark.createDataFrame(rows, "page long, member long, richness long, vector array<double>"), 4).collect():
        got.setdefault(r.part, set()).add(r.member)
    assert got == {0: {0, 1, 2, 3}, 1: {4, 5, 6, 7}}


def test_small_pages_join_their_kin(spark):
    rows = [(1, 1, 1, ["a"]), (1, 2, 2, ["a"]), (1, 2, 3, ["a"]), (1, 2, 4, ["b"]), (1, 3, 5, ["z"])]
    got = {r.member: r.page for r in G.merge_small(spark.createDataFrame(rows, "sample_id long, page long, member long, terms array<string>")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}


def test_a_grid_cell_without_gold_is_not_observed(spark):
    items = spark.createDataFrame([(1, "flat_raw", 1, 0, "m", ["r1"], [7], 5), (1, "pages_only", 1, 1, "p", ["r1"], [7], 5)], "query_id long, variant string, rank long, cut long, item_id string, refs array<string>, trajectories array<long>, tokens long")
    labels = spark.createDataFrame([(1, 1, ["r1", "r2"], [7]), (2, 2, [], [])], "query_id long, sample_id long, source_refs array<string>, trajectory_ids array<long>")
    got = {(r.query_id, r.variant): (r.ref_coverage, r.all_refs, r.trajectory_recall, r.risk) for r in M.ablation_grid(items, labels, [1], [9], ["flat_raw", "pages_only"]).collect()}
    assert got == {(1, "flat_raw"): (0.5, False, 1.0, True), (1, "pages_only"): (None, None, 1.0, None), (2, "flat_raw"): (None, False, None, True), (2, "pages_only"): (None, None, None, None)}


def test_weights_of_one_give_the_saved_order_back(spark):
    x = spark.createDataFrame([(1, k, float(k % 3), 0.5 * k) for k in range(9)], "query_id long, id long, a double, score double")
    assert {(r.jaccard, r.unchanged) for r in X.perturbed_ranks(x, {"a": 1.0}, 4, 0.0, 3).collect()} == {(1.0, 1.0)}


def test_only_what_may_move_up_meets_the_draws(spark):
    import hashlib
    import random

    rng, rows = random.Random(3), []
    for q in range(30):
        for i in range(rng.choice([1, 2, 3, 12, 40])):
            w = [rng.choice([0.0, 0.0, round(rng.random(), 2)]) for _ in range(2)]
            rows.append((q, i, *w, round(0.8 * w[0] + 0.7 * w[1] + rng.choice([0.0, 0.0, 0.3]), 9)))
    x = X.perturbed_ranks(spark.createDataFrame(rows, "query_id long, id long, a double, b double, score double"), {"a": 0.8, "b": 0.7}, 4, 0.3, 3)
    unit = lambda name, d: int(hashlib.md5(f"7:{name}:{d}".encode()).hexdigest()[:8], 16) / 4294967295.0
    for r in x.collect():
        found = []
        for q in range(30):
            mine = [y for y in rows if y[0] == q]
            moved = lambda y: round(y[4] + 0.8 * y[2] * (2 * unit("a", r.draw) - 1) * 0.3 + 0.7 * y[3] * (2 * unit("b", r.draw) - 1) * 0.3, 9)
            one, two = ({y[1] for y in sorted(mine, key=lambda y: (-of(y), y[1]))[:3]} for of in (lambda y: y[4], moved))
            found.append(len(one & two) / len(one | two))
        assert (r.queries, r.jaccard, r.unchanged) == (30, round(sum(found) / 30, 9), round(sum(j == 1 for j in found) / 30, 9))
    # the rows that are multiplied: still ones beyond the first three of a query are not among them
    still = spark.createDataFrame([(1, i, 0.0, 0.0) for i in range(500)], "query_id long, id long, a double, score double")
    assert X.movable(still, {"a": 1.0}, 0.3, 3).count() == 3
    assert [(r.jaccard, r.unchanged) for r in X.perturbed_ranks(still, {"a": 1.0}, 1, 0.3, 3).collect()] == [(1.0, 1.0)]


def test_files_are_read_and_written(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sample_id": "s", "qa_uid": "q", "category": 1, "category_name": "c"}\n{"sample_id": "s", "category": 5}\nbroken\n')
    got = RD.dialogue_files(spark, [str(tmp_path / "a.jsonl")]).collect()
    assert sorted(str(r.excluded) for r in got) == ["None", "unreadable"]
    (tmp_path / "b.json").write_text('[{"id": "1", "messages": [{"role": "user", "content": "x"}], "meta": {"scene": "2"}}, {"id": "2", "meta": {"scene": "9"}}]')
    assert {r.id: (r.scene, r.excluded) for r in RD.multiturn_files(spark, [str(tmp_path / "b.json")]).collect()} == {"1": ("work", None), "2": (None, "unknown_scene")}
    x = spark.createDataFrame([(1, "a")], "b long, a string")
    for kind in ("json", "csv", "parquet"):
        RD.write_rows(x, str(tmp_path / kind), ["a", "b"], kind)
        RD.write_rows(x, str(tmp_path / kind), ["a", "b"], kind, append=True)
        back = spark.read.format(kind).options(header="true").load(str(tmp_path / kind))
        assert back.columns == ["a", "b"] and back.count() == 2
    s = spark.createDataFrame([(1, 5, 1, 9, "t")], "sample_id long, trajectory_id long, version long, snapshot_id long, content string")
    c = spark.createDataFrame([(9, 1, "active", "x")], "snapshot_id long, claim_id long, status string, text string")
    RD.write_memories(s, c, str(tmp_path / "memory"))
    assert spark.read.json(str(tmp_path / "memory")).first().snapshots[0].claims[0].text == "x"
