"""Drift of trajectories whose numbers repeat in other samples, and template words in keywords."""

from colloquy.operators import analysis as A
from colloquy.operators import evaluation as E
from colloquy.operators import results as X


def test_a_trajectory_number_of_two_samples_is_two_trajectories(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 7, 1, a), (1, 7, 2, a), (2, 7, 1, a), (2, 7, 2, b), (2, 8, 1, b)]
    drift = E.trajectory_drift(spark.createDataFrame(rows, "sample_id int, trajectory_id int, version int, embedding array<double>"), E.OWN)
    assert sorted(tuple(r) for r in drift.select("sample_id", "trajectory_id", "length", "head_tail", "bucket").collect()) == [(1, 7, 2, 1.0, "stable"), (2, 7, 2, 0.0, "possible_drift"), (2, 8, 1, 1.0, "singleton")]
    assert [tuple(r) for r in A.low_drift_examples(drift, 2).collect()] == [(7, 0.0), (7, 1.0)]


def test_a_keyword_counts_whole(spark):
    rows = [("Who: Anna", "anna"), ("Who: Anna's aunt", "anna's aunt"), ("anna-lena", "anna-lena")]
    (got,) = X.template_leaks(spark.createDataFrame(rows, "text string, keywords string"), ["anna"]).collect()
    assert tuple(got) == ("anna", 3, 1)


def test_queries_do_not_meet_each_trajectory(spark):
    targets = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 9)], "query_id int, sample_id int")
    drift = spark.createDataFrame([(0, 0.2), (0, 0.6), (0, None), (1, 1.0)], "sample_id int, head_tail double")
    outcomes = spark.createDataFrame([(1, "correct"), (2, "partial"), (3, "correct"), (4, "correct")], "query_id int, verdict string")
    found = X.query_drift(targets, drift, outcomes, ["sample_id"])
    assert sorted(tuple(r) for r in found.collect()) == [("correct", 2, 0.7, 0.2), ("partial", 1, 0.4, 0.2)]
    # each side is summed up first: below the join with the queries there is a grouping of the trajectories
    assert "avg(head_tail" in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1]
