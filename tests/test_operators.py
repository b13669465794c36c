"""Toy cases with values worked out by hand, and every SQL-backed query against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.operators import evaluation as E
from colloquy.operators import retrieval as R
from colloquy.plans import analysis, audit, build, extraction, memory, outputs, reports, results, rules, scoring, sources, streams  # noqa: F401  (add their queries)
from colloquy.plans.registry import QUERIES, SQL
from colloquy.sources.fixtures import view

DATA = "/root/testdata/sf0.001"


def test_drift_of_a_turning_chain(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.8, 0.6]), (1, 3, [0.0, 1.0]), (2, 1, [1.0, 0.0])], "trajectory_id long, version long, embedding array<double>")
    rows = {r.trajectory_id: r for r in E.trajectory_drift(v).collect()}
    assert (rows[1].head_tail, rows[1].adjacent_mean, rows[1].adjacent_min, rows[1].bucket) == (0.0, 0.7, 0.6, "possible_drift")
    assert (rows[2].head_tail, rows[2].bucket) == (1.0, "singleton")


def test_budget_stops_at_the_first_overflow(spark):
    r = spark.createDataFrame([(1, 1, 5), (1, 2, 10), (1, 3, 1)], "query_id long, rank long, tokens long")
    assert [x.rank for x in R.budget_prefix(r, 6, 9).collect()] == [1]


def test_unigram_precision_has_no_brevity_penalty(spark):
    p = spark.createDataFrame([(1, "a cat", "a cat sat"), (2, "a cat x y", "a cat"), (3, "", "")], "id long, predicted string, gold string")
    got = {r.id: (r.bleu1, r.token_f1) for r in E.token_overlap(p).collect()}
    assert got == {1: (1.0, 0.8), 2: (0.5, round(4 / 6, 9)), 3: (1.0, 1.0)}


def test_unknown_usage_keeps_a_total_null(spark):
    c = spark.createDataFrame([(1, "answer", 5), (2, "answer", None)], "call_item_uid long, task string, prompt_tokens long")
    c = c.withColumns({"provider_call_uid": F.col("call_item_uid"), "completion_tokens": F.lit(1), "latency_ms": F.lit(1.0)})
    row = E.cost_by_phase(c).first()
    assert (row.prompt_total, row.prompt_seen, row.completion_total) == (None, 5, 2)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    tidy = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    mine = sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([tidy(r[names.index(c)]) for c in cols]) for r in want.fetchall())
    assert mine == theirs


def test_every_snapshot_has_its_neighbors(spark):
    rows = duckdb.execute(f"SELECT * FROM '{DATA}/embeddings.parquet'").fetchnumpy()
    got = QUERIES["f13_expand_neighbors"](spark, DATA).collect()
    place = {r.snapshot_id: (r.trajectory_id, r.version) for r in view(spark, DATA, "fx_vectors").select("snapshot_id", "trajectory_id", "version").collect()}
    at = {v: k for k, v in place.items()}
    assert len(place) == len(at) == len(next(iter(rows.values())))
    assert sorted(map(tuple, got)) == sorted((k, at[t, n + d]) for k, (t, n) in place.items() for d in (-1, 0, 1) if (t, n + d) in at)
