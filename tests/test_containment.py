"""The containment index against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators.containment import found_in


def test_no_side_of_the_index_is_broadcast(spark):
    # sizes are estimated from the texts, pieces are many times larger
    x = spark.createDataFrame([(1, "tea", 1)], "sample_id int, surface string, text_id int")
    plan = found_in(x.select("sample_id", "surface"), x.select("sample_id", "text_id", x.surface.alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("words", [False, True])
def test_index_finds_what_all_pairs_find(spark, words):
    rng = random.Random(words)
    bits = ["a", "ab", "cab", "tea", "eat", "at", "b", "teapot", "x", "1"]
    texts = [(rng.randrange(3), k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for k in range(200)] + [(1, 900, None), (1, 901, ""), (None, 902, "tea")]
    surfaces = [(rng.randrange(4), " ".join(rng.choice(bits) for _ in range(rng.randint(0, 3)))) for _ in range(150)] + [(1, "ea p"), (1, "t"), (1, ""), (1, None), (2, "zzz"), (2, "tea zz")]
    got = found_in(spark.createDataFrame(surfaces, "sample_id int, surface string"), spark.createDataFrame(texts, "sample_id int, text_id int, text string"), words=words)
    want = set()
    for g, s in surfaces:
        for h, i, t in texts:
            if g == h and s is not None and t is not None and (f" {s} " in f" {t} " if words else s in t):
                want.add((g, s, i))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len(want) > 200


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("few", [0, 2])
def test_groups_of_few_and_of_many_surfaces_find_the_same(spark, words, few):
    rng = random.Random(few)
    texts = [(g, k, " ".join(rng.choice(["tea", "eat", "at", "pot"]) for _ in range(rng.randint(0, 5)))) for g in range(4) for k in range(30)]
    surfaces = [(g, x) for g in range(4) for x in ["tea", "", "at pot", "ea", "zz", "t"][: 1 + 2 * g]]
    got = found_in(spark.createDataFrame(surfaces, "sample_id int, surface string"), spark.createDataFrame(texts, "sample_id int, text_id int, text string"), words=words, few=few)
    inside = lambda s, t: (t == "" if s == "" else f" {s} " in f" {t} ") if words else s in t
    assert Counter(map(tuple, got.collect())) == Counter((g, s, i) for g, s in surfaces for h, i, t in texts if g == h and inside(s, t))


def test_a_text_is_not_sent_once_for_each_of_its_pieces(spark):
    x = spark.createDataFrame([(1, 1, "tea")], "sample_id int, text_id int, text string")

    def outputs(plan):
        yield {plan.output().apply(i).name() for i in range(plan.output().size())}
        for i in range(plan.children().size()):
            yield from outputs(plan.children().apply(i))

    seen = list(outputs(found_in(x.select("sample_id", F.col("text").alias("surface")), x)._jdf.queryExecution().optimizedPlan()))
    assert any("piece" in names for names in seen)
    assert not any("piece" in names and names & {"text", "surface"} for names in seen)
