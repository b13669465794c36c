"""Large buckets of nearly the same classes are compared together."""

from pyspark.sql import functions as F

from colloquy.llm import ngram_jaccard as N


def test_buckets_of_nearly_the_same_members_become_one_crowd(spark):
    # ten buckets of the classes 0 to 39, each without one of its own; and one of other classes
    rows = [(b, 39, 3900, k, 100, k) for b in range(10) for k in range(40) if k != b + 30] + [(99, 30, 3000, 1000 + k, 100, k) for k in range(30)]
    subs = spark.createDataFrame(rows, "sub long, members long, size long, key long, n long, comp long")
    got = N._crowds(subs)
    assert got.count() <= 3 * 40 + 30 < len(rows)
    crowds = {}
    for r in got.collect():
        crowds.setdefault((r.sub, r.members, r.size), set()).add(r.key)
        assert (r.n, r.comp) == (100, r.key % 1000)
    assert all(len(keys) == members and size == 100 * members for (_, members, size), keys in crowds.items())
    for b in (*range(10), 99):
        own = {r[3] for r in rows if r[0] == b}
        assert any(own <= keys for keys in crowds.values())


def test_buckets_that_share_one_member_stay_apart(spark):
    # every bucket has class 0 and 30 classes of its own, so that one crowd would make ten times the comparisons
    least = spark.range(1000).select(F.min_by("id", F.xxhash64("id"))).first()[0]
    rows = [(b, 31, 3100, k, 100, k) for b in range(10) for k in (least, *(1000 * (b + 1) + i for i in range(30)))]
    got = N._crowds(spark.createDataFrame(rows, "sub long, members long, size long, key long, n long, comp long"))
    assert {len({r.key for r in part}) for part in [[r for r in got.collect() if r.sub == s] for s in {r.sub for r in got.collect()}]} == {31}
