"""Tables that are written once: what joins may make of them."""

from colloquy.sources.staging import BROADCAST_FILES, written_once


def test_a_table_of_repeated_texts_is_not_broadcast(spark, tmp_path):
    # its files are within Spark's limit for a broadcast, its rows in memory are far beyond what they seem
    make = lambda n: lambda: spark.range(n).selectExpr("id", "uuid() AS own", "repeat('the same long text ', 50) AS text")
    big, few = (written_once(spark, f"staging-test-{tmp_path.name}", name, make(n)) for name, n in (("big", 20_000), ("few", 10)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    files = int(str(big._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert BROADCAST_FILES < files < 10 << 20
    other = spark.range(10_000_000)
    assert "Broadcast" not in plan(other.join(big, "id"))
    assert "BroadcastHashJoin" in plan(other.join(few, "id"))
    assert big.count() == 20_000 and few.count() == 10
