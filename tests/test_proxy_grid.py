"""The cell of the ablation grid that packets are held against."""

from pyspark.sql import functions as F

from colloquy.plans import audit, memory
from colloquy.sources.fixtures import Views


def test_only_the_cell_and_variants_that_are_read_are_made_and_are_the_grids(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    made = audit.proxy_grid(v)
    want = memory.grid(v).where("cutoff = 15 AND budget = 400").where(F.col("variant").isin(audit.PROXIES))
    assert made.count() == want.count() > 0
    assert made.exceptAll(want).count() == 0 == want.exceptAll(made).count()
