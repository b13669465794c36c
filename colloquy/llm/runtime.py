"""Small helpers for jobs that have to cut their lineage, size a broadcast or deal out a hot key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this many bytes, counted before the join is planned.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that may meet in one task of a dealt join, and the slots in which hot keys are told where they are many.
HOT_ROWS, SLOTS = 1024, 64
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session has a
    temporary folder of its own, and a cluster a folder in its warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master.startswith("local")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged-{app}"
    return _OWN[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a later task loss never recomputes what is above.

    The tables of an application lie in one folder, which ``clear_staged`` removes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/colloquy-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> bool:
    """Removes this application's staged tables; frames that were built on them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/colloquy-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast only if a count of the staged rows proves that they fit; the plain join otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dealt_join(rows: DataFrame, table: DataFrame, key: str, by: str, counts: DataFrame) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which has one row for each ``key``, without a hot task.

    ``counts`` has (key, rows). A key of more than ``HOT_ROWS`` rows is dealt by the hash of ``by`` over copies of its row
    of the table. Where hot keys are too many to broadcast, ``rows`` meet them in slots, which deals them out as well.
    """
    hot = stage(counts.where(F.col("rows") > HOT_ROWS).select(key, F.ceil(F.col("rows") / HOT_ROWS).alias("__salts")), "hot")
    salts = F.coalesce("__salts", F.lit(1))
    if hot.count() * 24 <= BROADCAST_BYTES:
        left = rows.join(F.broadcast(hot), key, "left")
    else:
        slotted = hot.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).cast("long"))
        left = rows.withColumn("__slot", F.pmod(F.xxhash64(by, F.lit(1)), F.lit(SLOTS)).cast("long")).join(slotted, [key, "__slot"], "left").drop("__slot")
    left = left.withColumn("__salt", F.pmod(F.xxhash64(by), salts)).drop("__salts")
    right = table.join(small(hot, 24), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")
