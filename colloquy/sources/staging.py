"""Tables that several queries stand on, written once for each version of their inputs and read by all of them.

A version is a digest of the input files' names, sizes and times, so that changed inputs make a new one. What is written lies in
the folder that driver and executors share; a table is known only once its write has ended, and a lost executor reads it
again instead of computing what is above it.

Repeated texts and vectors take hardly any room in a file and all of it in memory, so that a size estimated from files lets joins
broadcast what no driver can hold. Only a table of a few files' bytes may be broadcast; the others are joined by merging.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the files of a table that joins may broadcast, at most.
BROADCAST_FILES = 256 << 10
_OWN: dict[str, str] = {}
_WRITTEN: dict[tuple[str, str, str], tuple[str, object, bool]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a local session's own temporary folder, or a folder in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master.startswith("local")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-staged-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged-{app}"
    return _OWN[app]


def version_of(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below ``paths``: their names, sizes and times, as their file system tells them."""
    told = []
    for path in sorted(paths):
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            continue
        found = files.listFiles(root, True)
        while found.hasNext():
            f = found.next()
            told.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:24]


def written_once(spark: SparkSession, version: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of a version: made and written by the first that asks for it."""
    key = (spark.sparkContext.applicationId, version, name)
    if key not in _WRITTEN:
        df = make()
        path = f"{shared_dir(spark)}/colloquy-{key[0]}/{version}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = root.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(root).getLength()
        _WRITTEN[key] = (path, df.schema, size <= BROADCAST_FILES)
    path, schema, little = _WRITTEN[key]
    table = spark.read.schema(schema).parquet(path)
    return table if little else table.hint("merge")


def forget(spark: SparkSession) -> bool:
    """Removes what this application has written; frames that stand on it can't be read any more."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _WRITTEN if k[0] == app]:
        del _WRITTEN[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/colloquy-{app}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
