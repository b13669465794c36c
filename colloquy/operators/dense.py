"""Nearest vectors by cosine over an inverted file of cells, approximate or exact, without a pair of all.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors with the least hash of their id, a parameter); every vector is put into the
cell of its nearest centroid. A query meets the cells of its ``probes`` nearest centroids, all of them for the exact answer. Vectors
of a group's cell are dealt to blocks of about ``BLOCK``, queries to blocks of their own; a block pair is one matrix product, of which
each query keeps its best ``k``, so that what goes on is bounded by queries, blocks and k.

Null vectors and those of length 0 or norm 0 are nearest to nothing. Ties (scores to six places) go by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors that centroids are fitted on, at most; vectors and queries of a block, about; rounds of the fit.
SAMPLE, BLOCK, QUERIES, ROUNDS = 8192, 4096, 1024, 8


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Whether a vector has a direction and is finite."""
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & (square > 0) & (square < math.inf)


def _usable(df: DataFrame, vector: str) -> DataFrame:
    return df.where(usable(vector))


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Unit centroids, fitted by spherical k-means on at most ``sample`` vectors (vec_id, embedding)."""
    taken = _usable(vectors, "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    if not taken:
        return np.zeros((0, 1))
    x, rng = _unit([r[0] for r in taken]), np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def _celled(df: DataFrame, vector: str, c: np.ndarray, probes: int) -> DataFrame:
    """``df`` with ``cells``: the ``probes`` nearest centroids of its vector."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            close = _unit(b.column(vector).to_pylist()) @ c.T if b.num_rows else np.zeros((0, len(c)))
            best = np.argsort(-close, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(best), pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    return df.mapInArrow(near, T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def topk(queries: DataFrame, vectors: DataFrame, k: int = 4, cells: int = 16, probes: int | None = 4, sample: int = SAMPLE) -> DataFrame:
    """(query_id, vec_id, score, rank): of each query (by, query_id, query) the ``k`` nearest vectors (by, vec_id, embedding) of its
    group ``by``. ``probes`` None takes every cell: exact."""
    v, q = _usable(vectors.select("by", "vec_id", "embedding"), "embedding"), _usable(queries.select("by", "query_id", "query"), "query")
    c = centroids(v, cells, sample)
    if not len(c):
        return q.select("query_id", F.lit(None).cast(vectors.schema["vec_id"].dataType).alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    v = _celled(v, "embedding", c, 1).select("by", "vec_id", "embedding", F.col("cells")[0].alias("cell"))
    q = _celled(q, "query", c, probes or len(c)).select("by", "query_id", "query", F.explode("cells").alias("cell"))
    return _nearest(q, v, k)


def all_pairs(queries: DataFrame, vectors: DataFrame, k: int = 4) -> DataFrame:
    """What ``topk`` gives, with every pair of a group compared and nothing fitted; a group's vectors are of one length."""
    cell = F.lit(0).alias("cell")
    return _nearest(_usable(queries, "query").select("by", "query_id", "query", cell), _usable(vectors, "embedding").select("by", "vec_id", "embedding", cell), k)


def _nearest(q: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query among the vectors of its group's cells, by block pairs."""
    # how many blocks a group's cell is dealt to
    deal = lambda df, most, name: df.groupBy("by", "cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    blocks = deal(v, BLOCK, "vb").join(deal(q, QUERIES, "qb"), ["by", "cell"])
    mark = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = v.join(blocks, ["by", "cell"]).withColumn("vi", mark("vec_id", "vb")).withColumn("qi", each("qb"))
    right = q.join(blocks, ["by", "cell"]).withColumn("qi", mark("query_id", "qb")).withColumn("vi", each("vb"))
    vec, ask = v.schema["vec_id"].dataType.simpleString(), q.schema["query_id"].dataType.simpleString()
    doubles = lambda x: F.transform(x, lambda y: y.cast("double"))
    both = left.select("by", "cell", "vi", "qi", "vec_id", F.lit(None).cast(ask).alias("query_id"), doubles("embedding").alias("x"), F.lit(0).alias("side")).unionByName(right.select("by", "cell", "vi", "qi", F.lit(None).cast(vec).alias("vec_id"), "query_id", doubles("query").alias("x"), F.lit(1).alias("side")))

    def best(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, asks = table.column("vec_id"), table.column("query_id")
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x = table.column("x").to_pylist()
        base, found, who, score = _unit([x[i] for i in a]), [], [], []
        for at in range(0, len(b), 256):
            part = b[at : at + 256]
            close = np.round(_unit([x[i] for i in part]) @ base.T, 6)
            for i, row in zip(part, close, strict=True):
                # every vector as near as the k-th: ties are settled by id behind
                edge = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                near = np.flatnonzero(row >= edge)
                found += a[near].tolist()
                who += [int(i)] * len(near)
                score += row[near].tolist()
        return pa.table({"query_id": asks.take(pa.array(who, pa.int64())), "vec_id": ids.take(pa.array(found, pa.int64())), "score": pa.array(score, pa.float64())})

    met = both.groupBy("by", "cell", "vi", "qi").applyInArrow(best, f"query_id {ask}, vec_id {vec}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    got = hit.agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("all")).first()
    return got["hit"] / got["all"] if got["all"] else math.nan
