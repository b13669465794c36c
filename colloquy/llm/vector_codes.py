"""Vector codes over small codebooks, by per-dimension value dictionaries.

Components are scaled and floored to integers and vectors cut into equal parts; each part has a codebook of its own. Blocks of
vectors are written once in dictionary form: for each dimension the distinct integers of the block, and for each vector the
places of its components among them. A pass over the blocks tabulates, for each dimension, the squared differences of every
distinct integer to the component of every codebook entry; the distances of a part are then gathers from these tables, added
up. A pass that fits sends sums and counts of each entry, (parts x entries) rows at most, so that nothing that grows
with the vectors reaches the driver and no vector is shuffled.

A row is dropped if its vector is null, holds null or non-finite components, or one beyond 2**19 either way (its squared
differences, summed, would not fit 64 bits), or has not the table's length: the one that most of the rows have that can be cut
into the parts, the shortest of several such. The first entries are the parts of the rows with the least ids (null ids last, ties by vector); of fewer
rows than entries all. Repeated rows and ids keep their rows and count each time; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_BYTES, dealt_join, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, which shares its dictionaries.
BLOCK = 4096
_LIMIT = 1 << 19


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(id, label, v): the rows that can be coded, components as integers floor(SCALE * x)."""
    fits = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= _LIMIT))  # false for NaN, which is above all
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & fits.cast("boolean"))
    length = kept.select(F.size("v").alias("n")).where((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    return kept.where(F.size("v") == (length[0]["n"] if length else -1)).select("id", "label", whole.alias("v"))


def value_blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors in dictionary form: ids, labels, the dictionaries one after the other, their sizes, and places."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                values, places = zip(*(np.unique(v[:, d], return_inverse=True) for d in range(v.shape[1])), strict=True)
                codes = np.stack(places).astype("<u2")
                columns = [one(part.column("id")), one(part.column("label")), one(pa.array(np.concatenate(values))), one(pa.array([len(x) for x in values], pa.int32())), pa.array([codes.tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "labels", "values", "sizes", "places"])

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(coded, f"ids array<{kind['id']}>, labels array<{kind['label']}>, values array<bigint>, sizes array<int>, places binary")


def _opened(block: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The dictionaries of block ``k`` of a batch and the places, a row for each dimension."""
    sizes = block.column("sizes")[k].values.to_numpy()
    values = np.split(block.column("values")[k].values.to_numpy(), np.cumsum(sizes)[:-1])
    return values, np.frombuffer(block.column("places")[k].as_py(), "<u2").reshape(len(sizes), -1)


def nearest(values: list[np.ndarray], places: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of every part of every vector; ``books`` is (parts, entries, width). Ties to the lower index."""
    parts, _, width = books.shape
    n = places.shape[1]
    code, distance = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        total = 0
        for k in range(width):
            d = p * width + k
            table = (values[d][:, None] - books[p, :, k]) ** 2
            total = total + table[places[d]]
        code[:, p] = total.argmin(1)
        distance[:, p] = np.take_along_axis(total, code[:, p : p + 1], 1)[:, 0]
    return code, distance


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each used entry is the floored mean of its parts, component by component."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((width, parts * entries), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                values, places = _opened(b, k)
                code, _ = nearest(values, places, books)
                for p in range(parts):
                    at = code[:, p] + p * entries
                    np.add.at(count, at, 1)
                    for c in range(width):
                        d = p * width + c
                        np.add.at(total[c], at, values[d][places[d]])
        used = np.flatnonzero(count)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[:, used].T.ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], ["entry", "n", "total"])

    made = blocks.select("values", "sizes", "places").mapInArrow(sums, "entry long, n long, total array<long>")
    # a row for each entry at most
    rows = made.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(c))).alias(f"t{c}") for c in range(width))).collect()
    books = books.copy()
    for r in rows:
        books[r["entry"] // entries, r["entry"] % entries] = [r[f"t{c}"] // r["n"] for c in range(width)]
    return books


def train(vectors: DataFrame, blocks: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (parts, entries, width) after ``rounds`` rounds over all blocks; None if there is no vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code takes one byte: 1 to 256 entries")
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _refined(blocks, books)
    return books


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """One row per vector: (id, label, code, error), the code a byte for each part, the error the summed squared distances."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                code, distance = nearest(*_opened(b, k), books)
                raw = code.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("ids")[k].values, b.column("labels")[k].values, pa.array([x.tobytes() for x in raw]), pa.array(distance.sum(1))], ["id", "label", "code", "error"])

    kind = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema if f.name in ("ids", "labels")}
    return blocks.mapInArrow(coded, f"id {kind['ids']}, label {kind['labels']}, code binary, error long")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per coded vector: (id, code, error, label_error, codebooks_sha256); the code in hex digits, label_error
    the error of all vectors of the label (nulls are one)."""
    vectors = integer_vectors(rows, id_col, vector_col, label_col, parts)
    blocks = stage(value_blocks(vectors), "value_blocks")
    books = train(vectors, blocks, parts, entries, rounds)
    if books is None:
        coded = vectors.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = stage(encode(blocks, books), "codes")
    # labels may be nulls, and one may hold most rows: totals first, then a join that deals hot labels out
    coded = coded.withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = stage(coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label_errors")
    size = totals.agg(F.sum(F.length("of") * 4 + 32)).first()[0] or 0
    sums = totals.select("of", "label_error")
    named = coded.join(F.broadcast(sums), "of") if size <= BROADCAST_BYTES else dealt_join(coded, sums, "of", "id", totals.select("of", "rows"))
    return named.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
