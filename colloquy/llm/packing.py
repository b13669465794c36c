"""Best-fit-decreasing packing of token sequences, for a whole corpus at once.

Lengths are at most ``capacity``, so the corpus comes down to a histogram of that many sizes. Best fit decreasing runs
over it: a segment tree over the remaining capacities finds the tightest open bin that takes a size, in logarithmic
time; all documents of one size that go to like bins are placed by one step. The steps (a few thousand intervals of
ranks within a size, however large the corpus) are joined back to the pieces by size and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .runtime import small, stage
from .word_bpe import encoder
from .wordhash import parts

CAPACITY, END_ID = 4096, 1


class CapacityTree:
    """A segment tree over remaining capacities 0..top with the number of open bins of each."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        at = self.width + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of an open bin that is ``size`` or more."""
        at = self.width + size
        while not self.count[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.width:
            at = 2 * at + (not self.count[2 * at])
        return at - self.width


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (size, lo, hi, bin, per_bin, used): of the items of a size, those with ranks lo..hi-1 go ``per_bin`` to a
    bin to the bins from ``bin`` on, each of which already holds ``used``."""
    tree, bins, steps, opened = CapacityTree(capacity), defaultdict(list), [], 0

    def keep(room: int, first: int, n: int) -> None:
        if n:
            tree.add(room, n)
            bins[room].append((first, n))

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = tree.tightest(size)
            per = (capacity if room is None else room) // size
            if room is None:
                room, first, n = capacity, opened, -(-left // per)
                opened += n
            else:
                first, n = bins[room].pop()
                tree.add(room, -n)
            full = min(n, left // per)
            if full:
                steps.append((size, rank, rank + full * per, first, per, capacity - room))
                keep(room - per * size, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:
                steps.append((size, rank, rank + min(left, per), first + full, per, capacity - room))
                keep(room - min(left, per) * size, first + full, 1)
                rank, left, full = rank + min(left, per), left - min(left, per), full + 1
            keep(room, first + full, n - full)
    return steps


def id_type(tokenizer: str) -> str:
    """The numpy type that ids travel in: two bytes if the vocabulary allows it."""
    return "<u2" if encoder(tokenizer).size <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The documents' token ids, each followed by ``end_id``, cut where longer than ``capacity``.

    Rows: doc_id, piece, start, length, ids_crc32, and (part, place): the partition that made the row and its number
    there among those of its length; with ``with_ids`` the ids as a binary of ``id_type``. A null text is empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen, kind = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int), id_type(tokenizer)
        for b in parts(batches, limit=3 << 20):
            ids, offs = bpe.encode(b.column("text"))
            rows, number, start, length, crc, place, cuts = [], [], [], [], [], [], []
            for k in range(len(b)):
                mine = np.append(ids[offs[k] : offs[k + 1]], end_id).astype("<u4")
                for j, s in enumerate(range(0, len(mine), capacity)):
                    piece = mine[s : s + capacity]
                    n = len(piece)
                    rows.append(k)
                    number.append(j)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(piece.tobytes()))
                    place.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        cuts.append(piece.astype(kind).tobytes())
            out = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(place, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            if with_ids:
                out.append(pa.array(cuts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to staged pieces.

    A rank within a size is the pieces of that size in earlier partitions plus the place in the own one, so no size,
    however common, is sorted in one task.
    """
    spark = cut.sparkSession
    counts = stage(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "sizes")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    steps = spark.createDataFrame(best_fit_decreasing(histogram, capacity), "length long, lo long, hi long, bin long, per_bin long, used long")
    ranked = cut.join(small(stage(base, "bases"), 24), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    put = ranked.join(F.broadcast(steps), [ranked["length"] == steps["length"], F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")]).drop(steps["length"])  # a few thousand rows at any size
    nth = F.col("rank") - F.col("lo")
    return put.withColumn("sequence_id", F.col("bin") + F.floor(nth / F.col("per_bin"))).withColumn("offset", F.col("used") + F.pmod(nth, F.col("per_bin")) * F.col("length")).drop("rank", "lo", "hi", "bin", "per_bin", "used", "base", "part", "place")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored, and a null id stays null.
    """
    cut = stage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    return place(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _sequences(capacity: int, kind: str, doc_type: pa.DataType):
    """Rows in order of (sequence_id, offset) -> one row for each sequence. The last sequence waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def written(rows: list[dict]) -> pa.RecordBatch:
            groups: list[list[dict]] = []
            for r in rows:
                if not groups or groups[-1][0]["sequence_id"] != r["sequence_id"]:
                    groups.append([])
                groups[-1].append(r)
            ids, positions, ends, tokens = [], [], [], []
            for g in groups:
                sizes = np.array([r["length"] for r in g])
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                line, place = np.zeros(capacity, "<u4"), np.zeros(capacity, "<u4")
                line[: bounds[-1]] = np.frombuffer(b"".join(r["ids"] for r in g), kind)
                place[: bounds[-1]] = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
                ids.append(line.tobytes())
                positions.append(place.tobytes())
                ends.append(bounds.tolist())
                tokens.append(int(bounds[-1]))
            each = lambda c: [[r[c] for r in g] for g in groups]
            return pa.RecordBatch.from_arrays([
                pa.array([g[0]["sequence_id"] for g in groups], pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()),
                pa.array(ends, pa.list_(pa.int32())), pa.array(positions, pa.binary()), pa.array(each("doc_id"), pa.list_(doc_type)),
                pa.array(each("piece"), pa.list_(pa.int32())), pa.array(each("start"), pa.list_(pa.int64())),
            ], MATRIX)

        for b in batches:
            for at in range(0, len(b), 512):
                rows = waiting + b.slice(at, 512).to_pylist()
                last = next((k for k in range(len(rows) - 1, 0, -1) if rows[k]["sequence_id"] != rows[k - 1]["sequence_id"]), 0)
                waiting = rows[last:]
                if last:
                    yield written(rows[:last])
        if waiting:
            yield written(waiting)

    return run


MATRIX = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "starts"]


def packed_matrix(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed matrix, one row per sequence: sequence_id, n_tokens, ids and position_ids (little-endian unsigned 32-bit
    binaries of ``capacity`` numbers, zeros behind the tokens; positions start again at 0 in each segment), cu_seqlens (0
    and each segment's end), and the segments' doc_ids, pieces and starts. No token is lost or cut off.

    Ids travel once, as two-byte binaries where the vocabulary allows it, and only to the partition of their sequence,
    which reads its rows in order: a sequence has at most ``capacity`` tokens.
    """
    put = place(stage(pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces"), capacity)
    rows = put.select("sequence_id", "offset", "length", "doc_id", "piece", "start", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    kind = docs.schema["doc_id"].dataType
    schema = f"sequence_id long, n_tokens long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind.simpleString()}>, pieces array<int>, starts array<long>"
    return rows.drop("offset").mapInArrow(_sequences(capacity, id_type(tokenizer), to_arrow_type(kind)), schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the matrix as Parquet, a row per sequence, as it is."""
    packed.select("sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids").write.parquet(path)
