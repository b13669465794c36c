"""Document fingerprints by content-defined chunking.

A rolling gear hash over the last 16 bytes proposes boundaries; normalised chunking takes a rare kind before the mean
size and a common kind after it, between a least and a most size. A fingerprint is the set of a text's distinct chunk
digests with their lengths. Because boundaries depend on nearby bytes only, an edit changes the chunks around it and no
others, wherever it shifts the rest. Likeness is containment weighted by length: bytes of shared chunks over the bytes
of the smaller set (1 for two empty texts, 0 if one is empty).

The next document of a table is the next lower id (after the last, the first again); equal ids are ordered by their
text, null ids come last, null texts are empty. Rows are dealt to blocks of neighbouring ids, each block also gets the
first row of the next one, and every block is read in order: no pass sorts the table in one task. Repeated rows stay;
an empty table gives no rows; other columns are ignored. Ids are whole numbers (others are cast to them); rows of one id lie in
one block. A very long text is chunked as a whole, with its edited text and the next one in memory.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stage

#: Least, mean and most bytes of a chunk.
LEAST, MEAN, MOST = 24, 64, 256
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Seven bits before the mean size, five after it, of those that see the last 16 bytes.
_RARE, _OFTEN = np.uint32(0x7F << 9), np.uint32(0x1F << 11)
_PAIR = np.dtype([("digest", ">u8"), ("length", ">u2")])


def _cuts(size: int, rare: list[int], often: list[int], start: int) -> list[int]:
    """Chunk ends of the text at start..start+size, given the places of both kinds of boundary."""
    ends, pos, end, i, j = [], start, start + size, bisect_left(rare, start), bisect_left(often, start)
    n, m = len(rare), len(often)
    while end - pos > LEAST:
        low, mid, high = pos + LEAST, pos + MEAN, min(pos + MOST, end)
        while i < n and rare[i] < low:
            i += 1
        if i < n and rare[i] <= min(mid, high):
            pos = rare[i]
        else:
            j = bisect_left(often, mid, j)
            pos = often[j] if j < m and often[j] <= high else high
        ends.append(pos)
    if pos < end:
        ends.append(end)
    return ends


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct (digest, length) pairs, in order of digest."""
    data = b"".join(texts)
    flat = np.frombuffer(data, np.uint8)
    rare, often = [], []
    block = 1 << 20
    for at in range(0, len(flat), block):
        lead = min(at, 16)
        h = _GEAR[flat[at - lead : at + block]]
        for s in (1, 2, 4, 8):
            shifted = h[:-s] << np.uint32(s)
            h = h.copy()
            h[s:] += shifted
        h = h[lead:]
        rare.append(np.flatnonzero((h & _RARE) == 0) + at + 1)
        often.append(np.flatnonzero((h & _OFTEN) == 0) + at + 1)
    rare, often = (np.concatenate(x).tolist() if x else [] for x in (rare, often))
    out, start, view, digest = [], 0, memoryview(data), xxhash.xxh3_64_intdigest
    for t in texts:
        ends = _cuts(len(t), rare, often, start)
        seen, pos = {}, start
        for e in ends:
            seen[digest(view[pos:e])] = e - pos
            pos = e
        pairs = np.empty(len(seen), _PAIR)
        pairs["digest"] = np.fromiter(seen.keys(), np.uint64, len(seen))
        pairs["length"] = np.fromiter(seen.values(), np.int64, len(seen))
        out.append(pairs[np.argsort(pairs["digest"])])
        start += len(t)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Length-weighted containment of the smaller fingerprint in the larger."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b["digest"], a["digest"]), len(b) - 1)
    shared = int(a["length"][b["digest"][at] == a["digest"]].sum())
    return min(1.0, shared / min(int(a["length"].sum(dtype=np.int64)), int(b["length"].sum(dtype=np.int64))))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (block, halo, order) -> one result for each row that is no halo. The last row waits for its next one."""
    last = None
    for b in batches:
        block, halo, ids = b.column("block").to_pylist(), b.column("halo").to_pylist(), b.column("doc_id").to_pylist()
        rows = list(zip(block, halo, ids, b.column("text").to_pylist(), strict=True))
        rows = ([last] if last else []) + rows
        last = rows[-1] if rows else None
        pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1]]
        at = 0
        while at < len(pairs):  # by about 4 MB of text
            end, size = at, 0
            while end < len(pairs) and size < 4 << 20:
                size += len(pairs[end][0][3])
                end += 1
            part, at = pairs[at:end], end
            news = [edited(x[3], y[3]).encode() for x, y in part]
            prints = fingerprints([x[3].encode() for x, _ in part] + [part[-1][1][3].encode()] + news)
            own, changed = prints[: len(part) + 1], prints[len(part) + 1 :]
            # the next document of a row is the row after it, but for a block's last row, which its halo follows
            lone = [k for k in range(len(part) - 1) if part[k][1] is not part[k + 1][0]]
            far = dict(zip(lone, fingerprints([part[k][1][3].encode() for k in lone]), strict=True))
            yield pa.RecordBatch.from_pydict({
                "doc_id": [x[2] for x, _ in part], "n_chars": [len(x[3]) for x, _ in part],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in news],
                "fingerprint": [p.tobytes().hex() for p in own[:-1]], "edited_fingerprint": [p.tobytes().hex() for p in changed],
                "near_edited": [likeness(p, c) for p, c in zip(own, changed, strict=False)],
                "near_next": [likeness(own[k], far.get(k, own[k + 1])) for k in range(len(part))],
            }, schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compared_with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    edges = slim.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] if blocks > 1 else []
    edges = np.array(sorted(set(edges or []), reverse=True), np.int64)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(-(2**63)).to_numpy(np.int64)
        found = np.searchsorted(-edges, -np.maximum(known, -(2**63) + 1), "left")
        return pd.Series(np.where(ids.isna(), len(edges), found))

    dealt = slim.withColumn("block", block_of("doc_id"))
    # the first row of each block, for the block before it: as many rows as blocks
    heads = slim.select("doc_id").withColumn("block", block_of("doc_id")).groupBy("block").agg(F.max("doc_id").alias("head"))
    order = [r["block"] for r in heads.select("block").orderBy("block").collect()]
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    heads = stage(heads, "heads")
    first = slim.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("block", "doc_id").agg(F.min("text").alias("text"))  # one row for each block
    to = spark.createDataFrame([(int(a), int(b)) for a, b in before.items()], "block int, to int")
    halo = first.join(F.broadcast(to), "block").select("doc_id", "text", F.col("to").alias("block"), F.lit(1).alias("halo"))
    both = dealt.select("doc_id", "text", "block", F.lit(0).alias("halo")).unionByName(halo)
    ordered = both.repartition("block").sortWithinPartitions("block", "halo", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.select("block", "halo", "doc_id", "text").mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
