"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has 64 bits: each is 1 if it is set in more than half of the hashes of its shingles. For every distinct
fingerprint a table of Hamming distances to ``PIVOTS`` reference fingerprints is made once, each distance also by the
``BLOCKS`` blocks of bits that it is the sum of. Two fingerprints that differ in ``NEAR`` = 3 bits or fewer

* differ by at most 3 in every coordinate of the table: a pair with a larger difference is discarded;
* have at least BLOCKS - 3 blocks without a differing bit, so that all coordinates of these blocks are equal. Distances to whole
  references alone lie too close together to look anything up by (nearly half of all pairs are within 3 of one another
  at one reference), block coordinates do not: candidates share all coordinates of some three of the six blocks.

What passes is verified by the differing bits themselves. Equal fingerprints are one class from the start, however many documents
have them. A bucket of candidates is not expanded into all its pairs: each member first meets one leader, links are
closed into components, and only members of different components of a bucket meet one another. Large buckets are cut into blocks
of members, whose pairs are compared as matrices of coordinates and give a spanning set of links. No link between
different components is lost, and no cap or sample is taken.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles three words (repeats count) joined by a
space, their hashes XXH64 of UTF-8 with seed 42; a text of fewer words is one shingle. Null, empty and blank texts have fingerprint zero and link with
one another, and with any other that is near, like all. Whole texts are used, however long. Repeated rows and ids keep their rows; a null id is never the smallest
of a component unless all its ids are null; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import dealt_join, stage
from .wordhash import chunks, column_bytes, parts

#: Words in a shingle, the seed of their hashes, and differing bits of a link.
WIDTH, SEED, NEAR = 3, 42, 3
#: Reference fingerprints, eight to a word of the table, and blocks of bits.
PIVOTS, BLOCKS = 16, 6
#: Buckets up to this many members are compared as pairs, larger ones in blocks of this many.
PAIR_BUCKET, BLOCK_MEMBERS = 24, 2048
_REFERENCES = np.random.default_rng(20240713).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
_BOUNDS = [round(64 * b / BLOCKS) for b in range(BLOCKS + 1)]
_MASKS = [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(_BOUNDS, _BOUNDS[1:], strict=False)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text of a column."""
    data, offs = column_bytes(texts)
    out = np.zeros(len(offs) - 1, np.uint64)
    for lo, hi in chunks(offs):
        hashes, sizes = [], []
        for k in range(lo, hi):
            words = data[offs[k] : offs[k + 1]].tobytes().translate(_LOWER).split()
            # with single spaces a shingle is a slice of the text
            ends = np.cumsum([len(w) + 1 for w in words]) if words else np.zeros(0, np.int64)
            text = b" ".join(words)
            if len(words) <= width:
                own = [xxhash.xxh64_intdigest(text, SEED)] if words else []
            else:
                starts = np.concatenate(([0], ends[:-width]))
                own = [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
            hashes += own
            sizes.append(len(own))
        sizes = np.array(sizes, np.int64)
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        h = np.array(hashes, np.uint64)
        # 64 flags a hash, lowest bit first, in slices of a bounded number of hashes
        ends, count = np.cumsum(sizes), np.zeros((len(sizes), 64), np.int64)
        for at in range(0, len(h), 1 << 16):
            part = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = some[np.searchsorted(ends[some], at, "right") : np.searchsorted(ends[some] - sizes[some], at + len(part), "left")]
            count[rows] += np.add.reduceat(part, np.maximum(ends[rows] - sizes[rows] - at, 0), axis=0, dtype=np.int64)
        bits = (2 * count > sizes[:, None]).astype(np.uint8)
        out[lo:hi] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: (doc_id, fp), the fingerprint as a signed 64-bit number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text"), width).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, f"doc_id {kind}, fp long")


def distances(fp: np.ndarray) -> np.ndarray:
    """(fingerprint, pivot, block) of the table of distances."""
    apart = fp[:, None] ^ _REFERENCES
    return np.stack([np.bitwise_count(apart & mask) for mask in _MASKS], 2)


def pivot_table(prints: DataFrame) -> DataFrame:
    """(fp, copies, d0, d1, keys) of (fp, copies): the distances to the references, a byte each, eight to a word, and a
    key for each choice of blocks, made of all their coordinates."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = distances(b.column("fp").to_numpy().view(np.uint64))
            whole = np.ascontiguousarray(table.sum(2).astype(np.uint8)).view("<u8").astype(np.int64)
            keys = []
            for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - NEAR)):
                own = np.ascontiguousarray(table[:, :, list(chosen)].reshape(len(table), -1))
                keys.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=n) for row in own])
            keys = np.array(keys, np.uint64).T.reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * (len(keys) // max(1, len(table)))), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column("fp"), b.column("copies"), pa.array(whole[:, 0]), pa.array(whole[:, 1]), lists], ["fp", "copies", "d0", "d1", "keys"])

    return prints.mapInArrow(made, "fp long, copies long, d0 long, d1 long, keys array<long>")


def _near(a: str, b: str) -> Column:
    """The coordinates of the fingerprints in columns ``a`` and ``b`` differ by at most NEAR, and then their bits do."""
    byte = lambda c, k: F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(F.lit(255))
    apart = [F.abs(byte(f"{a}_d{w}", k) - byte(f"{b}_d{w}", k)) <= NEAR for w in (0, 1) for k in range(8)]
    out = apart[0]
    for x in apart[1:]:
        out = out & x
    return out & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= NEAR)


def _block_links(table: pa.Table) -> pa.Table:
    """A spanning set of the links of two blocks of a bucket (or of one with itself).

    Pairs of one component are left out, then those of different coordinates, one reference after the other; what is left is
    verified. Each turn of the loop takes the members that are near one member, so that a crowd gives a row for each member.
    """
    fp = table.column("fp").to_numpy()
    comp, side = table.column("comp").to_numpy(), table.column("side").to_numpy()
    whole = np.stack([table.column(c).to_numpy() for c in ("d0", "d1")], 1).copy().view(np.uint8).reshape(len(fp), -1).astype(np.int16)
    _, root = np.unique(comp, return_inverse=True)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    a, b = [], []
    for i in left:
        some = right[root[right] != root[i]]
        for k in range(whole.shape[1]):
            if not len(some):
                break
            some = some[np.abs(whole[some, k] - whole[i, k]) <= NEAR]
        some = some[np.bitwise_count((fp[some] ^ fp[i]).view(np.uint64)) <= NEAR]
        if len(some):
            _, first = np.unique(root[some], return_index=True)  # one link to each component, which then is the same one
            for j in some[first]:
                a.append(fp[i])
                b.append(fp[j])
                root[root == root[j]] = root[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_components(prints: DataFrame) -> DataFrame:
    """(node, root) over the distinct fingerprints of (fp, copies); those without a link are left out."""
    table = stage(pivot_table(prints), "pivots")
    member = table.select("fp", "copies", "d0", "d1", F.explode("keys").alias("h"))
    leader = member.groupBy("h").agg(F.max(F.struct("copies", "fp", "d0", "d1")).alias("l"), F.count(F.lit(1)).alias("members")).where("members > 1")
    leader = stage(leader.select("h", "members", F.col("l.fp").alias("b"), F.col("l.d0").alias("b_d0"), F.col("l.d1").alias("b_d1")), "leaders")
    shared = dealt_join(member, leader, "h", "fp", leader.select("h", F.col("members").alias("rows")))
    shared = stage(shared.select("h", "members", F.col("fp").alias("a"), F.col("d0").alias("a_d0"), F.col("d1").alias("a_d1"), "b", "b_d0", "b_d1"), "members")
    found = stage(shared.where(F.col("a") != F.col("b")).where(_near("a", "b")).select("a", "b").distinct(), "links")
    root = stage(components(found), "roots")

    placed = shared.join(root.withColumnRenamed("node", "a"), "a", "left").select("h", "members", "a", "a_d0", "a_d1", F.coalesce("root", "a").alias("comp"))
    placed = stage(placed, "placed")
    open_ = stage(placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("h", "n"), "open")
    placed = stage(dealt_join(placed, open_, "h", "a", open_.select("h", F.col("n").alias("rows"))), "open_members")
    few = placed.where(F.col("members") <= PAIR_BUCKET)
    x = few.select("h", "a", "a_d0", "a_d1", F.col("comp").alias("ca"))
    y = few.select("h", F.col("a").alias("b"), F.col("a_d0").alias("b_d0"), F.col("a_d1").alias("b_d1"), F.col("comp").alias("cb"))
    found = found.unionByName(x.join(y, "h").where("a < b AND ca <> cb").where(_near("a", "b")).select("a", "b"))

    crowd = placed.where(F.col("members") > PAIR_BUCKET)
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    crowd = crowd.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    # block i of a bucket meets every block j of it: it stands left for j > i and right for j < i
    met = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), F.col("a").alias("fp"), F.col("a_d0").alias("d0"), F.col("a_d1").alias("d1"), "comp")
    found = found.unionByName(met.groupBy("h", "i", "j").applyInArrow(_block_links, "a long, b long"))
    return components(stage(found, "links"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id, class_id), the fingerprint in 16 hex digits.

    component_id is the smallest id that links of at most NEAR differing bits reach, class_id the smallest one of the same fingerprint.
    """
    prints = stage(document_fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    root = near_components(classes.select("fp", "copies"))
    named = classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id", F.col("least").alias("class_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_id")
