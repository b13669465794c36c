"""N-gram Jaccard join: candidates must share prefix tokens under several global token orders.

A document is the set of its distinct 5-word shingles (64-bit hashes). If two sets of n and m tokens have a Jaccard
similarity of t or more, they share at least ceil(t * max(n, m)) tokens, so whatever the global order of tokens is, the
first n - ceil(t * n) + 1 tokens of each hold a common one. Three orders are used, one after the other:

1. by hash value, with a prefix that is longer by k = n // 4 tokens, of which at least about k must occur in another
   document. This needs half of each set and no statistics, and clears away most documents;
2. by document frequency among the documents left (rare first), ties by hash value: its prefix makes the buckets;
3. by document frequency, ties by another hash, and by frequency class, ties by a third hash: a pair from a bucket must
   also share a prefix token under each of these before its full sets are compared.

Equal sets are one class from the start. A bucket is not expanded into all its pairs: every member is first compared
with one leader, links are closed into components, and only members of different components of a bucket are then
compared with one another. Small buckets are joined with themselves. A large one is first cut by sizes (two sets that
differ by more than the threshold cannot link); what is still large is compared in blocks of sets, each pair of which
passes the size, second and third order before it is counted. Buckets of the same members are compared once, and those
of nearly the same ones together. Tokens
that very many classes have are dealt over several tasks in every join. No link between different components is lost.

Nulls, empty texts and texts without words have no shingles and link with nothing; very long texts are taken whole, alone in
memory; an empty table gives no row. Repeated rows and repeated ids keep
their rows; a null id is never the smallest id of a component unless all its ids are null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import dealt_join, small, stage
from .wordhash import parts, shingle_sets

#: Similarity in hundredths and words in a shingle.
THRESHOLD, WIDTH = 75, 5
#: Buckets up to this many classes are compared as pairs, larger ones in blocks.
PAIR_BUCKET = 24
#: Classes and tokens of a block, about.
BLOCK_CLASSES, BLOCK_TOKENS = 512, 1 << 20


def _need(n, threshold: int):
    """The least overlap of a set of n tokens with any set that it links to."""
    return -(-threshold * n // 100)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed=len(x)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: (id, n, key), key being a digest of its set; n and key are 0 for an empty set."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = list(shingle_sets(b.column("text"), width))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(_digests(sets))], ["doc_id", "n", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(digest, f"doc_id {kind}, n long, key long")


def _hash_order_survivors(docs: DataFrame, text_col: str, width: int, threshold: int) -> DataFrame:
    """(key, n) of the classes that pass the first order.

    Rows to the shuffle, made from some 8 MB of documents at once: (h, key) for a token that one class of them has; one
    (h, null) for a token that several have, so a token of very many documents costs a row for each 8 MB; and
    (some h, key, n, known) for each class, known being its tokens that were seen to be shared in the batch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [x for x in shingle_sets(b.column("text"), width) if len(x)]
            if not sets:
                continue
            keys, first = np.unique(_digests(sets), return_index=True)
            sets = [sets[i] for i in first]
            n = np.array([len(x) for x in sets])
            long = np.maximum(1, np.minimum(n, n - _need(n, threshold) + n // 4))
            tokens = np.concatenate([x[:k] for x, k in zip(sets, long, strict=True)])
            owner = np.repeat(np.arange(len(sets)), long)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            times = np.diff(np.append(np.flatnonzero(new), len(tokens)))
            alone = np.repeat(times == 1, times)
            known = np.bincount(owner[~alone], minlength=len(sets))
            many = tokens[new][times > 1].view(np.int64)
            # by class again: equal keys then stand together and compress well
            back = np.argsort(owner[alone], kind="stable")
            h = np.concatenate([tokens[alone][back].view(np.int64), many, keys])
            key = pa.concat_arrays([pa.array(keys[owner[alone][back]]), pa.nulls(len(many), pa.int64()), pa.array(keys)])
            size = pa.concat_arrays([pa.nulls(len(h) - len(keys), pa.int64()), pa.array(n.astype(np.int64))])
            count = pa.concat_arrays([pa.nulls(len(h) - len(keys), pa.int64()), pa.array(known.astype(np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(h), key, size, count], ["h", "key", "n", "known"])

    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "h long, key long, n long, known long")
    same = Window.partitionBy("h")
    token_of = F.when(F.col("n").isNull(), F.col("key"))
    several = F.max(F.col("n").isNull() & F.col("key").isNull()).over(same) | (F.min(token_of).over(same) < F.max(token_of).over(same))
    counted = made.select("key", "n", F.coalesce("known", several.cast("long"), F.lit(0)).alias("shared")).where("key is not null")
    return (
        counted.groupBy("key").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"))
        .where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") / 4) - 2))
        .select("key", "n")
    )


def _whole_sets(docs: DataFrame, sets: DataFrame, alive: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(key, n, copies, tokens) of the surviving classes, from one document of each."""
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = stage(sets.join(alive, ["key", "n"]).groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = small(chosen.select("rep").distinct(), 24)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [x for x in shingle_sets(b.column("text"), width) if len(x)]
            if sets:
                keys, first = np.unique(_digests(sets), return_index=True)
                sets = [sets[i].view(np.int64) for i in first]
                offs = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(sets)))], ["key", "tokens"])

    found = texts.select("text").mapInArrow(whole, "key long, tokens array<long>")
    return found.groupBy("key").agg(F.first("tokens").alias("tokens")).join(chosen, "key").select("key", "n", "copies", "tokens")


def _with_prefixes(whole: DataFrame, threshold: int) -> DataFrame:
    """(key, n, copies, tokens, p1, p2, p3): the tokens that other classes have too, and the prefix of each class under the three
    frequency-based orders; tokens of one class alone are left out.

    Such tokens come first in these orders, so that they use up the prefix of a class that has many of them.
    """
    token = whole.select("key", F.explode("tokens").alias("h"))
    df = token.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # what a class has alone is in no intersection: its shared tokens are all that is kept of it
    shared = token.join(df, "h").groupBy("key").agg(F.collect_list(F.struct("df", "h")).alias("s"))
    room = (F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - (F.col("n") - F.size("s"))).cast("int")
    x = whole.select("key", "n", "copies").join(shared, "key").withColumn("room", room).where("room > 0")
    first = F.sort_array("s")
    second = F.sort_array(F.transform("s", lambda t: F.struct(t.df, F.xxhash64(t.h, F.lit(2)).alias("o"), t.h.alias("h"))))
    third = F.sort_array(F.transform("s", lambda t: F.struct(F.floor(F.log2(t.df)).alias("df"), F.xxhash64(t.h, F.lit(3)).alias("o"), t.h.alias("h"))))
    cut = lambda s: F.transform(F.slice(s, F.lit(1), F.col("room")), lambda t: t.h)
    return x.select("key", "n", "copies", F.transform("s", lambda t: t.h).alias("tokens"), cut(first).alias("p1"), cut(second).alias("p2"), cut(third).alias("p3"))


def _links(pairs: DataFrame, whole: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b), those that pass the other orders and then the exact comparison."""
    side = lambda s: whole.select(*(F.col(c).alias(c if c == "key" else f"{c}_{s}") for c in ("key", "n", "tokens", "p2", "p3"))).withColumnRenamed("key", s)
    pairs = stage(pairs, "pairs")
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
    both = dealt_join(pairs, side("a"), "a", "b", hot).join(side("b"), "b").where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(100 * common >= threshold * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


class _Postings:
    """An inverted index of the tokens of some rows of a list column."""

    def __init__(self, offs: np.ndarray, flat: np.ndarray, rows: np.ndarray):
        owner = np.repeat(np.arange(len(rows)), np.diff(offs)[rows])
        tokens = np.concatenate([flat[offs[i] : offs[i + 1]] for i in rows]) if len(rows) else flat[:0]
        order = np.argsort(tokens)
        self.tokens, self.owner, self.n = tokens[order], owner[order], len(rows)

    def common(self, mine: np.ndarray, among: np.ndarray) -> np.ndarray:
        """How many tokens of ``mine`` each of the rows ``among`` (a mask) has; 0 for all others."""
        lo, hi = np.searchsorted(self.tokens, mine, "left"), np.searchsorted(self.tokens, mine, "right")
        size = hi - lo
        found = self.owner[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())] if len(mine) else self.owner[:0]
        return np.bincount(found[among[found]], minlength=self.n)


def _block_links(threshold: int):
    """Compares two blocks of whole sets: sizes first, then the second and third order, then what is left of them.

    A later filter's index is made only if a pair passes those before it.
    """

    def compare(table: pa.Table) -> pa.Table:
        comp, side, key, n = (table.column(c).to_numpy() for c in ("comp", "side", "key", "n"))
        lists = {c: (x.offsets.to_numpy(), x.values.to_numpy()) for c in ("tokens", "p2", "p3") for x in [table.column(c).combine_chunks()]}
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        made: dict[str, _Postings] = {}

        def common(c: str, i: int, among: np.ndarray) -> np.ndarray:
            offs, flat = lists[c]
            if c not in made:
                made[c] = _Postings(offs, flat, right)
            return made[c].common(flat[offs[i] : offs[i + 1]], among)

        a, b = [], []
        for i in left:
            some = (comp[right] != comp[i]) & (100 * np.minimum(n[i], n[right]) >= threshold * np.maximum(n[i], n[right]))
            for c in ("p2", "p3"):
                if some.any():
                    some &= common(c, i, some) > 0
            if some.any():
                shared = common("tokens", i, some)
                hit = some & (100 * shared >= threshold * (n[i] + n[right] - shared))
                a += [key[i]] * int(hit.sum())
                b += key[right[hit]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _sub_buckets(big: DataFrame, threshold: int) -> DataFrame:
    """(sub, members, size, key, n, comp): large open buckets by sizes that can link, without those of one component and
    those that have the same members as another one (a passage of many tokens makes many such buckets)."""
    band = F.floor(F.log(F.col("n")) / (math.log(100 / threshold) * 1.0001))
    rows = big.withColumn("sub", F.explode(F.array(F.xxhash64("h", band), F.xxhash64("h", band + 1)))).select("sub", "key", "n", "comp")
    mark = F.xxhash64("key")
    stats = rows.groupBy("sub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("y"))
    kept = stats.where("lo <> hi").groupBy("members", "size", "x", "y").agg(F.min("sub").alias("sub")).select("sub", "members", "size")
    kept = stage(kept, "subs")
    return stage(dealt_join(rows, kept, "sub", "key", kept.select("sub", F.col("members").alias("rows"))), "sub_members")


def _crowds(members: DataFrame) -> DataFrame:
    """(sub, members, size, key, n, comp) of large buckets -> the same of crowds: a passage of many tokens makes many buckets of nearly
    the same members, each of which would bring their whole sets. Buckets whose least class (by hash) is the same become one,
    unless that makes more comparisons than each for itself; all pairs of a bucket stay together."""
    least = stage(members.groupBy("sub").agg(F.min(F.xxhash64("key")).alias("crowd"), F.first("members").alias("rows")), "least")
    counts = least.select("sub", "rows")
    together = dealt_join(members.select("sub", "key"), least.select("sub", "crowd"), "sub", "key", counts).select("crowd", "key").distinct().groupBy("crowd").agg(F.count(F.lit(1)).cast("double").alias("together"))
    apart = least.groupBy("crowd").agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("apart"))
    fewer = F.col("together") * F.col("together") <= F.col("apart")
    choice = stage(least.join(together, "crowd").join(apart, "crowd").select("sub", F.when(fewer, F.col("crowd")).otherwise(F.col("sub")).alias("crowd")), "choice")
    met = dealt_join(members.select("sub", "key", "n", "comp"), choice, "sub", "key", counts)
    met = stage(met.groupBy(F.col("crowd").alias("sub"), "key").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "crowds")
    sizes = stage(met.groupBy("sub").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size")), "sizes")
    return dealt_join(met, sizes, "sub", "key", sizes.select("sub", F.col("members").alias("rows")))


def class_components(whole: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, root) over the keys of ``whole``, which has prefixes; keys without a link are left out."""
    alike = lambda a, b: 100 * F.least(a, b) >= threshold * F.greatest(a, b)
    member = whole.select("key", "n", "copies", F.explode("p1").alias("h"))
    leader = member.groupBy("h").agg(F.max(F.struct("copies", "key", "n")).alias("l"), F.count(F.lit(1)).alias("members")).where("members > 1")
    leader = stage(leader.select("h", F.col("l.key").alias("leader"), F.col("l.n").alias("leader_n"), "members"), "leaders")
    star = dealt_join(member, leader, "h", "key", leader.select("h", F.col("members").alias("rows"))).where(F.col("key") != F.col("leader")).where(alike("n", "leader_n"))
    found = stage(_links(star.select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct(), whole, threshold), "links")
    root = stage(components(found), "roots")

    placed = stage(member.join(root.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "h", F.coalesce("root", "key").alias("comp")), "placed")
    open_ = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi")
    open_ = stage(open_.select("h", "members"), "open")
    placed = stage(dealt_join(placed, open_, "h", "key", open_.select("h", F.col("members").alias("rows"))), "open_members")
    big = placed.where(F.col("members") > PAIR_BUCKET)
    large = big.limit(1).count() > 0
    few = placed.where(F.col("members") <= PAIR_BUCKET).select("h", "key", "n", "comp")
    if large:
        subs = _sub_buckets(big, threshold)
        few = few.unionByName(subs.where(F.col("members") <= PAIR_BUCKET).select(F.col("sub").alias("h"), "key", "n", "comp"))
    x, y = few.toDF("h", "a", "na", "ca"), few.toDF("h", "b", "nb", "cb")
    rest = x.join(y, "h").where("a < b AND ca <> cb").where(alike("na", "nb")).select("a", "b").distinct()
    known = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = found.unionByName(_links(rest.join(known, ["a", "b"], "left_anti"), whole, threshold))

    if large:
        crowd = _crowds(subs.where(F.col("members") > PAIR_BUCKET))
        blocks = F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("size") / BLOCK_TOKENS)).cast("int")
        crowd = crowd.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        # block i of a bucket meets every block j of it: it stands left for j > i and right for j < i
        met = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("sub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "comp")
        met = met.join(whole.select("key", "n", "tokens", "p2", "p3"), "key")
        found = found.unionByName(met.groupBy("sub", "i", "j").applyInArrow(_block_links(threshold), "a long, b long"))
    return components(stage(found, "links"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, class_key).

    Two documents link when 100 * |A & B| >= threshold * |A | B|; component_id is the smallest id that links reach.
    """
    sets = stage(document_sets(docs, id_col, text_col, width), "sets")
    filled = sets.where("n > 0")
    alive = stage(_hash_order_survivors(docs, text_col, width, threshold), "alive")
    whole = stage(_with_prefixes(stage(_whole_sets(docs, filled, alive, id_col, text_col, width), "whole"), threshold), "prefixes")
    root = class_components(whole, threshold)
    per_class = filled.groupBy("key").agg(F.min("doc_id").alias("least")).join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = per_class.groupBy("root").agg(F.min("least").alias("component"))
    named = per_class.join(least, "root").select("key", "component")
    return sets.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.col("key").alias("class_key"))
