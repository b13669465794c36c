"""Periodic runs of words: seed and extend along diagonals.

A run is a maximal stretch of words with smallest period q (words q apart are equal) of at least ``max(LEAST, 2 * q)``
words. Laid over itself at lag q, a run of n words overlaps in n - q words, at least ``max(LEAST - q, q)``: whatever q
is, no overlap is shorter than k = LEAST / 2, and at a lag of k * 2**j or more none is shorter than k * 2**j.

* Index: the k-grams of a text that occur more than once in it; from them, level by level, its (2k)-grams, (4k)-grams and
  so on (a longer gram that recurs is two shorter ones that do), each numbered by an exact sort.
* Seeds: level j takes the pairs of occurrences of one (k * 2**j)-gram in the same text, k * 2**j up to twice that apart
  (level 0: up to 2k). So a lag belongs to one level, and a gram without a short period has few occurrences in reach.
  Of occurrences inside a run of a short period p that an earlier level found, only the first p and the last p are paired
  with others, and never with those of the same run, whose lag is a multiple of p: a run that meets another one at lag q
  has its seed at one of these ends. The pairs of a level grow with the words, not with the square of the occurrences.
* Extension: for each lag the seeds are taken in order against the furthest word covered so far; those inside are not
  extended again. The others are extended to both sides by the levels' gram numbers, longest first, all at once.

The stretch of a multiple of the smallest period is that period's stretch, so of equal stretches the least period stays.

Null, empty and blank texts have no words and no run. Very long texts are handled alone, in memory for some 4 bytes a word
and level; nothing is cut. Repeated rows and ids keep their rows, null ids too; other columns are ignored, and an empty table
gives no row. Words count as equal if their 64-bit hashes are, the longer grams by exact numbers within their batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import chunks, column_bytes, mix, parts, span_hashes, spans

#: Words of the shortest run.
LEAST = 12
#: White space between words, as a character class of Java and Python.
SPACE = r"[\x20\x09-\x0D]+"
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _numbered(keys: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, pos) of the keys that occur more than once, by name and position; ``pos`` ascends."""
    order = np.argsort(keys, kind="stable")
    keys, pos = keys[order], pos[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    name = np.cumsum(new) - 1
    again = np.bincount(name, minlength=1)[name] > 1 if len(keys) else new
    return name[again], pos[again]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, place) with lo[row] <= place < hi[row]."""
    size = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lo[row]


class _Text:
    """The words of some texts in a row: their hashes, the bounds of each word's text, and the gram numbers of each level."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray):
        self.h, ends = h, np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.end = (ends - sizes)[self.doc], ends[self.doc]
        self.levels: list[tuple[int, np.ndarray]] = []

    def index(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(name, pos) of the recurring grams of ``length`` words; that is the shortest one or twice the last one."""
        if not self.levels:
            pos = np.flatnonzero(np.arange(len(self.h)) + length <= self.end)
            keys = mix(self.doc[pos].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            for k in range(length):
                keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + self.h[pos + k])
        else:
            half, names = self.levels[-1]
            pos = np.flatnonzero(names >= 0)
            pos = pos[pos + length <= self.end[pos]]
            pos = pos[names[pos + half] >= 0]
            keys = names[pos].astype(np.int64) << 32 | names[pos + half]
        name, pos = _numbered(keys, pos)
        names = np.full(len(self.h), -1, np.int32)
        names[pos] = name
        self.levels.append((length, names))
        return name, pos

    def extended(self, left: np.ndarray, right: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest [left, right) around the given ones in which every word equals the one ``lag`` later."""
        left, right = left.copy(), right.copy()
        first, end = self.first[left], self.end[left]
        for length, same in [*((n, x) for n, x in reversed(self.levels)), (1, None)]:
            for side in (0, 1):
                todo = np.arange(len(left))
                while len(todo):
                    at = (left[todo] - length) if side == 0 else right[todo]
                    fits = at >= first[todo] if side == 0 else at + lag[todo] + length <= end[todo]
                    todo, at = todo[fits], at[fits]
                    if same is None:
                        go = self.h[at] == self.h[at + lag[todo]]
                    else:
                        go = (same[at] >= 0) & (same[at] == same[at + lag[todo]])
                    todo = todo[go]
                    if side == 0:
                        left[todo] -= length
                    else:
                        right[todo] += length
        return left, right


def _seeds(name: np.ndarray, pos: np.ndarray, k: int, level: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the pairs of occurrences of a level; ``runs`` has (start, end, period) of the runs found so far."""
    span = np.int64(1) << 32
    key = name * span + pos
    if level == 0:
        row, other = _ranges(np.arange(1, len(key) + 1), np.searchsorted(key, key + 2 * k))
        return pos[row], pos[other] - pos[row]
    inside = runs[(2 * runs[:, 2] <= k) & (runs[:, 1] - runs[:, 0] >= k)]
    inside = inside[np.argsort(inside[:, 0])]
    own = np.full(int(pos.max()) + 1 if len(pos) else 0, -1, np.int64)
    row, at = _ranges(inside[:, 0], np.minimum(inside[:, 1] - k + 1, len(own)))
    own[at] = row
    own = own[pos]
    edge = np.ones(len(pos), bool)
    held = np.flatnonzero(own >= 0)
    start, end, period = inside[own[held]].T
    edge[held] = (pos[held] < start + period) | (pos[held] > end - k - period)
    ahead = np.flatnonzero(edge)
    row, other = _ranges(np.searchsorted(key, key[ahead] + k), np.searchsorted(key, key[ahead] + 2 * k))
    a, b = ahead[row], other
    back = held[edge[held]]
    row, other = _ranges(np.searchsorted(key, key[back] - 2 * k, "right"), np.searchsorted(key, key[back] - k, "right"))
    a, b = np.concatenate((a, other)), np.concatenate((b, back[row]))
    apart = (own[a] < 0) | (own[a] != own[b])
    a, b = a[apart], b[apart]
    return pos[a], pos[b] - pos[a]


def maximal_runs(h: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of every run of the texts of ``sizes`` words with the hashes ``h``, by start and period."""
    text, k, level = _Text(h, sizes), -(-least // 2), 0
    found = np.zeros((0, 3), np.int64)
    while True:
        name, pos = text.index(k)
        if not len(pos):
            break
        place, lag = _seeds(name, pos, k, level, found)
        order = np.unique(lag << 32 | place)
        place, lag = order & ((1 << 32) - 1), order >> 32
        if len(place):
            # a seed that begins within what the one before it covers, at the same lag and in the same text, is not extended
            new = np.ones(len(place), bool)
            new[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + k) | (text.doc[place[1:]] != text.doc[place[:-1]])
            heads = np.flatnonzero(new)
            left, right = text.extended(place[heads], place[np.append(heads[1:], len(place)) - 1] + k, lag[heads])
            lag = lag[heads]
            whole = right - left >= np.maximum(least - lag, lag)
            made = np.stack((left, right + lag, lag), 1)[whole]
            both = np.concatenate((found, made[np.argsort(made[:, 2], kind="stable")]))
            _, keep = np.unique(both[:, 0] << 32 | both[:, 1], return_index=True)
            found = both[np.sort(keep)]
        k, level = 2 * k, level + 1
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", least: int = LEAST) -> DataFrame:
    """One row per document: (doc_id, n_words, runs, collapsed).

    ``runs`` has (start, length, period) of each run by start and period, ``collapsed`` the words that no run holds after
    its first period, joined by one space.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, limit=1 << 20):
            data, offs = column_bytes(b.column("text"))
            texts, starts, counts, totals = [], [], [], []
            for lo, hi in chunks(offs, 1 << 20):
                own = offs[lo : hi + 1] - offs[lo]
                part = data[offs[lo] : offs[hi]]
                first, end, row = spans(part, own)
                sizes = np.bincount(row, minlength=hi - lo)
                runs = maximal_runs(span_hashes(part, first, end), sizes, least)
                base = np.cumsum(sizes) - sizes
                of = np.searchsorted(base, runs[:, 0], "right") - 1  # a text without words has the base of the next one
                runs = np.stack((runs[:, 0] - base[of], runs[:, 1] - runs[:, 0], runs[:, 2]), 1) if len(runs) else runs
                held = np.bincount(of, minlength=hi - lo)
                raw, at = part.tobytes(), 0
                for k, n in enumerate(held.tolist()):
                    words = raw[own[k] : own[k + 1]].split()
                    texts.append(b" ".join(_without_repeats(words, runs[at : at + n].tolist()) if n else words))
                    at += n
                starts.append(runs)
                counts.append(held)
                totals.append(sizes)
            runs = np.concatenate(starts) if starts else np.zeros((0, 3), np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1)
            each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
            total = np.concatenate(totals) if totals else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return docs.select(F.col(id_col).alias("doc_id"), text.cast("string").alias("text")).mapInArrow(found, f"doc_id {kind}, n_words long, runs {_RUNS}, collapsed string")


def repeated_tail(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text in which a tenth of the documents, told by the CRC-32 of their id, has a tail that repeats itself.

    With g the tenth of that number, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8), each word i from a on is the
    original word a + (i - a) % p. A null id, a null text or one without words stays as it is.
    """
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  computed once a row, not once a word
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_col, SPACE), lambda w: w != "")
    bounds = lambda w: F.struct(w.alias("words"), (g % F.size(w)).alias("a"), (1 + F.floor((F.size(w) - g % F.size(w)) / (3 + g % 8))).alias("p"))
    word = lambda x, i: F.get(x["words"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))
    made = let(let(words, bounds), lambda x: F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.size(x["words"]) - 1), lambda i: word(x, i))))
    return F.when((h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), made).otherwise(F.col(text_col))


def run_digests(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: doc_id, n_runs, the longest run and digests of all runs and of the collapsed text."""
    # the greatest length, then the least start, then the least period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
