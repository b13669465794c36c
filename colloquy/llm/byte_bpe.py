"""Byte-level BPE encoding and decoding by merge replay.

The texts of a batch are one corpus: its distinct pieces lie in one array of symbols, an inverted index leads from every
mergeable pair (by the rank of what it becomes) to its places, and the merges are applied in rank order to all places at
once, each time touching only the two neighbours. A piece is thus encoded once a batch however often it occurs, and
words seen in earlier batches are remembered. The batch is the corpus, and not the whole table, so that texts never go
through a shuffle.

A null text is empty and has no ids. Every row comes back, repeated ones too; an empty table gives no row; a very long text is a
corpus for itself, encoded as a whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import Units, column_bytes, parts


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder for a rank file; known words live on from batch to batch until there are ``max_units``."""

    def __init__(self, path: str, pattern: str, max_units: int = 400_000):
        self.ranks = read_ranks(path)
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.shift = max(self.bytes).bit_length()
        self.pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << self.shift | b] = rank
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.double = np.full((256, 256), -1, np.int64)  # what two bytes become
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.double[token[0], token[1]] = rank
        self.pattern, self.max_units = regex.compile(pattern), max_units
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.shown, self.plain, self.odd = [], [], [], []

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each distinct piece. A piece that is a token is that token."""
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        data = np.frombuffer(b"".join(todo), np.uint8)
        n = len(data)
        ends = np.cumsum([len(p) for p in todo]) if todo else np.zeros(0, np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate(([0], ends[:-1])) if len(ends) else ends] = -1
        rank = np.full(n, -1, np.int64)
        if n > 1:
            rank[:-1] = self.double[data[:-1], data[1:]]
            rank[ends - 1] = -1
        sym, nxt, prv = self.single[data].tolist(), after.tolist(), before.tolist()
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        ordered = rank[places]
        bounds = np.concatenate((np.flatnonzero(np.diff(ordered, prepend=-1)), [len(places)]))
        index = {int(ordered[a]): places[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)}
        heap, pair, shift = list(index), self.pairs.get, self.shift
        heapify(heap)
        while heap:
            r = heappop(heap)
            at = index.pop(r, None)
            if at is None:
                continue
            at.sort()
            for k, p in enumerate(at):
                q = nxt[p]
                if q < 0 or sym[p] < 0 or pair(sym[p] << shift | sym[q]) != r:
                    continue  # the place was merged otherwise meanwhile
                sym[p], sym[q] = r, -1
                nxt[p] = b = nxt[q]
                sooner = False
                if b >= 0:
                    prv[b] = p
                    s = pair(r << shift | sym[b])
                    if s is not None:
                        sooner = s <= r
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heappush(heap, s)
                a = prv[p]
                if a >= 0:
                    s = pair(sym[a] << shift | r)
                    if s is not None:
                        sooner |= s <= r
                        if s in index:
                            index[s].append(a)
                        else:
                            index[s] = [a]
                            heappush(heap, s)
                if sooner:  # a merge of no higher rank has come up: it goes first, the other places wait
                    if r in index:
                        index[r] += at[k + 1 :]
                    else:
                        index[r] = at[k + 1 :]
                        heappush(heap, r)
                    break
        left = np.array(sym, np.int64)
        alive = left >= 0
        counts = np.cumsum(alive)[ends - 1] if len(ends) else ends
        flat, out, at, k = left[alive].tolist(), [], 0, 0
        for w in whole:
            if w is not None:
                out.append([w])
            else:
                out.append(flat[at : counts[k]])
                at, k = counts[k], k + 1
        return out

    def _learn(self, units: list[str]) -> None:
        pieces, number = [], {}
        for u in units:
            found = self.pattern.findall(u)
            pieces.append([number.setdefault(p, len(number)) for p in found])
            word = u.strip(" \t\n\v\f\r")
            self.odd.append(bool(word) and (word[0].isspace() or word[-1].isspace()))
        ids = self.replay([p.encode() for p in number])
        shown = [" ".join(map(str, x)) for x in ids]
        back = [self.decode(x) for x in ids]
        size = [len(x) for x in ids]
        for p in pieces:
            self.count.append(sum([size[k] for k in p]))
            self.shown.append(" ".join([shown[k] for k in p]))
            self.plain.append(b"".join([back[k] for k in p]))

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def encode_text(self, text: str) -> list[int]:
        """One text's ids, without the table of known words."""
        pieces = self.pattern.findall(text)
        number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        ids = self.replay([p.encode() for p in number])
        return [i for p in pieces for i in ids[number[p]]]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, str, bytes]]:
        """For each text: the number of ids, the ids in decimal with a space between, the bytes they decode to."""
        if len(self.hashes) > self.max_units:
            self._forget()
        units = Units(column, gaps=True)
        known = np.isin(units.hashes, self.hashes)
        if not known.all():
            first = len(self.count)
            self._learn(units.texts(np.flatnonzero(~known)))
            self.hashes = np.concatenate([self.hashes, units.hashes[~known]])
            self.rows = np.concatenate([self.rows, np.arange(first, len(self.count))])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.rows = self.hashes[order], self.rows[order]
        row = self.rows[np.searchsorted(self.hashes, units.hashes)] if len(units.hashes) else np.zeros(0, np.int64)
        at = row[units.number] if len(row) else row
        counts = np.array(self.count, np.int64)[at] if len(at) else at
        odd = np.array(self.odd, bool)[at] if len(at) else at.astype(bool)
        ends = np.concatenate(([0], np.cumsum(units.rows)))
        data, offs = None, None
        shown, plain, at = self.shown, self.plain, at.tolist()
        for k in range(len(units.rows)):
            a, b = int(ends[k]), int(ends[k + 1])
            if odd[a:b].any():  # white space beyond ASCII at a word's edge: gaps are no longer split off safely
                if data is None:
                    data, offs = column_bytes(column)
                ids = self.encode_text(data[offs[k] : offs[k + 1]].tobytes().decode())
                yield len(ids), " ".join(map(str, ids)), self.decode(ids)
            else:
                mine = at[a:b]
                yield int(counts[a:b].sum()), " ".join([shown[i] for i in mine]), b"".join([plain[i] for i in mine])


_KEPT: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The Python worker's codec for a file and pattern."""
    if (path, pattern) not in _KEPT:
        _KEPT[path, pattern] = ByteBpe(path, pattern)
    return _KEPT[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in parts(batches):
            n, ids, back = [], [], []
            for count, shown, plain in bpe.encode(b.column("text")):
                n.append(count)
                ids.append(hashlib.sha256(shown.encode()).hexdigest())
                back.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            ids = [np.array(shown.split(), np.int32) for _, shown, _ in bpe.encode(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes); null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")
