"""Ids of a lower-casing word BPE (byte-level alphabet, end-of-word suffix), for all distinct words of a batch at once.

The tokenizer file is read by path. Words of plain Latin text are merged in numpy: in each round every word merges its
leftmost pair of lowest rank, which is what the merge list prescribes. Anything else (other scripts, combining marks,
unusual spaces, words that hold an added token such as ``<|endoftext|>``) goes through the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex

from .wordhash import Units

_PLAIN = "!-~¡-įı-ɏ"
_PLAIN_WORDS = re.compile(f"[{_PLAIN} ]*")
_PLAIN_WORD = re.compile(f"[{_PLAIN}]*")


def _pieces() -> re.Pattern:
    """The tokenizer's word pattern over the plain characters; a space between two words is a match of its own."""
    plain = sorted({chr(c).lower() for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)) if c != 0x130})
    letters = "".join(c for c in plain if regex.match(r"\p{L}", c))
    digits = "".join(c for c in plain if regex.match(r"\p{N}", c))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ {letters}{digits}]+| ")


_PIECES = _pieces()
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pairs:
    """A hash table from a pair of ids to its merge rank and the merged id."""

    def __init__(self, left, right, rank, merged):
        self.bits, self.mult = 20, np.uint64(0x9E3779B97F4A7C15)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.merged = np.full(1 << self.bits, _NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        keys = left.astype(np.int64) << 20 | right
        for key, at, r, m in zip(keys.tolist(), self._slot(keys).tolist(), rank.tolist(), merged.tolist(), strict=True):
            while self.key[at] not in (-1, key):
                at = (at + 1) & ((1 << self.bits) - 1)
            if self.key[at] == -1:
                self.key[at], self.rank[at], self.merged[at] = key, r, m

    def _slot(self, keys):
        return ((keys.view(np.uint64) * self.mult) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """The slot of each pair; an empty slot where there is none."""
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        odd = np.flatnonzero((self.key[at] != keys) & (self.key[at] != -1))
        while len(odd):
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            odd = odd[(self.key[at[odd]] != keys[odd]) & (self.key[at[odd]] != -1)]
        return at


class WordBpe:
    """Encoder whose table of known words lives on from batch to batch, emptied when it passes ``max_words``."""

    def __init__(self, path: str, max_words: int = 400_000):
        from tokenizers import Tokenizer

        self.path, self.max_words = path, max_words
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        # an added token that stands in a text is that token, as the library has it
        self.added = [t["content"] for t in whole.get("added_tokens", ())]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max([*vocab.values(), *(t["id"] for t in whole.get("added_tokens", ()))]) + 1
        sign = byte_alphabet()
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[sign[b] + end] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.pairs = _Pairs(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2])
        self._forget()

    def _forget(self):
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each (non-empty) piece."""
        raw = [p.encode() for p in pieces]
        n = np.array([len(p) for p in raw], np.int64)
        word = np.repeat(np.arange(len(raw)), n)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(n) - 1
        ids[ends] = self.final[data[ends]]
        done_ids, done_word = [], []
        slot = np.zeros(len(ids), np.int64)
        rank = np.full(len(ids), _NONE, np.int32)

        def look(at):
            at = at[word[at] == word[at + 1]]
            slot[at] = self.pairs.find(ids[at], ids[at + 1])
            rank[at] = self.pairs.rank[slot[at]]

        look(np.arange(len(ids) - 1))
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(starts, len(ids)))
            low = np.minimum.reduceat(rank, starts)
            active = low != _NONE
            if not active.all():
                keep = np.repeat(active, size)
                done_ids.append(ids[~keep])
                done_word.append(word[~keep])
                ids, word, slot, rank, size, low = ids[keep], word[keep], slot[keep], rank[keep], size[active], low[active]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            ids[at] = self.pairs.merged[slot[at]]
            rank[at] = rank[at + 1]  # no pair follows if the merged one was the last of its word
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            ids, word, slot, rank = ids[stay], word[stay], slot[stay], rank[stay]
            again = np.concatenate([at, at - 1])
            again = again[(again >= 0) & (again < len(ids) - 1)]
            look(again)
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw))

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of new words to the table."""
        joined, odd = " ".join(words), []
        if not _PLAIN_WORDS.fullmatch(joined) or any(t in joined for t in self.added):
            odd = [k for k, w in enumerate(words) if not _PLAIN_WORD.fullmatch(w) or any(t in w for t in self.added)]
            plain = words.copy()
            for k in odd:
                plain[k] = ""
            joined = " ".join(plain)
        piece_of: dict[str, int] = _Numbered()
        piece_of[" "]  # 0 stands for the space between two words
        found = _PIECES.findall(joined.lower())
        parts = np.fromiter(map(piece_of.__getitem__, found), np.int64, len(found))
        flat, n = self._merge(list(piece_of)[1:]) if len(piece_of) > 1 else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        gaps = np.flatnonzero(parts == 0)
        counts = np.diff(np.concatenate(([-1], gaps, [len(parts)]))) - 1
        ids, sizes = gather(flat, np.concatenate(([0], np.cumsum(n))), parts[parts > 0] - 1)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        if odd:
            rows = [ids[bounds[k] : bounds[k + 1]] for k in range(len(words))]
            for k, e in zip(odd, self.library.encode_batch([words[k] for k in odd], add_special_tokens=False), strict=True):
                rows[k] = np.array(e.ids, np.int32)
            ids, bounds = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        self.flat = np.concatenate([self.flat, ids])
        self.offs = np.concatenate([self.offs, self.offs[-1] + bounds[1:]])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts of a string column and the offsets of each; a null is empty."""
        if len(self.hashes) > self.max_words:
            self._forget()
        units = Units(column)
        at = np.searchsorted(self.hashes, units.hashes)
        new = np.ones(len(at), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != units.hashes
        if new.any():
            first = len(self.offs) - 1
            self._learn(units.texts(np.flatnonzero(new)))
            self.hashes = np.concatenate([self.hashes, units.hashes[new]])
            self.rows = np.concatenate([self.rows, np.arange(first, len(self.offs) - 1)])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.rows = self.hashes[order], self.rows[order]
            at = np.searchsorted(self.hashes, units.hashes)
        ids, sizes = gather(self.flat, self.offs, self.rows[at][units.number] if len(at) else at)
        ends = np.concatenate(([0], np.cumsum(units.rows)))
        return ids, np.concatenate(([0], np.cumsum(sizes)))[ends]


class _Numbered(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def gather(flat: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a flat list column, one after the other, and their sizes."""
    size = offs[rows + 1] - offs[rows]
    shift = offs[rows] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(rows) else size
    return flat[np.repeat(shift, size) + np.arange(size.sum())], size


_KEPT: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The Python worker's encoder for a file."""
    if path not in _KEPT:
        _KEPT[path] = WordBpe(path)
    return _KEPT[path]
