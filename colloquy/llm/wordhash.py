"""Words of ``[^\\x20\\x09-\\x0D]+`` and their 64-bit hashes, a whole Arrow column at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Bytes of text that are hashed at once; one longer text is hashed alone.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, xor and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.concatenate(([True], new))]


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end
        row = end


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, which bounds what is held for one of them."""
    for b in batches:
        _, offs = column_bytes(b.column(column))
        for start, end in chunks(offs, limit):
            yield b.slice(start, end - start)


def spans(data: np.ndarray, offs: np.ndarray, gaps: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all words, in row order. ``offs`` starts at 0.

    With ``gaps`` a span is a word with the white space before it, and what a row ends with is one more: the spans then
    cover every byte.
    """
    size = int(offs[-1])
    solid = ~_SPACE[data[:size]]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < size)]
    if gaps:
        last[edges - 1] = True
        last[-1:] = True
        end = np.flatnonzero(last) + 1
        start = np.concatenate(([0], end[:-1])) if size else end
    else:
        last[edges - 1] = solid[edges - 1]
        first = solid
        first[1:] &= ~solid[:-1] | last[:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = int(end[-1])
    buf = np.zeros(size + 8, np.uint8)
    buf[:size] = data[:size]
    eights = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), shape=(size,), strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(len(start))
    at, left = start, length
    while len(todo):
        h[todo] = mix(h[todo] ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all A-Z lower-cased words in row order, and the number of words of each row. ``offs`` starts at 0."""
    start, end, row = spans(data, offs)
    return span_hashes(_LOWER[data[: int(offs[-1])]], start, end), np.bincount(row, minlength=len(offs) - 1)


class Units:
    """The distinct words (or words with the gaps before them) of a string column, numbered by their hashes.

    ``number`` has the place in ``hashes`` of every span of the column, ``rows`` how many spans each row has, and
    ``text(k)`` is the k-th distinct one. Spans count as equal if their 64-bit hashes are.
    """

    def __init__(self, column: pa.Array, gaps: bool = False):
        data, offs = column_bytes(column)
        self.base, found, counts = data, [], []
        for a, b in chunks(offs):
            part, own = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            start, end, row = spans(part, own, gaps)
            found.append((span_hashes(part, start, end), start + offs[a], end + offs[a]))
            counts.append(np.bincount(row, minlength=b - a))
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        h, start, end = (cat([f[k] for f in found], np.int64) for k in range(3))
        self.rows = cat(counts, np.int64)
        self.hashes, first, self.number = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.end = start[first], end[first]

    def texts(self, which: np.ndarray) -> list[str]:
        raw = self.base.tobytes() if len(which) > 64 else None
        span = zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)
        return [str(raw[a:b] if raw is not None else self.base[a:b].tobytes(), "utf-8") for a, b in span]


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's ``width``-word shingles of A-Z lower-cased words.

    A row with fewer words has its whole sequence as the one shingle, a row without words has none.
    """
    data, offs = column_bytes(texts)
    for a, b in chunks(offs):
        h, n_words = words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        ends = np.cumsum(n_words)
        s = h.copy()
        for k in range(1, min(width, len(h))):  # fewer words in all: no window is that long
            s[: len(h) - k] = mix(s[: len(h) - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
        for row in range(b - a):
            n, end = int(n_words[row]), int(ends[row])
            if n >= width:
                yield distinct(s[end - n : end - width + 1])
            elif n:
                one = h[end - n : end - n + 1]
                for k in range(1, n):
                    one = mix(one * np.uint64(0xD6E8FEB86659FD93) + h[end - n + k : end - n + k + 1])
                yield mix(one + np.uint64(n))
            else:
                yield h[:0]
