"""Token counts of the sections of documents, by offset-mapped attribution.

A document is encoded once as a whole. Its tokens' character spans are joined with the spans of its sections as
intervals (both are in order, so the join is a search in sorted bounds), and a token that crosses a boundary goes to one
section by an explicit rule: ``start`` (where its first character is), ``end`` (its last) or ``most`` (which holds most
of it, the earlier on a tie). Sections are the lines of a text, each with the newline that ends it; they cover it, so
the counts of a document add up to its tokens.

A null text is empty; an empty text has one empty section without tokens; a very long text is encoded as a whole, alone.
Repeated rows come back each; an empty table gives no row; other columns are ignored. A token that is part of a character spans that character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import read_ranks

RULES = ("start", "end", "most")


def token_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, given the text's bytes and the tokens' byte lengths."""
    lead = np.cumsum((data & 0xC0) != 0x80)
    ends = np.cumsum(sizes)
    return lead[ends - sizes] - 1, lead[ends - 1]


def attributed(first: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section [bounds[k], bounds[k + 1]), and how many of them cross one of its bounds."""
    a, z = np.searchsorted(bounds, first, "right") - 1, np.searchsorted(bounds, end - 1, "right") - 1
    own = a if rule == "start" else z
    crossing = np.flatnonzero(a != z)
    if rule == "most":
        own = a.copy()
        for t in crossing:  # a token is short: few bounds lie in it
            held = np.diff(np.clip(bounds[a[t] : z[t] + 2], first[t], end[t]))
            own[t] = a[t] + int(held.argmax())
    n = len(bounds) - 1
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def section_token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """One row per line of each document: doc_id, section, start_char, end_char, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = read_ranks(path)
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size_of[rank] = len(token)
        for b in batches:
            rows, section, start, stop, count, crossing = [], [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                text = text or ""
                lines = np.cumsum([len(x) + 1 for x in text.split("\n")])
                lines[-1] -= 1
                bounds = np.concatenate(([0], lines if len(lines) == 1 or lines[-1] > lines[-2] else lines[:-1]))
                n = c = np.zeros(len(bounds) - 1, np.int64)
                if text:
                    data = np.frombuffer(text.encode(), np.uint8)
                    first, end = token_spans(data, size_of[encoding.encode_ordinary(text)])
                    n, c = attributed(first, end, bounds, rule)
                rows += [k] * len(n)
                section += range(len(n))
                start.append(bounds[:-1])
                stop.append(bounds[1:])
                count.append(n)
                crossing.append(c)
            cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(section, pa.int64()), cat(start), cat(stop), cat(count), cat(crossing)], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, section long, start_char long, end_char long, n_tokens long, n_crossing long")
