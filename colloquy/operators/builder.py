"""Building memory from exchanges in order: trajectories, snapshots, claims and their changes as one tagged stream of rows.

Each exchange of a sample continues the open trajectory that it fits best or opens one; its claims are compared with the claims
that the trajectory had. A trajectory closes when it has ``most`` versions, when its sample has been idle, or at the end.
The work is sequential within a sample and nothing else: a task reads its samples in order, row by row, and holds the open
trajectories of one sample alone; the streaming form (``streaming/memory.py``) keeps the same in typed state.

Rows (kind): ``snapshot`` (reason new or continue, score), ``claim`` (every claim that a snapshot holds), ``op`` (ADD, KEEP, REVISE,
DEPRECATE, CARRY), ``trajectory`` (once closed: version is its length, reason max_length, idle or finalize). Ids are made of the
sample, a number and a version, so that none collide. Null terms, names or claims are empty; exchanges without a sample or
time are left out; equal times go by message id.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .build import CONTINUE, LATEST, SHORTLIST, SUMMARY, WORDS

ROWS = "sample_id string, kind string, trajectory_id string, version int, message_id long, claim_id string, text string, status string, op string, old_id string, score double, reason string, ts timestamp"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
#: Keywords that a claim must share with the one it revises.
SHARED = 2
_SPACE, _OTHER, _WORD = re.compile(r"\s+"), re.compile(r"[^a-z0-9\s]"), re.compile(r"[a-z0-9][a-z0-9\-']+")


@lru_cache(1 << 14)
def _plain(text: str) -> str:
    return _SPACE.sub(" ", _OTHER.sub(" ", text.lower())).strip()


@lru_cache(1 << 14)
def _keys(text: str) -> frozenset[str]:
    return frozenset(w for w in _WORD.findall(text.lower()) if len(w) > 2)


@dataclass
class Trajectory:
    """An open trajectory: all its words, those of its last version, and the claims that it holds as (id, text, status)."""

    words: set[str] = field(default_factory=set)
    latest: set[str] = field(default_factory=set)
    length: int = 0
    message_id: int = 0
    claims: list[tuple[str, str, str]] = field(default_factory=list)


def changed_claims(old: list[tuple[str, str, str]], new: list[tuple[str, str]], prefix: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str | None, str | None]]]:
    """(claims now held, ops) when ``new`` (text, status) meet the ``old`` claims.

    Equal texts keep their id: KEEP, or DEPRECATE or REVISE if the status is another; then a claim and an old one that are each
    other's best by shared keywords (ties by place) make a REVISE; what is left of the new is an ADD, of the old a CARRY.
    """
    waiting: dict[str, list[int]] = {}
    for k, (_, text, _) in enumerate(old):
        waiting.setdefault(_plain(text), []).append(k)
    match: dict[int, int] = {}
    for k, (text, _) in enumerate(new):
        if waiting.get(_plain(text)):
            match[k] = waiting[_plain(text)].pop(0)
    taken = set(match.values())
    fresh, gone = [k for k in range(len(new)) if k not in match], [k for k in range(len(old)) if k not in taken]
    words = {k: _keys(new[k][0]) for k in fresh}, {k: _keys(old[k][1]) for k in gone}
    shared = {(a, b): n for a in fresh for b in gone if (n := len(words[0][a] & words[1][b])) >= SHARED}
    best_old = {a: min((-n, b) for (x, b), n in shared.items() if x == a)[1] for a in {x for x, _ in shared}}
    best_new = {b: min((-n, a) for (a, x), n in shared.items() if x == b)[1] for b in {x for _, x in shared}}
    revised = {a: b for a, b in best_old.items() if best_new[b] == a}
    held, ops, replaced = [], [], set(revised.values())
    for k, (text, status) in enumerate(new):
        if k in match:
            id_, _, before = old[match[k]]
            held.append((id_, text, status))
            ops.append(("KEEP" if status == before else "DEPRECATE" if status == "deprecated" else "REVISE", id_, id_))
        else:
            held.append((f"{prefix}:c{k + 1}", text, status))
            ops.append(("REVISE", held[-1][0], old[revised[k]][0]) if k in revised else ("ADD", held[-1][0], None))
    for k in gone:
        if k not in replaced:
            held.append(old[k])
            ops.append(("CARRY", None, old[k][0]))
    return held, ops


class MemoryBuilder:
    """The open trajectories of a sample, and what an exchange does to them. ``touched`` and ``closed`` tell which numbers changed.

    Times are numbers with a number as ``idle``, or time stamps with a time difference."""

    def __init__(self, sample: str, most: int, least: float = CONTINUE, idle: dt.timedelta | int | None = None):
        self.sample, self.most, self.least, self.idle = sample, most, least, idle
        self.open: dict[int, Trajectory] = {}
        self.next, self.last = 0, None
        self.touched: set[int] = set()
        self.closed: set[int] = set()

    def _row(self, kind: str, n: int, version: int, **more) -> dict:
        return {"sample_id": self.sample, "kind": kind, "trajectory_id": f"{self.sample}:t{n}", "version": version, **more}

    def close(self, n: int, reason: str, ts) -> dict:
        t = self.open.pop(n)
        self.touched.discard(n)
        self.closed.add(n)
        return self._row("trajectory", n, t.length, message_id=t.message_id, reason=reason, ts=ts)

    def close_all(self, reason: str) -> list[dict]:
        return [self.close(n, reason, self.last) for n in sorted(self.open)]

    def _fits(self, words: set[str], names: set[str]) -> tuple[float, int | None]:
        """The best score of the shortlisted open trajectories, and the first of those that have it."""
        near = sorted(self.open, key=lambda n: (-len(words & self.open[n].words) - 2 * len(names & self.open[n].words), n))[:SHORTLIST]
        best, at = 0.0, None
        for n in sorted(near):
            t = self.open[n]
            either = lambda a: len(words & a) / len(words | a) if words or a else 0.0
            score = round(SUMMARY * either(t.words) + LATEST * either(t.latest) + WORDS * len(words & t.words) / max(1, len(words)) + 0.10 * bool(names & t.words), 9)
            if score > best:
                best, at = score, n
        return best, at

    def add(self, message_id: int, ts, terms, names, claims) -> list[dict]:
        """The rows of an exchange; ``claims`` are (text, status)."""
        rows = []
        if self.idle is not None and self.last is not None and ts - self.last > self.idle:
            rows += self.close_all("idle")
        words, names = set(terms), set(names)
        score, n = self._fits(words, names)
        how = "continue"
        if n is None or score < self.least:
            n, self.next, how = self.next, self.next + 1, "new"
            self.open[n] = Trajectory()
        t = self.open[n]
        t.words |= words
        t.latest, t.length, t.message_id, self.last = words, t.length + 1, message_id, ts
        self.touched.add(n)
        one = {"message_id": message_id, "ts": ts}
        rows.append(self._row("snapshot", n, t.length, score=score, reason=how, **one))
        t.claims, ops = changed_claims(t.claims, claims, f"{self.sample}:t{n}:v{t.length}")
        rows += [self._row("claim", n, t.length, claim_id=i, text=text, status=status, **one) for i, text, status in t.claims]
        rows += [self._row("op", n, t.length, op=op, claim_id=i, old_id=old, **one) for op, i, old in ops]
        if t.length >= self.most:
            rows.append(self.close(n, "max_length", ts))
        return rows


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], columns=COLUMNS, dtype=object)


def exchanges(table: DataFrame) -> DataFrame:
    """(sample_id, message_id, ts, terms, names, claims), typed and without nulls, of a table that has these columns."""
    claims = F.transform(F.coalesce("claims", F.array()), lambda c: F.struct(F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"), F.coalesce(c["status"].cast("string"), F.lit("active")).alias("status")))
    words = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<string>"))).alias(c)
    return table.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("message_id").cast("long").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"), words("terms"), words("names"), claims.alias("claims")).where("sample_id is not null and ts is not null")


def build_memory(table: DataFrame, most: int, least: float = CONTINUE, idle: str | None = None, until: str | None = None) -> DataFrame:
    """The tagged rows of all exchanges (sample_id, message_id, ts, terms, names, claims array of (text, status)).

    With ``idle``, a sample's trajectories close after so long without an exchange; at the end they close as idle if that time
    had passed by ``until`` (a UTC time), else as finalize.
    """
    wait = pd.Timedelta(idle).value // 1000 if idle else None
    end = pd.Timestamp(until).value // 1000 if until else None
    kinds = {"version": pa.int32(), "message_id": pa.int64(), "score": pa.float64(), "ts": pa.timestamp("us", "UTC")}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in COLUMNS], COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = None
        finish = lambda b: b.close_all("idle" if wait is not None and end is not None and b.last + wait < end else "finalize")
        for b in batches:
            rows = []
            # times as microseconds
            ts = b.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
            for sample, message_id, at, terms, names, claims in zip(*(ts if c == "ts" else b.column(c).to_pylist() for c in ("sample_id", "message_id", "ts", "terms", "names", "claims")), strict=True):
                if builder is None or builder.sample != sample:
                    rows += finish(builder) if builder else []
                    builder = MemoryBuilder(sample, most, least, wait)
                rows += builder.add(message_id, at, terms, names, [(c["text"], c["status"]) for c in claims])
            if rows:
                yield batch(rows)
        if builder:
            yield batch(finish(builder))

    return exchanges(table).repartition("sample_id").sortWithinPartitions("sample_id", "ts", "message_id").mapInArrow(run, ROWS)
