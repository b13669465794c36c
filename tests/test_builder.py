"""Memory in all four kinds of rows against a plain version, and the stream against the batch."""

import datetime as dt
import random
import re
from collections import Counter

import pytest

from colloquy.operators import builder as B
from colloquy.streaming import jobs as J
from colloquy.streaming.memory import stream_memory

SCHEMA = "sample_id long, message_id long, ts timestamp, terms array<string>, names array<string>, claims array<struct<text: string, status: string>>"
START = dt.datetime(2024, 1, 1)


def made(seed, n=150, samples=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(14)]
    facts = [f"{a} likes {b} and {c}" for a in ("anna", "ben") for b in ("tea", "chess", "rain") for c in ("bread", "tea")] + ["", "short", "ANNA likes, tea and tea!"]
    rows = []
    for k in range(n):
        claims = [(rng.choice(facts), rng.choice(["active", "active", "deprecated"])) for _ in range(rng.randint(0, 3))]
        rows.append((rng.randrange(samples), k, START + dt.timedelta(hours=3 * k + (60 * 24 if k > 100 else 0)), rng.sample(words, rng.randint(0, 5)), rng.sample(words[:3], rng.randint(0, 2)), claims))
    return rows


def plain(rows, most, least, idle=None, until=None):
    """The same, written down step by step over lists."""
    out = []
    for sample in {r[0] for r in rows}:
        chains, count, last = [], 0, None
        tid = lambda c: f"{sample}:t{c['no']}"

        def shut(c, why, out=out, sample=sample):
            out.append((str(sample), "trajectory", f"{sample}:t{c['no']}", len(c["texts"]), c["ids"][-1], None, None, None, None, None, None, why))

        for _, mid, ts, terms, names, claims in sorted((r for r in rows if r[0] == sample), key=lambda r: (r[2], r[1])):
            if idle and last and ts - last > idle:
                for c in chains:
                    shut(c, "idle")
                chains = []
            last = ts
            terms, names = set(terms or []), set(names or [])
            seen = lambda c: set().union(*c["texts"])
            ranked = sorted(chains, key=lambda c: (-(len(terms & seen(c)) + 2 * len(names & seen(c))), c["no"]))[:32]
            jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
            scores = [(round(0.6 * jac(terms, seen(c)) + 0.2 * jac(terms, c["texts"][-1]) + 0.2 * len(terms & seen(c)) / max(1, len(terms)) + (0.10 if names & seen(c) else 0), 9), -c["no"], c) for c in ranked]
            top = max(scores, key=lambda s: s[:2], default=(0.0, 0, None))
            if top[0] >= least and top[0] > 0:
                c, why = top[2], "continue"
            else:
                c, why = {"no": count, "texts": [], "ids": [], "held": []}, "new"
                chains.append(c)
                count += 1
            c["texts"].append(terms)
            c["ids"].append(mid)
            v = len(c["texts"])
            base = (str(sample), tid(c), v, mid)
            out.append((base[0], "snapshot", *base[1:], None, None, None, None, None, top[0], why))
            norm = lambda t: " ".join(re.sub("[^a-z0-9 ]", " ", t.lower()).split())
            keys = lambda t: {w for w in re.findall(r"[a-z0-9][a-z0-9\-']+", t.lower()) if len(w) > 2}
            old, now, ops, used = list(c["held"]), [], [], set()
            pending = []
            for k, (text, status) in enumerate(claims or []):
                same = next((j for j, o in enumerate(old) if j not in used and norm(o[1]) == norm(text)), None)
                if same is None:
                    pending.append(k)
                    now.append((f"{tid(c)}:v{v}:c{k + 1}", text, status))
                    ops.append(None)
                else:
                    used.add(same)
                    now.append((old[same][0], text, status))
                    ops.append(("KEEP" if old[same][2] == status else "DEPRECATE" if status == "deprecated" else "REVISE", old[same][0], old[same][0]))
            left = [j for j in range(len(old)) if j not in used]
            n_shared = lambda k, j: len(keys(claims[k][0]) & keys(old[j][1]))
            for k in pending:
                mine = max(left, key=lambda j: (n_shared(k, j), -j), default=None)
                ops[k] = ("ADD", now[k][0], None)
                if mine is not None and n_shared(k, mine) >= 2 and max(pending, key=lambda x: (n_shared(x, mine), -x)) == k:
                    ops[k] = ("REVISE", now[k][0], old[mine][0])
            gone = {o[2] for o in ops if o[0] == "REVISE"}
            for j in left:
                if old[j][0] not in gone:
                    now.append(old[j])
                    ops.append(("CARRY", None, old[j][0]))
            c["held"] = now
            out += [(base[0], "claim", *base[1:], i, t, s, None, None, None, None) for i, t, s in now]
            out += [(base[0], "op", *base[1:], i, None, None, op, o, None, None) for op, i, o in ops]
            if v == most:
                shut(c, "max_length")
                chains.remove(c)
        for c in chains:
            shut(c, "idle" if idle and until and last + idle < until else "finalize")
    return Counter(out)


def shown(df):
    return Counter(tuple(r)[:12] for r in df.select(B.COLUMNS).collect())


@pytest.mark.parametrize("seed, most, least, idle", [(1, 6, 0.72, None), (2, 3, 0.3, None), (3, 4, 0.25, "20 days"), (4, 1, 0.5, "1 hour")])
def test_batch_against_a_plain_version(spark, seed, most, least, idle):
    rows = made(seed) + [(9, 7, START, None, None, None), (9, 8, START, [], [None], [(None, None)])]
    wait = dt.timedelta(days=20) if idle == "20 days" else dt.timedelta(hours=1) if idle else None
    until = dt.datetime(2024, 4, 1)
    got = shown(B.build_memory(spark.createDataFrame([*rows, (None, 1, START, [], [], []), (5, 1, None, [], [], [])], SCHEMA), most, least, idle, str(until) if idle else None))
    want = plain([r if r[1] != 8 or r[0] != 9 else (9, 8, START, [], [], [("", "active")]) for r in rows], most, least, wait, until)
    assert got == want
    if not idle:
        assert B.build_memory(spark.createDataFrame([], SCHEMA), most).count() == 0


def drained_in_files(spark, tmp_path, rows, cuts, query):
    """``rows`` as files, each one a micro-batch."""
    at = 0
    for n, end in enumerate([*cuts, len(rows)]):
        spark.createDataFrame(rows[at:end], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        at = end
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return query(stream.withWatermark("ts", "1 hour"))


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = made(7)
    stream = drained_in_files(spark, tmp_path, rows, [20, 21, 70, 105], lambda s: stream_memory(s, 4, 0.25, "30 days"))
    got = shown(J.drained(stream))
    batch = shown(B.build_memory(spark.createDataFrame(rows, SCHEMA), 4, 0.25, "30 days"))
    still_open = Counter({r: n for r, n in batch.items() if r[11] == "finalize"})
    assert {r[1] for r in got} == {"trajectory", "snapshot", "claim", "op"} and {"idle", "max_length"} <= {r[11] for r in got}
    assert got == batch - still_open


def test_late_rows_are_dropped_and_a_restart_goes_on(spark, tmp_path):
    rows = made(8, 60, 2)
    late = (0, 999, START - dt.timedelta(days=1), ["w1"], [], [("late", "active")])
    end = (7, 1000, START + dt.timedelta(days=400), ["w1"], [], [])
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    for n, part in enumerate([rows[:30], [late, *rows[30:]], [end]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / str(n)))
        out = stream_memory(stream.withWatermark("ts", "1 hour"), 4, 0.25, "30 days")
        # a new query each time: state and place come from the checkpoint alone
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = shown(spark.read.parquet(str(tmp_path / "out")))
    want = shown(B.build_memory(spark.createDataFrame([*rows, end], SCHEMA), 4, 0.25, "30 days", str(end[2])))
    assert not any(r[4] == 999 for r in got)
    assert got == Counter({r: n for r, n in want.items() if r[11] != "finalize"})


def test_ids_do_not_collide():
    b = B.MemoryBuilder("1", 100)
    b.next = 100_000
    (row,) = [r for r in b.add(1, START, ["x"], [], []) if r["kind"] == "snapshot"]
    assert row["trajectory_id"] == "1:t100000" != "2:t0"


def test_a_repeated_text_is_searched_once_and_rows_do_not_pass_through_pandas(spark):
    B._keys.cache_clear()
    B.changed_claims([("a", "the big red house", "active")] * 40, [("a small blue garden", "active")] * 40, "p")
    assert B._keys.cache_info().misses == 2
    x = spark.sql("SELECT 'a' AS sample_id, 1L AS message_id, timestamp '2020-01-01' AS ts, array('house') AS terms, array('anna') AS names, array(struct('x' AS text, 'active' AS status)) AS claims")
    found = B.build_memory(x, 4)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert sorted((r.kind, str(r.ts)) for r in found.collect()) == [(k, "2020-01-01 00:00:00") for k in ("claim", "op", "snapshot", "trajectory")]


def test_a_stream_removes_only_what_it_had_stored():
    import pandas as pd

    from colloquy.streaming.memory import MemoryProcessor

    class State:
        def __init__(self, value=None):
            self.value, self.rows, self.removed = value, {}, 0

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        iterator = lambda self: iter(list(self.rows.items()))
        containsKey = lambda self, k: k in self.rows
        getValue = lambda self, k: self.rows[k]

        def update(self, value):
            self.value = value

        def updateValue(self, k, v):
            self.rows[k] = v

        def removeKey(self, k):
            self.removed += 1
            del self.rows[k]

    class Handle:
        getValueState = lambda self, *_: State()
        getMapState = lambda self, *_: State()
        registerTimer = deleteTimer = lambda self, at: None

    p = MemoryProcessor(2, 0.3, "2 days")
    p.init(Handle())
    part = lambda first, n: [pd.DataFrame([(k, pd.Timestamp("2020-01-01") + pd.Timedelta(minutes=k), ["house"], [], []) for k in range(first, first + n)], columns=["message_id", "ts", "terms", "names", "claims"])]
    list(p.handleInputRows(("a",), iter(part(0, 5)), None))
    assert p.open.removed == 0 and list(p.open.rows) == [(2,)]
    list(p.handleInputRows(("a",), iter(part(5, 1)), None))
    assert p.open.removed == p.claims.removed == 1 and not p.open.rows
