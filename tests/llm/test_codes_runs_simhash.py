"""Vector codes, periodic runs and SimHash components against versions that share no code with them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, h long, fp long, runs string, best long"
VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, code long, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "r", 3) for i, t in rows], DOCS)


# vector codes


def plain_codes(rows, parts, entries, rounds):
    """(id, code, error, label_error, digest) by plain loops; ``rows`` are (id, vector, label)."""
    good = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) <= 2**19 for x in v)]
    lengths = Counter(len(v) for _, v, _ in good if v and len(v) % parts == 0)
    if not lengths:
        return []
    most = min(lengths, key=lambda n: (-lengths[n], n))
    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in good if len(v) == most]
    width = most // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min(range(len(books[p])), key=lambda e: (apart(part, books[p][e]), e)) for p, part in enumerate(cut(v))] for _, v, _ in kept]

    for _ in range(rounds):
        held = defaultdict(list)
        for (_, v, _), code in zip(kept, assigned(), strict=True):
            for p, part in enumerate(cut(v)):
                held[p, code[p]].append(part)
        for (p, e), got in held.items():
            books[p][e] = tuple(sum(x) // len(got) for x in zip(*got, strict=True))
    codes = assigned()
    errors = [sum(apart(part, books[p][c[p]]) for p, part in enumerate(cut(v))) for (_, v, _), c in zip(kept, codes, strict=True)]
    by_label = Counter()
    for (_, _, c), e in zip(kept, errors, strict=True):
        by_label[c] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, bytes(code).hex(), e, by_label[c], digest) for (i, _, c), code, e in zip(kept, codes, errors, strict=True)]


@pytest.mark.parametrize("n, parts, entries, rounds, block", [(300, 4, 8, 2, 4096), (300, 2, 64, 3, 17), (5, 4, 64, 2, 4096), (0, 4, 64, 2, 4096)])
def test_vector_codes_by_plain_loops(spark, monkeypatch, n, parts, entries, rounds, block):
    from colloquy.llm import vector_codes as vc

    monkeypatch.setattr(vc, "BLOCK", block)
    rng = random.Random(n + parts)
    value = lambda: rng.choice([rng.uniform(-1, 1), round(rng.uniform(-1, 1), 1), 0.25])
    rows = [(rng.randrange(10 * n), [value() for _ in range(8)], rng.choice([0, 1, 1, 1, None])) for _ in range(n)]
    rows += rows[:3] + rows[:1] * 40  # repeated rows and a hot vector
    if n > 100:
        bad = [None, [], [0.5] * 7, [0.5] * 16, [0.5] * 7 + [None], [0.5] * 7 + [math.nan], [math.inf] + [0.0] * 7, [1e30] + [0.0] * 7, [-0.001] * 8, [2.0**19] * 8]
        rows += [(-5 + k, v, 1) for k, v in enumerate(bad)] + [(None, [0.125] * 8, 2)]
    got = vc.vector_codes(spark.createDataFrame([(i, v, c, "x", "y", 1, 2) for i, v, c in rows], VECTORS), parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_codes(rows, parts, entries, rounds))


def test_hot_labels_are_joined_alike(spark, monkeypatch):
    from colloquy.llm import runtime, vector_codes as vc

    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)], None if k % 3 else k % 5) for k in range(200)]
    table = spark.createDataFrame([(i, v, c, "x", "y", 1, 2) for i, v, c in rows], VECTORS)
    want = Counter(map(tuple, vc.vector_codes(table, parts=2, entries=4).collect()))
    monkeypatch.setattr(vc, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    assert Counter(map(tuple, vc.vector_codes(table, parts=2, entries=4).collect())) == want == Counter(plain_codes(rows, 2, 4, 2))


# periodic runs


def plain_runs(words, least=12):
    """Every lag in turn; of equal stretches the least period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q) and i > s:
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic(rng, n):
    """Words with short and long periods, broken ones, and runs inside runs."""
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(40) for _ in range(n)]
    if kind == 2:
        base = [rng.randrange(3) for _ in range(rng.randint(1, 20))]
        words = [base[i % len(base)] for i in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            words[rng.randrange(n)] = rng.randrange(3)
        return words
    if kind == 3:
        words = []
        while len(words) < n:
            words += [rng.randrange(2) for _ in range(rng.randint(1, 4))] * rng.randint(1, 30)
        return words
    if kind == 4:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    unit = []
    for _ in range(5):
        unit += [rng.randrange(2) for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
    return unit * rng.randint(1, 4)


@pytest.mark.parametrize("least", [12, 7])
def test_runs_by_every_lag(least):
    import numpy as np

    from colloquy.llm.periodic_runs import maximal_runs

    rng = random.Random(least)
    for _ in range(600):
        texts = [periodic(rng, rng.randint(0, 120)) for _ in range(rng.randint(1, 4))]
        h = np.array([hash(("w", x)) % 2**64 for t in texts for x in t], np.uint64)
        want, at = [], 0
        for t in texts:
            want += [(at + s, at + s + n, q) for s, n, q in plain_runs(t, least)]
            at += len(t)
        assert [tuple(r) for r in maximal_runs(h, np.array([len(t) for t in texts]), least).tolist()] == want


def test_runs_of_long_periodic_texts_take_linear_room():
    import numpy as np

    from colloquy.llm.periodic_runs import maximal_runs

    n = 60_000
    one = np.zeros(n, np.uint64)
    assert maximal_runs(one, np.array([n])).tolist() == [[0, n, 1]]
    assert maximal_runs(np.arange(n, dtype=np.uint64) % 7, np.array([n])).tolist() == [[0, n, 7]]
    broken = one.copy()
    broken[n // 2] = 1  # either side is one run, and the whole is no square
    assert maximal_runs(broken, np.array([n])).tolist() == [[0, n // 2, 1], [n // 2 + 1, n, 1]]
    nested = np.tile(np.concatenate((np.arange(2, 42, dtype=np.uint64), np.zeros(60, np.uint64))), n // 100)
    assert [0, n, 100] in maximal_runs(nested, np.array([n])).tolist()


def plain_digests(i, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_digests_of_odd_and_periodic_texts(spark):
    from colloquy.llm.periodic_runs import periodic_runs, repeated_tail, run_digests

    rng = random.Random(8)
    names = ["w%d" % k for k in range(40)] + ["日本", "É", "\xa0x", "a\x1cb"]
    gap = lambda: rng.choice([" ", "  ", "\n", "\t ", "\x0b", "\x0c\r"])
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "a " * 11), (5, "a " * 12), (6, " b c\n" * 6), (7, "a " * 5000 + "b " * 5000), (8, "x" * 300_000), (9, "  lead and trail  ")]
    for k in range(10, 250):
        rows.append((k, rng.choice(["", gap()]) + "".join(names[w] + gap() for w in periodic(rng, rng.choice([0, 1, 5, 40, 90])))))
    rows += [(20, rows[20][1]), (20, rows[21][1]), (None, "a " * 30), (None, "a " * 30), (-7, "q r " * 9), (2**62, "q r s " * 9)]
    edited = [i for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0 and (t or "").split()]
    assert len(edited) > 10
    got = run_digests(periodic_runs(docs_of(spark, rows), text_col=repeated_tail()))
    assert Counter(tuple(r)[:8] for r in got.collect()) == Counter(plain_digests(i, t) for i, t in rows if i != 7) + Counter([plain_digests_of_seven()])
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    assert periodic_runs(docs_of(spark, [])).count() == 0


def plain_digests_of_seven():
    """Document 7 (too long for every lag): two runs of one word each."""
    assert zlib.crc32(b"7") % 10
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (7, 2, 0, 5000, 1, 5_000_000, sha("0,5000,1\n5000,5000,1\n"), sha("a b"))


def test_runs_and_collapsed_text(spark):
    from colloquy.llm.periodic_runs import periodic_runs

    got = {r.doc_id: r for r in periodic_runs(docs_of(spark, [(1, "x " + "a b c " * 5 + "y"), (2, "one two")])).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 15, 3)] and got[1].collapsed == "x a b c y" and got[1].n_words == 17
    assert (got[2].runs, got[2].collapsed) == ([], "one two")


# SimHash


def plain_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, near=3):
    """(id, fingerprint) rows -> the component id of each row, by all pairs."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= near:
                root[top(a)] = top(b)
    least = {}
    for i, f in prints:
        t = top(f)
        least[t] = min((x for x in (i, least.get(t)) if x is not None), default=None)
    return Counter((i, f"{f:016x}", least[top(f)]) for i, f in prints)


def test_simhash_of_odd_and_near_texts(spark):
    from colloquy.llm.simhash import simhash_components

    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)] + ["日本", "É", "a\x1cb"]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE  Two"), (5, "one two"), (6, "one two three"), (7, "x" * 200_000), (8, "long word " * 40_000), (None, "one"), (None, None)]
    base = [[rng.choice(words) for _ in range(n)] for n in (30, 200, 900)]
    for k in range(20, 220):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 12])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(20, rows[12][1]), (20, rows[12][1]), (21, "other text of the same id")]
    got = simhash_components(docs_of(spark, rows))
    assert Counter(tuple(r)[:3] for r in got.collect()) == plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert simhash_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("pairs, block", [(24, 2048), (2, 5)])
def test_near_fingerprints_against_all_pairs(spark, monkeypatch, pairs, block):
    """Chains, crowds around a few centres, and far ones; small and large buckets give the same components."""
    from colloquy.llm import simhash

    monkeypatch.setattr(simhash, "PAIR_BUCKET", pairs)
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", block)
    rng = random.Random(pairs)
    prints = {0, 2**64 - 1}
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(40):  # a crowd within some bits of a centre
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
        for _ in range(12):  # a chain
            prints.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(2, 4)))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    rows = sorted(prints)
    found = {r.node: r.root for r in simhash.near_components(spark.createDataFrame([(signed(f), 1) for f in rows], "fp long, copies long")).collect()}
    groups = defaultdict(list)
    for f in rows:
        groups[found.get(signed(f), signed(f))].append(f)
    least = {f: min(g) for g in groups.values() for f in g}
    assert Counter((f, f"{f:016x}", least[f]) for f in rows) == plain_components([(f, f) for f in rows])


def test_table_never_discards_a_link():
    """Differences of coordinates never exceed the differing bits, and some three blocks agree on all of theirs."""
    import numpy as np

    from colloquy.llm.simhash import BLOCKS, NEAR, distances

    rng = random.Random(1)
    for _ in range(500):
        f = rng.getrandbits(64)
        g = f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, NEAR)))
        a, b = distances(np.array([f, g], np.uint64)).astype(int)
        assert abs(a.sum(1) - b.sum(1)).max() <= (f ^ g).bit_count()
        assert (a == b).all(0).sum() >= BLOCKS - NEAR


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_periodic_runs"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    from colloquy.llm import registry

    sql = registry.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no SQL")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = registry.queries()[name](spark, sf)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want)
