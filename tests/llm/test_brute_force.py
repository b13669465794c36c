"""Operators against versions that share no code with them, and odd tables for all of them."""

import math
from collections import Counter
from html.parser import HTMLParser

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, rank long, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 2, 3, "x") for i, t in rows], DOCS)


def plain_fingerprint(text):
    """Chunks cut byte by byte, their digests in hexadecimal order."""
    import numpy as np
    import xxhash

    gear = [int(x) for x in np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)]
    data, chunks, start = text.encode(), {}, 0

    def falls(end, bits, shift):
        h = sum(gear[data[end - 1 - k]] << k for k in range(16) if end - 1 - k >= 0) % (1 << 32)
        return (h >> shift) % (1 << bits) == 0

    while start < len(data):
        end = start + 24
        while end < len(data) and end < start + 256:
            if falls(end, 7, 9) if end <= start + 64 else falls(end, 5, 11):
                break
            if end == start + 64 and falls(end, 5, 11):
                break
            end += 1
        piece = data[start : min(end, len(data))]
        chunks[xxhash.xxh3_64_intdigest(piece)] = len(piece)
        start += len(piece)
    return "".join(f"{d:016x}{n:04x}" for d, n in sorted(chunks.items())), chunks


def test_fingerprints_cut_byte_by_byte(spark):
    import random

    from colloquy.llm.fingerprints import compared_with_next

    rng = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "öl", "日本", "x"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400])))) for k in range(25)] + [(30, None), (31, ""), (32, "a" * 3000)]
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in compared_with_next(docs_of(spark, rows), blocks=3).collect()}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 3
        (own, a), (changed, b), (_, c) = plain_fingerprint(t), plain_fingerprint(t[: len(t) - k] + u[:k]), plain_fingerprint(u)
        like = lambda x, y: float(len(x) == len(y)) if not x or not y else min(1.0, sum(n for d, n in x.items() if d in y) / min(sum(x.values()), sum(y.values())))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, changed)
        assert (got[i].near_edited, got[i].near_next) == (pytest.approx(like(a, b)), pytest.approx(like(a, c)))


def test_crossing_tokens_go_by_the_rule(spark):
    import tiktoken

    from colloquy.llm.byte_bpe import read_ranks
    from colloquy.llm.token_counts import section_token_counts

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = [(1, "ab\n\n\ncd é\n\n\n x\n"), (3, "日本\n\n語"), (4, "x"), (5, "a \n \n\n b"), (6, ("word\n\n" * 4000))]
    for rule in ("start", "end", "most"):
        got = section_token_counts(docs_of(spark, rows), path, pattern, rule).collect()
        for i, t in rows:
            bounds, at = [0], 0
            while (at := t.find("\n", at) + 1) and at < len(t):
                bounds.append(at)
            bounds.append(len(t))
            count, crossing, raw, byte = Counter(), Counter(), t.encode(), 0
            for piece in library.decode_tokens_bytes(library.encode_ordinary(t)):
                first = len(raw[: byte + 1].decode(errors="ignore" if raw[byte] < 0x80 else "replace")) - 1
                byte += len(piece)
                last = len(raw[:byte].decode(errors="replace")) - 1
                held = Counter(sum(b <= c for b in bounds[1:-1]) for c in range(first, last + 1))
                own = min(held) if rule == "start" else max(held) if rule == "end" else min(held, key=lambda s: (-held[s], s))
                count[own] += 1
                crossing[own] += len(held) > 1
            mine = {r.section: (r.n_tokens, r.n_crossing) for r in got if r.doc_id == i}
            assert mine == {s: (count[s], crossing[s]) for s in range(len(bounds) - 1)}


def test_language_scores_by_plain_counting():
    import numpy as np
    import pyarrow as pa

    from colloquy.llm.language_id import BUCKETS, LENGTHS, _scored

    rng = np.random.default_rng(3)
    weights = rng.normal(size=(2, len(LENGTHS) * BUCKETS)).astype(np.float32)
    texts = ["The cat, 12 sat!", "Ünder é", "", None, "a", "ß" * 3000]
    got = _scored(pa.array(texts), weights)
    for row, text in zip(got, texts, strict=True):
        data = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in (text or "").lower().encode())
        total = np.zeros(2)
        for at in range(len(data)):
            for k, n in enumerate(LENGTHS):
                gram = int.from_bytes((data[at : at + n] + b"   ")[:n], "little")
                total += weights[:, ((gram * 2654435761) % (1 << 32) >> 20) + k * BUCKETS]
        assert row == pytest.approx(total / max(1, len(LENGTHS) * len(data)), abs=1e-4)


class Tree(HTMLParser):
    """A plain tree of well-formed markup: [tag, children]."""

    def __init__(self, html):
        super().__init__()
        self.root = ["body", []]
        self.stack = [self.root]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def counts(node):
    """(characters, tags, link characters, link tags) of a subtree."""
    c = t = lc = lt = 0
    for x in node[1]:
        if isinstance(x, str):
            c += len("".join(x.split()))
        else:
            a, b, d, e = counts(x)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x[0] == "a")
    return c, t, c if node[0] == "a" else lc, lt


def test_densest_part_of_a_page_without_landmarks():
    import random

    from colloquy.llm.html_text import main_text, measure, parse

    rng = random.Random(8)
    word = lambda: rng.choice(["stone", "river", "green", "window", "paper"])
    para = lambda n: "<p>" + " ".join(word() for _ in range(n)) + "</p>"
    for _ in range(20):
        article = "".join(para(rng.randint(30, 60)) for _ in range(rng.randint(3, 6)))
        links = "<ul>" + "".join(f"<li><a>{word()}</a></li>" for _ in range(8)) + "</ul>"
        html = f"<div>{links}</div><div><div>{article}</div></div><div>{links}<p>{word()}</p></div>"
        tree = Tree(html).root
        whole = counts(tree)

        def density(node):
            c, t, lc, lt = counts(node)
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + whole[2] / whole[0] * c + math.e)
            return c / max(1, t) * max(0.0, math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)) + math.e - 1)) / base

        def nodes(node):
            yield node
            for x in node[1]:
                if not isinstance(x, str):
                    yield from nodes(x)

        mine = {n.tag: [] for n in measure(parse(f"<body>{html}</body>"))}
        for n in measure(parse(f"<body>{html}</body>")):
            mine[n.tag].append(n.density)
        theirs = {}
        for n in nodes(tree):
            theirs.setdefault(n[0], []).append(density(n))
        assert {t: mine[t] for t in theirs} == {t: pytest.approx(d) for t, d in theirs.items()}
        best = max(nodes(tree), key=lambda n: sum(density(x) for x in n[1] if not isinstance(x, str)))
        said = " ".join("".join(x if isinstance(x, str) else "" for x in p[1]) for p in nodes(best) if p[0] == "p")
        assert said and said in main_text(f"<body>{html}</body>") and "<" not in main_text(html)


def test_hostile_markup_takes_linear_time():
    import time

    from colloquy.llm.html_text import main_text

    for page in ("<b>" * 60_000 + "</zz>" * 60_000, "<p><table>" + "<b>" * 60_000 + "<p></p>" * 60_000, "<header>" * 60_000, "<li>" * 60_000 + "</p>" * 60_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 15


ODD = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "no id at all"), (None, None), (2, None), (3, ""), (-(2**63), "least id"), (4, "word " * 60_000), (5, "\x00   ﻿")]


def _runs():
    from colloquy.llm import byte_bpe, fingerprints, language_id, ngram_jaccard, packing, quality, token_counts

    ranks, pattern, words = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
    return {
        "byte_bpe": lambda d: byte_bpe.round_trip(d, ranks, pattern), "fingerprints": fingerprints.compared_with_next, "token_counts": lambda d: token_counts.section_token_counts(d, ranks, pattern).groupBy("doc_id").count().drop("count"),
        "quality": quality.judged, "jaccard": ngram_jaccard.similarity_components, "packing": lambda d: packing.pack(d, words).where("piece = 0"), "matrix": lambda d: packing.packed_matrix(d, words).selectExpr("explode(arrays_zip(doc_ids, pieces)) AS x").where("x.pieces = 0").selectExpr("x.doc_ids AS doc_id"),
        "language": language_id.identified,
    }


@pytest.mark.parametrize("name", ["byte_bpe", "fingerprints", "token_counts", "quality", "jaccard", "packing", "matrix", "language"])
def test_odd_tables(spark, name):
    run = _runs()[name]
    want = Counter(i for i, _ in ODD) if name != "token_counts" else Counter({i for i, _ in ODD})
    assert Counter(r.doc_id for r in run(docs_of(spark, ODD)).collect()) == want
    assert run(docs_of(spark, [])).count() == 0


def test_odd_pages(spark):
    from colloquy.llm.html_text import extracted
    from colloquy.llm.url_reputation import judged_urls

    rows = [(1, None, None), (1, None, None), (None, "http://a.b/", "<p>x"), (2, "http://[::1]:80/", ""), (3, "HTTP://A.B:81/", "<p>" + "y " * 200_000)]
    pages = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    got = extracted(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows) and max(r.n_chars for r in got) == 399_999
    marks = spark.createDataFrame([(1, True), (1, False), (9, None)], "page_id long, bad boolean")
    assert Counter(r.page_id for r in judged_urls(pages, marks).collect()) == Counter(r[0] for r in rows)
    tie = [("block", "a.com", "/x"), ("allow", "com", "/x/yyy")]
    one = spark.createDataFrame([(1, "http://a.com/x/yyy")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in judged_urls(one, marks, tie).collect()] == [("com/x/yyy", "allow")]
    assert extracted(pages.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{(k * 37 + j * j) % 211}x" for j in range(60))
    rows = [(k, text(k)) for k in range(30)] + [(0, text(0)), (100, text(3)), (101, None), (102, ""), (103, "12 34 " * 30)]
    docs_of(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in got if r.piece == 0)
    assert max(ids.values()) == 1 and 100 not in ids and not {101, 102, 103} & set(ids)
    docs_of(spark, []).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
