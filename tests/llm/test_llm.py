"""Each operator against a brute-force version or an exact round trip, with nulls, empties, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long"


def docs_of(spark, rows):
    """(id, text) or (id, text, lang) rows, with columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, "k", 2) for r in rows], DOCS)


def sample(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE  Two"), (5, "x" * 5000), (6, "a b c d e"), (7, "a b c d e"), (8, "   x é\r\n\ny")]
    base = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(10, 10 + n):
        words = list(base) if k % 2 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
    return rows + [(6, "a b c d e"), (6, "a b c d e")]


def test_byte_bpe_is_what_tiktoken_says(spark):
    import tiktoken

    from colloquy.llm.byte_bpe import read_ranks, round_trip

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = sample() + [(900, "I'm  don't \n\n x <|endoftext|> 日本 😀é"), (901, "aaaa" * 300), (902, "\xa0 \xa0x")]
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in round_trip(docs_of(spark, rows), path, pattern).collect()) == want
    assert round_trip(docs_of(spark, []), path, pattern).count() == 0


def test_fingerprints_follow_the_next_document(spark):
    from colloquy.llm.fingerprints import compared_with_next, edited, fingerprints, likeness

    rows = [r for r in sample() if r[0] != 6] + [(6, "a b c d e")]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in compared_with_next(docs_of(spark, rows), blocks=7).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        a, b, c = fingerprints([t.encode(), u.encode(), edited(t, u).encode()])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited(t, u).encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.tobytes().hex(), c.tobytes().hex())
        assert (r.near_edited, r.near_next) == (likeness(a, c), likeness(a, b))
    assert compared_with_next(docs_of(spark, [])).count() == 0


def test_token_counts_add_up(spark):
    import tiktoken

    from colloquy.llm.byte_bpe import read_ranks
    from colloquy.llm.token_counts import section_token_counts

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = [(1, "ab\n\n\ncd é\n"), (2, None), (3, "日本\n語"), (4, "x")]
    for rule in ("start", "end", "most"):
        got = {}
        for r in section_token_counts(docs_of(spark, rows), path, pattern, rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t in rows:
            t = t or ""
            ids = library.encode_ordinary(t)
            assert sum(r.n_tokens for r in got[i]) == len(ids)
            assert "".join(t[r.start_char : r.end_char] for r in sorted(got[i], key=lambda r: r.section)) == t
            at = 0
            count = Counter()
            for x in library.decode_tokens_bytes(ids):
                first, last = len(t.encode()[:at].decode(errors="ignore")), None
                at += len(x)
                last = len(t.encode()[:at].decode(errors="replace")) - 1
                if rule != "most":
                    count[next(r.section for r in got[i] if r.start_char <= (first if rule == "start" else last) < r.end_char)] += 1
            assert rule == "most" or all(count[r.section] == r.n_tokens for r in got[i])


def test_html_keeps_the_article_alone(spark):
    from colloquy.llm.html_text import extracted

    p = "word &amp; more text in a long enough paragraph. " * 4
    clean = " ".join(p.replace("&amp;", "&").split())
    pages = [
        (1, f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>m</a></li></ul></nav><div class='ad'>buy</div><article><h1>Head</h1><p>{p}<p>a<b>b</b>c<br>d</article><div id=comments><p>{p}</p></div><footer>f</footer></body></html>", f"Head {clean} abc d"),
        (2, None, ""), (3, "", ""), (4, "plain", "plain"), (5, f"<body><div><div><p>{p}<p>{p}</div><div><p>{p}</div></div><aside>{p}</aside><form>{p}</form><script>'<p>'</script></body>", f"{clean} {clean} {clean}"),
        (6, "<div" * 2000, ""), (6, "<!-- only -->", ""),
    ]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h, _ in pages], "page_id long, url string, html string, text string")
    assert Counter((r.page_id, r.text, r.n_chars) for r in extracted(df).collect()) == Counter((i, t, len(t)) for i, _, t in pages)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='has-sidebar'><article><p>{p}</article></div>", "{p}"),
        ("<div class='has-sidebar'><div class=sidebar>menu</div><div><p>{p}<p>{p}</div></div>", "{p} {p}"),
        ("<div class='sidebar'><article><p>{p}</article></div>", "{p}"),
        ("<article><h2 id='share-prices'>Prices</h2><p>{p}<section id='related-work'><p>{p}</section><p id='notice-1'>n</article>", "Prices {p} {p} n"),
        ("<article><h2 id=related>Related</h2><p>{p}<p class=notice>n<p class=ad>buy</p><div class='social-share'>s</div><div id=comments>c</div></article>", "Related {p} n"),
        ("<div class='related'><article>teaser</article></div><article><p>{p}</article><div class='comment-list'>c</div>", "{p}"),
        ("<article><p>{p}<figure><img src=x><figcaption>A cat</figcaption></figure><figure><table><tr><td>1<td>2</table></figure><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>", "{p} A cat 1 2 so x=2 holds"),
    ],
)
def test_html_names_do_not_take_the_article(page, want):
    from colloquy.llm.html_text import main_text

    p = " ".join(["Word and more text in a long enough paragraph."] * 4)
    got = main_text("<html><body><nav>n</nav>" + page.format(p=p) + "<footer>f</footer></body></html>")
    assert got == want.format(p=p)


def measures_of(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures_and_thresholds(spark):
    from colloquy.llm.quality import judged

    rows = sample() + [(700, "a b c d e f a b c d e f g\na b c\na b c"), (701, "a " * 40)] + [(800 + k, f"{'#%& ' * 3}" + " ".join(f"v{j}" for j in range(12))) for k in range(3)]
    for r in judged(docs_of(spark, rows)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect():
        n, *rest = measures_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * rest[3] > 20 * n)
        if r.doc_id >= 800:
            assert not r.kept
        elif 10 <= r.doc_id < 100:
            assert r.kept == (not r.base_failed)
    assert judged(docs_of(spark, [])).count() == 0
    assert judged(docs_of(spark, [(k, "a b c d e f g h i j") for k in range(300)])).where("kept").count() == 300  # copies alone


def test_quality_thresholds_follow_the_source(spark):
    from colloquy.llm.quality import judged

    rng = random.Random(5)
    text = lambda signs: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) + ("*" if rng.random() < signs else "") for _ in range(rng.randint(60, 200)))
    odd = " ".join(f"{w}{'*' if k % 3 == 0 else ''}" for k, w in enumerate(text(0).split()))
    rows = [(k, text(0), "en", "plain") for k in range(300)] + [(1000 + k, text(0.3), "en", "starred") for k in range(300)]
    rows += [(5000, odd, "en", "plain"), (5001, odd, "en", "starred"), (5002, odd, "en", "plain"), (5003, odd, None, None)]
    kept = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (kept[5000], kept[5001], kept[5002]) == (False, True, False)
    assert sum(kept[k] for k in range(300)) >= 295 and sum(kept[1000 + k] for k in range(300)) >= 290


def test_url_reputation_blocks_hosts_domains_and_suffixes(spark):
    from colloquy.llm.url_reputation import judged_urls

    rng, pages, marks = random.Random(2), [], []
    rate = lambda host: 0.9 if host.endswith(".bad.info") or host.endswith(".worse") or host == "one.mixed.info" else 0.05
    hosts = [f"h{k}.{d}" for k in range(6) for d in ("bad.info", "good.info", "fine.de", "more.de", "x.worse", "y.worse", "z.co.uk")] + ["one.mixed.info", "two.mixed.info", "three.mixed.info"]
    for host in hosts:
        for _ in range(30):
            pages.append((len(pages), f"http://{host}/p"))
            marks.append((len(marks), rng.random() < rate(host)))
    unseen = ["new.bad.info", "new.good.info", "new.other.worse", "new.z.co.uk", "u@h0.bad.info:8080", "10.0.0.7"]
    pages += [(9000 + k, f"http://{h}/p") for k, h in enumerate(unseen)]
    pages += [(9100, None), (9100, None)]
    got = judged_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad boolean")).collect()
    verdict = {r.host: r.verdict for r in got}
    assert all(verdict[h] == ("block" if rate(h) > 0.5 else "allow") for h in hosts)
    assert [verdict[h] for h in unseen] == ["block", "allow", "block", "allow", "block", "allow"]
    assert len(got) == len(pages) and verdict[""] == "allow"
    none = judged_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")).collect()
    assert {r.verdict for r in none} == {"allow"}
    assert judged_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def test_url_rules_and_reputation(spark):
    from colloquy.llm.url_reputation import judged_urls

    urls = [(1, "https://A.example.COM/en/7/x?q"), (2, "http://b.com/en/1"), (3, "http://x.example.net/de/8"), (4, "http://x.net/de/#f"), (5, "http://org/es/"), (6, None), (7, "nothing"), (8, "http://notcom/en/")]
    urls += [(100 + k, f"http://bad.example.org/fr/{k}") for k in range(40)] + [(200 + k, f"http://good.example.org/fr/{k}") for k in range(40)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in urls], "page_id long, url string, host string")
    marks = spark.createDataFrame([(i, 100 <= i < 140) for i, _ in urls if i >= 100], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged_urls(pages, marks).collect()}
    assert got[1] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("example.net/de/8", "block") and got[4] == ("x.net", "/de/", "net/de/", "allow") and got[5][2:] == ("org/es/", "block")
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][2] is None
    assert got[100][3] == "block" and got[200][3] == "allow"


def components_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("limit", [2, 24])
def test_jaccard_components_against_all_pairs(spark, monkeypatch, limit):
    from colloquy.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "PAIR_BUCKET", limit)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_CLASSES", 7)
    rows = sample(3, 70)
    got = Counter(tuple(r)[:3] for r in ngram_jaccard.similarity_components(docs_of(spark, rows)).collect())
    assert got == components_of(rows)
    assert ngram_jaccard.similarity_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["one", "one Two", "one two three", "one two three four"])
def test_a_short_text_alone_has_one_shingle(spark, text):
    import pyarrow as pa

    from colloquy.llm.ngram_jaccard import similarity_components
    from colloquy.llm.wordhash import shingle_sets

    (alone,), (beside, *_) = shingle_sets(pa.array([text])), shingle_sets(pa.array([text, "a b c d e f g"]))
    assert len(alone) == 1 and (alone == beside).all()
    rows = [(7, text)]
    assert Counter(tuple(r)[:3] for r in similarity_components(docs_of(spark, rows)).collect()) == components_of(rows)


def test_packing_is_best_fit_decreasing_and_ids_are_the_librarys(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from colloquy.llm.packing import pack, packed_matrix

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows, cap = sample() + [(950, "It's 'S İstanbul Σ 12ab <|endoftext|> áé"), (951, "a<|endoftext|>b <|startoftext|> c <|ENDOFTEXT|>"), (952, "long text " * 3000)], 64
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    want = Counter((i, k // cap, k, len(x[k : k + cap]), zlib.crc32(np.array(x[k : k + cap], "<u4").tobytes())) for (i, _), x in zip(rows, ids) for k in range(0, len(x), cap))
    got = pack(docs_of(spark, rows), path, cap).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins, room = {}, []
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    for n in sorted((r.length for r in got), reverse=True):
        fit = [(x, k) for k, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(cap - n)
    assert len(bins) == len(room)
    found, sequences = {}, 0
    for r in packed_matrix(docs_of(spark, rows), path, cap).collect():
        sequences += 1
        line, place = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(line) == len(place) == cap and r.n_tokens == r.cu_seqlens[-1] and not line[r.n_tokens :].any() and not place[r.n_tokens :].any()
        for i, k, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert place[a:b].tolist() == list(range(b - a)) and start == k * cap
            found.setdefault(i, Counter())[k, tuple(line[a:b].tolist())] += 1
    assert sequences == len(room)
    wanted = {}
    for (i, _), x in zip(rows, ids, strict=True):
        for k in range(0, len(x), cap):
            wanted.setdefault(i, Counter())[k // cap, tuple(x[k : k + cap])] += 1
    assert found == wanted
    assert packed_matrix(docs_of(spark, []), path).count() == 0
    assert pack(docs_of(spark, []), path).count() == 0


def test_language_id_on_held_out_documents(spark):
    from colloquy.llm.language_id import identified

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in identified(docs_of(spark, [(1, None), (2, "12 34"), (3, ""), (4, "ab", None)])).collect()}
    assert odd == {k: ("und", 0.0) for k in (1, 2, 3, 4)}


def test_language_of_a_text_is_the_same_beside_any_neighbour():
    import numpy as np
    import pyarrow as pa

    from colloquy.llm.language_id import BUCKETS, LENGTHS, Model, ngram_buckets

    known = [("en", "the cat sat with the other cats there"), ("de", "der hund und die katze sind schon dort"), ("fr", "le chat est avec les autres chats")]
    shares = [np.bincount(ngram_buckets(np.frombuffer(t.encode(), np.uint8)).ravel(), minlength=len(LENGTHS) * BUCKETS) for _, t in known]
    model = Model([v for v, _ in known], np.array([s / s.sum() for s in shares], np.float32))
    for text in ("d", "le", "und", "thé", "the cat"):
        lang, score = model.predict(pa.array([text]))
        for beside in (*(t for _, t in known), "zzz", "", None, "x", text):
            for texts in ([text, beside], [beside, text], [beside, text, beside]):
                got = model.predict(pa.array(texts, pa.string()))
                k = texts.index(text)
                assert (got[0][k], got[1][k]) == (lang[0], score[0])


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, " ".join(f"alpha{k}" for k in range(40)))] + [(k, " ".join(f"beta{j}" for j in range(30))) for k in (2, 3, 4)] + [(5, None), (6, "#$% " * 30)]
    docs_of(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == [1, 2]


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_url_reputation", "op8_ngram_jaccard"])
def test_against_duckdb(spark, name):
    import duckdb

    from colloquy.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())


def test_ids_and_bytes_of_byte_bpe(spark):
    from colloquy.llm.byte_bpe import decoded, encoded, read_ranks

    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = sample() + [(900, "日本 é"), (901, None)]
    ids = encoded(docs_of(spark, rows), path, pattern)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in decoded(ids, path, pattern).collect()) == Counter((i, (t or "").encode()) for i, t in rows)


def test_packed_matrix_is_written_as_it_is(spark, tmp_path):
    from colloquy.llm.packing import packed_matrix, write_packed

    packed = packed_matrix(docs_of(spark, sample()), public_tokenizers.path("word_bpe_49k.json"), 64)
    write_packed(packed, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    shown = lambda df: Counter((r.sequence_id, r.n_tokens, bytes(r.ids), tuple(r.cu_seqlens), bytes(r.position_ids)) for r in df.collect())
    assert shown(back) == shown(packed.select(back.columns))
