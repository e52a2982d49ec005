"""Operators against brute force, and their results in special cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillon.llm import bpe, embedding_dedup, exact_dedup, html_extract, mixing, ngram_join, suffix_dedup, token_counts, toxicity, url_filter
from quillon.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _node string, size string"


def docs(spark, rows):
    """rows of (doc_id, text, source); the other columns clash with internal names."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z") for i, t, s in rows], DOCS)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "one two", "b"), (5, words(1, 300), "b"), (6, words(1, 300), "b"), (6, words(1, 300), "b"), (None, "one two", "c"), (8, words(2, 40), "é"), (9, " \t\n", "c")]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("rows", "cores", "shuffle", "leaves"), [(0, 1, 200, 2), (1000, 6, 200, 8), (230_000, 6, 64, 8), (15_000_000, 6, 200, 256), (4_000_000_000, 900, 200, 1024), (50_000_000_000, 900, 200, 16384)])
def test_exact_dedup_leaves(rows, cores, shuffle, leaves):
    assert 2 ** exact_dedup.levels(rows, cores, shuffle) == leaves


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, keep):
    rows = ODD + [(100 + k, f"copy {k % 7}", "s") for k in range(200)]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep=keep).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: (max if keep == "max" else min)([i for i in g if i is not None]) for t, g in groups.items()}
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = by_digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.drop_copies(docs(spark, rows), keep=keep)
    assert left.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(best.values())


def test_empty_tables(spark):
    none = docs(spark, [])
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path
    for df in (
        exact_dedup.exact_dedup(none), mixing.mix(none), ngram_join.jaccard_classes(none), suffix_dedup.drop_repeats(none), embedding_dedup.embedding_links(vec),
        html_extract.extract_text(pages), url_filter.url_filter(pages), toxicity.toxicity(none, labels), bpe.encode_documents(none, path("word_bpe_49k.json")),
        token_counts.length_histogram(token_counts.token_lengths(none, path("byte_bpe_50k.tiktoken"))), exact_dedup.drop_copies(none), ngram_join.drop_near_copies(none), mixing.repeat(none),
    ):
        assert df.count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = ODD + [(1000 + k, words(k, rng.randint(1, 60)), f"s{k % 5}") for k in range(400)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2 * sizes[s]
            left -= capped[s]
    want = {s: capped.get(s, weight[s] * level) for s in order}
    source = {}
    for i, t, s in rows:
        source.setdefault(i, s)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] + r.part
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == sorted((str(r.doc_id), r["size"], r.taken) for r in again)
    copies = {}
    for r in mixing.repeat(docs(spark, rows)).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert sum(copies.values()) == sum(r.copies for r in got)


def test_bpe_equals_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    theirs.no_padding()
    theirs.no_truncation()
    rng = random.Random(5)
    texts = ["", "a" * 3000, "aaaa bbbb", "I'm <|endoftext|>x<|startoftext|>", "İΣΑΣ é ½ ٣", "\x1c\x85​﻿", "日本 😀", words(7, 500)]
    texts += ["".join(rng.choice("abAB' \n.,1éΣ日😀́<|>endoftext") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    own = bpe.WordBpe(path, cache=50)
    for a in range(0, len(texts), 40):
        flat, counts = own.encode_batch(texts[a : a + 40])
        for text, stop, n in zip(texts[a : a + 40], np.cumsum(counts), counts, strict=True):
            ids = theirs.encode(text, add_special_tokens=False).ids
            assert flat[stop - n : stop].tolist() == ids
            assert own.decode(flat[stop - n : stop]) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_documents(spark):
    got = bpe.encode_documents(docs(spark, ODD), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    assert len(got) == len(ODD)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.ids_sha256 == r.decoded_sha256 == empty and r.n_tokens == 0 for r in got if r.doc_id in (1, 2, 9))
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in got)


def test_token_counts(spark):
    encode = token_counts.rank_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), token_counts.PATTERN).encode_ordinary
    rows = ODD + [(50 + k, words(k, k), "q") for k in range(0, 900, 30)]
    lengths = [len(encode(t or "")) for _, t, _ in rows]
    hist = token_counts.length_histogram(token_counts.token_lengths(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"))).cache()
    for r in hist.collect():
        n = r.n_tokens
        assert r.docs == lengths.count(n) and r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n) and r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.docs_total == len(lengths) and r.tokens_total == sum(lengths)
    cut = {r.limit: (r.docs_cut, r.truncated_total) for r in token_counts.at_limits(hist, [0, 100, 10**6]).collect()}
    assert cut == {k: (sum(x > k for x in lengths), sum(min(x, k) for x in lengths)) for k in cut}
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        text = words(k, rng.randint(5, 60)).split()
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["zzfoul", "zzgrim", "zzvile"]))
        rows.append((k, " ".join(text), "s"))
        labels.append((k, 0, int(toxic)))
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "x", "s")]
    known = spark.createDataFrame(labels + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), known).collect()}
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    held = [r for i, r in got.items() if i in truth and zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(r.held_out for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert got[5000].score == got[5001].score and got[5000].predicted == 0
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def near(text, k):
    parts = text.split()
    parts[k % len(parts)] = f"new{k}"
    return " ".join(parts)


def test_jaccard_classes(spark):
    base = [words(k, 150) for k in range(12)]
    rows = ODD + [(10_000 + 100 * k + j, near(t, 17 * j) if j else t, "s") for k, t in enumerate(base) for j in range(k + 1)] + [(20_000 + k, near(base[0], k), "h") for k in range(150)]
    rows += [(30_000 + k, " ".join(base[5].split()[:k]), "h") for k in range(20, 150)]
    got = {}
    for r in ngram_join.jaccard_classes(docs(spark, rows), tile=16).collect():
        assert got.setdefault(r.doc_id, r) == r
    unique = {i: t for i, t, _ in rows if i is not None}
    sets = {}
    for i, t in unique.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(unique)
    links = {i: [j for j in ids if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in ids}
    for i in ids:
        assert got[i].n_links == len(links[i]), i
    label = {i: i for i in ids}
    for _ in ids:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in ids}
        if new == label:
            break
        label = new
    assert {i: got[i].class_id for i in ids} == label
    assert got[None].class_id is None and got[None].kept
    kept = ngram_join.drop_near_copies(docs(spark, [r for r in rows if r[0] is not None]))
    assert {r.doc_id for r in kept.collect()} == {i for i in ids if label[i] == i}


def test_bands_reach_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.plan_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128


def test_embedding_links(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    extra = base[:60] + rng.normal(scale=0.04, size=(60, 16)) * np.abs(base[:60])
    hot = base[0] + rng.normal(scale=0.02, size=(200, 16))
    x = np.vstack([base, extra, hot, base[5:8]])
    label = [int(k % 2) for k in range(300)] + [int(k % 2) for k in range(60)] + [0] * 200 + [1, 0, 1]
    rows = [(int(i), [float(v) for v in np.float32(e)], int(y)) for i, (e, y) in enumerate(zip(x, label, strict=True))]
    bad = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [None] + [1.0] * 15, 0), (9003, [float("nan")] * 16, 0), (9004, rows[0][1], None), (9005, [], 0), (9006, rows[0][1][:3], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<float>, label int, _cell string")
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(df, tile=32).collect()}
    assert len(got) == len(rows) + len(bad)
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    y = np.array(label)
    linked = (u @ u.T >= 0.98) & (y[:, None] == y[None])
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(len(rows))] == linked.sum(1).tolist()
    lab = np.arange(len(rows))
    while True:
        new = np.array([min([lab[i], *lab[np.flatnonzero(linked[i])]]) for i in range(len(rows))])
        if (new == lab).all():
            break
        lab = new
    assert [got[i].component_id for i in range(len(rows))] == lab.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i, _, _ in bad)


def test_embedding_links_in_few_dimensions(spark):
    rng = np.random.default_rng(5)
    x = np.float32(rng.normal(size=(1500, 5)) @ rng.normal(size=(5, 64))).astype(float)
    df = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_links(df, words=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i] for i in range(len(x))] == ((u @ u.T >= 0.98).sum(1) - 1).tolist()


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, hot):
    base = words(9, 400)
    rng = random.Random(10)
    rows = [(k, words(100 + k, rng.randint(5, 80)) + " " + base[rng.randint(0, 400) :][: rng.randint(20, 900)], "s") for k in range(60)]
    rows += [(900, "a" * 700, "s"), (901, "ab" * 300, "s"), (902, None, "s"), (903, "é" * 120, "s"), (904, base, "s"), (905, base, "s")]
    seen, want = set(), {}
    for i, t, _ in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        kept = bytes(c for c, x in zip(data, gone, strict=True) if not x)
        want[i] = (len(data), sum(gone), sum(x and not (k and gone[k - 1]) for k, x in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.drop_repeats(docs(spark, rows + [rows[3], rows[7], rows[-2], (None, base, "s")]).repartition(5), hot=hot).collect()
    assert len(got) == len(rows) + 4
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    last = [r for r in got if r.doc_id is None]
    assert len(last) == 1 and last[0].n_removed == last[0].n_bytes


def test_suffix_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    data = words(11, 900).encode()
    parts = [p for chunk in suffix_dedup.chunks(iter([(1, 1, data)]), 100) for p in chunk]
    starts = sorted(s for _, _, a, b in parts for s in range(a, a + len(b) - 99))
    assert starts == list(range(len(data) - 99))


def test_url_rules_and_graph(spark):
    rows = [
        (1, "http://a.example.net/en/x?q", None), (2, "https://a.example.net/fr/", ""), (3, "http://B.EXAMPLE.com/de/1#t", ""), (4, "http://x.org/fr/", '<a href="http://good.test/">g</a>'),
        (5, "http://good.test/1", '<a class=x href=http://deep.test>d</a>'), (6, "http://deep.test", ""), (7, "http://linker.test/", '<a href="http://bad.net/">b</a><a href="/own">o</a>'),
        (8, "http://bad.net/", ""), (9, None, None), (10, "no scheme", ""), (11, "http://myexample.net/en/", ""), (12, "http://plain.test?x=://y", ""), (12, "http://plain.test?x=://y", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((tuple(r)[:5] for r in url_filter.url_filter(df).collect()), key=lambda r: r[0])
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.example.net", "/fr/", "net/", "block"), (3, "b.example.com", "/de/1", "example.com/de/", "block"), (4, "x.org", "/fr/", "org/fr/", "allow"),
        (5, "good.test", "/1", None, "allow"), (6, "deep.test", "", None, "allow"), (7, "linker.test", "/", None, "block"), (8, "bad.net", "/", "net/", "block"), (9, "", "", None, "allow"), (10, "", "", None, "allow"),
        (11, "myexample.net", "/en/", "net/", "block"), (12, "plain.test", "", None, "allow"), (12, "plain.test", "", None, "allow"),
    ]


def test_pagerank_matches_power_iteration(spark):
    edges = {("a", "b"): 1.0, ("b", "c"): 0.5, ("b", "a"): 0.5, ("c", "a"): 1.0}
    e = spark.createDataFrame([("trust", a, b, s) for (a, b), s in edges.items()], "kind string, from string, to string, share double")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, weight double")
    got = {r.host: r.score for r in url_filter.propagate(seeds, e).collect()}
    score = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(200):
        score = {h: 0.15 * (h == "a") + 0.85 * sum(score[a] * s for (a, b), s in edges.items() if b == h) for h in score}
    assert got == pytest.approx(score, abs=1e-2)


def test_pagerank_runs_until_it_is_close(spark):
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, weight double")
    edges = spark.createDataFrame([("trust", "a", "b", 1.0), ("trust", "b", "a", 1.0)], "kind string, from string, to string, share double")
    got = {r.host: r.score for r in url_filter.propagate(seeds, edges).collect()}
    assert got == pytest.approx({"a": 0.15 / (1 - 0.85**2), "b": 0.85 * 0.15 / (1 - 0.85**2)}, abs=1e-8)
    with pytest.raises(RuntimeError):
        url_filter.propagate(seeds, edges, rounds=8)


def test_linked_hosts_without_pages_are_seeds(spark):
    df = spark.createDataFrame([(1, "http://linker.test/", '<a href="http://unseen.net/x">u</a>')], "page_id long, url string, html string")
    assert url_filter.url_filter(df).first().verdict == "block"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>"</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">Cookies</div><article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp; three<br>four<p>five<ul><li>x<li>y</ul><div class="ad">Buy</div></article>
<aside>Side</aside><form>Find <input></form><section class="comments"><p>Nice</p></section><footer>&copy;</footer></body></html>"""


def soup(i):
    return f'<html><body><div class="a1"><a href="/1">One</a> <a href="/2">Two</a></div><div class="b1"><div class="c1">Welcome to our site, read every day by many</div><div class="d1"><p>Story number {i} starts like this today.</p><p>It has {i * 7} more parts to it.</p></div></div><div class="e1">All rights reserved by the owners of this site</div></body></html>'


@pytest.mark.parametrize("bound", [32_000_000, 0])
def test_html_extraction(spark, bound):
    rows = [(1, "http://x.test/1", PAGE), (2, "http://x.test/2", None), (3, None, ""), (4, "http://x.test/4", "just text"), (5, "http://x.test/5", "<p>cut <b"), (6, "http://x.test/6", "<div>" * 3000 + "deep")]
    rows += [(100 + k, f"http://soup.test/{k}", soup(k)) for k in range(6)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_text(df, bound=bound).collect()}
    assert got[1].text == "A & B\nOne two three\nfour\nfive\nx\ny"
    assert [got[k].text for k in (2, 3, 4, 5, 6)] == ["", "", "just text", "cut", "deep"]
    for k in range(6):
        assert got[100 + k].text == f"Story number {k} starts like this today.\nIt has {k * 7} more parts to it."
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_template_decides_inside_main(spark):
    def page(i, more=""):
        return f'<main><div><h1>Story {i}</h1><p>Share this line with your friends</p><p>{f"Words of number {i}. " * 9}</p>{more}<div class="box">Written by the staff</div></div></main>'

    table = "<table><tr><td>Only here</table>"
    near = [f"<article><p>Seen on day {i}</p><p>{'The same long report of one page. ' * 5}</p></article>" for i in range(2)]
    rows = [(k, f"http://many.test/{k}", page(k)) for k in range(6)]
    rows += [(10 + k, f"http://many.test/c{k}", page(99, table)) for k in range(2)]
    rows += [(20 + k, f"http://near.test/{k}", h) for k, h in enumerate(near)]
    rows += [(30 + k, f"http://copy.test/{k}", page(7)) for k in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(6):
        assert got[k] == f"Story {k}\n" + (f"Words of number {k}. " * 9).strip()
    for k in range(2):
        assert got[10 + k] == "Story 99\n" + ("Words of number 99. " * 9).strip() + "\nOnly here"
        assert got[20 + k] == f"Seen on day {k}\n" + ("The same long report of one page. " * 5).strip()
        assert got[30 + k] == "Story 7\nShare this line with your friends\n" + ("Words of number 7. " * 9).strip() + "\nWritten by the staff"


def test_html_keeps_all_that_varies(spark):
    def page(i):
        body = f'<h1>Title {i}</h1><p>{f"First part of {i}. " * 20}</p><p>Second {i}</p><ul><li>Item {i}</li><li><a href="/{i}">Linked item {i}</a></li></ul><h2>Part {i}</h2><p>Below {i}</p><table><tr><td>Cell {i}</table><p><a href="/s">Source {i}</a></p>'
        return f'<body><div class="a1"><a href="/">Home</a></div><div class="c1"><div>{body}</div></div><div class="d1">Dated {i}</div><div class="e1">All rights reserved</div></body>'

    rows = [(k, f"http://all.test/{k}", page(k)) for k in range(5)] + [(9, "http://one.test/", page(9))]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = lambda i: "\n".join([f"Title {i}", (f"First part of {i}. " * 20).strip(), f"Second {i}", f"Item {i}", f"Linked item {i}", f"Part {i}", f"Below {i}", f"Cell {i}", f"Source {i}", f"Dated {i}"])
    assert all(got[k] == want(k) for k in range(5))
    assert got[9] == f"Home\n{want(9)}\nAll rights reserved"


def test_html_never_hangs():
    for bad in ("<a" * 20_000, "<" * 20_000, "<!" * 20_000, '<a "' * 20_000, "<p>" * 5_000, "&" * 20_000, "<!--" * 5_000):
        html_extract.main_text(bad, None)


def test_pipeline(spark, sf):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "BPE"]
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in rows.collect()}
    one = corpus_pipeline.not_toxic(spark, rows, sf).cache()
    two = corpus_pipeline.no_copies(spark, one, sf).cache()
    three = corpus_pipeline.no_near_copies(spark, two, sf).cache()
    four = corpus_pipeline.mixed(spark, three, sf).cache()
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    assert len({text[i] for i in ids(one)}) == two.count()
    want = {r.doc_id for r in ngram_join.jaccard_classes(two).where("kept").collect()}
    assert set(ids(three)) == want
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    assert sorted(ids(four)) == sorted(i for i, n in copies.items() for _ in range(n))
    assert one.columns == two.columns == three.columns == four.columns == rows.columns
    got = corpus_pipeline.run(spark, sf)
    assert sorted(ids(got)) == sorted(ids(four))
