"""The numpy parts of the operators against brute force."""

import itertools
import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import crf, decontaminate, language_id, licenses, near_dedup, packing, pii, suffix_dedup, toxicity, url_filter
from graphloom.llm.exact_dedup import BinaryFuse16
from graphloom.llm.suffix_array import suffix_array
from graphloom.llm.text import Tokens, chunks, ngrams, shingles


def test_tokens():
    t = Tokens(pa.array(["ab c-é9", None, "", "zz", "xab"]))
    assert t.counts.tolist() == [3, 0, 0, 1, 1] and t.words(0, 5) == [b"ab", b"c", "é9".encode(), b"zz", b"xab"]
    one = Tokens(pa.array(["ab"]))
    assert t.hashes[0] == one.hashes[0] and len(set(t.hashes.tolist())) == 5
    h, b = shingles(t, 3)
    assert b.tolist() == [0, 1, 1, 1, 2, 3] and h[0] == ngrams(t.hashes[:3], 3)[0]
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 50, None, "b" * 500, "", "c"]})
    parts = list(chunks(iter([batch]), "t", 100))
    assert [p.num_rows for p in parts] == [2, 1, 2] and sum(p.num_rows for p in parts) == 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(s):
    assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=15), min_size=1, max_size=8))
def test_repeats(docs):
    k = 3
    words = [np.array(d, np.uint32) for d in docs]
    ids = np.arange(len(docs))
    seg, at, least = suffix_dedup.repeats(words, ids, ids, k)
    where = {}
    for i, d in enumerate(docs):
        for j in range(len(d) - k + 1):
            where.setdefault(tuple(d[j : j + k]), set()).add(i)
    want = {(i, j, min(where[tuple(d[j : j + k])])) for i, d in enumerate(docs) for j in range(len(d) - k + 1) if len(where[tuple(d[j : j + k])]) > 1}
    assert set(zip(seg.tolist(), at.tolist(), least.tolist())) == want


def test_window_min():
    x = np.random.RandomState(0).randint(0, 99, 137).astype(np.uint64)
    for w in (1, 5, 43, 137, 138):
        assert suffix_dedup.window_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_crf():
    r = np.random.RandomState(0)
    counts, S = np.array([3, 0, 1, 4]), 3
    em, start, tr = r.randn(8, S), r.randn(S), r.randn(S, S)
    gamma, best, o = crf.marginals(em, counts, start, tr), crf.viterbi(em, counts, start, tr), 0
    for n in counts.tolist():
        total, z, top = np.zeros((n, S)), 0.0, (-1e9, ())
        for path in itertools.product(range(S), repeat=n):
            score = start[path[0]] + sum(em[o + i, p] for i, p in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:])) if n else 0
            z += math.exp(score)
            for i, p in enumerate(path):
                total[i, p] += math.exp(score)
            top = max(top, (score, path))
        if n:
            assert np.allclose(total / z, gamma[o : o + n]) and best[o : o + n].tolist() == list(top[1])
        o += n


def test_fuse_filter():
    r = np.random.RandomState(1)
    for n in (0, 1, 2, 3, 50, 5000, 60_000):
        keys = r.randint(0, 2**63, n).astype(np.uint64)
        f = BinaryFuse16.build(np.concatenate([keys, keys[: n // 2]]))
        assert f.contains(keys).all()
        assert f.contains(r.randint(0, 2**63, 100_000).astype(np.uint64)).mean() < 1e-3
        assert n < 5000 or len(f.cells) < 1.35 * n


def test_minhash_and_odd_sketch():
    r = np.random.RandomState(2)
    base = r.randint(0, 2**63, 4000).astype(np.uint64)
    errors = []
    for share in (0.98, 0.9, 0.8, 0.6):
        k = int(len(base) * share)
        a, b = base, np.concatenate([base[:k], r.randint(0, 2**63, len(base) - k).astype(np.uint64)])
        samples = near_dedup.minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        sketch = near_dedup.odd_sketch(samples)
        true = k / (2 * len(base) - k)
        errors.append(abs(near_dedup.similarity(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) - true))
    assert max(errors) < 0.17 and np.mean(errors) < 0.08
    assert near_dedup.most_bits(0.55) > near_dedup.most_bits(0.9) >= 0


def test_link_is_exact():
    r = np.random.RandomState(3)
    s = r.randint(0, 4, (60, 2)).astype(np.uint64)
    a, b = near_dedup.link(s, 1)
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(60), 2):
        if np.bitwise_count(s[i] ^ s[j]).sum() <= 1:
            parent[find(i)] = find(j)
    want = {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)}
    parent = list(range(60))
    for i, j in zip(a.tolist(), b.tolist()):
        parent[find(i)] = find(j)
    assert {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_packing_bounds(sizes):
    """Lower bound <= optimum <= best fit decreasing, by exhaustive search."""
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    bins, offsets, made = packing.best_fit_decreasing(sizes, 20)
    for b in range(made):
        spans = sorted((o, o + s) for o, s, x in zip(offsets, sizes, bins) if x == b)
        assert spans[0][0] == 0 and spans[-1][1] <= 20 and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))

    def best(left, rooms):
        if not left:
            return len(rooms)
        tried, least = set(), best(left[1:], [*rooms, 20 - left[0]])
        for i, r in enumerate(rooms):
            if r >= left[0] and r not in tried:
                tried.add(r)
                least = min(least, best(left[1:], [*rooms[:i], r - left[0], *rooms[i + 1 :]]))
        return least

    optimum = best(sizes.tolist()[:7], [])
    if len(sizes) <= 7:
        assert packing.lower_bound(sizes, 20) <= optimum <= made
    assert packing.lower_bound(sizes, 20) <= made


def test_dual_feasible_functions_beat_the_sum():
    assert packing.lower_bound(np.full(10, 11), 20) == 10 and packing.lower_bound(np.full(9, 7), 20) == 5


def test_containment_search_recall():
    r = np.random.RandomState(4)
    word = lambda: "".join(chr(97 + c) for c in r.randint(0, 26, 5))
    items = [(k, " ".join(word() for _ in range(r.randint(6, 60)))) for k in range(120)] + [(999, "just two"), (1000, "")]
    index = decontaminate.Index(items)
    docs, want = [], set()
    for k, (item, text) in enumerate(items[:120]):
        words = text.split()
        if k % 3 == 2 and len(words) > 30:
            words[len(words) // 2] = "changed"  # still above the threshold
        long = [word() for _ in range(r.randint(0, 4000))]
        at = r.randint(0, len(long) + 1)
        docs.append(" ".join(long[:at] + words + long[at:]))
        want.add((k, item))
    docs += ["it is just two words", " ".join(word() for _ in range(3000)), ""]
    want.add((120, 999))
    got = {(d, i) for d, i, _, _ in index.matches(Tokens(pa.array(docs)))}
    shingle = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    brute = set()
    for d, t in enumerate(docs):
        for i, text in items[:121]:
            q = shingle(text.split(), min(5, len(text.split())))
            if q and len(q & shingle(t.split(), min(5, len(text.split())))) >= 0.6 * len(q):
                brute.add((d, i))
    assert want <= brute and got <= brute and len(got) >= 0.97 * len(brute)


def test_license_index_equals_search():
    texts = ["x released under the mit license y", "mit licence", "gnu general public license version 3", "licensed under cc by nc 4 0 and apache license version 2 0 mit license", "the gnu general public license as published by the free software foundation either version 2 of the license", None, "", "license mit license mit"]
    index = licenses.Index({"license": 9, "the": 99})
    got = index.find(Tokens(pa.array(texts)))
    assert got == [(0, "MIT", 4), (2, "GPL-3.0", 0), (3, "Apache-2.0", 8), (3, "CC-BY-NC-4.0", 2), (3, "MIT", 13), (4, "GPL-2.0", 1), (7, "MIT", 1)]


def test_pii_on_held_out_rows():
    model = pii.train()
    rows = pii.labelled_rows(200, seed=77)
    tokens = Tokens(pa.array([" ".join(t) for t, _ in rows]), by_space=True)
    truth = np.concatenate([np.array(t) for _, t in rows])
    got = pii.decode(model, tokens)
    assert (got == truth).mean() > 0.99
    texts = ["é mail bob.77@mail3.example.com, now", None, "", "call +1 (743) 555-3824 or 152.143.123.131!!", 'token = "' + "a1b2c3d4e5" * 4 + '"###', "plain words only 2024 3.5", "4845168114407329 " * 2]
    found = list(pii.find(model, pa.array(texts)))
    assert [(r, k, v) for r, k, _, _, v in found] == [(0, "email", "bob.77@mail3.example.com"), (3, "phone", "+1 (743) 555-3824"), (3, "ip", "152.143.123.131"), (4, "secret", "a1b2c3d4e5" * 4), (6, "card", "4845168114407329"), (6, "card", "4845168114407329")]
    assert all(texts[r][a : a + n] == v for r, _, a, n, v in found)


def test_urls_on_held_out_rows():
    f = url_filter.default_filter()
    rows = url_filter.labelled_urls(500, seed=123)
    assert np.mean((f.score([u for u, _ in rows]) >= 0.5) == np.array([y for _, y in rows])) > 0.95
    assert f.score(["http://www.cheap-pills.example.com/en/450", "https://therha.example.com/en/676"]).round().tolist() == [1, 0]
    assert url_filter.split("HTTP://u@Host.Example.com:80/a/b?x=1&y#z") == ("http", "host.example.com", "/a/b", "x=1&y") and url_filter.split("")[1] == ""
    assert np.isfinite(f.score(["?", "mailto:x", "é" * 5000, "http://[::1]/"])).all()


LANGS = {"en": "the of and that with from this was are for", "de": "der die und das nicht mit auch sich von auf", "es": "el la los que para con una por como más"}


def test_language_of_switched_text():
    r = np.random.RandomState(6)
    make = lambda lang, n: " ".join(r.choice(LANGS[lang].split(), n))
    model = language_id.fit([(k, make(k, 20)) for k in LANGS for _ in range(60)])
    text = make("en", 15) + " " + make("de", 15)
    tokens = Tokens(pa.array([text, "", "12 345 6"]))
    post = model.label(tokens)
    word = [model.langs[i] for i in post.argmax(1)]
    assert word[:13] == ["en"] * 13 and word[17:30] == ["de"] * 13
    best, conf, ok = language_id._decide(model, post, tokens)
    assert ok.tolist() == [True, False, False] and model.langs[best[1]] == "und" and conf[1] == 0
    none = language_id.fit([])
    assert language_id._decide(none, none.label(tokens), tokens)[2].tolist() == [False] * 3


def test_walk_is_the_fixed_point():
    step = np.array([[0.2, 0.5], [0.1, 0.3]])
    start = np.array([1.0, 0.0])
    want = toxicity.RESTART * start @ np.linalg.inv(np.eye(2) - (1 - toxicity.RESTART) * step)
    assert np.allclose(toxicity.walk(step, start), want)


def test_counter_merges():
    c = toxicity.Counter(1, most=4)
    for _ in range(3):
        c.add(np.array([1, 1, 2], np.uint64), np.ones(3))
        c.full()
    keys, (n,) = c.merged()
    assert keys.tolist() == [1, 2] and n.tolist() == [6, 3]


