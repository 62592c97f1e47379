"""The whole lexicon against a plain computation in Python, and the rows that op6 must not trip over."""

import math
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import text, toxicity

R = np.random.RandomState(21)
WORDS = ["".join(chr(97 + c) for c in R.randint(0, 26, 5)) for _ in range(220)]
BAD = ["vile", "scum", "rotten", "moronic"]
HIDDEN = ["knave", "cur"]  # never labelled: knave stands by seeds, cur only by knave and its like
BETWEEN = ["dolt", "oaf", "lout"]


def corpus():
    r = np.random.RandomState(22)
    rows, labels = [], {}
    for i in range(500):
        words = list(r.choice(WORDS, 40, p=np.arange(220, 0, -1) / 24310))
        if i % 5 == 0:
            for w in r.choice(BAD, 6):
                words.insert(r.randint(15, 25), w)
            labels[i] = 1
        elif i % 2:
            labels[i] = 0
        if i % 5 == 0 and i % 10 == 0:
            for w in [*BETWEEN, *HIDDEN[:1]]:
                words.insert(r.randint(16, 26), w)
                labels.pop(i, None)
        if i % 5 == 1:
            words[18:18] = [["dolt", "cur", "oaf", "cur", "lout"][k] for k in r.permutation(5)]
            labels.pop(i, None)
        rows.append((i, " ".join(words)))
    return rows, labels


def code(w):
    return int(np.array([text.word_hash(w)], np.uint64).view(np.int64)[0])


def lexicon(rows, labels):
    docs = {i: t.split() for i, t in rows}
    bad_docs, good_docs = ([docs[i] for i, y in labels.items() if y == k] for k in (1, 0))
    a, b = (Counter(w for d in x for w in set(d)) for x in (bad_docs, good_docs))
    n1, n0 = len(bad_docs), len(good_docs)
    z, ratio, most = {}, {}, {}
    for w in a | b:
        u, v = a[w] + 0.5, b[w] + 0.5
        p = (u + v) / (n1 + n0 + 2)
        g = 2 * (u * math.log(u / (p * (n1 + 1))) + v * math.log(v / (p * (n0 + 1))))
        odds, err = math.log(u / (n1 + 1)) - math.log(v / (n0 + 1)), math.sqrt(1 / u + 1 / v)
        z[w], ratio[w], most[w] = math.copysign(math.sqrt(max(g, 0)), odds), odds - err, odds + err
    least = NormalDist().inv_cdf(1 - toxicity.SEED_ERROR / len(a))
    bad = sorted((w for w in z if z[w] >= least and ratio[w] >= math.log(toxicity.SEED_RATIO)), key=lambda w: code(w) & (2**64 - 1))

    def near(texts, hubs, bits=None):
        joint = defaultdict(Counter)
        for d in texts:
            for i, s in enumerate(d):
                if s in hubs:
                    for j in range(max(0, i - toxicity.WINDOW), min(len(d), i + toxicity.WINDOW + 1)):
                        if i != j:
                            joint[s][d[j]] += 1
                            if bits is not None:
                                a, b = min(i, j) - 1, max(i, j) + 1
                                sides = [np.array([text.word_hash(d[k]) if 0 <= k < len(d) else 0], np.uint64) for k in (a, b)]
                                bits[s, d[j]] |= int(toxicity.context_bits(*sides)[0])
        return joint

    even = {w for w in a if abs(z[w]) < 1}
    good = set()
    for s, c in near(bad_docs, set(bad)).items():
        good |= set(sorted((w for w in c if w in even), key=lambda w: (-c[w], code(w)))[: toxicity.BESIDE])
    count = Counter(w for d in docs.values() for w in d)
    total = sum(count.values())
    veto = {w for w in most if most[w] < math.log(toxicity.SEED_RATIO)}
    hubs, toxic_hubs, out = [*bad, *sorted(good)], set(bad), {}
    for hop in range(toxicity.HOPS):
        edge = {}
        bits = defaultdict(int)
        for s, c in near(docs.values(), set(hubs), bits).items():
            for w, n in c.items():
                if n >= 3 and bits[s, w].bit_count() >= 3:
                    x = math.log((math.sqrt(n) - 1) ** 2 / (count[s] * count[w] * 2 * toxicity.WINDOW / total + 1))
                    if x > 0:
                        edge[s, w] = x
        names = sorted({w for _, w in edge})
        m = np.zeros((len(hubs), len(names)))
        for (s, w), x in edge.items():
            m[hubs.index(s), names.index(w)] = x
        go = m / np.maximum(m.sum(1, keepdims=True), 1e-12)
        back = (m / np.maximum(m.sum(0), 1e-12)).T
        visit = []
        for pole in (bad, good):
            start = np.array([1 / len(pole) if h in pole else 0 for h in hubs])
            stay = toxicity.RESTART * start @ np.linalg.inv(np.eye(len(hubs)) - (1 - toxicity.RESTART) * go @ back)
            visit.append(stay @ go)
        enough = [sum(1 for s in toxic_hubs if (s, w) in edge) >= min(toxicity.NEAR, len(bad)) or w in bad or visit[0][k] <= visit[1][k] for k, w in enumerate(names)]
        out = {w: (visit[0][k] - visit[1][k]) / (visit[0][k] + visit[1][k]) for k, w in enumerate(names) if enough[k] and visit[0][k] + visit[1][k] > 0}
        fresh = [w for w in out if out[w] >= toxicity.LEXICON and w not in veto and w not in hubs]
        if not fresh or hop + 1 == toxicity.HOPS:
            break
        hubs, toxic_hubs = hubs + fresh, toxic_hubs | set(fresh)
    found = {w: p for w, p in out.items() if p >= toxicity.LEXICON and w not in veto}
    for w in bad:
        found[w] = max(found.get(w, 0), (math.exp(ratio[w]) - 1) / (math.exp(ratio[w]) + 1))
    return found


def test_lexicon_equals_brute_force(spark):
    rows, labels = corpus()
    frame = lambda ids: spark.createDataFrame([(t,) for i, t in rows if i in ids], "t string")
    want = {code(w): p for w, p in lexicon(rows, labels).items()}
    got = {r.w: r.polarity for r in toxicity.lexicon_of(frame(dict(rows)), frame({i for i, y in labels.items() if y}), frame({i for i, y in labels.items() if not y})).collect()}
    assert set(got) == set(want) and max(abs(got[w] - want[w]) for w in want) < 0.01
    assert {code(w) for w in BAD} <= set(got)
    assert code("knave") in got and code("cur") in got  # cur is reached through words that are no seeds


def test_copies_make_no_edges(spark):
    """Words of one copied toxic passage aren't toxic, however often it is copied."""
    rows, labels = corpus()
    passage = " ".join([*WORDS[:3], "quiet", "vile", "calm", "scum", "gentle", "rotten", "moronic", "meadow", *WORDS[5:9]])
    rows += [(1000 + k, passage) for k in range(60)]
    frame = lambda ids: spark.createDataFrame([(t,) for i, t in rows if i in ids], "t string")
    got = {r.w for r in toxicity.lexicon_of(frame(dict(rows)), frame({i for i, y in labels.items() if y}), frame({i for i, y in labels.items() if not y})).collect()}
    assert {code(w) for w in BAD} <= got and not {code(w) for w in ("quiet", "calm", "gentle", "meadow")} & got


def test_one_hop_misses_what_no_seed_is_near(spark):
    rows, labels = corpus()
    bad = np.array([text.word_hash(w) for w in BAD], np.uint64)
    good = np.array([text.word_hash(w) for w in WORDS[:20]], np.uint64)
    texts = spark.createDataFrame([(t,) for _, t in rows], "t string")
    one, two = ({r.w for r in toxicity.induce(texts, (bad, good), hops=k).where("polarity >= 0.5").collect()} for k in (1, 2))
    assert code("cur") not in one and code("cur") in two


def test_repeated_rows_ties_and_ids(spark):
    """Repeated rows score alike, two texts of one id are scored each, and the order of rows is of no account."""
    rows, labels = corpus()
    rows = [*rows, rows[0], (0, "vile scum rotten words"), (0, "plain"), (None, "vile scum rotten"), (900, None), (901, " .,")]
    marks = spark.createDataFrame([*labels.items(), (0, 1), (0, 0)], "doc_id long, toxic int")
    results = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("toxic", F.lit("clash")).repartition(3)
        results.append(sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.terms, r.toxic) for r in toxicity.score_documents(docs, marks).collect())))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    own = [x for x in results[0] if not x[0] and x[1] == 0]
    assert len(own) == 4 and sum(x[4] for x in own) >= 2 and [x[2:] for x in results[0] if x[1] in (900, 901)] == [(0.0, 0, False)] * 2


def test_unfolds_until_nothing_new_is_found(spark):
    """Each group of words stands only by the one before it; the last is four steps from the seeds."""
    r = np.random.RandomState(23)
    groups = [BAD[:3], BETWEEN, ["cad", "boor", "churl"], ["swine", "wretch", "lummox"], ["toad", "vermin", "blackguard"]]
    rows = []
    for i in range(600):
        words = list(r.choice(WORDS, 40))
        if i % 3:
            one = i % 4
            words[15:25] = r.permutation([*groups[one], *groups[one + 1], *r.choice(WORDS, 3)])
        rows.append(" ".join(words))
    bad, good = (np.array([text.word_hash(w) for w in x], np.uint64) for x in (groups[0], WORDS[:20]))
    texts = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {r.w for r in toxicity.induce(texts, (bad, good)).where(F.col("polarity") >= toxicity.LEXICON).collect()}
    assert [w for g in groups for w in g if code(w) not in got] == [] and not {code(w) for w in WORDS} & got


def test_three_contexts_of_one_bit_make_an_edge(spark):
    """Contexts that share a bit of the mask are still told apart, and two contexts are still too few."""
    of = lambda w: np.array([text.word_hash(w)], np.uint64)
    sides = {}
    for i in range(400):
        sides.setdefault(int(toxicity.context_bits(of(f"l{i}"), of(f"r{i}"))[0]), []).append(i)
    same = max(sides.values(), key=len)[:3]
    assert len(same) == 3
    r = np.random.RandomState(24)
    rows = [" ".join(r.choice(WORDS, 40)) for _ in range(200)]
    rows += [f"l{i} vile knave r{i}" for i in same for _ in range(10)] + [f"l{i} vile cur r{i}" for i in same[:2] for _ in range(15)]
    texts = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {r.w: r.polarity for r in toxicity.induce(texts, (of("vile"), of(WORDS[0]))).collect()}
    assert got.get(code("knave"), 0) >= toxicity.LEXICON and code("cur") not in got
