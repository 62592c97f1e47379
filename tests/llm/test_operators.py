"""The operators in Spark: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, exact_dedup, language_id, licenses, near_dedup, packing, pii, suffix_dedup, text, toxicity, url_filter

R = np.random.RandomState(0)
WORDS = ["".join(chr(97 + c) for c in R.randint(0, 26, 5)) for _ in range(3000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> list[str]:
    return [WORDS[i] for i in np.random.RandomState(seed).randint(0, len(WORDS), n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def hard(spark):
    """Every awkward case at once, with columns named like the operators' own."""
    long = " ".join(prose(1, 60_000))
    rows = [(1, None), (2, ""), (3, ""), (None, "lost " * 60), (4, "  .,!  "), (5, "one"), (6, "one"), (6, "one"), (7, long), (8, long + " end"), (9, "é" * 30_000), (None, None), (10, "one two")]
    df = frame(spark, rows)
    for c in ("t", "d1", "shard", "keep_id", "sig", "bucket", "anchor", "item_id", "bin", "part", "toxic", "score", "__t"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_exact(hard, none):
    assert pairs(exact_dedup.exact_duplicates(hard), "doc_id", "keep_id", "found") == [(3, 2, "archive"), (6, 5, "archive")]
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(hard)
    assert kept.columns == hard.columns and sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 4, 5, 7, 8, 9, 10]
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def test_exact_against_brute_force(spark):
    r = np.random.RandomState(3)
    rows = [(i, f"text {r.randint(0, 120)}") for i in range(400)]
    first = {}
    want = [(i, first.setdefault(t, i)) for i, t in rows]
    got = exact_dedup.exact_duplicates(frame(spark, rows), keys_per_shard=40)  # several shards
    assert pairs(got, "doc_id", "keep_id") == sorted(x for x in want if x[0] != x[1])
    kept = exact_dedup.drop_exact_duplicates(frame(spark, [*rows, (7, "text other"), rows[0], rows[0]]))
    assert sorted(r.text for r in kept.collect()) == sorted({t for _, t in rows} | {"text other"})


def test_near(hard, none, spark):
    assert pairs(near_dedup.near_duplicates(hard), "doc_id", "keep_id") == [(6, 5), (8, 7)]
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0
    kept = near_dedup.drop_near_duplicates(hard)
    assert kept.columns == hard.columns and sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 9, 10]


def test_near_against_brute_force(spark):
    rows, r = [], np.random.RandomState(5)
    for k in range(60):
        base = prose(100 + k, int(r.randint(40, 400)))
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for i in r.randint(0, len(copy), max(1, len(copy) // 50)):
                copy[i] = WORDS[r.randint(0, len(WORDS))]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, rows[0][1]) for k in range(300)]  # many copies
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    similar = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.65 * len(sets[i] | sets[j])}
    group = {r.doc_id: r.keep_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    found = {(i, j) for i, j in similar if group.get(i, i) == group.get(j, j)}
    assert len(found) >= 0.97 * len(similar)
    assert all(len(sets[i] & sets[k]) > 0.3 * len(sets[i] | sets[k]) for i, k in group.items())  # nothing unrelated


def test_repeats(hard, none, spark):
    assert pairs(suffix_dedup.repeated_passages(hard), "doc_id", "first_word", "n_words", "origin") == [(7, 0, 60_000, 7), (8, 0, 60_000, 7)]
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_repeats_against_brute_force(spark):
    r = np.random.RandomState(8)
    shared = [prose(500 + k, int(r.randint(45, 90))) for k in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            words += prose(1000 + 10 * i + len(words), int(r.randint(0, 80)))
            words += shared[r.randint(0, 6)][r.randint(0, 5) :]
        rows.append((i, " ".join(words)))
    rows += [(90, "aa " * 120), (91, "aa " * 70), (92, "bb cc " * 60)]  # repeats of themselves
    where = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = []
    for i, t in rows:
        w = t.split()
        at = [k for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1]
        for k in at:
            origin = min(where[tuple(w[k : k + 50])])
            if want and want[-1][0] == i and want[-1][1] + want[-1][2] >= k:
                want[-1] = (i, want[-1][1], k + 50 - want[-1][1], min(origin, want[-1][3]))
            else:
                want.append((i, k, 50, origin))
    assert pairs(suffix_dedup.repeated_passages(frame(spark, rows)), "doc_id", "first_word", "n_words", "origin") == sorted(want)


def test_decontaminate(hard, none, spark):
    item = " ".join(prose(1, 60_000)[31_000:31_030])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one"), (5, item), (5, item), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = decontaminate.contaminated(hard, bench)
    assert pairs(found.where("item_id IS NULL"), "doc_id", "containment") == [(7, 1.0), (8, 1.0)]
    got = pairs(found.where("item_id IS NOT NULL"), "doc_id", "item_id", "containment")
    assert got == [(5, 4, 1.0), (6, 4, 1.0), (7, 1, 1.0), (7, 5, 1.0), (8, 1, 1.0), (8, 5, 1.0), (10, 4, 1.0)]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(hard, bench.where("false")).count() == 0
    kept = decontaminate.drop_contaminated(hard, bench)
    assert kept.columns == hard.columns and sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 9]


def test_large_benchmark_in_slices(hard, spark, monkeypatch):
    item = " ".join(prose(1, 60_000)[100:140])
    bench = spark.createDataFrame([(k, item if k == 3 else " ".join(prose(9000 + k, 20))) for k in range(10)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 4)
    assert pairs(decontaminate.contaminated(hard, bench), "doc_id", "item_id") == [(7, 3), (8, 3)]


def test_language(hard, none, spark):
    train = spark.createDataFrame([(k, " ".join(prose(k, 40)) if k % 2 else "über straße größe mädchen fürs " * 8, "xx" if k % 2 else "de") for k in range(60)] + [(70, None, "de"), (71, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(train)
    got = {r.doc_id: r for r in language_id.label(hard.where("doc_id IS NOT NULL"), model).collect()}
    assert got[7].lang == "xx" and got[7].accepted and got[7].n_words == 60_000 and sum(s.words for s in got[7].spans) == 60_000
    assert [(got[i].lang, got[i].accepted, got[i].spans) for i in (1, 2, 4)] == [("und", False, [])] * 3
    kept = language_id.keep_known_languages(hard, model)
    assert kept.columns == hard.columns and {7, 8} <= {r.doc_id for r in kept.collect()} and not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()}
    assert language_id.label(none, language_id.train(none)).count() == 0 and language_id.keep_known_languages(none, model).count() == 0
    assert not any(r.accepted for r in language_id.label(hard, language_id.train(none)).collect())


def test_packing(hard, none, spark):
    got = packing.pack(hard, capacity=1000).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {None, 4, 5, 6, 7, 8, 9, 10} and len(by_doc[6]) == 2 and len(by_doc[8]) == 61
    assert packing.pack(none).count() == 0


def test_packing_in_partitions(spark):
    r = np.random.RandomState(11)
    rows = [(i, "w " * int(n)) for i, n in enumerate(r.randint(1, 90, 900))]
    got = packing.pack(frame(spark, rows), capacity=64, pieces_per_partition=100).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: t.count("w") for i, t in rows}
    bins = got.sort_values(["part", "bin", "bin_offset"]).groupby(["part", "bin"])
    assert (bins.n_tokens.sum() <= 64).all() and (got.bin_offset == bins.n_tokens.cumsum().loc[got.index] - got.n_tokens).all()
    parts = got.groupby("part")
    assert (parts.bin.nunique() == parts.bins_in_part.first()).all() and (parts.lower_bound.first() <= parts.bins_in_part.first()).all()
    assert parts.bins_in_part.first().sum() <= 1.03 * -(-got.n_tokens.sum() // 64)


def test_licenses(hard, none, spark):
    assert licenses.scan(hard).count() == 0 and licenses.scan(none).count() == 0
    text = "word " * 50_000 + "Released under the MIT License. " * 2
    assert pairs(licenses.scan(frame(spark, [(1, text), (1, text), (None, text)]).where("doc_id = 1")), "doc_id", "license", "first_word") == [(1, "MIT", 50_003)] * 2


def test_pii(hard, none, spark):
    assert pii.personal_data(none).count() == 0 and {r.kind for r in pii.personal_data(hard).collect()} == set()
    mail = "bob.12@mail1.example.com"
    got = pii.personal_data(frame(spark, [(1, "word " * 40_000 + mail), (2, f"{mail} {mail}"), (None, mail)])).collect()
    assert sorted((r.doc_id or 0, r.first_char) for r in got) == [(0, 0), (1, 200_000), (2, 0), (2, 25)] and {r.value for r in got} == {mail}


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "http://cheap-pills.example.com/en/4", "x"), (3, "http://cheap-pills.example.com/en/4", "x"), (4, "https://therha.example.com/en/676", None), (5, "no scheme", ""), (None, "x" * 100_000, "")], "page_id long, url string, score string")
    got = url_filter.score_urls(pages).collect()
    assert sorted((r.page_id or 0, r.blocked) for r in got if r.page_id in (1, 2, 3, 4)) == [(1, False), (2, False), (3, True), (3, True), (4, False)] and len(got) == 7
    assert url_filter.score_urls(pages.where("false")).count() == 0


def test_toxicity(hard, none, spark):
    r = np.random.RandomState(12)
    bad, rows, marks = ["vile", "scumbag", "moronic", "rotten"], [], []
    for i in range(300):
        words = list(r.choice(WORDS[:150], 60))
        toxic = i % 6 == 0
        if toxic:
            for w in r.choice(bad, 6):
                words.insert(r.randint(20, 40), w)
        rows.append((100 + i, " ".join(words)))
        if i % 2 == 0:
            marks.append((100 + i, int(toxic)))
    labels = spark.createDataFrame([*marks, (100, 1), (99999, 1), (None, 1), (102, None)], "doc_id long, toxic int")
    docs = hard.select("doc_id", "text", "toxic", "score").unionByName(frame(spark, rows), allowMissingColumns=True)
    got = {r.doc_id: r.toxic for r in toxicity.score_documents(docs, labels).collect() if r.doc_id}
    assert {i for i, t in got.items() if t} == {100 + i for i in range(0, 300, 6)}
    assert not any(r.toxic for r in toxicity.score_documents(docs, labels.where("false")).collect())
    assert toxicity.score_documents(none, labels).count() == 0


def hashes(*words):
    return np.array([text.word_hash(w) for w in words], np.uint64)


def test_toxicity_rare_neighbours(spark):
    """A neighbour in less than 1/5000 of its seed's joint occurrences takes part."""
    r = np.random.RandomState(13)
    rows = [" ".join([*r.choice(WORDS, 5), "vile", *r.choice(WORDS, 5), "the", *r.choice(WORDS, 5)]) for _ in range(8000)]
    rows += [f"{a} scum vile {b}" for a, b in r.choice(WORDS, (14, 2))] + [" ".join(r.choice(WORDS, 1000)) for _ in range(400)]
    got = {x.w: x.polarity for x in toxicity.induce(spark.createDataFrame([(t,) for t in rows], "t string"), (hashes("vile"), hashes("the"))).collect()}
    assert got[int(hashes("scum").view(np.int64)[0])] > 0


def test_toxicity_rare_seeds(spark):
    """An insult in 15 % of the toxic documents is a seed beside one in 90 %; a word of clean documents isn't."""
    r = np.random.RandomState(14)
    texts = [r.choice(WORDS[:150], 60).tolist() for _ in range(1000)]
    toxic = [" ".join(w + ["vile"] * (i % 10 > 0) + ["scum"] * (i % 20 < 3) + ["often"] * (i % 3 > 0)) for i, w in enumerate(texts[:200])]
    clean = [" ".join(w + ["often"] * (i % 4 == 0)) for i, w in enumerate(texts[200:])]
    bad, good = toxicity.find_seeds(*(spark.createDataFrame([(t,) for t in x], "t string") for x in (toxic, clean)))
    assert set(bad.tolist()) == set(hashes("vile", "scum").tolist()) and len(good)


@pytest.mark.parametrize("size", [20, 400])
def test_toxicity_many_induced(spark, size):
    """Words near toxic seeds are found however many there are, and the seeds stay as polar."""
    r = np.random.RandomState(15)
    held = [f"insult{i}" for i in range(size)]
    rows = [f"{a} {w} vile scum rotten {b}" for w in held for a, b in r.choice(WORDS, (12, 2))]
    rows += [" ".join(w for x in r.choice(WORDS, 900) for w in (x, "the")[: 1 + (x < "f")]) for _ in range(2 * size)]
    got = {x.w: x.polarity for x in toxicity.induce(spark.createDataFrame([(t,) for t in rows], "t string"), (hashes("vile", "scum", "rotten"), hashes("the"))).collect()}
    assert min(got.get(int(w), 0) for w in hashes(*held, "vile", "scum", "rotten").view(np.int64)) >= toxicity.LEXICON


def test_pipeline(spark, hard, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(prose(3000 + i, 120)), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)] + [(200, rows[9][1] + " more", "en", "s", 1), (201, "", "en", "s", 1), (202, None, None, None, None)]
    item = " ".join(rows[20][1].split()[30:60])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == set(range(40)) - {20}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_registered():
    import __spark_entry__ as e

    names = [q for q in e.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
