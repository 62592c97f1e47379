"""The pipeline against a plain computation, stage by stage, and with awkward tables."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import language_id, packing

R = np.random.RandomState(51)
WORDS = {k: ["".join(R.choice(list(letters), R.randint(3, 9))) for _ in range(800)] for k, letters in (("en", "abcdefghiklmnoprstuwy"), ("de", "äaeefghiklmnnörsßtüuz"))}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, lang="en"):
    return [str(x) for x in np.random.RandomState(seed).choice(WORDS[lang], n)]


def corpus():
    r = np.random.RandomState(52)
    rows = [(i, " ".join(prose(i, int(r.randint(40, 160)), "de" if i % 4 == 0 else "en")), "de" if i % 4 == 0 else "en") for i in range(80)]
    rows += [(100 + i, rows[i * 3][1], "en") for i in range(12)] + [(200 + i, rows[7][1], "en") for i in range(40)]  # copies
    for i in range(15):  # near copies
        words = rows[i * 5][1].split()
        words[int(r.randint(len(words)))] = "changed"
        rows.append((300 + i, " ".join([*words, "tail"]), "en"))
    items = [(k, " ".join(rows[10 + 9 * k][1].split()[5:35])) for k in range(5)] + [(50, " ".join(prose(9999, 30)))]
    rows += [(400, "Россия является крупнейшей страной мира", None), (401, "123 456 789 000 111 222", None), (402, "", None), (403, None, None), (404, "   ", "en")]
    rows += [rows[2], rows[2], (3, rows[20][1], "en"), (None, rows[5][1], "en"), (500, " ".join(prose(777, 30_000)), "en")]
    return [(i, t, lang, f"src{(i or 0) % 3}", len(t) if t else None) for i, t, lang in rows], items


def write(spark, path, rows, items, seed=0):
    order = np.random.RandomState(seed).permutation(len(rows))
    spark.createDataFrame([rows[i] for i in order], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def shingles(text, n):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain(rows, items, accepted):
    """(doc_id, text) of what the first four stages keep."""
    kept = [(i, t) for i, t in rows if (i, t) in accepted]
    least = defaultdict(lambda: None)
    for i, t in kept:
        if i is not None and (least[t] is None or i < least[t]):
            least[t] = i
    kept = [(i, t) for i, t in kept if i is None] + sorted({(i, t) for i, t in kept if i is not None and least[t] == i})
    sets = {t: shingles(t, 3) for _, t in kept}
    texts = sorted(sets)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[texts[a]], sets[texts[b]]
            similar = len(x & y) / len(x | y)
            assert similar < 0.3 or similar > 0.75  # nothing that an estimate could miss
            if similar > 0.75:
                root[find(texts[a])] = find(texts[b])
    first = {}
    for i, t in kept:
        if i is not None:
            first[find(t)] = min(i, first.get(find(t), i))
    kept = [(i, t) for i, t in kept if i is None or first[find(t)] == i]
    wanted = [shingles(t, min(5, len(t.split()))) for _, t in items]
    return [(i, t) for i, t in kept if i is None or not any(len(q & shingles(t, 5)) >= 0.6 * len(q) for q in wanted)]


@pytest.mark.parametrize("seed", [0, 1])
def test_pipeline_equals_plain_computation(spark, tmp_path, seed):
    rows, items = corpus()
    write(spark, tmp_path, rows, items, seed)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labelled = language_id.label(docs, language_id.train(docs)).where("accepted").select("doc_id", "n_words")  # its decisions have tests of their own
    texts = {(i, t) for i, t, *_ in rows if t}
    good = {(r.doc_id, r.n_words) for r in labelled.collect()}
    accepted = {(i, t) for i, t in texts if (i, len(t.split())) in good}
    assert not {400, 401, 402, 403, 404} & {i for i, _ in accepted} and len(accepted) == len(texts) - 3
    want = plain([(i, t) for i, t, *_ in rows], items, accepted)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(want, key=key)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    lengths = defaultdict(int)
    for i, t in want:
        lengths[i] += len(t.split())
    assert sorted(packed.n_tokens.groupby(packed.doc_id.fillna(-1)).sum().items()) == sorted((i if i is not None else -1, n) for i, n in lengths.items())
    bins = packed.groupby(["part", "bin"])
    assert (bins.n_tokens.sum() <= packing.CAPACITY).all()
    sizes = np.sort(packed.n_tokens.to_numpy())[::-1]
    assert packed.groupby("part").bins_in_part.first().sum() == packing.best_fit_decreasing(sizes, packing.CAPACITY)[2]  # one partition: the plain algorithm


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    rows, items = corpus()
    for k, (docs, bench) in enumerate([([], items), (rows[:20], []), ([], [])]):
        path = tmp_path / str(k)
        write(spark, path, docs, bench) if docs else (spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet"), spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet"))
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(path)).collect()} == {i for i, *_ in docs}
    path = tmp_path / "clash"
    write(spark, path, rows, items)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for c in ("d1", "keep_id", "gone_id", "sig", "item_id", "accepted", "row", "t", "key", "shard"):
        docs = docs.withColumn(c, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(path))
        assert got.columns == docs.columns and got.count() > 0
        docs = got
