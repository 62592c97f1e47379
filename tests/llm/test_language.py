"""Language ID: what it accepts and rejects, its decisions against plain loops, and awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id as L

TEXT = {
    "en": "the of and that with from this was are for which have been they their would there about other into could people after first these little where every great again right still think small found those never under might while house world",
    "de": "der die und das nicht mit auch sich von auf eine ist dem werden aus bei nach wie wir aber noch durch mehr zwischen schon vor müssen über können größe straße während jahre haben wurde gegen unter dieser keine",
    "es": "el la los que para con una por como más pero sus este también entre cuando muy sin sobre todo años hasta desde donde quien porque todos durante contra otros ese eso ante ellos otra año señor niño español",
}


@pytest.fixture(scope="module")
def model():
    r = np.random.RandomState(6)
    return L.fit([(k, " ".join(r.choice(t.split(), 24))) for k, t in TEXT.items() for _ in range(120)])


def decide(model, texts):
    tokens = L.words_of(pa.array(texts))
    post = model.label(tokens)
    return L._decide(model, post, tokens), post, tokens


JUNK = [
    "Россия является крупнейшей страной мира по территории", "これは日本語の文章です 今日は天気がいいですね", "한국어 문장은 이렇게 생겼습니다", "中国是世界上人口最多的国家之一", "Ελλάδα είναι μια χώρα στη νοτιοανατολική", "שלום עולם איך אתה היום", "مرحبا بالعالم كيف حالك اليوم", "เมืองไทยมีอากาศร้อน", "😀😀 😂",
    "1234567890 9876543210 555", "a8f7e2c1 09bd77 e1f0a9 deadbeef00 77aa21", "0 1 2 3 4 5 6 7 8 9 10", "zxqv wkjq zzxq kkvb vbnq wxzk qqjx",
]


def test_rejects_what_is_no_known_language(model):
    (_, _, ok), _, _ = decide(model, JUNK)
    assert not ok.any(), [t for t, o in zip(JUNK, ok) if o]


def test_accepts_clean_and_switched_text(model):
    texts = [*TEXT.values(), *[" ".join(t.split()[:4]) for t in TEXT.values()], " ".join(TEXT[k] for k in TEXT), TEXT["en"] + " 4111111111111111 555 0123", TEXT["de"].upper()]
    (best, conf, ok), _, _ = decide(model, texts)
    assert ok.all() and [model.langs[b] for b in best[:6]] == list(TEXT) * 2
    assert conf[6] < L.MIN_CONFIDENCE  # three languages: accepted for its sure words


def test_held_out_rows(model):
    r = np.random.RandomState(7)
    rows = [(k, " ".join(r.choice(t.split(), 8))) for k, t in TEXT.items() for _ in range(100)]
    (best, _, ok), _, _ = decide(model, [t for _, t in rows])
    assert np.mean([model.langs[b] == k for b, (k, _) in zip(best, rows)]) > 0.99 and ok.mean() > 0.99


def test_decisions_equal_plain_loops(model):
    texts = [*JUNK, *TEXT.values(), "", None, "the der la", "the 123 456", "el die of und", "." * 10]
    (best, conf, ok), post, tokens = decide(model, texts)
    und = len(model.langs) - 1
    for i in range(len(texts)):
        rows = post[tokens.bounds[i] : tokens.bounds[i + 1]]
        sums = [sum(float(x[k]) for x in rows) for k in range(und + 1)]
        known = sum(sums[:und])
        if not len(rows) or known < L.MIN_KNOWN * len(rows):
            assert (model.langs[best[i]], conf[i], ok[i]) == ("und", 0, False)
            continue
        share = max(sums[:und]) / known
        sure = sum(1 for x in rows if max(x[:und]) >= L.SURE)
        assert ok[i] == (share >= L.MIN_CONFIDENCE or sure >= L.MIN_SURE * len(rows))
        if sums[und] <= known:
            assert model.langs[best[i]] == model.langs[int(np.argmax(sums[:und]))] and abs(conf[i] - share) < 1e-5


def test_repeated_rows_two_texts_of_an_id_and_clashing_columns(spark, model):
    rows = [(1, TEXT["en"]), (1, TEXT["en"]), (1, TEXT["de"]), (None, TEXT["es"]), (2, JUNK[0]), (3, None), (4, "ÄÖÜ ẞ İ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("accepted", F.lit("clash")).withColumn("words", F.lit(1))
    got = sorted(((r.doc_id or 0, r.lang, r.accepted) for r in L.label(docs, model).collect()))
    assert got[:4] == [(0, "es", True), (1, "de", True), (1, "en", True), (1, "en", True)] and [x[2] for x in got[4:6]] == [False, False]
    kept = L.keep_known_languages(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect() if r.doc_id != 4) == [0, 1, 1, 1]


def test_words_of_labelled_scripts_are_no_noise():
    texts = L.noise(np.random.RandomState(1), [("ru", "привет мир как дела " * 20), ("en", "the of and " * 20)])
    assert not any("а" <= c <= "я" for t in texts for c in t) and any("가" <= c <= "힣" for t in texts for c in t)
