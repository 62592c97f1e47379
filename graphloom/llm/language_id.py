"""Word-level language identification with a linear-chain conditional random field.

Every word has affix, character n-gram and lexicon features (hashed); transitions
between languages are learned from code-switched training sequences, and words are
labelled by forward-backward. A document's language is the one with the largest sum of
word posteriors; words of no language ('und') take no part in its confidence.

A document is accepted if at least MIN_KNOWN of its words' posterior is of languages and
either one language has MIN_CONFIDENCE of that or, for code-switched text, at least
MIN_SURE of its words are of some language with a posterior of SURE or more. All else
(other scripts, numbers, codes, random letters, text that looks a little like several
languages) is rejected.

Training reads a bounded sample of labelled rows: DOCS_PER_LANG documents of each
language, WINDOWS spans of SPAN words from each. Besides the languages there is the
state 'und' for words that are no language: it is trained on numbers, random letters,
codes, and words of the scripts that the labelled rows don't use.

Letters are lower-cased by Arrow's rule in training, labelling and filtering alike.

Defined results: a document without words (null, empty, punctuation only) is 'und' with
confidence 0 and isn't accepted; a null label is no training row; without any label
every document is 'und'; repeated rows are labelled each; two texts of one doc_id are
labelled each; ties go to the language that is first in alphabetical order; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import crf
from .tables import read, with_ids
from .text import Tokens, chunks, mix, span_hashes

DOCS_PER_LANG = 250
WINDOWS = 3
SPAN = 24
BUCKETS = 1 << 16
#: The least share of the words' posterior that must be of languages, and of that the least share of the best one.
MIN_KNOWN = 0.5
MIN_CONFIDENCE = 0.5
#: Instead of the second: this share of the words must be of some language with this posterior.
MIN_SURE = 0.5
SURE = 0.8
#: First and last character of the letters from which words of other scripts are drawn for 'und'.
SCRIPTS = [(0x430, 0x44F), (0x3B1, 0x3C9), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x985, 0x9B9), (0xB85, 0xBB9), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x1200, 0x1357), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x2010, 0x2044), (0x2190, 0x27BF), (0x1F300, 0x1F6FF)]


#: A bit for each kind of byte that begins a character: letters, digits, then the scripts by lead byte.
_SCRIPT = np.zeros(256, np.uint32)
for _bit, (_lo, _hi) in enumerate([(97, 122), (48, 57), (0xC2, 0xC3), (0xC4, 0xC5), (0xC6, 0xCD), (0xCE, 0xCF), (0xD0, 0xD3), (0xD4, 0xD5), (0xD6, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE1), (0xE2, 0xE2), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED), (0xEE, 0xEF), (0xF0, 0xF4)]):
    _SCRIPT[_lo : _hi + 1] = 1 << _bit


def words_of(column: pa.Array) -> Tokens:
    """The words of a text column in lower case."""
    return Tokens(pc.utf8_lower(column))


def _features(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Trigram features of all bytes with each token's first, and the per-token features: prefixes, suffixes, whole word, and which scripts the word has."""
    s, e, data = tokens.starts, tokens.ends, tokens.data
    n = e - s
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(s - first[:-1], n) + np.arange(first[-1])
    mid = data[at].astype(np.uint32)
    left, right = np.zeros_like(mid), np.zeros_like(mid)
    left[1:] = mid[:-1]
    right[:-1] = mid[1:]
    left[first[:-1]] = 0
    right[first[1:] - 1] = 0
    tri = (left << 16) | (mid << 8) | right
    tri = (tri * np.uint32(0x9E3779B1)) >> np.uint32(16)
    script = np.bitwise_or.reduceat(_SCRIPT[mid], first[:-1]) if len(s) else np.zeros(0, np.uint32)
    del left, mid, right, at
    mask = np.uint64(BUCKETS - 1)
    spans = [(s, np.minimum(s + 2, e), 1), (s, np.minimum(s + 4, e), 2), (np.maximum(e - 2, s), e, 3), (np.maximum(e - 4, s), e, 4)]
    whole = [((span_hashes(data, a, b) + np.uint64(k * 7919)) & mask).astype(np.int64) for a, b, k in spans]
    whole.append((mix(tokens.hashes + np.uint64(5)) & mask).astype(np.int64))
    whole.append((mix(script.astype(np.uint64) + np.uint64(1 << 40)) & mask).astype(np.int64))
    return tri.astype(np.intp), first[:-1], whole


class Model:
    """Languages (the last state is 'und') and the field's weights."""

    def __init__(self, langs: list[str], weights: np.ndarray, start: np.ndarray, trans: np.ndarray):
        self.langs, self.start, self.trans = [*langs, "und"], start, trans
        self.tables = [np.ascontiguousarray(weights[:, k]) for k in range(len(self.langs))]

    def label(self, tokens: Tokens) -> np.ndarray:
        """Posteriors (tokens, states)."""
        out = np.empty((len(tokens), len(self.langs)), np.float32)
        if not len(tokens):
            return out
        tri, first, whole = _features(tokens)
        for k, table in enumerate(self.tables):
            x = np.add.reduceat(table[tri], first)
            for f in whole:
                x += table[f]
            out[:, k] = x
        return crf.marginals(out, tokens.counts, self.start, self.trans)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words): WINDOWS spans of SPAN words, spread over the whole document."""
    for batch in chunks(batches, "text"):
        tokens = words_of(batch.column("text"))
        langs, spans = [], []
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            a, b = int(tokens.bounds[i]), int(tokens.bounds[i + 1])
            for x in sorted({int(v) for v in np.linspace(a, max(a, b - SPAN), WINDOWS)}):
                if b > a:
                    langs.append(lang)
                    spans.append(b" ".join(tokens.words(x, min(b, x + SPAN))).decode())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(spans, pa.string())], ["lang", "words"])


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model from a bounded sample of the rows of ``docs`` (doc_id, text, lang) that have a language."""
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND lang <> 'und'").select("doc_id", "lang").withColumn("r", F.row_number().over(w)).where(F.col("r") <= docs_per_lang)
    chosen = [r[0] for r in ids.select("doc_id").collect()]  # docs_per_lang rows of each language at most
    rows = docs.where(F.col("doc_id").isin(chosen)).where("lang IS NOT NULL AND lang <> 'und'").select("lang", "text").mapInArrow(_sample, "lang string, words string").toPandas()
    return fit(list(zip(rows["lang"], rows["words"])))


def noise(rng: np.random.RandomState, spans: list[tuple[str, str]]) -> list[str]:
    """Spans of words that are no language: numbers, consonants, random letters, codes, and words of the SCRIPTS that have less than a thousandth of the spans' characters."""
    seen = np.sort(np.frombuffer("".join(t for _, t in spans).encode("utf-32-le"), np.uint32))
    other = [(a, b) for a, b in SCRIPTS if np.searchsorted(seen, b, "right") - np.searchsorted(seen, a) <= len(seen) // 1000]
    latin = "abcdefghijklmnopqrstuvwxyz"
    if np.searchsorted(seen, 0x17F, "right") - np.searchsorted(seen, 0x100) <= len(seen) // 1000:  # letters such as those of Polish or Turkish
        other.append((0x100, 0x17F))
    kinds = [("0123456789", 18), ("0123456789", 5), ("0123456789bcdfghjkqvwxz", 9), (latin, 12), ("0123456789abcdef", 40), ("0123456789" + latin, 12)]

    def word(k: int) -> str:
        if k < len(kinds):
            letters, most = kinds[k]
            return "".join(rng.choice(list(letters), rng.randint(1 if k < 2 else 3, most)))
        first, last = other[k - len(kinds)]
        letters = "".join(map(chr, rng.randint(first, last + 1, rng.randint(1, 10))))
        return letters if first != 0x100 else "".join(rng.permutation(list(letters[:2] + "".join(rng.choice(list(latin), rng.randint(2, 8))))))

    n = max(60, len(spans) // 8)
    half = [[word(i % len(kinds)) for _ in range(12)] for i in range(n)]
    half += [[word(len(kinds) + i % len(other)) for _ in range(12)] for i in range(n if other else 0)]
    return [" ".join(x) for x in half]


def fit(spans: list[tuple[str, str]]) -> Model:
    """A model from labelled spans of words."""
    langs = sorted({lang for lang, _ in spans})
    und = len(langs)
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32))
    rng = np.random.RandomState(5)
    pool = sorted(spans) + [("und", x) for x in noise(rng, spans)]
    texts, tags, k = [], [], 0
    order = rng.permutation(len(pool))
    while k < len(order):  # code-switched sequences of one to four spans
        words, marks = [], []
        for i in order[k : (k := k + rng.randint(1, 5))]:
            own = pool[i][1].split()
            words += own
            marks += [langs.index(pool[i][0]) if pool[i][0] != "und" else und] * len(own)
        texts.append(" ".join(words))
        tags.append(marks)
    tokens = Tokens(pa.array(texts))
    tri, first, whole = _features(tokens)
    longest = int((tokens.ends - tokens.starts).max(initial=1))
    n = tokens.ends - tokens.starts
    grams = [np.where(n > j, tri[np.minimum(first + j, len(tri) - 1)], -1) for j in range(min(longest, 40))]
    w, start, trans = crf.fit(grams + whole, BUCKETS, np.concatenate([np.array(t, np.int64) for t in tags]), tokens.counts, und + 1, rounds=30)
    return Model(langs, w, start, trans)


_LABELS = "doc_id long, lang string, confidence double, n_words long, accepted boolean, spans array<struct<lang:string,first:int,words:int>>"


def _decide(model: Model, post: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, confidence and acceptance of each document."""
    counts = tokens.counts
    sums = np.zeros((len(counts), post.shape[1]))
    some = counts > 0
    if some.any():
        sums[some] = np.add.reduceat(post, tokens.bounds[:-1][some], axis=0)
    und = len(model.langs) - 1
    if not und:
        return np.zeros(len(counts), np.int64), np.zeros(len(counts)), np.zeros(len(counts), bool)
    best = sums[:, :und].argmax(1)
    known = sums[:, :und].sum(1)
    conf = sums[:, :und].max(1) / np.maximum(known, 1e-9)
    sure = np.zeros(len(counts))
    if some.any():
        sure[some] = np.add.reduceat((post[:, :und].max(1) >= SURE).astype(np.int64), tokens.bounds[:-1][some])
    best[~some] = und
    conf[~some] = 0
    ok = some & (known >= MIN_KNOWN * counts) & ((conf >= MIN_CONFIDENCE) | (sure >= MIN_SURE * counts))
    strange = some & (sums[:, und] > known)  # more 'und' than all languages together
    best[strange] = und
    conf[strange] = 0
    return best, conf, ok


def label(docs: DataFrame, model: Model) -> DataFrame:
    """Language, confidence and the runs of equally labelled words of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.langs)
        for batch in chunks(batches, "text"):
            tokens = words_of(batch.column("text"))
            post = model.label(tokens)
            best, conf, ok = _decide(model, post, tokens)
            word = post.argmax(1)
            turn = np.ones(len(word), bool)
            turn[1:] = word[1:] != word[:-1]
            turn[tokens.bounds[:-1][tokens.counts > 0]] = True
            at = np.flatnonzero(turn)
            size = np.diff(np.append(at, len(word)))
            per = np.searchsorted(at, tokens.bounds)
            begin = at - np.repeat(tokens.bounds[:-1], np.diff(per))
            runs = pa.StructArray.from_arrays([names.take(pa.array(word[at])), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))], ["lang", "first", "words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), names.take(pa.array(best)), pa.array(conf.round(6)), pa.array(tokens.counts), pa.array(ok), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), runs)],
                ["doc_id", "lang", "confidence", "n_words", "accepted", "spans"],
            )

    return with_ids(docs).select("doc_id", "text").mapInArrow(run, _LABELS)


def keep_known_languages(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            tokens = words_of(batch.column("text"))
            _, _, ok = _decide(model, model.label(tokens), tokens)
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return label(docs, train(docs))
