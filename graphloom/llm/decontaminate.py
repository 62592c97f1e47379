"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles (powers of two). For a partition
of items with at most m shingles, a document is read in windows of 2m shingles at a
stride of m, so that a passage of m shingles lies in one window whole, however long the
document is. Containment bounds the Jaccard similarity of item and window from below. For
windows of twice the size this bound is so low (0.14 to 0.25 at containment 0.6) that bands of two
samples would lose most items that are near the threshold; each of the SAMPLES samples is a band of
its own, which finds an item at the threshold with probability 0.99 or more. A
window can only match if it holds an item's minimal shingle, so windows without any such
shingle aren't hashed. Candidates are verified by exact containment: the share of the item's
distinct shingles (as words, not hashes) that the document has.

Items of fewer than SHINGLE words are one shingle of their own length.

A benchmark beyond ITEMS_PER_PASS items or BYTES_PER_PASS of text is searched slice by
slice; only a slice's index is sent to the tasks.

Defined results: null or wordless documents and items match nothing; null ids are carried as
null, and items without id are searched like others; repeated rows give one row for each
(doc_id, item_id); different texts under one id, of documents or items, are compared each by
itself, so a pair of ids can have several rows; ids are integers; an empty table on either
side gives an empty result. Dropping removes a row by its id and text; a row without id stays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import materialize

from .tables import hinted, lowered, read, with_ids
from .text import Tokens, chunks, ngrams

SHINGLE = 5
SAMPLES = 32
CONTAINMENT = 0.6
#: Items and bytes of text whose index is held in memory at once; a larger benchmark is searched slice by slice.
ITEMS_PER_PASS = 50_000
BYTES_PER_PASS = 32 << 20

_rng = np.random.RandomState(2)
_A = _rng.randint(0, 1 << 62, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.randint(0, 1 << 62, SAMPLES).astype(np.uint64)


def _minima(x: np.ndarray) -> np.ndarray:
    """Permuted values (..., n, SAMPLES) of shingle hashes."""
    return x[..., None] * _A + _B


class Index:
    """Bands of the items by shingle length and size partition, and the items' exact shingles."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = CONTAINMENT):
        self.threshold = threshold
        self.exact: dict[int, tuple[int, frozenset]] = {}
        self.parts: dict[tuple[int, int], dict] = {}
        seeds = defaultdict(list)
        for item, text in items:
            tokens = Tokens(pa.array([text]))
            n = min(SHINGLE, len(tokens))
            if not n:
                continue
            grams = np.unique(ngrams(tokens.hashes, n))
            words = tokens.words(0, len(tokens))
            self.exact[item] = (n, frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
            m = 1 << max(0, int(len(grams) - 1).bit_length())
            bands = self.parts.setdefault((n, m), defaultdict(list))
            values = _minima(grams)
            at = values.argmin(0)
            for key in self._bands(values.min(0)[None])[0].tolist():
                bands[key].append(item)
            seeds[n].append(grams[at])
        self.seeds = {n: np.unique(np.concatenate(x)) for n, x in seeds.items()}
        self.maps = {}
        for n, x in self.seeds.items():
            self.maps[n] = np.zeros(1 << 22, bool)
            self.maps[n][(x & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    @staticmethod
    def _bands(minima: np.ndarray) -> np.ndarray:
        return minima + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def search(self, tokens: Tokens) -> set[tuple[int, int]]:
        """Candidates (document, item)."""
        found: set[tuple[int, int]] = set()
        for n, seeds in self.seeds.items():
            grams = ngrams(tokens.hashes, n)
            at = np.flatnonzero(self.maps[n][(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if len(at):
                i = np.minimum(np.searchsorted(seeds, grams[at]), len(seeds) - 1)
                at = at[seeds[i] == grams[at]]
            doc = np.searchsorted(tokens.bounds, at, "right") - 1
            begin, count = tokens.bounds[doc], tokens.bounds[doc + 1] - tokens.bounds[doc] - n + 1
            inside = at - begin < count  # not over a document's end
            at, doc, begin, count = at[inside], doc[inside], begin[inside], count[inside]
            if not len(at):
                continue
            for (k, m), bands in self.parts.items():
                if k != n:
                    continue
                w = (at - begin) // m
                at_window = np.unique(np.stack([np.concatenate([doc, doc]), np.concatenate([w, np.maximum(w - 1, 0)])], 1), axis=0)
                for part in np.array_split(at_window, max(1, len(at_window) * 2 * m // 100_000)):
                    lo = tokens.bounds[part[:, 0]] + part[:, 1] * m
                    hi = np.minimum(lo + 2 * m, tokens.bounds[part[:, 0] + 1] - n + 1)
                    spread = lo[:, None] + np.arange(2 * m)
                    x = grams[np.minimum(spread, hi[:, None] - 1)]
                    keys = self._bands(_minima(x).min(1))
                    for d, row in zip(part[:, 0].tolist(), keys.tolist()):
                        for key in row:
                            for item in bands.get(key, ()):
                                found.add((d, item))
        return found

    def matches(self, tokens: Tokens) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, matched shingles, item's shingles) with enough containment."""
        by_doc = defaultdict(list)
        for d, item in self.search(tokens):
            by_doc[d].append(item)
        for d in sorted(by_doc):
            words = tokens.words(int(tokens.bounds[d]), int(tokens.bounds[d + 1]))
            own: dict[int, set] = {}
            for item in sorted(by_doc[d]):
                n, wanted = self.exact[item]
                if n not in own:
                    own[n] = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
                hit = len(wanted & own[n])
                if hit >= self.threshold * len(wanted):
                    yield d, item, hit, len(wanted)


def _contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, d1, item_id, matched, shingles) for each text with an item; d1 is the text's hash."""
    spark = docs.sparkSession
    items = materialize(lowered(with_ids(benchmark, "item_id").where("text IS NOT NULL"), "item_id").distinct(), "items")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("t"))).head()
    slices = max(1, -(-n // ITEMS_PER_PASS), -(-(size or 0) // BYTES_PER_PASS))
    source = lowered(with_ids(docs).withColumn("d1", F.xxhash64("text")), "doc_id", "d1")
    out = None
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(slices)) == k).orderBy("item_id", "t").collect()  # a slice's share
        ids = pa.array([r["item_id"] for r in rows], pa.int64())
        index = spark.sparkContext.broadcast(Index(list(enumerate(r["t"] for r in rows)), threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "t"):
                hits = list(index.value.matches(Tokens(batch.column("t"))))
                if hits:
                    d, item, hit, size = map(np.array, zip(*hits))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), batch.column("d1").take(pa.array(d)), ids.take(pa.array(item)), pa.array(hit), pa.array(size)], ["doc_id", "d1", "item_id", "matched", "shingles"])

        part = source.mapInArrow(run, "doc_id long, d1 long, item_id long, matched long, shingles long")
        out = part if out is None else out.unionAll(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, matched, shingles, containment) for each document that contains an item."""
    return _contaminated(docs, benchmark, threshold).drop("d1").distinct().withColumn("containment", F.round(F.col("matched") / F.col("shingles"), 6))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    gone = _contaminated(docs, benchmark, threshold).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id"), F.col("d1").alias("gone_d1"))
    gone = hinted(materialize(gone.distinct(), "gone"))
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_d1"]), "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH t AS (SELECT DISTINCT doc_id AS id, false AS item, md5(text) AS k, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents
           UNION ALL SELECT DISTINCT item_id, true, md5(lower(text)), regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') FROM benchmark),
p AS (SELECT id, item, k, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5),
s AS (SELECT DISTINCT id, item, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM p),
n AS (SELECT id, k, count(*) AS shingles FROM s WHERE item GROUP BY id, k),
h AS (SELECT d.id AS doc_id, d.k AS dk, b.id AS item_id, b.k AS bk, count(*) AS matched FROM s d JOIN s b ON d.g = b.g WHERE b.item AND NOT d.item GROUP BY 1, 2, 3, 4)
SELECT DISTINCT doc_id, item_id, matched, shingles, round(matched / shingles, 6) AS containment FROM h JOIN n ON n.k = h.bk AND n.id IS NOT DISTINCT FROM h.item_id
WHERE matched >= 0.6 * shingles
"""
