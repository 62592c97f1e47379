"""Passages that repeat across documents, by suffix arrays over shards of the corpus.

A passage is LENGTH words or more (tokens of ``text.py``). Each start of LENGTH words
belongs to the shard of its minimizer, the least hash of the SEED-word runs inside it, so
equal passages always meet, and consecutive starts with one minimizer travel as one
segment. Segments whose minimizer occurs in a single document can't repeat and go no
further; equal segments collapse to one with its least and greatest document. The others'
words are laid end to end with distinct separators, whole minimizers together, and
suffix-sorted by linear grouping (``suffix_array``). Neighbours that agree in LENGTH words
form classes; a class with two documents is a repeat. Repeats of a document that overlap
or touch are joined to maximal spans.

A minimizer whose distinct segments have more than HOT symbols isn't sorted in one task: its
starts are grouped again by the hash of all their LENGTH words, which equal passages share,
so no task holds more than the copies of one passage, and those collapse before.

A word is compared by 32 bits of its hash; a false span needs such a collision inside an
otherwise equal run.

Defined results: null, empty and short texts have no passage; null doc_ids are ignored;
equal rows under one doc_id are one document; different texts under one doc_id are searched
each by itself, and a passage that only texts of one doc_id share isn't reported, nor one that
is repeated only inside one document; ids are integers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import materialize

from .near_dedup import _runs
from .suffix_array import suffix_array
from .tables import BROADCAST_ROWS, hinted, read, with_ids
from .text import Tokens, chunks, mix, ngrams

LENGTH = 50
SEED = 8
#: Symbols that are sorted at a time; a minimizer's segments are never parted.
SYMBOLS = 200_000
#: Symbols of one minimizer's distinct segments that one task sorts.
HOT = 4_000_000


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(tokens: Tokens, length: int = LENGTH, heavy: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Document, first start, number of starts, minimizer and content hash of every segment. With ``heavy`` (sorted), only starts with these minimizers, grouped by the hash of all their words instead."""
    h = tokens.hashes
    seed = min(SEED, length)
    low = window_min(ngrams(h, seed), length - seed + 1)
    counts = np.maximum(tokens.counts - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.repeat(tokens.bounds[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    low = low[at]
    if heavy is not None:
        wanted = heavy[np.minimum(np.searchsorted(heavy, low), len(heavy) - 1)] == low
        at, doc = at[wanted], doc[wanted]
        low = ngrams(h, length)[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    a = at[begin]
    b = a + n + length - 1
    total = np.zeros(len(h) + 1, np.uint64)
    p = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), np.uint64(0x9E3779B97F4A7C15), np.uint64)]), dtype=np.uint64)
    q = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64)]), dtype=np.uint64)
    np.cumsum(h * p[:-1], out=total[1:])
    content = mix((total[b] - total[a]) * q[a] + n.astype(np.uint64))
    return doc[begin], a - tokens.bounds[doc[begin]], n, low[begin], content


_PLACE = "anchor long, seg long, doc_id long, key long, first int, n int"


def _segment(heavy: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            doc, first, n, low, content = segments(Tokens(batch.column("t")), heavy=heavy)
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(pick), batch.column("key").take(pick), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "seg", "doc_id", "key", "first", "n"]
            )

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their wanted segments -> the segments' words as 32-bit symbols."""
    for batch in chunks(batches, "t"):
        tokens = Tokens(batch.column("t"))
        h = (tokens.hashes >> np.uint64(32)).astype(np.uint32)
        want = batch.column("want")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(want.offsets.to_numpy()))
        flat = want.flatten()
        first, n = flat.field("first").to_numpy(), flat.field("n").to_numpy()
        a = tokens.bounds[owner] + first
        words = [h[x:y].tobytes() for x, y in zip(a.tolist(), (a + n + LENGTH - 1).tolist())]
        yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("seg"), flat.field("lo"), flat.field("hi"), pa.array(words, pa.binary())], ["anchor", "seg", "lo", "hi", "words"])


def repeats(words: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, offset and least document of every start of ``length`` words that two documents have; lo and hi are each segment's least and greatest document."""
    sizes = np.array([len(w) for w in words])
    text = np.concatenate([np.append(w.astype(np.int64), -1 - i) for i, w in enumerate(words)])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    room = (starts + sizes)[owner[order]] - order
    order = order[room >= length]
    same = np.ones(max(len(order) - 1, 0), bool)
    a, b = order[:-1], order[1:]
    for k in range(length):
        same &= text[a + k] == text[b + k]
    if not len(order):
        return order, order, order
    begin = np.flatnonzero(np.append(True, ~same))
    size = np.diff(np.append(begin, len(order)))
    least = np.minimum.reduceat(lo[owner[order]], begin)
    most = np.maximum.reduceat(hi[owner[order]], begin)
    hit = np.repeat(least < most, size)
    found = order[hit]
    return owner[found], found - starts[owner[found]], np.repeat(least, size)[hit]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by minimizer -> runs of repeated starts (seg, anchor, offset, n, origin)."""

    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        words = [np.frombuffer(w, np.uint32) for w in table["words"].to_pylist()]
        seg, at, least = repeats(words, table["lo"].to_numpy(), table["hi"].to_numpy())
        key = np.lexsort((at, seg))
        seg, at, least = seg[key], at[key], least[key]
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(seg)))
        origin = np.minimum.reduceat(least, begin) if len(begin) else least
        pick = pa.array(seg[begin])
        return pa.RecordBatch.from_arrays([table["anchor"].combine_chunks().take(pick), table["seg"].combine_chunks().take(pick), pa.array(at[begin].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(origin)], ["anchor", "seg", "offset", "n", "origin"])

    held, symbols = [], 0
    for run in _runs(batches, "anchor"):
        for table in _by_anchor(run):
            held.append(table)
            symbols += sum(map(len, table["words"].to_pylist())) // 4
            if symbols >= SYMBOLS:
                yield solve(held)
                held, symbols = [], 0
    if held:
        yield solve(held)


def _by_anchor(table: pa.Table, most: int = 2000) -> Iterator[pa.Table]:
    """Pieces of at least ``most`` rows that end where the minimizer changes."""
    keys = table["anchor"].to_numpy()
    ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
    start = 0
    while start < len(keys):
        end = int(ends[min(np.searchsorted(ends, start + most), len(ends) - 1)])
        yield table.slice(start, end - start)
        start = end


def _shared(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places whose minimizer two documents have, and each distinct segment of them once: (anchor, seg, at, hi) with its least place and greatest document."""
    anchors = places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    kept = materialize(places.join(anchors, "anchor", "left_semi"), "kept")
    return kept, materialize(kept.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "key", "first", "n")).alias("at"), F.max("doc_id").alias("hi")), "distinct")


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, first_word, n_words, origin) for each maximal span of a document whose every LENGTH words also stand in another one; ``origin`` is the least doc_id that has some of them, so a span with origin = doc_id is the first copy."""
    docs = with_ids(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    # where ids repeat, the text's hash tells their rows apart
    key = F.xxhash64("text") if _repeated_ids(docs) else F.lit(0).cast("long")
    texts = docs.select("doc_id", key.alias("key"), F.lower("text").alias("t"))
    places = materialize(texts.mapInArrow(_segment(), _PLACE), "segments")
    kept, one = _shared(places)
    heavy = materialize(one.groupBy("anchor").agg(F.sum(F.col("at.n") + (LENGTH - 1)).alias("symbols")).where(F.col("symbols") > hot).select("anchor"), "heavy")
    if not heavy.isEmpty():
        found = np.sort(heavy.toPandas()["anchor"].to_numpy(np.int64).view(np.uint64))  # at most one for each HOT symbols of all segments
        fine = texts.mapInArrow(_segment(found), _PLACE)
        kept, one = _shared(materialize(places.join(hinted(heavy), "anchor", "left_anti").unionByName(fine), "segments"))
    wanted = one.select("at.doc_id", "at.key", F.struct("anchor", "seg", F.col("at.first").alias("first"), F.col("at.n").alias("n"), F.col("at.doc_id").alias("lo"), "hi").alias("x"))
    wanted = materialize(wanted.groupBy("doc_id", "key").agg(F.collect_list("x").alias("want")), "wanted")
    # only texts with something to sort are shuffled, as long as their ids are few enough to send to every task
    sources = texts.join(F.broadcast(wanted.select("doc_id", "key")), ["doc_id", "key"], "left_semi") if wanted.count() <= BROADCAST_ROWS else texts
    words = sources.dropDuplicates(["doc_id", "key"]) if _repeated_ids(docs) else sources
    words = words.join(wanted.hint("merge"), ["doc_id", "key"]).select("t", "want").mapInArrow(_words, "anchor long, seg long, lo long, hi long, words binary")
    found = words.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort, "anchor long, seg long, offset int, n int, origin long")
    found = materialize(found.withColumnRenamed("n", "starts"), "found")
    spans = kept.join(found, ["anchor", "seg"]).select("doc_id", "key", (F.col("first") + F.col("offset")).alias("a"), (F.col("first") + F.col("offset") + F.col("starts") + (LENGTH - 1)).alias("b"), "origin").distinct()
    w = Window.partitionBy("doc_id", "key").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = marked.groupBy("doc_id", "key", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("origin").alias("origin"))
    return joined.select("doc_id", F.col("a").cast("long").alias("first_word"), (F.col("b") - F.col("a")).cast("long").alias("n_words"), "origin")


def _repeated_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (SELECT DISTINCT doc_id, md5(text) AS k, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, k, i - 1 AS a, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
r AS (SELECT g, min(doc_id) AS origin FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, k, a, a + 50 AS b, origin FROM p JOIN r USING (g)),
m AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY doc_id, k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS new FROM h),
z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, k ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, CAST(min(a) AS BIGINT) AS first_word, CAST(max(b) - min(a) AS BIGINT) AS n_words, min(origin) AS origin FROM z GROUP BY doc_id, k, island
"""
