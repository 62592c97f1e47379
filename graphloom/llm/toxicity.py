"""Toxicity by lexicon induction: random walks over a word graph of positive PMI.

Seeds come from the labelled documents: every word that toxic ones hold more often than
clean ones by its own evidence (the log-likelihood ratio of document frequencies, at a level
for as many tests as words, and a ratio of the rates), however rare beside others, and, as the
other pole, the even words (in both alike) that stand oftenest beside each toxic seed, so
that both poles have the same languages. The graph joins words that occur within WINDOW words
of each other, weighted by positive pointwise mutual information over all documents, taken at
a lower bound of the joint count (a standard error less, one more expected) so that chance
neighbours have no edge, and only if the pair stands in TOGETHER different contexts (the
words on both sides of it), so that copies of one passage make none. A mask of 63 bits shows
most pairs to have enough contexts; those of the rest are counted exactly in a second pass.
The graph is unfolded from the seeds: first all edges of the seeds, then all edges of the words
that the walk so far finds toxic (the hubs that are no seeds), until it finds no more, so a word
that stands by no seed is reached through those, however many lie between. By definition it has
the edges with a hub at one end at least, and none between two other words. A walk with restart starts
at each pole's seeds; it goes from hubs to words and back, and one more step gives each word
its visiting mass. Polarity is the difference of both masses over their
sum, so it doesn't depend on how many words share the mass. A seed is at least as polar as
its labels say; another word needs several toxic hubs near it, and labels that don't show
it in clean documents. A document's score is the sum of the polarities of its distinct toxic words; the
cut-off is the one with the best F1 on the labelled documents.

All counts cover all documents.

Defined results: null, empty and wordless texts score 0 and aren't toxic; null labels and
labels without document are ignored; a document labelled both ways counts as toxic; without
toxic or without clean labels the lexicon is empty and nothing is toxic; repeated rows are
scored each; ties go to the word with the lower hash; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import materialize

from .tables import hinted, read, with_ids
from .text import Tokens, chunks, mix

#: Each toxic seed gives so many clean ones, most of them the same as others give.
BESIDE = 10
WINDOW = 5
#: A toxic seed's own evidence: the chance that any word at all passes without cause (so each is tested at this by the number of words), and how many times as often toxic documents hold it, a standard error less.
SEED_ERROR = 0.01
SEED_RATIO = 9
RESTART = 0.2
#: The walk ends when a round moves less mass than this.
CLOSE = 1e-4
LEXICON = 0.5
#: Two words are joined if they stand together so many times, in so many different contexts (told apart by a 64-bit hash).
TOGETHER = 3
#: A word that isn't a seed stands near so many toxic hubs (or all seeds, if these are fewer); a copied passage seldom gives as many.
NEAR = 3
#: How many times the graph is unfolded at most: no bound, as it ends when no new toxic word is found.
HOPS = sys.maxsize
#: Bits of the filter of pairs whose contexts are counted exactly; more pairs than bits make it slower, not wrong.
FILTER_BITS = 1 << 24
#: Steps of a score between which the cut-off is chosen.
LEVELS = 200


class Counter:
    """Sums by 64-bit key over the chunks of a partition, given out when large."""

    def __init__(self, columns: int, most: int = 1_000_000):
        self.parts, self.rows, self.columns, self.most = [], 0, columns, most

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        u, inv = np.unique(keys, return_inverse=True)
        self.parts.append((u, [np.bincount(inv, v, len(u)).astype(np.int64) for v in values]))
        self.rows += len(u)

    def merged(self) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = np.concatenate([k for k, _ in self.parts])
        u, inv = np.unique(keys, return_inverse=True)
        out = [np.bincount(inv, np.concatenate([v[j] for _, v in self.parts]), len(u)).astype(np.int64) for j in range(self.columns)]
        self.parts, self.rows = [], 0
        return u, out

    def full(self) -> bool:
        if self.rows >= self.most:
            u, out = self.merged()
            self.parts, self.rows = [(u, out)], len(u)
        return self.rows >= self.most // 2


def _batch(names: list[str], keys: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, values)], names)


def _document_words(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, word) pairs."""
    order = np.lexsort((tokens.hashes, tokens.doc))
    d, h = tokens.doc[order], tokens.hashes[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[first], h[first]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of all words."""
    counter = Counter(1)
    for batch in chunks(batches, "t"):
        _, h = _document_words(Tokens(batch.column("t")))
        if len(h):
            counter.add(h, np.ones(len(h)))
        if counter.full():
            u, (n,) = counter.merged()
            yield _batch(["w", "n"], u, [n])
    if counter.parts:
        u, (n,) = counter.merged()
        yield _batch(["w", "n"], u, [n])


def _in(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def rated(toxic: DataFrame, clean: DataFrame) -> DataFrame:
    """(w, a, b, n1, n0, z, ratio, most) of each word of the labelled texts ``t``: toxic and clean documents with it, of how many; the signed root of the log-likelihood ratio; how many times as often toxic documents hold it, a standard error less and more (logarithms)."""
    n1, n0 = toxic.count(), clean.count()
    a = toxic.mapInArrow(_frequencies, "w long, n long").groupBy("w").agg(F.sum("n").alias("a"))
    b = clean.mapInArrow(_frequencies, "w long, n long").groupBy("w").agg(F.sum("n").alias("b"))
    x = a.join(b, "w", "full").select("w", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), F.lit(n1).alias("n1"), F.lit(n0).alias("n0"))
    u, v = F.col("a") + 0.5, F.col("b") + 0.5
    p = (u + v) / (n1 + n0 + 2)
    g = 2 * (u * F.log(u / (p * (n1 + 1))) + v * F.log(v / (p * (n0 + 1))))
    odds = F.log(u / (n1 + 1)) - F.log(v / (n0 + 1))
    error = F.sqrt(1 / u + 1 / v)
    return materialize(x.select("*", (F.signum(odds) * F.sqrt(F.greatest(g, F.lit(0.0)))).alias("z"), (odds - error).alias("ratio"), (odds + error).alias("most")), "rated")


def find_seeds(toxic: DataFrame, clean: DataFrame, words: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the toxic and the clean seeds. Both frames have the lower-case text ``t``; ``words`` is what ``rated`` gives for them."""
    words = rated(toxic, clean) if words is None else words
    none = np.zeros(0, np.uint64)
    tests = words.where("a > 0").count()
    if not tests or not words.where("n0 > 0").limit(1).count():
        return none, none
    least = NormalDist().inv_cdf(1 - SEED_ERROR / max(tests, 2))
    bad = words.where((F.col("z") >= least) & (F.col("ratio") >= float(np.log(SEED_RATIO)))).select("w").toPandas()["w"].to_numpy(np.int64)
    if not len(bad):
        return none, none
    bad = np.sort(bad).view(np.uint64)
    even = words.where((F.abs("z") < 1) & (F.col("a") > 0)).select("w")  # in toxic and clean documents alike
    beside = toxic.mapInArrow(_together(bad), _PAIR).selectExpr(f"{_NUMBER} AS s", "w", "n").groupBy("s", "w").agg(F.sum("n").alias("n")).join(even, "w")
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "w"))
    good = beside.withColumn("rank", rank).where(F.col("rank") <= BESIDE).select("w").distinct().toPandas()["w"].to_numpy(np.int64)
    good = np.sort(good).view(np.uint64)
    return (bad, good) if len(good) else (none, none)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums of n and unions of contexts by (w, s)."""
    s, w, n, m = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((s, w))
    s, w, n, m = s[order], w[order], n[order], m[order]
    begin = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (w[1:] != w[:-1])))
    return s[begin], w[begin], np.add.reduceat(n, begin), np.bitwise_or.reduceat(m, begin)


def _context(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words on both sides of a pair."""
    return mix(left + mix(right))


def context_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One of 63 bits for the words on both sides of a pair."""
    return np.left_shift(np.int64(1), (_context(left, right) % np.uint64(63)).astype(np.int64))


#: ``p`` is the seed number with, below it, the place of the only bit of the mask (from 1 on, and ``m`` is 0 then) or 0: a pair seen once, as most are, differs from the next in these few bytes only.
_PAIR = "p long, w long, n long, m long"
_NUMBER = "CAST(shiftright(p, 8) AS int)"
_MASK = "IF((p & 255) > 0, shiftleft(1L, CAST((p & 255) - 1 AS int)), m)"


class Neighbours:
    """Pairs of a seed and a word within WINDOW words of it, in the texts of a column."""

    def __init__(self, column: pa.Array, table: np.ndarray, order: np.ndarray):
        """``table`` are the seeds, sorted, and ``order`` their numbers."""
        tokens = Tokens(column)
        self.h, self.doc = h, doc = tokens.hashes, tokens.doc
        at = np.flatnonzero(_in(table, h)) if len(h) else np.zeros(0, np.int64)
        spread = at[:, None] + np.array([k for k in range(-WINDOW, WINDOW + 1) if k])
        ok = (spread >= 0) & (spread < len(h))
        if len(at):
            ok &= doc[np.clip(spread, 0, len(h) - 1)] == doc[at][:, None]
        number = order[np.searchsorted(table, h[at])]
        self.other = spread[ok]
        self.own, self.seed = (np.broadcast_to(x[:, None], spread.shape)[ok] for x in (at, number))

    def keep(self, ok: np.ndarray) -> None:
        self.other, self.own, self.seed = self.other[ok], self.own[ok], self.seed[ok]

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """The words on both sides of each pair, 0 beyond its document."""
        return self._word(np.minimum(self.own, self.other) - 1), self._word(np.maximum(self.own, self.other) + 1)

    def _word(self, k: np.ndarray) -> np.ndarray:
        inside = np.clip(k, 0, len(self.h) - 1)
        return np.where((k == inside) & (self.doc[inside] == self.doc[self.own]), self.h[inside], np.uint64(0))


def _together(seeds: np.ndarray, most: int = 1_000_000):
    """(seed number, word) -> joint occurrences within WINDOW words, in both directions, and their contexts, as _PAIR has them."""
    order = np.argsort(seeds)
    table = seeds[order]

    def batch_of(s: np.ndarray, w: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        one = n == 1
        place = np.where(one, np.log2(np.where(one, m, 1).astype(float)).astype(np.int64) + 1, 0)
        return pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64) << 8 | place), pa.array(w.view(np.int64)), pa.array(n), pa.array(np.where(one, 0, m))], ["p", "w", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in chunks(batches, "t"):
            near = Neighbours(batch.column("t"), table, order)
            if not len(near.other):
                continue
            bits = context_bits(*near.sides())
            parts.append(_merged([(near.seed, near.h[near.other], np.ones(len(near.other), np.int64), bits)]))
            rows += len(parts[-1][0])
            if rows >= most:
                parts = [_merged(parts)]
                rows = len(parts[0][0])
            if rows >= most // 2 and len(parts) == 1:
                yield batch_of(*parts[0])
                parts, rows = [], 0
        if parts:
            yield batch_of(*_merged(parts))

    return run


#: Spreads the numbers of the seeds over the filter; its product with one stays within 63 bits.
_SPREAD = 0x9E3779B1


def _filter_of(pairs: DataFrame) -> np.ndarray:
    """Bits that are set for all ``pairs`` (s, w), and for few others."""
    place = F.col("w").bitwiseXOR(F.col("s").cast("long") * F.lit(_SPREAD)).bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = pairs.select(place.alias("p")).selectExpr("shiftright(p, 5) AS k", "shiftleft(1L, CAST(p & 31 AS int)) AS bit")
    rows = bit.groupBy("k").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    out[rows["k"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _contexts(seeds: np.ndarray, wanted: np.ndarray, most: int = 1_000_000):
    """(seed number, word, context), each once or a few times, of the pairs that the filter ``wanted`` lets through."""
    order = np.argsort(seeds)
    table = seeds[order]

    def distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        s, w, c = (np.concatenate(x) for x in zip(*parts))
        at = np.lexsort((c, s, w))
        s, w, c = s[at], w[at], c[at]
        first = np.append(True, (s[1:] != s[:-1]) | (w[1:] != w[:-1]) | (c[1:] != c[:-1]))
        return s[first], w[first], c[first]

    def batch_of(s: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(w.view(np.int64)), pa.array(c.view(np.int64))], ["s", "w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in chunks(batches, "t"):
            near = Neighbours(batch.column("t"), table, order)
            place = (near.h[near.other] ^ (near.seed.astype(np.uint64) * np.uint64(_SPREAD))) & np.uint64(FILTER_BITS - 1)
            near.keep((wanted[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1)
            if not len(near.other):
                continue
            parts.append(distinct([(near.seed, near.h[near.other], _context(*near.sides()))]))
            rows += len(parts[-1][0])
            if rows >= most:
                yield batch_of(*distinct(parts))
                parts, rows = [], 0
        if parts:
            yield batch_of(*distinct(parts))

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of all words."""
    counter = Counter(1)
    for batch in chunks(batches, "t"):
        h = Tokens(batch.column("t")).hashes
        if len(h):
            counter.add(h, np.ones(len(h)))
        if counter.full():
            u, (n,) = counter.merged()
            yield _batch(["w", "n"], u, [n])
    if counter.parts:
        u, (n,) = counter.merged()
        yield _batch(["w", "n"], u, [n])


def walk(step, start: np.ndarray, close: float = 1e-12, first: np.ndarray | None = None) -> np.ndarray:
    """Visiting mass of a walk with restart: the fixed point of m = RESTART * start + (1 - RESTART) * m @ step, sought from ``first`` on. ``step`` may be a function that gives m @ step."""
    m = (start if first is None else first).copy()
    for _ in range(200):
        new = RESTART * start + (1 - RESTART) * (step(m) if callable(step) else m @ step)
        if np.abs(new - m).sum() < close:
            break
        m = new
    return m


def _visits(batch: pa.RecordBatch, share: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, seed and weight of each edge of the batch, and each row's mass, one line for each walk."""
    near = batch.column("near")
    flat, lengths = near.flatten(), near.value_lengths().to_numpy(zero_copy_only=False)
    s, x = flat.field("s").to_numpy(), flat.field("x").to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, s, x, np.stack([np.bincount(row, x * line[s], len(lengths)) for line in share])


def _back(share: np.ndarray):
    """From the seeds to words and back: the mass that arrives at each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(share)
        for batch in batches:
            row, s, x, v = _visits(batch, share)
            v = v / np.bincount(row, x, batch.num_rows)
            for line, mass in zip(total, v):
                line += np.bincount(s, mass[row] * x, len(line))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(share.shape[1], dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["s", "mt", "mc"])

    return run


def _arrive(share: np.ndarray, bad: np.ndarray, toxic: np.ndarray):
    """Mass of each word that isn't near too few toxic hubs, where toxic mass is the larger; ``bad`` are the toxic seeds, sorted, and ``toxic`` marks the hubs that are seeds like them or found with them."""
    least = min(NEAR, len(bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, s, _, v = _visits(batch, share)
            w = batch.column("w").to_numpy()
            enough = (np.bincount(row, toxic[s], len(w)) >= least) | _in(bad, w.view(np.uint64)) | (v[0] <= v[1])
            enough &= v.sum(0) > 0
            yield pa.RecordBatch.from_arrays([pa.array(w[enough]), pa.array(v[0][enough]), pa.array(v[1][enough])], ["w", "vt", "vc"])

    return run


def _edges(texts: DataFrame, counts: DataFrame, hubs: np.ndarray, first: int, least_together: int) -> DataFrame:
    """(s, w, x): the edges of ``hubs``, numbered from ``first`` on, with their weight. ``counts`` (w, c, total) are the words' occurrences."""
    spark = texts.sparkSession
    part = F.expr(f"pmod({_NUMBER}, 8)")  # rows of one word lie together, so they compress, but a common word is not one task
    pairs = texts.mapInArrow(_together(hubs), _PAIR).repartition("w", part).select("w", part.alias("part"), F.expr(_NUMBER).alias("s"), "n", F.expr(_MASK).alias("m")).groupBy("w", "part", "s").agg(F.sum("n").alias("n"), F.bit_or("m").alias("m")).where(F.col("n") >= least_together)
    numbers = spark.createDataFrame(pd.DataFrame({"w": hubs.view(np.int64), "s": np.arange(len(hubs), dtype=np.int32)}))
    sizes = counts.join(F.broadcast(numbers), "w").select("s", F.col("c").cast("double").alias("cs"))
    expected = F.col("cs") * F.col("c") * (2 * WINDOW) / F.col("total")
    pmi = F.log(F.pow(F.sqrt("n") - 1, 2) / (expected + 1))
    sure = (F.bit_count("m") >= least_together).alias("sure")  # so many bits are so many contexts; fewer bits may be more contexts
    likely = materialize(pairs.join(F.broadcast(sizes), "s").join(hinted(counts), "w").select("s", "w", pmi.alias("x"), sure).where("x > 0"), "likely")
    number = (F.col("s") + F.lit(first)).cast("int").alias("s")
    edges = likely.where("sure").select(number, "w", "x")
    rest = likely.where("NOT sure").select("s", "w", "x")
    wanted = _filter_of(rest)
    if not wanted.any():
        return edges
    contexts = texts.mapInArrow(_contexts(hubs, wanted), "s int, w long, c long").distinct().groupBy("s", "w").agg(F.count("*").alias("contexts"))
    enough = contexts.where(F.col("contexts") >= least_together).select("s", "w")
    return edges.unionAll(materialize(rest.join(enough, ["s", "w"]).select(number, "w", "x"), "edges"))


def induce(texts: DataFrame, seeds: tuple[np.ndarray, np.ndarray], least_together: int = TOGETHER, hops: int = HOPS, veto: DataFrame | None = None) -> DataFrame:
    """The lexicon (w, polarity) from all ``texts`` (t), unfolded ``hops`` times or until no new toxic word is found. The words of ``veto`` (w) are no hubs unless they are seeds."""
    spark = texts.sparkSession
    bad, good = seeds
    hubs = np.concatenate([bad, good])
    if not len(hubs):
        return spark.createDataFrame([], "w long, polarity double")
    counts = texts.mapInArrow(_occurrences, "w long, n long").groupBy("w").agg(F.sum("n").alias("c"))
    counts = materialize(counts, "counts")
    counts = counts.withColumn("total", F.lit(float(counts.agg(F.sum("c")).head()[0] or 1)))
    start = np.zeros((2, len(hubs)))
    start[0, : len(bad)] = 1 / len(bad)
    start[1, len(bad) :] = 1 / len(good)
    toxic = np.arange(len(hubs)) < len(bad)
    fresh, edges, mass, words = hubs, None, start, None
    for hop in range(hops):
        own = _edges(texts, counts, fresh, len(hubs) - len(fresh), least_together)
        edges = own if edges is None else edges.unionAll(own)
        near = materialize(edges.groupBy("w").agg(F.collect_list(F.struct(F.col("s"), F.col("x"))).alias("near")), "near")  # one entry for each hub
        out = np.zeros(len(hubs))
        for r in edges.groupBy("s").agg(F.sum("x").alias("out")).collect():  # a row for each hub
            out[r["s"]] = r["out"]
        out[out == 0] = 1  # no edge, so nothing leaves

        def step(m: np.ndarray, near=near, out=out) -> np.ndarray:
            got = near.mapInArrow(_back(m / out), "s int, mt double, mc double").groupBy("s").agg(F.sum("mt"), F.sum("mc")).toPandas().to_numpy(float)
            new = np.zeros_like(m)
            new[:, got[:, 0].astype(int)] = got[:, 1:].T
            return new

        start = np.pad(start, ((0, 0), (0, len(hubs) - start.shape[1])))
        mass = walk(step, start, CLOSE, np.pad(mass, ((0, 0), (0, len(hubs) - mass.shape[1]))))
        visits = near.mapInArrow(_arrive(mass / out, np.sort(bad), toxic), "w long, vt double, vc double")
        words = visits.select("w", ((F.col("vt") - F.col("vc")) / (F.col("vt") + F.col("vc"))).alias("polarity"))
        if hop + 1 == hops:
            break
        found = words.where(F.col("polarity") >= LEXICON).select("w")
        found = (found if veto is None else found.join(veto, "w", "left_anti")).toPandas()["w"].to_numpy(np.int64).view(np.uint64)
        fresh = np.setdiff1d(found, hubs)
        if not len(fresh):
            break
        hubs, toxic = np.concatenate([hubs, fresh]), np.concatenate([toxic, np.ones(len(fresh), bool)])
    return words


def lexicon_of(texts: DataFrame, toxic: DataFrame, clean: DataFrame) -> DataFrame:
    """(w, polarity) of the toxic words: the seeds, and the induced words that the labels don't speak against. A seed is at least as polar as its labels say."""
    words = rated(toxic, clean)
    bad, good = find_seeds(toxic, clean, words)
    veto = words.where(F.col("most") < float(np.log(SEED_RATIO))).select("w")
    induced = induce(texts, (bad, good), veto=veto).where(F.col("polarity") >= LEXICON).join(veto, "w", "left_anti")
    seeds = texts.sparkSession.createDataFrame(pd.DataFrame({"w": bad.view(np.int64)}), "w long")
    own = words.join(F.broadcast(seeds), "w").select("w", ((F.exp("ratio") - 1) / (F.exp("ratio") + 1)).alias("polarity"))
    return induced.unionByName(own).groupBy("w").agg(F.max("polarity").alias("polarity"))


def _scorer(words: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            tokens = Tokens(batch.column("t"))
            d, i = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(words) and len(tokens):
                at = np.flatnonzero(_in(words, tokens.hashes))
                pair = np.unique(tokens.doc[at] * len(words) + np.searchsorted(words, tokens.hashes[at]))
                d, i = pair // len(words), pair % len(words)
            score = np.bincount(d, weights[i], batch.num_rows).astype(float).round(6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(np.bincount(d, minlength=batch.num_rows))], ["doc_id", "score", "terms"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, terms, toxic) for every document: the sum of the polarities of its distinct lexicon words, how many these are, and whether the score reaches the cut-off."""
    texts = with_ids(docs).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    marks = materialize(with_ids(labels).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "marks")
    toxic = texts.join(hinted(marks.where("toxic = 1").select("doc_id")), "doc_id", "left_semi").select("t")
    clean = texts.join(hinted(marks.where("toxic = 0").select("doc_id")), "doc_id", "left_semi").select("t")
    lexicon = lexicon_of(texts.select("t"), toxic, clean).toPandas().sort_values("w")
    words = lexicon["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    scored = materialize(texts.mapInArrow(_scorer(words[order], lexicon["polarity"].to_numpy(float)[order]), "doc_id long, score double, terms long"), "scored")
    level = F.floor(F.col("score") * LEVELS) / LEVELS
    known = scored.where("score > 0").join(marks, "doc_id").groupBy(level.alias("level")).agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.count("*").alias("n")).toPandas().sort_values("level", ascending=False)
    cut = float("inf")
    if len(known):
        positives = marks.where("toxic = 1").count()
        hit = known["p"].cumsum().to_numpy(float)
        f1 = 2 * hit / (known["n"].cumsum().to_numpy() + positives)
        cut = float(known["level"].iloc[int(len(f1) - 1 - f1[::-1].argmax())])
    return scored.withColumn("toxic", F.col("score") >= cut if np.isfinite(cut) else F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
