"""Near-duplicate groups by banded MinHash, verified with odd sketches.

Each document's word shingles give ``SAMPLES`` MinHash values. Bands of them propose
candidates; an odd sketch (every sample flips one bit of a bitmap) verifies them: the
XOR of two bitmaps has a population count from which the Jaccard similarity follows.
Documents with equal samples collapse to one signature first, so thousands of exact copies
cost one row, and all further work is on signatures, never on ids. Inside a bucket, groups
grow breadth first from one pivot after another, with all distances of a pivot in one vector
operation: no pair is left out, and a bucket of thousands of near copies takes few pivots.
Groups of all buckets are then joined.

A band that more than HOT signatures share isn't brought together in one task. Its members
are salted into blocks and linked inside them; the bands' salts differ, so copies meet in one
band or another. What the groups so far don't join is then compared exactly: the members
outside the band's largest group go to every block of it, all others to their own.

The similarity is estimated, so pairs just above THRESHOLD are missed as often as found;
from RELIABLE on at least 0.9 of the pairs are (tested against exact Jaccard).

Defined results: a document without tokens (null, empty, punctuation) or without
doc_id has no shingles and is in no group; one of fewer tokens than a shingle has one
shingle; repeated rows of one doc_id count once; two texts of one doc_id are in the groups
of each text, and join nothing; equal texts are in one group; the kept
document is the one with the least doc_id; ids are integers; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import materialize

from .tables import components, hinted, lowered, read, with_ids
from .text import Tokens, chunks, mix, shingles

SHINGLE = 3
SAMPLES = 128
ROWS = 4
BITS = 512
THRESHOLD = 0.55
RELIABLE = 0.65
#: Signatures of one band that one task compares; more are salted into blocks.
HOT = 20_000

_rng = np.random.RandomState(9)
_A = (_rng.randint(0, 1 << 31, SAMPLES).astype(np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.randint(0, 1 << 31, SAMPLES).astype(np.uint32)


def minhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, SAMPLES) minima; documents must have a shingle each."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, SAMPLES), np.uint32)
    starts = bounds[:-1]
    step = 1 << 16
    cuts = [0]
    while cuts[-1] < len(starts):  # blocks of shingles that stay in cache
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + step, "right")) - 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        b = min(b, len(starts))
        part = x[bounds[a] : bounds[b]]
        at = starts[a:b] - bounds[a]
        work = np.empty_like(part)
        for k in range(SAMPLES):
            np.multiply(part, _A[k], out=work)
            np.add(work, _B[k], out=work)
            out[a:b, k] = np.minimum.reduceat(work, at)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(documents, BITS / 64) parity bitmaps of the samples."""
    n = len(samples)
    bit = (mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)
    parity = np.bincount((bit + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def similarity(pop: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the population counts of XORed sketches."""
    odd = np.minimum(pop / BITS, 0.4999)
    return 1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * odd)


#: The largest population count whose estimate reaches THRESHOLD.
def most_bits(threshold: float) -> int:
    return int(np.flatnonzero(similarity(np.arange(BITS // 2)) >= threshold)[-1])


_SIGNED = "doc_id long, d1 long, sig long, sketch binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "t"):
        tokens = Tokens(batch.column("t"))
        hashes, bounds = shingles(tokens, SHINGLE)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            continue
        samples = minhash(hashes, np.append(bounds[some], bounds[-1]))
        n = len(some)
        bands = SAMPLES // ROWS
        keys = np.zeros((n, bands), np.uint64)
        for r in range(ROWS):
            keys = mix(keys + samples[:, r::ROWS][:, :bands].astype(np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sig = np.zeros(n, np.uint64)
        for b in range(bands):
            sig = mix(sig + keys[:, b])
        sketch = odd_sketch(samples)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(some)),
                batch.column("d1").take(pa.array(some)),
                pa.array(sig.view(np.int64)),
                pa.array([x.tobytes() for x in sketch], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
            ],
            ["doc_id", "d1", "sig", "sketch", "bands"],
        )


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole key runs from batches sorted by ``key``; the last run waits for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif rest and rest[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, sig) sorted by band -> (bucket, size, sig) for buckets of two and more; a bucket is named by its members."""
    for table in _runs(batches, "band"):
        keys, ids = table["band"].to_numpy(), table["sig"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        name = np.add.reduceat(mix(ids.view(np.uint64) + np.uint64(77)), starts)
        many = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[many].view(np.int64)), pa.array(np.repeat(sizes, sizes)[many]), pa.array(ids[many])], ["bucket", "size", "sig"])


def link(sketches: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the graph that joins sketches at most ``bits`` bits apart."""
    left, a, b = np.arange(len(sketches)), [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        p = queue.pop()
        near = np.bitwise_count(sketches[left] ^ sketches[p]).sum(1) <= bits
        found = left[near]
        left = left[~near]
        a.append(np.full(len(found), p))
        b.append(found)
        queue.extend(found.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _verify(threshold: float):
    bits = most_bits(threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "bucket"):
            keys, ids = table["bucket"].to_numpy(), table["sig"].to_numpy()
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            near = two[np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(1) <= bits]
            a, b = [ids[near]], [ids[near + 1]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                i, j = link(sketches[s : s + n], bits)
                a.append(ids[s + i])
                b.append(ids[s + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return verify


def _complete(threshold: float):
    """Blocks of hot bands, (bucket, sig, sketch, root, rest): links of the ``rest`` rows to the rows of other groups."""
    bits = most_bits(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "bucket"):
            keys, ids, roots, rest = (table[c].to_numpy() for c in ("bucket", "sig", "root", "rest"))
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
            for s, e in zip(starts := np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), np.r_[starts[1:], len(keys)]):
                for p in np.flatnonzero(rest[s:e]) + s:
                    near = np.flatnonzero((np.bitwise_count(sketches[s:e] ^ sketches[p]).sum(1) <= bits) & (roots[s:e] != roots[p])) + s
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[p])), pa.array(ids[near])], ["a", "b"])

    return run


def _hot_edges(bands: DataFrame, sizes: DataFrame, sketches: DataFrame, edges: DataFrame, threshold: float, hot: int) -> DataFrame:
    """All links of the bands in ``sizes`` (band, n), over those that ``edges`` has: first inside salted blocks, then of what these leave apart."""
    blocks = F.ceil(F.col("n") / hot).cast("int")
    rows = bands.join(sizes.withColumn("m", blocks), "band").join(sketches, "sig")
    rows = materialize(rows.select("band", "m", F.pmod(F.xxhash64("sig", "band"), F.col("m")).cast("int").alias("block"), "sig", "sketch"), "hot")
    bucket = F.xxhash64("band", "block").alias("bucket")
    inside = rows.select(bucket, "sig", "sketch").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(threshold), "a long, b long")
    edges = materialize(edges.unionAll(inside), "links")
    groups = components(edges)
    rooted = materialize(rows.join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "rooted")
    size = rooted.groupBy("band", "root").count()
    largest = size.groupBy("band").agg(F.max(F.struct("count", "root")).alias("top")).select("band", F.col("top.root").alias("top"))
    marked = rooted.join(largest, "band").withColumn("rest", F.col("root") != F.col("top"))
    rest = marked.where("rest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    others = marked.where("NOT rest")
    both = rest.select(bucket, "sig", "sketch", "root", "rest").unionAll(others.select(bucket, "sig", "sketch", "root", "rest"))
    left = both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_complete(threshold), "a long, b long")
    return edges.unionAll(left)


def _near(docs: DataFrame, threshold: float, hot: int) -> DataFrame:
    """(doc_id, d1, keep_id) of every row in a group; d1 is its text's hash."""
    docs = with_ids(docs).where("doc_id IS NOT NULL")
    signed = materialize(lowered(docs.withColumn("d1", F.xxhash64("text")), "doc_id", "d1").mapInArrow(_sign, _SIGNED), "signed")
    # documents with equal samples have equal bands and sketches too: any of them will do
    same = signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    same = materialize(same, "same")
    bands = same.select(F.explode("bands").alias("band"), "sig")
    sketches = same.select("sig", "sketch")
    heavy = materialize(bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > hot), "heavy")
    usual = bands if heavy.isEmpty() else bands.join(hinted(heavy), "band", "left_anti")
    buckets = usual.repartition("band").sortWithinPartitions("band").mapInArrow(_buckets, "bucket long, size long, sig long").distinct()
    members = buckets.join(sketches, "sig").select("bucket", "sig", "sketch")
    edges = members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(threshold), "a long, b long")
    if not heavy.isEmpty():
        edges = _hot_edges(bands, hinted(heavy), sketches, edges, threshold, hot)
    groups = components(edges).withColumnRenamed("node", "sig")
    rooted = same.select("sig", "doc_id", "last").join(groups, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.max("last").alias("last")).where("keep_id < last")
    kept = materialize(rooted.join(first.select("root", "keep_id"), "root").select("sig", "keep_id"), "kept")
    return signed.join(hinted(kept), "sig").select("doc_id", "d1", "keep_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id) for every document in a group of near duplicates that isn't the group's first."""
    return _near(docs, threshold, hot).where("doc_id <> keep_id").select("doc_id", "keep_id").distinct()


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the least doc_id."""
    gone = materialize(_near(docs, threshold, hot).where("doc_id <> keep_id").select(F.col("doc_id").alias("gone_id"), F.col("d1").alias("gone_d1")).distinct(), "gone")
    gone = hinted(gone)
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_d1"]), "left_anti").select(*docs.columns)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
