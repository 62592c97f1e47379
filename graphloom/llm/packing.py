"""Bound-certified best-fit packing of documents into training sequences.

A document of more than ``capacity`` words is cut into full pieces and a remainder; a
full piece is a sequence of its own. The others are packed by best-fit decreasing in
partitions of bounded size. Dual-feasible functions give a lower bound on each
partition's sequences; a partition that meets its bound is certified optimal. The
partitions with a gap exchange their documents (a new hash each round) and run again;
the new packing replaces theirs if it needs fewer sequences. The exchange ends when no two
partitions have a gap, when it gains nothing, or after ROUNDS; a gap that is left shows in the
result, as bins_in_part above lower_bound.

Defined results: a null or wordless text has no piece; repeated rows are packed each;
ties in length go to the lower doc_id, then the lower piece, then the earlier row; null
doc_ids are packed last among equal lengths; rows spread over the partitions by their place in
the table too, so many rows with one id or none fill no partition; ids are integers; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import materialize

from .tables import read, with_ids
from .text import Tokens, chunks

CAPACITY = 2048
PIECES_PER_PARTITION = 20_000
ROUNDS = 4


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size (given in decreasing order), and the number of bins. The fullest bin with room is taken, the newest among equals."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for i, s in enumerate(sizes.tolist()):
        m = mask >> s
        if m:
            room = s + (m & -m).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        rest = room - s
        if rest:
            free[rest].append(b)
            mask |= 1 << rest
    return bins, offsets, made


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual-feasible functions, in integer arithmetic."""
    if not len(sizes):
        return 0
    s, n = np.unique(sizes, return_counts=True)
    bound = -(-int((s * n).sum()) // capacity)
    for k in range(1, 101):  # u(k): rounds down to k-ths unless exact
        up = (k + 1) * s
        value = np.where(up % capacity == 0, s * k, up // capacity * capacity)
        bound = max(bound, -(-int((value * n).sum()) // (k * capacity)))
    for cut in s[s <= capacity // 2].tolist():  # U(cut): large ones count whole, small ones nothing
        value = np.where(s > capacity - cut, capacity, np.where(s >= cut, s, 0))
        bound = max(bound, -(-int((value * n).sum()) // capacity))
        small = capacity // cut  # phi(cut): counts of pieces of the size of cut
        value = np.where(2 * s > capacity, 2 * (small - (capacity - s) // cut), np.where(2 * s == capacity, small, 2 * (s // cut)))
        bound = max(bound, -(-int((value * n).sum()) // (2 * small)))
    return bound


_PACKED = "part long, doc_id long, row long, piece int, n_tokens int, bin long, bin_offset int, bins long, bound long"


def _pack(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["n_tokens"].to_numpy()
        bins, offsets, made = best_fit_decreasing(sizes, capacity)
        return pdf[["part", "doc_id", "row", "piece", "n_tokens"]].assign(bin=bins, bin_offset=offsets, bins=made, bound=lower_bound(sizes, capacity))

    return pack


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n): words of each document, split at white space, and its place in the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(Tokens(batch.column("text"), by_space=True).counts)], ["doc_id", "row", "n"])

    return with_ids(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(count, "doc_id long, row long, n long")


def pack(docs: DataFrame, capacity: int = CAPACITY, pieces_per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """A row for each piece: doc_id, piece, first_token, n_tokens, and its place: part, bin, bin_offset; with the part's bins and certified bound (bins_in_part, lower_bound)."""
    sized = lengths(docs).where("n > 0")
    pieces = sized.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    pieces = materialize(pieces.select("doc_id", "row", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_tokens")), "pieces")
    parts = max(1, -(-pieces.count() // pieces_per_partition))

    def arrange(df: DataFrame, n: int, turn: int) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(turn)), F.lit(n)).alias("part")
        return materialize(df.select(part, "doc_id", "row", "piece", "n_tokens").groupBy("part").applyInPandas(_pack(capacity), _PACKED), "packed")

    current = arrange(pieces, parts, 0)
    done: list[tuple[int, DataFrame]] = []
    for turn in range(1, rounds + 1):
        gaps = current.select("part", "bins", "bound").distinct().agg(F.count_if(F.col("bins") > F.col("bound")).alias("parts"), F.sum(F.when(F.col("bins") > F.col("bound"), F.col("bins"))).alias("bins")).head()
        if gaps["parts"] < 2:  # nobody to exchange with
            break
        open_ = current.where("bins > bound")
        again = arrange(open_, gaps["parts"], turn)
        made = again.select("part", "bins").distinct().agg(F.sum("bins")).head()[0]
        if made >= gaps["bins"]:
            break
        done.append((turn - 1, current.where("bins <= bound")))
        current = again
    done.append((len(done), current))
    out = None
    for turn, df in done:
        rows = df.select(
            "doc_id", "piece", (F.col("piece") * capacity).cast("long").alias("first_token"), "n_tokens", (F.col("part") + F.lit(turn * parts)).alias("part"), "bin", "bin_offset", F.col("bins").alias("bins_in_part"), F.col("bound").alias("lower_bound")
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
