"""Vectorised tokenising and hashing over Arrow string buffers.

A token is a maximal run of ASCII letters and digits and of non-ASCII characters,
lower-cased. In SQL: ``regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')``.
Batches are cut by bytes, never by dropping text: one long document is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        n = max(n, CHUNK_BYTES + (1 << 16))
        for name, base in (("p", _P), ("q", _PI)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text, one row at least."""
    for batch in batches:
        offsets, _ = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; a null row is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    _, off, data = column.buffers()
    if off is None or off.size == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        lengths = np.diff(offsets)
        if lengths[~valid].any():  # bytes below a null: drop them
            return buffers(column.fill_null(""))
    return offsets, raw


class Tokens:
    """Tokens of a column: byte spans, 64-bit hashes, and each document's token range."""

    def __init__(self, column: pa.Array, by_space: bool = False):
        offsets, raw = buffers(column)
        base = offsets[0]
        self.data = data = raw[base : offsets[-1]]
        self.offsets = offsets - base
        n = len(data)
        inside = ~_SPACE[data] if by_space else _WORD[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def words(self, a: int, b: int) -> list[bytes]:
        raw = self.data.tobytes() if b - a > 64 else None
        pick = (lambda s, e: raw[s:e]) if raw is not None else (lambda s, e: self.data[s:e].tobytes())
        return [pick(s, e) for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the bytes."""
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hash(word: str) -> int:
    return int(Tokens(pa.array([word])).hashes[0])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n tokens from each position on; the last n - 1 positions are missing."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + m]
    return mix(out)


def shingles(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents and each one's bounds. A document of 1 to n - 1 tokens has one shingle: all of it."""
    counts = tokens.counts
    grams = ngrams(tokens.hashes, n)
    short = (counts > 0) & (counts < n)
    per = np.where(counts >= n, counts - n + 1, short.astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(bounds[-1], np.uint64)
    full = np.repeat(counts >= n, per)
    at = np.repeat(tokens.bounds[:-1] - bounds[:-1], per) + np.arange(bounds[-1])
    out[full] = grams[at[full]]
    for i in np.flatnonzero(short):
        a, b = tokens.bounds[i], tokens.bounds[i + 1]
        out[bounds[i]] = ngrams(tokens.hashes[a:b], int(b - a))[0]
    return out, bounds
