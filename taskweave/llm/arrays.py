"""Numpy helpers used inside tasks: batches of texts, ragged gathers, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd multipliers; a sequence hash is sum(x[i] * BASE**i) mod 2**64, mixed.
BASE = 0x9E3779B97F4A7C15
# Characters (code points) that a task holds as arrays at once, about 40 bytes each.
CHUNK = 400_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.inverse = pow(BASE, -1, 1 << 64)
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


POWERS = Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of ``values[i] * BASE**i``, with a zero in front."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end), equal wherever its values are equal."""
    _, down = POWERS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i]+1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(BASE))


BYTES = byte_values()


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words, i.e. the runs without \\x20 and \\x09-\\x0D, of UTF-8 bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~SPACES[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words of UTF-8 bytes and a 64-bit hash of each word."""
    starts, ends = word_spans(data)
    return starts, ends, span_hashes(prefix_sums(BYTES[data]), starts, ends)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of record batches, so that few rows at a time become Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def chunks(sizes: Iterable[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``limit`` size each, or one long text."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, i + 1
