"""Vectorised text helpers used inside tasks: words, rolling hashes, sliding minima.

All work on one batch of documents laid end to end, so a batch costs a fixed number of numpy calls whatever the
number of documents in it. Hashes are 64-bit polynomials of random byte values: they choose and group candidates;
operators whose result depends on equality compare digests of the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_held: dict = {}


def one_model(key: tuple, make: Callable):
    """A worker's model. Another one takes its place: a reused worker never holds two stages' tables."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept and grown."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for at, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x81DADEF4BC2DD44D)
    values ^= values >> np.uint64(33)
    return values


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`cut` takes the hash of any part."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _power(len(values))[0], out=sums[1:])
    return sums


def cut(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the parts [start, end); equal parts hash alike wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def byte_values(buffer: np.ndarray) -> np.ndarray:
    return _BYTES[buffer]


def gram_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values."""
    if len(values) < size:
        return np.empty(0, np.uint64)
    sums = prefix_hash(values)
    return mix((sums[size:] - sums[:-size]) * _power(len(sums) - size)[1])


def spans(buffer: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table ``inside`` holds; none crosses a row."""
    held = inside[buffer]
    cuts = offsets[(offsets > 0) & (offsets < len(buffer))]
    before, after = np.zeros_like(held), np.zeros_like(held)
    before[1:] = held[:-1]
    before[cuts] = False
    after[:-1] = held[1:]
    after[cuts - 1] = False
    return np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in each window of ``width``; the leftmost of equal ones.

    The order is that of the upper 32 bits, then the place: it depends on a window's content alone.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    keys = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(blocks, width)
    right = np.minimum.accumulate(table, axis=1).ravel()
    left = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(left[:count], right[width - 1 : width - 1 + count]) & low).astype(np.int64)


def run_bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.r_[starts[1:], len(values)]


def runs_of(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, laid end to end."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end (no copy), and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that working arrays stay small; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(text))[1])
        begin, held = 0, 0
        for at, size in enumerate(sizes):
            if at > begin and held + size > most:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        yield batch.slice(begin)


def owner(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row in whose bytes each place lies."""
    return np.searchsorted(offsets, places, "right") - 1


def anchored(values: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring windows of one row that share their anchor, the ``gram`` of least hash.

    Per run: the anchor's hash, the first window, and the number of windows. Equal windows have equal anchors, so they
    are found under the same hash; and no two windows of one run are equal.
    """
    if len(values) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = gram_hash(values, gram)
    anchor = sliding_argmin(grams, window - gram + 1)
    inside = row[: len(row) - window + 1] == row[window - 1 :]
    changed = np.empty(len(anchor), bool)
    changed[0] = True
    changed[1:] = (anchor[1:] != anchor[:-1]) | (row[1 : len(anchor)] != row[: len(anchor) - 1])
    starts = np.flatnonzero(changed)
    # Windows that leave their row are the last ones of it: they shorten or end its last run.
    counts = np.add.reduceat(inside, starts, dtype=np.int64)
    starts, counts = starts[counts > 0], counts[counts > 0]
    return grams[anchor[starts]], starts, counts
