"""External induced sorting of suffixes, with common prefixes up to a limit.

The string's S* substrings are named by rank; the string of names is sorted by recursion; then all suffixes are induced from the sorted
S* suffixes, first the L-type ones in ascending, then the S-type ones in descending order. What waits to be scanned
lies in priority queues that spill to disk, and every entry brings the length of its common prefix with the
entry before it: an induced pair's is one more than the least between its sources.

Over bytes (few symbols, many suffixes) the queue is one file-backed list a symbol, worked off in arrays. Over names (many
symbols, few suffixes) it is a heap with sorted runs on disk. Spill files are unlinked when opened, so a task
that is lost leaves nothing, and no other task reads them.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

from qapulse.llm import arrays

#: Entries a queue keeps in memory.
HELD = 16_000_000
_BLOCK = 1_000_000


class Lists:
    """A priority queue for few different keys: per key a first-in, first-out list of (position, prefix)."""

    def __init__(self, keys: int, held: int) -> None:
        self.parts: list[list] = [[] for _ in range(keys)]
        self.most, self.held, self.file = held, 0, None

    def push(self, key: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts[key].append((positions.astype(np.int32), prefixes.astype(np.uint16)))
        self.held += len(positions)
        if self.held > self.most:
            for parts in self.parts:
                parts[:] = [p if p[0] is None else self._spilled(*p) for p in parts]
            self.held = 0

    def _spilled(self, positions: np.ndarray, prefixes: np.ndarray) -> tuple[None, int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        place = self.file.seek(0, 2)
        self.file.write(positions.tobytes() + prefixes.tobytes())
        return None, place, len(positions)

    def _read(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """The parts end to end."""
        found = []
        for part in parts:
            if part[0] is None:
                self.file.seek(part[1])
                data = self.file.read(6 * part[2])
                part = np.frombuffer(data[: 4 * part[2]], np.int32), np.frombuffer(data[4 * part[2] :], np.uint16)
            found.append(part)
        return np.concatenate([p for p, _ in found]).astype(np.int64), np.concatenate([q for _, q in found]).astype(np.int64)

    @staticmethod
    def _size(part: tuple) -> int:
        return part[2] if part[0] is None else len(part[0])

    def drain(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The key's entries in order, also those pushed meanwhile; they stay readable by :meth:`backwards`."""
        at, parts = 0, self.parts[key]
        while at < len(parts):
            begin, count = at, 0
            while at < len(parts) and count < _BLOCK:
                count += self._size(parts[at])
                at += 1
            yield self._read(parts[begin:at])

    def backwards(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, parts = len(self.parts[key]), self.parts[key]
        while at:
            end, count = at, 0
            while at and count < _BLOCK:
                at -= 1
                count += self._size(parts[at])
            positions, prefixes = self._read(parts[at:end])
            yield positions[::-1], prefixes[::-1]


class Heap:
    """A priority queue of (key, position), first in, first out among equal keys; sorted runs go to disk.

    An item is one integer: key, number and position, 32 bits each for the latter two.
    """

    def __init__(self, held: int) -> None:
        self.most, self.count, self.items, self.runs = held, 0, [], []

    def push(self, key: int, position: int) -> None:
        self.count += 1
        heapq.heappush(self.items, (key << 64) | (self.count << 32) | position)
        if len(self.items) > self.most:
            file = tempfile.TemporaryFile()
            for item in sorted(self.items):
                file.write(item.to_bytes(16))
            file.seek(0)
            run = self._stored(file)
            self.items = []
            heapq.heappush(self.runs, (next(run), run))

    @staticmethod
    def _stored(file) -> Iterator[int]:
        while data := file.read(16 * 65536):
            for at in range(0, len(data), 16):
                yield int.from_bytes(data[at : at + 16])

    def least(self) -> int:
        """The smallest key; one larger than any if there is none."""
        if self.runs and (not self.items or self.runs[0][0] < self.items[0]):
            return self.runs[0][0] >> 64
        return self.items[0] >> 64 if self.items else 1 << 40

    def pop(self) -> int:
        if self.runs and (not self.items or self.runs[0][0] < self.items[0]):
            item, run = heapq.heappop(self.runs)
            following = next(run, None)
            if following is not None:
                heapq.heappush(self.runs, (following, run))
            return item & 0xFFFFFFFF
        return heapq.heappop(self.items) & 0xFFFFFFFF


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one (S), and how often its first symbol repeats."""
    starts, ends = arrays.run_bounds(text)
    rising = np.ones(len(starts), bool)
    rising[:-1] = text[starts[1:]] > text[starts[:-1]]
    sizes = ends - starts
    return np.repeat(rising, sizes), np.repeat(ends, sizes) - np.arange(len(text))


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of pairs of suffixes, at most ``most``."""
    room = np.minimum(len(sums) - 1 - np.maximum(a, b), most)
    low, high = np.zeros(len(a), np.int64), room.astype(np.int64)
    while np.any(low < high):
        middle = (low + high + 1) // 2
        same = arrays.cut(sums, a, a + middle) == arrays.cut(sums, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Rank of each S* substring; where one begins another, the longer is smaller."""
    ends = np.r_[stars[1:] + 1, len(text)]
    _, one, back = np.unique(arrays.cut(arrays.prefix_hash(text.astype(np.uint64) + np.uint64(1)), stars, ends), return_index=True, return_inverse=True)
    raw = text.astype(">u4").tobytes()
    keys = [raw[4 * a : 4 * b] + b"\xff\xff\xff\xff" for a, b in zip(stars[one].tolist(), ends[one].tolist())]
    rank = np.empty(len(keys), np.int64)
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    return rank[back]


def _sorted_stars(text: np.ndarray, stars: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The S* suffixes in order, as numbers, and their names."""
    names = _names(text, stars)
    if int(names.max(initial=0)) + 1 == len(names):
        return np.argsort(names), names
    return _sort_names(names, held), names


def _sort_names(text: np.ndarray, held: int) -> np.ndarray:
    """Suffix order of a string of names, whose last one is unique and least."""
    small, _ = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, _ = _sorted_stars(text, stars, held)
    symbols, is_small = text.tolist(), small.tolist()
    waiting = Heap(held)
    push, pop, least = waiting.push, waiting.pop, waiting.least
    falling: list[int] = []

    def fall(limit: int) -> None:
        while least() <= limit:
            position = pop()
            falling.append(position)
            if position and symbols[position - 1] >= symbols[position]:
                push(symbols[position - 1], position - 1)

    for star in stars[order].tolist():
        fall(symbols[star])
        push(symbols[star - 1], star - 1)
    most = max(symbols)
    fall(most)

    # Descending: keys are counted from the largest symbol.
    waiting = Heap(held)
    push, pop, least = waiting.push, waiting.pop, waiting.least
    rising: list[int] = []

    def rise(limit: int) -> None:
        while least() <= limit:
            position = pop()
            rising.append(position)
            if position and is_small[position - 1]:
                push(most - symbols[position - 1], position - 1)

    for position in reversed(falling):
        rise(most - symbols[position])
        if position and is_small[position - 1]:
            push(most - symbols[position - 1], position - 1)
    rise(most)
    # The last symbol has no successor: it is first of all.
    rising = [p for p in rising if p != len(symbols) - 1]
    every = np.array([len(symbols) - 1, *falling, *reversed(rising)], np.int64)
    return every[np.argsort(text[every], kind="stable")]


class _Least:
    """Least prefix between entries of a block, any two of them."""

    def __init__(self, prefixes: np.ndarray) -> None:
        self.levels = [prefixes.astype(np.uint16)]
        width = 1
        while 2 * width <= len(prefixes):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def between(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Over [begin, end), none of them empty."""
        level = np.frexp((ends - begins).astype(np.float64))[1] - 1
        out = np.empty(len(begins), np.int64)
        for at in np.unique(level).tolist():
            some = level == at
            held = self.levels[at]
            out[some] = np.minimum(held[begins[some]], held[ends[some] - (1 << at)])
        return out


class _Inducer:
    """Feeds scanned blocks' predecessors to a queue, with common prefixes."""

    def __init__(self, text: np.ndarray, queue: Lists, symbols: int, most: int) -> None:
        self.text, self.queue, self.most = text, queue, most
        self.since = np.full(symbols, -1, np.int64)  # least prefix since a symbol's last push; -1: none yet

    def scan(self, positions: np.ndarray, prefixes: np.ndarray, induced: np.ndarray) -> None:
        """``induced``: predecessors to push, as places in this block."""
        least = _Least(prefixes)
        before = positions[induced] - 1
        symbols = self.text[before].astype(np.int64)
        order = np.argsort(symbols, kind="stable")
        induced, before, symbols = induced[order], before[order], symbols[order]
        starts, ends = arrays.run_bounds(symbols)
        begins = np.empty(len(induced), np.int64)
        begins[1:] = induced[:-1] + 1
        begins[starts] = 0
        gap = least.between(begins, induced + 1) if len(induced) else begins
        keys = symbols[starts]
        old = self.since[keys]
        prefix = np.minimum(gap + 1, self.most)
        prefix[starts] = np.where(old < 0, 0, np.minimum(np.minimum(gap[starts], old) + 1, self.most))
        whole = int(prefixes.min())
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, whole))
        last = induced[ends - 1] if len(ends) else ends
        rest = np.full(len(keys), self.most, np.int64)
        open_ = last + 1 < len(positions)
        if open_.any():
            rest[open_] = least.between(last[open_] + 1, np.full(int(open_.sum()), len(positions)))
        self.since[keys] = rest
        for key, a, b in zip(keys.tolist(), starts.tolist(), ends.tolist()):
            self.queue.push(key, before[a:b], prefix[a:b])


def suffixes(text: np.ndarray, symbols: int, most: int, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, prefixes) that are the suffix array back to front; a prefix is that with the suffix before it
    in this (descending) order, at most ``most``. ``text`` ends with its least symbol, which occurs once."""
    small, repeat = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, names = _sorted_stars(text, stars, held)
    sums = arrays.prefix_hash(names.astype(np.uint64) + np.uint64(1))
    ranked = stars[order]
    # Equal names first, symbol by symbol in the first different ones.
    equal = _common(sums, order[:-1], order[1:], most)
    reach = np.minimum(np.r_[stars, len(text)][np.minimum(order[:-1] + equal, len(stars))] - ranked[:-1], most)
    while True:
        a, b = ranked[:-1] + reach, ranked[1:] + reach
        open_ = np.flatnonzero((reach < most) & (np.maximum(a, b) < len(text)))
        open_ = open_[text[a[open_]] == text[b[open_]]]
        if not len(open_):
            break
        reach[open_] += 1
    star_prefix = np.r_[0, reach]
    first = text[ranked]
    bounds = np.searchsorted(first, np.arange(symbols + 1))

    falling = Lists(symbols, held)
    down = _Inducer(text, falling, symbols, most)
    for key in range(symbols):
        last = -1
        for positions, prefixes in falling.drain(key):
            last = int(positions[-1])
            some = np.flatnonzero(positions > 0)
            down.scan(positions, prefixes, some[text[positions[some] - 1] >= key])
        for begin in range(int(bounds[key]), int(bounds[key + 1]), _BLOCK):
            positions = ranked[begin : min(begin + _BLOCK, int(bounds[key + 1]))]
            prefixes = star_prefix[begin : begin + len(positions)].copy()
            if begin == bounds[key]:
                prefixes[0] = min(most, repeat[last], repeat[positions[0]]) if last >= 0 else 0
            down.scan(positions, prefixes, np.arange(len(positions)))

    rising = Lists(symbols, held)
    up = _Inducer(text, rising, symbols, most)
    for key in range(symbols - 1, -1, -1):
        last = -1
        for positions, prefixes in rising.drain(key):
            last = int(positions[-1])
            yield positions, prefixes
            some = np.flatnonzero(positions > 0)
            up.scan(positions, prefixes, some[small[positions[some] - 1]])
        following = None
        for positions, prefixes in falling.backwards(key):
            # Each entry's prefix is that with the one before it in ascending order: move them on by one.
            seam = (min(most, int(repeat[last]), int(repeat[positions[0]])) if last >= 0 else 0) if following is None else following
            moved = np.r_[seam, prefixes[:-1]]
            following = int(prefixes[-1])
            yield positions, moved
            some = np.flatnonzero(positions > 0)
            up.scan(positions, moved, some[small[positions[some] - 1]])
