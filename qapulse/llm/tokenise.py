"""Token ids of many texts by the tokenizers library, each different piece encoded once per worker.

The vocabulary's normaliser and splitter never join what white space parts, so a text's ids are those of its chunks in a
row. A chunk of ASCII and Latin-1 letters, digits and marks is cut further where the splitter cuts (letter runs,
single digits, runs of marks); any other chunk (an apostrophe, ``<``, a letter beyond Latin-1, control
characters) is encoded whole. Pieces are looked up by hash in a table of bounded size; unknown ones go to the library.

The rules hold for vocabularies with this normaliser and splitter; others are encoded text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from qapulse.llm import arrays

#: Pieces a worker remembers before it starts anew, and the longest piece it remembers.
KEPT, LONGEST = 1_000_000, 64
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_GAP, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)
_CLASS = np.full(256, _WHOLE, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[list(b"'<")] = _WHOLE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[list(b" \t\n\r")] = _GAP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class _Table:
    """Open addressing from hash to entry number."""

    def __init__(self) -> None:
        self.bits = (2 * KEPT - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entries = np.zeros(1 << self.bits, np.int32)
        self.held = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.entries[slots], -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[open_]]
            right = held == keys[open_]
            found[open_[right]] = self.entries[slots[open_[right]]]
            open_ = open_[~right & (held != 0)]
        return found

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Add keys that are different and not yet there; the caller leaves slots free (``held`` is at most ``KEPT``)."""
        self.held += len(keys)
        slots, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slots[rest]] == 0]
            _, one = np.unique(slots[free], return_index=True)
            free = free[one]
            self.keys[slots[free]] = keys[free]
            self.entries[slots[free]] = entries[free]
            rest = rest[self.keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & (len(self.keys) - 1)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        kinds = [x["type"] for x in (held["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (held["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.parts = kinds == _NORMALISERS and splits == [_SPLIT, None] and held["model"].get("end_of_word_suffix") == "</w>"
        if self.parts:
            ends = [i for token, i in held["model"]["vocab"].items() if token.endswith("</w>")]
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            self.ends[ends] = True
        self._clear()

    def _clear(self) -> None:
        self.table = _Table()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.offsets, self.lengths, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0

    def _grown(self, held: np.ndarray, size: int) -> np.ndarray:
        return held if size <= len(held) else np.concatenate([held, np.empty(max(size, len(held)), held.dtype)])[: max(size, 2 * len(held))]

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Entry numbers of new pieces whose ids lie end to end."""
        self.flat = self._grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        upto = self.count + len(lengths)
        self.offsets, self.lengths = self._grown(self.offsets, upto), self._grown(self.lengths, upto)
        self.lengths[self.count : upto] = lengths
        self.offsets[self.count : upto] = self.used + np.cumsum(lengths) - lengths
        entries = np.arange(self.count, upto, dtype=np.int32)
        self.used, self.count = self.used + len(ids), upto
        return entries

    def _encode(self, pieces: list[str], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end and their counts; ``single`` pieces are one word, so many share a call."""
        lengths = np.empty(len(pieces), np.int64)
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(pieces)
        ones, others = np.flatnonzero(single), np.flatnonzero(~single)
        for at, found in zip(others.tolist(), self.library.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)):
            parts[at] = np.asarray(found.ids, np.uint32)
        for begin in range(0, len(ones), 256):
            group = ones[begin : begin + 256].tolist()
            ids = np.asarray(self.library.encode(" ".join([pieces[i] for i in group]), add_special_tokens=False).ids, np.uint32)
            for at, own in zip(group, np.split(ids, np.flatnonzero(self.ends[ids])[:-1] + 1)):
                parts[at] = own
        lengths[:] = [len(x) for x in parts]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), lengths

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and where each row's begin; null is empty."""
        if not self.parts:
            found = self.library.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)
            lengths = np.array([len(x.ids) for x in found], np.int64)
            ids = np.concatenate([np.empty(0, np.uint32), *(np.asarray(x.ids, np.uint32) for x in found)])
            return ids, np.r_[0, np.cumsum(lengths)]
        buffer, offsets = arrays.text_bytes(column)
        if not len(buffer):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        buffer = _LOWER[buffer]
        kind = _CLASS[buffer]
        # Two-byte letters from U+00C0 to U+00FF, but for the signs U+00D7 and U+00F7.
        lead = np.flatnonzero(buffer[:-1] == 0xC3)
        lead = lead[(buffer[lead + 1] != 0x97) & (buffer[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        odd = np.flatnonzero(kind == _WHOLE)
        inside = np.array([False, True, True, True, True])
        if len(odd):  # the chunks they stand in become one piece
            starts, ends = arrays.spans(kind, inside, offsets)
            hit = np.unique(np.searchsorted(starts, odd, "right") - 1)
            lengths = ends[hit] - starts[hit]
            kind[np.repeat(starts[hit], lengths) + arrays.runs_of(lengths)] = _WHOLE
        edge = np.empty(len(kind), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == _DIGIT
        edge[offsets[offsets < len(kind)]] = True
        starts = np.flatnonzero(edge)
        ends = np.r_[starts[1:], len(kind)]
        held = kind[starts] != _GAP
        starts, ends = starts[held], ends[held]
        hashes = arrays.cut(arrays.prefix_hash(arrays.byte_values(buffer)), starts, ends) | np.uint64(1)
        long = ends - starts > LONGEST
        hashes[long] = np.arange(2, 2 + 2 * int(long.sum()), 2, dtype=np.uint64)  # even: each its own, never remembered
        if self.count > KEPT:
            self._clear()
        entries = self.table.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            new, one, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            one = missing[one]
            text = buffer.tobytes()
            pieces = [text[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            made = self._add(*self._encode(pieces, kind[starts[one]] != _WHOLE))
            entries[missing] = made[back]
            kept = np.flatnonzero(new & np.uint64(1))[: KEPT - self.table.held]  # the others serve this batch only
            self.table.put(new[kept], made[kept])
        lengths = self.lengths[entries].astype(np.int64)
        ids = self.flat[np.repeat(self.offsets[entries], lengths) + arrays.runs_of(lengths)]
        return ids, np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    return arrays.one_model(("tokens", path), lambda: Encoder(path))


def vocabulary(path: str | None) -> str:
    """The installed word-level vocabulary unless another file, which every executor has, is named."""
    import public_tokenizers

    return path or public_tokenizers.path("word_bpe_49k.json")
