"""Substring dedup over words and suffix-array dedup over bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from qapulse.llm import debruijn, induced, suffixes


def words_left(rows, window):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def bytes_left(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        flags = np.cumsum(gone[:-1]) > 0
        runs = int((np.diff(np.r_[0, flags.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~flags])
        out.append((d, len(t), int(flags.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]
BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("cut, left, columns, window", [
    (debruijn.cut_repeats, words_left, WORDS, 50), (suffixes.cut_repeats, bytes_left, BYTES, 200),
])
def test_messy_documents(messy, messy_rows, nothing, cut, left, columns, window):
    got = Counter(tuple(r) for r in cut(messy).select(*columns).collect())
    expected = left(messy_rows, window)
    assert sum(n * k[2] for k, n in expected.items()) > 0
    assert got == expected
    assert cut(nothing).select(*columns).collect() == []


def test_kept_text_is_that_of_the_digest(messy):
    rows = debruijn.cut_repeats(messy).where("kept_text is not null").collect()
    assert rows and all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)


@pytest.mark.parametrize("cut, left, columns, window", [
    (debruijn.cut_repeats, words_left, WORDS, 50), (suffixes.cut_repeats, bytes_left, BYTES, 200),
])
def test_small_table(documents_of, small_rows, cut, left, columns, window):
    got = Counter(tuple(r) for r in cut(documents_of(small_rows)).select(*columns).collect())
    assert got == left(small_rows, window)


def test_many_variants_of_one_passage(documents_of):
    """One source with a third of all rows: a passage that is cut off at every place."""
    chance = random.Random(3)
    passage = [f"w{chance.randrange(999)}" for _ in range(160)]
    rows = []
    for i in range(120):
        a, b = sorted(chance.sample(range(161), 2))
        rows.append((i, " ".join([f"x{i}"] * 20 + passage[a:b] + [f"y{i}"] * 20) if i % 3 == 0 else f"only {i}"))
    got = Counter(tuple(r) for r in debruijn.cut_repeats(documents_of(rows)).select(*WORDS).collect())
    assert got == words_left(rows, 50)
    got = Counter(tuple(r) for r in suffixes.cut_repeats(documents_of(rows)).select(*BYTES).collect())
    assert got == bytes_left(rows, 200)


@pytest.mark.parametrize("held", [2, 7, 10_000])
def test_induced_sorting(held):
    """Against sorting; small queues spill all the time."""
    chance = random.Random(held)
    for _ in range(150):
        kinds = chance.choice([1, 2, 3, 6])
        block = [chance.randint(1, kinds) for _ in range(chance.randint(1, 8))]
        text = []
        while len(text) < chance.randint(1, 70):
            text += block if chance.random() < 0.5 else [chance.randint(1, kinds)]
        text.append(0)
        most = chance.choice([3, 5, 50])
        order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)

        def common(a, b):
            n = 0
            while n < most and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            return n

        blocks = list(induced.suffixes(np.array(text), kinds + 1, most, held))
        positions, prefixes = (np.concatenate(x).tolist() for x in zip(*blocks))
        assert positions == order[: len(positions)] and len(positions) >= len(order) - 1
        assert prefixes == [0, *(common(a, b) for a, b in zip(positions, positions[1:]))]
