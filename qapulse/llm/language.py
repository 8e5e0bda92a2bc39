"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a sample of its labelled text is built. A text is parsed greedily into
phrases, each the longest match with the sample; the language that needs the fewest phrases, normalised to bits
a character (phrases x log2(sample size) / characters), wins. All texts of a batch step through the automata together.

Every letter of the samples is a symbol of its own, whatever the script; letters that no sample has are one symbol, a phrase each.
Where alphabets are large the transitions of all automata lie in one table of about as many cells as there are transitions: a state's row is
shifted to where its cells are free, and a cell tells whose it is (row displacement). A missing transition ends the phrase and goes on from the root.

The sample is bounded: ``rows`` different texts a language, a stretch of ``chars`` characters of each; which texts, and where
in them, a hash of the text decides. Predictions read whole texts. Long texts are parsed in blocks of ``BLOCK`` characters side by side, each
from the root; then each block is parsed again with the state its predecessor really ended in, until both parses are in one state.
So phrases are those of one parse of the whole text. A learner's input are text and label alone; a prediction's is the text alone.

A text that is null or has no letter is ``und`` with score 0. Ties go to the language with more labelled texts, then by name.
Without any labelled text all is ``und``. Repeated rows are predicted alike; further columns pass through.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qapulse.llm import arrays
from qapulse.llm.shared import documents

ROWS, CHARS, BLOCK = 120, 400, 1024
#: Independent groups in which a language's sample is cut down before they meet.
SPREAD = 64
#: One sampled text in so many is held back from a language's automaton, and tells what its texts take; a text of ``LEAST_LETTERS`` or more
#: that takes over ``SLACK`` times the most of these is in none of the learned languages: prose with foreign parts takes 1.4 times as much, random letters three times.
HOLD, LEAST_LETTERS, SLACK = 5, 200, 2.0
#: Cells up to which every state and symbol has one: quicker for alphabets of some dozens of letters.
DENSE = 1 << 25
_GAP, _OTHER = 0, 1


def automaton(word: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of each state of the suffix automaton of a word, and suffix links."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in word:
        state = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in follow[at]:
            follow[at][symbol] = state
            at = link[at]
        if at >= 0:
            met = follow[at][symbol]
            if length[met] != length[at] + 1:
                copy = len(follow)
                follow.append(dict(follow[met]))
                length.append(length[at] + 1)
                link.append(link[met])
                while at >= 0 and follow[at].get(symbol) == met:
                    follow[at][symbol] = copy
                    at = link[at]
                link[met] = copy
                met = copy
            link[state] = met
        last = state
    return follow, link


class Model:
    """The automata of all languages in one displaced table. A cell holds the next state and how many phrases its step ends."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        """``samples``: (language, text), the preferred language first."""
        self.names = [name for name, *_ in samples]
        letters = sorted({c for _, text, *_ in samples for c in text.lower() if c.isalpha()})
        number = {letter: at for at, letter in enumerate(letters, 2)}
        self.width = len(letters) + 2
        self.symbol = np.array([number.get(chr(p).lower()[0], _OTHER) if chr(p).isalpha() else _GAP for p in range(sys.maxunicode + 1)], np.int32)
        rows, roots, bits, fallback = [], [], [], []
        for _, text, *_ in samples:
            word = self.squeezed(text).tolist()
            follow, _ = automaton(word)
            root = len(rows)
            # What a missing transition leads to: the phrase ends; a symbol the sample lacks is a phrase of its own.
            fallback.append([(root + follow[0][c]) << 2 | 1 if c in follow[0] else root << 2 | 2 for c in range(self.width)])
            rows += [{c: root + target for c, target in edges.items()} for edges in follow]
            roots.append(root)
            bits.append(np.log2(max(2, len(word))))
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)
        self.fallback = np.array(fallback, np.int32).reshape(len(samples), self.width)
        # At the root nothing is open that could end.
        self.at_root = np.array([[c - 1 if c & 3 else c for c in own] for own in fallback], np.int32).reshape(len(samples), self.width)
        self.dense = None
        if len(rows) * self.width <= DENSE:
            self._spread(rows)
        else:
            self._displace(rows)

    def _spread(self, rows: list[dict[int, int]]) -> None:
        """One cell for each state and symbol; states are numbered by the place of their first cell."""
        scale = self.width

        def placed(cells: np.ndarray) -> np.ndarray:
            return (cells >> 2) * scale << 2 | cells & 3

        table = np.empty((len(rows), scale), np.int32)
        for at, (begin, end) in enumerate(zip(self.roots.tolist(), [*self.roots[1:].tolist(), len(rows)])):
            table[begin:end] = placed(self.fallback[at])
            table[begin] = placed(self.at_root[at])
        states = np.repeat(np.arange(len(rows)), [len(edges) for edges in rows])
        symbols = np.array([c for edges in rows for c in edges], np.int64)
        table[states, symbols] = np.array([t for edges in rows for t in edges.values()], np.int64) * scale << 2
        self.dense, self.roots = table.ravel(), (self.roots * scale).astype(np.int32)

    def _displace(self, rows: list[dict[int, int]]) -> None:
        self.first = np.zeros(len(rows), np.int32)
        owners, places, targets = [], [], []
        taken, begin = bytearray(self.width), 0
        by_size = sorted(range(len(rows)), key=lambda state: -len(rows[state]))
        for state in (s for s in by_size if len(rows[s]) > 1):
            edges = sorted(rows[state])
            place = max(0, begin - edges[0])
            while True:
                if place + self.width > len(taken):
                    taken.extend(bytes(len(taken) + self.width))
                if not any(taken[place + c] for c in edges):
                    break
                place += 1
            # Where a row was long in finding room there is little left; single cells fill it later.
            begin = max(begin, place + edges[0] - 32)
            self.first[state] = place
            for c in edges:
                taken[place + c] = 1
                owners.append(state)
                places.append(place + c)
                targets.append(rows[state][c])
        alone = [s for s in by_size if len(rows[s]) == 1]
        taken.extend(bytes(len(alone) + self.width))
        free = np.flatnonzero(np.frombuffer(taken, np.uint8)[self.width :] == 0)[: len(alone)] + self.width
        self.first[alone] = free - np.array([next(iter(rows[s])) for s in alone], np.int64)
        owners, places, targets = np.r_[owners, alone], np.r_[places, free], np.r_[targets, [next(iter(rows[s].values())) for s in alone]]
        self.owner, self.cell = np.full(len(taken) + self.width, -1, np.int32), np.zeros(len(taken) + self.width, np.int32)
        self.owner[places.astype(np.int64)], self.cell[places.astype(np.int64)] = owners, targets.astype(np.int64) << 2

    def squeezed(self, text: str) -> np.ndarray:
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        kept = np.ones(len(symbols), bool)
        kept[1:] = (symbols[1:] != _GAP) | (symbols[:-1] != _GAP)
        return symbols[kept]

    def _step(self, language: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Cells of a step: the next state, shifted by two bits, and the phrases that end."""
        if self.dense is not None:
            return self.dense[state + symbol]
        place = self.first[state] + symbol
        cell = self.cell[place]
        missing = self.owner[place] != state
        language, symbol = (np.broadcast_to(x, state.shape)[missing] for x in (language, symbol))
        rooted = state[missing] == self.roots[language]
        cell[missing] = np.where(rooted, self.at_root[language, symbol], self.fallback[language, symbol])
        return cell

    def _parse(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended [language, part] in each part, parsed from the root, and the state it is left in."""
        order = np.argsort(-lengths, kind="stable")
        places = starts[order]
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
        language = np.arange(len(self.names))[:, None]
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        count = np.zeros((len(self.names), len(order)), np.int64)
        for step, n in enumerate(active.tolist()):
            cell = self._step(language, state[:, :n], symbols[places[:n] + step][None])
            count[:, :n] += cell & 3
            state[:, :n] = cell >> 2
        counts, states = np.empty_like(count), np.empty_like(state)
        counts[:, order], states[:, order] = count, state
        return counts, states

    def _meet(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, language: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part: how many more phrases end if it is entered in state ``entry`` instead of the root, and the state it is then
        left in, -1 if both parses meet."""
        more, left = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int32)
        going = np.flatnonzero(entry != self.roots[language])
        fresh, true = self.roots[language[going]], entry[going]
        step = 0
        while len(going):
            open_ = step < lengths[going]
            left[going[~open_]] = true[~open_]
            going, fresh, true = going[open_], fresh[open_], true[open_]
            symbol, own = symbols[starts[going] + step], language[going]
            one, two = self._step(own, fresh, symbol), self._step(own, true, symbol)
            more[going] += (two & 3) - (one & 3)
            fresh, true = one >> 2, two >> 2
            apart = fresh != true
            going, fresh, true = going[apart], fresh[apart], true[apart]
            step += 1
        return more, left

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases [language, row] of the rows of ``symbols`` that begin at ``bounds``."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        rows = np.repeat(np.arange(len(sizes)), blocks)
        at = arrays.runs_of(blocks)
        starts = bounds[rows] + at * BLOCK
        lengths = np.minimum(BLOCK, sizes[rows] - at * BLOCK)
        fresh, left = self._parse(symbols, starts, lengths)
        # Blocks after the first of their row are entered in the state the one before is left in. One round settles nearly all.
        more, after = np.zeros_like(fresh), left.copy()
        language, block = (x.ravel() for x in np.indices(left.shape))
        todo = np.flatnonzero(at[block] > 0)
        while len(todo):
            l, k = language[todo], block[todo]
            gained, met = self._meet(symbols, starts[k], lengths[k], l, after[l, k - 1])
            more[l, k] = gained
            exits = np.where(met < 0, left[l, k], met)
            changed = exits != after[l, k]
            after[l, k] = exits
            follows = changed & (k + 1 < len(rows))
            follows[follows] = rows[k[follows] + 1] == rows[k[follows]]
            todo = todo[follows] + 1
        counts = np.zeros((len(self.names), len(sizes)), np.int64)
        np.add.at(counts, (slice(None), rows), fresh + more)
        last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True]) if len(rows) else np.empty(0, np.int64)
        counts[:, rows[last]] += after[:, last] != self.roots[:, None]  # the phrase the row ends in
        return counts

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: und), score, bits a character and letters of each row."""
        buffer, offsets = arrays.text_bytes(column)
        symbols = self.symbol[np.frombuffer(buffer.tobytes().decode().encode("utf-32-le"), np.uint32)]
        bounds = np.r_[0, np.cumsum((buffer & 0xC0) != 0x80)][offsets]
        letters = np.diff(np.r_[0, np.cumsum(symbols != _GAP)][bounds])
        kept = np.ones(len(symbols), bool)
        kept[1:] = (symbols[1:] != _GAP) | (symbols[:-1] != _GAP)
        kept[bounds[bounds < len(symbols)]] = True  # a row's first symbol has no neighbour
        symbols, bounds = symbols[kept], np.r_[0, np.cumsum(kept)][bounds]
        sizes = np.diff(bounds)
        known = letters > 0
        if not len(self.names):
            return np.full(len(sizes), -1), np.zeros(len(sizes)), np.zeros(len(sizes)), letters
        entropy = self.phrases(symbols, bounds) * self.bits[:, None] / np.maximum(1, sizes)
        best = np.argmin(entropy, axis=0)
        least = entropy[best, np.arange(len(sizes))]
        rest = entropy.copy()
        rest[best, np.arange(len(sizes))] = np.inf
        second = rest.min(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(known, np.clip(1 - least / second, 0, 1), 0)
        return np.where(known, best, -1), score, np.where(known, least, 0), letters


def _model(samples: tuple[tuple, ...]) -> Model:
    return arrays.one_model(("languages", samples), lambda: Model(samples))


def learn(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> tuple[tuple[str, str, float], ...]:
    """(language, sample, most bits) of the labelled rows (text, lang) given, by number of different texts.

    At most ``rows`` keys, then stretches of ``chars`` characters, a language reach the driver. The most bits a character that a text of the
    language takes is read off held-back stretches; it is infinite for a language with fewer than ``HOLD`` long ones.
    """
    begin = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - chars + 1))
    stretch = F.substr(F.col("text"), begin.cast("int"), F.lit(chars))
    labelled = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), stretch.alias("part"))
    keys = labelled.groupBy("lang", "h").count()
    size = keys.groupBy("lang").agg(F.count("*").alias("n")).collect()
    least = keys.withColumn("group", F.pmod("h", F.lit(SPREAD)))
    for by in (["lang", "group"], ["lang"]):
        least = least.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("at") <= rows)
    picked = [(r.lang, r.h) for r in least.select("lang", "h").collect()]
    if not picked:
        return ()
    chosen = docs.sparkSession.createDataFrame(picked, "lang string, h bigint")
    parts = labelled.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("part").alias("part")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(parts, key=lambda r: r.h):
        texts.setdefault(r.lang, []).append(r.part)
    names = [r.lang for r in sorted(size, key=lambda r: (-r.n, r.lang))]
    held = {name: texts[name][HOLD - 1 :: HOLD] for name in names}
    samples = tuple((name, " ".join(t for at, t in enumerate(texts[name]) if at % HOLD != HOLD - 1)) for name in names)
    return tuple((name, text, most) for (name, text), most in zip(samples, _most_bits(samples, held)))


def _most_bits(samples: tuple[tuple[str, str], ...], held: dict[str, list[str]]) -> list[float]:
    model, out = Model(samples), []
    for at, (name, _) in enumerate(samples):
        words = [model.squeezed(text) for text in held[name] if sum(map(str.isalpha, text)) >= LEAST_LETTERS]
        if len(words) < HOLD:
            out.append(float("inf"))
            continue
        counts = model.phrases(np.concatenate(words), np.r_[0, np.cumsum([len(w) for w in words])])[at]
        out.append(SLACK * float((counts * model.bits[at] / [len(w) for w in words]).max()))
    return out


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """The rows with lang_pred, score (0 to 1: how much fewer bits than the second language), bits a character and
    n_letters; columns of these names are replaced. ``samples`` as :func:`learn` gives them."""
    made = ["lang_pred", "score", "bits", "n_letters"]
    kept = docs.select(*(docs[n] for n in docs.columns if n not in made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        names = np.array([*model.names, "und"], object)
        for batch in arrays.portions(batches):
            best, score, bits, letters = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(letters, pa.int64())],
                [*batch.schema.names, *made],
            )

    schema = T.StructType([*kept.schema, *T.StructType.fromDDL("lang_pred string, score double, bits double, n_letters bigint")])
    return kept.mapInArrow(run, schema)


def accepted(samples: tuple[tuple[str, str, float], ...]) -> Column:
    """Whether :func:`identify` found a learned language: a letter is there, and a text of ``LEAST_LETTERS`` or more takes
    no more bits a character than texts of that language do (``samples`` of :func:`learn`)."""
    most = F.lit(float("inf"))
    for name, _, bits in samples:
        most = F.when(F.col("lang_pred") == name, bits).otherwise(most)
    return (F.col("lang_pred") != "und") & ((F.col("n_letters") < LEAST_LETTERS) | (F.col("bits") <= most))


def verdicts(found: DataFrame, samples: tuple[tuple[str, str, float], ...]) -> DataFrame:
    """How many rows of :func:`identify` each language has, and how many of them are not accepted."""
    return found.groupBy("lang_pred").agg(F.count("*").alias("rows"), F.count_if(~accepted(samples)).alias("rejected"))


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id's digits leaves 2 on division by 4. No id: not held out, nor learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs.where(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
