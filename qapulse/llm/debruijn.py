"""Substring dedup over words by de Bruijn compaction.

Words are ``[^\\x20\\x09-\\x0D]+``. A window of ``window`` words is an edge between the two sequences of one word fewer;
neighbouring windows of a text form a path. Paths are compacted where they do not branch: all neighbouring windows
that share an anchor (the run of ``gram`` words of least hash in them) are one piece, equal pieces are one row wherever they
occur, and pieces of an anchor that meets no second document leave at once. Source coordinates then verify and
cut: a piece that also occurs in a document of smaller id is repeated as a whole; where an anchor has several different
pieces, the path branches, and each piece is read again at its first source and opened into its windows, which
meet by digest. Pieces and windows compare by 128-bit digests of their words, not by rolling hashes.

Removed are the words under any window whose words also start in a document with a smaller doc_id. Null and empty texts,
and those of fewer words than a window, keep all words. Rows of one doc_id are one document for that rule, and each gets its own result;
rows without doc_id neither lose words nor make others lose any. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qapulse.llm import arrays
from qapulse.llm.shared import documents, perhaps_in, same, stash, text_key

WINDOW, GRAM = 50, 16

_SPACE = np.zeros(256, bool)
_SPACE[0x20] = _SPACE[0x09:0x0E] = True
_FLAT = np.where(_SPACE, 0x20, np.arange(256)).astype(np.uint8)


class Words:
    """Words of a column of texts, with one space between neighbours."""

    def __init__(self, column: pa.Array) -> None:
        buffer, offsets = arrays.text_bytes(column)
        space = _SPACE[buffer]
        kept = np.ones(len(buffer), bool)
        kept[1:] = ~(space[1:] & space[:-1])
        self.bytes = _FLAT[buffer[kept]]
        self.offsets = np.r_[0, np.cumsum(kept)][offsets]
        self.starts, self.ends = arrays.spans(self.bytes, ~_SPACE, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text = self.bytes.tobytes()

    def joined(self, first: int, last: int) -> bytes:
        """Words first..last-1 of one row."""
        return self.text[self.starts[first] : self.ends[last - 1]] if first < last else b""

    def digests(self, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Two longs for each run of words."""
        if not len(begins):
            return np.empty((0, 2), np.int64)
        text = self.text
        made = [
            hashlib.blake2b(text[a:b], digest_size=16).digest()
            for a, b in zip(self.starts[begins].tolist(), self.ends[begins + sizes - 1].tolist())
        ]
        return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def _pieces(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.portions(batches):
            words = Words(batch.column("text"))
            values = arrays.cut(arrays.prefix_hash(arrays.byte_values(words.bytes)), words.starts, words.ends)
            row = np.repeat(np.arange(batch.num_rows), words.counts)
            anchor, begins, counts = arrays.anchored(values, row, window, gram)
            digests = words.digests(begins, counts + window - 1)
            pieces = pa.StructArray.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.array((begins - words.first[row[begins]]).astype(np.int32)), pa.array(counts.astype(np.int32)),
                ],
                ["anchor", "high", "low", "start", "n"],
            )
            places = np.searchsorted(begins, words.first).astype(np.int32)
            names = [n for n in batch.schema.names if n != "text"]
            whole = [
                hashlib.sha256(words.joined(a, b)).hexdigest() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(words.counts), pa.array(whole), pa.ListArray.from_arrays(pa.array(places), pieces)],
                [*names, "n_words", "whole_sha256", "pieces"],
            )

    return run


def _opened(window: int) -> Callable:
    """The windows of the pieces (start, n) that a text's row lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.portions(batches):
            words = Words(batch.column("text"))
            listed = batch.column("pieces")
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            start, n = (np.asarray(listed.flatten().field(f), np.int64) for f in ("start", "n"))
            at = np.repeat(start, n) + arrays.runs_of(n)
            row = np.repeat(row, n)
            digests = words.digests(words.first[row] + at, np.full(len(at), window))
            names = [c for c in batch.schema.names if c not in ("text", "pieces")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row)) for c in names), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(at.astype(np.int32))],
                [*names, "high", "low", "start"],
            )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of the texts without the words under their cuts (start, size)."""
    for batch in arrays.portions(batches):
        words = Words(batch.column("text"))
        listed = batch.column("cuts")
        row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
        start, size = (np.asarray(listed.flatten().field(f), np.int64) for f in ("start", "size"))
        start = start + words.first[row]
        depth = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + size, -1)
        gone = np.cumsum(depth[:-1]) > 0
        texts = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            texts.append(b" ".join([words.joined(a + s, a + e) for s, e in zip(*_runs(~gone[a:b]))]).decode())
        removed = np.diff(np.r_[0, np.cumsum(gone)][words.first])
        names = [c for c in batch.schema.names if c not in ("text", "cuts")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(removed), pa.array(texts, pa.string())], [*names, "n_removed", "kept_text"]
        )


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts): doc_id, text_key, n_words and whole_sha256 of every row; and for texts that repeat an earlier
    document, doc_id, text_key and cuts (array of start, size in words, which may overlap). ``docs`` needs doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    piece = "array<struct<anchor:bigint,high:bigint,low:bigint,start:int,n:int>>"
    found = stash(
        docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
            _pieces(window, gram), f"doc_id {kind}, text_key bigint, n_words bigint, whole_sha256 string, pieces {piece}"
        ),
        "pieces",
    )
    pieces = found.where("size(pieces) > 0 and doc_id is not null").select("doc_id", "text_key", F.explode("pieces").alias("p")).select("doc_id", "text_key", "p.*")

    # Anchors that one document holds alone are most of them and end here.
    anchors = pieces.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    anchors = stash(anchors.where("least < most").select("anchor"), "anchors")
    pieces = stash(perhaps_in(pieces, F.col("anchor"), anchors, F.col("anchor"), 26).join(anchors, "anchor", "left_semi"), "shared-pieces")
    paths = pieces.groupBy("anchor", "high", "low").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    paths = stash(paths, "paths")
    branches = paths.groupBy("anchor").agg(F.count("*").alias("paths")).where("paths > 1").select("anchor")
    # What matters of a path: it is met again after its source, or it branches.
    paths = paths.join(branches.withColumn("branches", F.lit(True)), "anchor", "left").where("source < last or branches")
    paths = stash(paths.select("high", "low", "source", F.coalesce("branches", F.lit(False)).alias("branches")), "open-paths")
    placed = stash(pieces.join(paths, ["high", "low"]).where("doc_id > source or branches"), "placed")
    whole = placed.where("doc_id > source").select("doc_id", "text_key", "start", (F.col("n") + window - 1).alias("size"))

    opened = placed.where("doc_id = source").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("pieces"))
    opened = stash(opened, "branching")
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")

    def with_text(rows: DataFrame) -> DataFrame:
        near = perhaps_in(texts, F.col("doc_id"), rows, F.col("doc_id"))
        return rows.join(near, same(rows, near, "doc_id", "text_key")).select(*(rows[c] for c in rows.columns), near["text"])

    windows = stash(with_text(opened).mapInArrow(_opened(window), f"doc_id {kind}, text_key bigint, high bigint, low bigint, start int"), "windows")
    first = windows.groupBy("high", "low").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    first = stash(first.where("source < last").drop("last"), "sources")
    single = windows.join(first, ["high", "low"]).where("doc_id > source").select("doc_id", "text_key", "start", F.lit(window).alias("size"))
    cuts = whole.unionByName(single).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))
    return found.drop("pieces"), with_text(stash(cuts, "cuts"))


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_sha256, and kept_text where something was removed (else null)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found, cuts = repeated_words(docs, window, gram)
    cut = cuts.mapInArrow(_kept, f"doc_id {kind}, text_key bigint, n_removed bigint, kept_text string").dropDuplicates(["doc_id", "text_key"])
    return found.join(cut, same(found, cut, "doc_id", "text_key"), "left").select(
        found.doc_id, found.text_key, "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.sha2("kept_text", 256), "whole_sha256").alias("kept_sha256"), "kept_text",
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
