"""Suffix-array dedup over bytes by external induced sorting.

A string of ``window`` bytes that starts twice anywhere, also within one document, is repeated. Neighbouring windows that share
their anchor (the ``gram`` bytes of least hash in them) form a piece; equal windows have equal anchors. Pieces
whose anchor occurs once leave at once, equal pieces are one row, and a piece that occurs twice is repeated as a whole.
Only pieces that share an anchor but differ remain: they are dealt to shards by anchor, and each shard's suffixes are
sorted by :mod:`qapulse.llm.induced`, whose queues spill to disk. Two neighbours in that order with ``window`` common
bytes are repeated windows.

Texts are taken as UTF-8; matches never cross documents; strings are judged on the input. Null and empty texts have no bytes. Each row is
a document, so repeated rows repeat each other. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qapulse.llm import arrays, induced
from qapulse.llm.shared import documents, perhaps_in, same, stash, text_key

WINDOW, GRAM = 200, 64
#: Bytes of text in a shard, about, and ranges of windows looked at on their own before a shard is sorted.
SHARD, STEPS = 2_000_000, 8


def _pieces(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.portions(batches):
            buffer, offsets = arrays.text_bytes(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            anchor, begins, counts = arrays.anchored(arrays.byte_values(buffer), row, window, gram)
            text = buffer.tobytes()
            made = [
                hashlib.blake2b(text[a:b], digest_size=8).digest() for a, b in zip(begins.tolist(), (begins + counts + window - 1).tolist())
            ]
            digests = np.frombuffer(b"".join(made), np.int64)
            pieces = pa.StructArray.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(digests),
                    pa.array((begins - offsets[row[begins]]).astype(np.int32)), pa.array(counts.astype(np.int32)),
                ],
                ["anchor", "digest", "start", "n"],
            )
            places = np.searchsorted(begins, offsets).astype(np.int32)
            whole = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(np.diff(offsets)), pa.array(whole), pa.ListArray.from_arrays(pa.array(places), pieces)],
                [*names, "n_bytes", "whole_sha256", "pieces"],
            )

    return run


def _contents(window: int) -> Callable:
    """The bytes of the pieces (anchor, start, n, once) that a text's row lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.portions(batches):
            buffer, offsets = arrays.text_bytes(batch.column("text"))
            text, listed = buffer.tobytes(), batch.column("pieces")
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            pieces = listed.flatten()
            start, n = (np.asarray(pieces.field(f), np.int64) for f in ("start", "n"))
            begins = offsets[row] + start
            contents = [text[a:b] for a, b in zip(begins.tolist(), (begins + n + window - 1).tolist())]
            names = [c for c in batch.schema.names if c not in ("text", "pieces")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row)) for c in names), *(pieces.field(f) for f in ("anchor", "start", "n", "once")), pa.array(contents, pa.binary())],
                [*names, "anchor", "start", "n", "once", "content"],
            )

    return run


def _possible(data: np.ndarray, anchor: np.ndarray, n: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece begins in ``data``, and its windows (first, number) that another piece can share.

    Windows are taken in ``STEPS`` ranges of their anchor's place in them. All windows of a range hold the same core around the
    anchor; where no other piece has that core, no other piece has any of them.
    """
    sizes = n + window - 1
    begin = np.cumsum(sizes) - sizes
    grams = arrays.gram_hash(arrays.byte_values(data), gram)
    place = np.flatnonzero(grams == np.repeat(anchor.view(np.uint64), sizes)[: len(grams)])
    # The first match that leaves room in its piece; it is the same place of the content in every piece of the anchor.
    piece = np.searchsorted(begin, place, "right") - 1
    inside = place + gram <= begin[piece] + sizes[piece]
    place, piece = place[inside], piece[inside]
    _, one = np.unique(piece, return_index=True)
    at = place[one] - begin
    sums = arrays.prefix_hash(arrays.byte_values(data))
    rest = window - gram
    step = -(-(rest + 1) // STEPS)
    first, last = n.copy(), np.zeros_like(n)
    for low in range(0, rest + 1, step):
        high = min(low + step - 1, rest)
        ids = np.flatnonzero((at >= low) & (at + gram + rest - high <= sizes))
        start = begin[ids] + at[ids] - low
        key = arrays.mix(arrays.cut(sums, start, start + window - (high - low)) + anchor[ids].view(np.uint64))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        ids = ids[count[back] > 1]
        first[ids] = np.minimum(first[ids], np.maximum(0, at[ids] - high))
        last[ids] = np.maximum(last[ids], np.minimum(n[ids], at[ids] - low + 1))
    return begin, first, np.maximum(0, last - first)


def _shard(window: int, gram: int) -> Callable:
    """Repeated windows (start, size in bytes) of the pieces that occur once, by sorting all of a shard's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        data = np.frombuffer(b"".join(b"".join(b.column("content").to_pylist()) for b in held), np.uint8)
        keys = pa.Table.from_batches(held).drop_columns(["content"]).combine_chunks()
        del held
        begin, first, n = _possible(data, keys["anchor"].to_numpy(), keys["n"].to_numpy().astype(np.int64), window, gram)
        sizes = np.where(n > 0, n + window - 1, 0)
        # Symbols: 0 ends the shard, 1 ends a piece, bytes follow.
        places = np.arange(sizes.sum()) + np.repeat(np.arange(len(n)), sizes)
        text = np.ones(int(sizes.sum()) + len(n) + 1, np.uint16)
        text[places] = data[np.repeat(begin + first, sizes) + arrays.runs_of(sizes)].astype(np.uint16) + 2
        text[-1] = 0
        del data, places
        begins = np.cumsum(sizes + 1) - sizes - 1
        repeated = np.zeros(len(text), bool)
        before = -1
        for positions, prefixes in induced.suffixes(text, 258, window):
            hit = prefixes >= window
            repeated[positions[hit]] = True
            repeated[np.r_[before, positions[:-1]][hit]] = True
            before = int(positions[-1])
        once = np.flatnonzero(keys["once"].to_numpy(zero_copy_only=False))
        rows = np.repeat(once, n[once])
        at = arrays.runs_of(n[once])
        hit = repeated[begins[rows] + at]
        rows, at = rows[hit], at[hit]
        opens = np.ones(len(rows), bool)
        opens[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)
        starts = np.flatnonzero(opens)
        size = np.diff(np.r_[starts, len(rows)]) + window - 1
        found = keys.select(["doc_id", "text_key", "start"]).take(pa.array(rows[starts]))
        start = found["start"].to_numpy() + first[rows[starts]] + at[starts]
        out = found.select(["doc_id", "text_key"]).append_column("start", pa.array(start.astype(np.int32))).append_column("size", pa.array(size.astype(np.int32)))
        yield from out.to_batches()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of the texts without the bytes under their cuts (start, size)."""
    for batch in arrays.portions(batches):
        buffer, offsets = arrays.text_bytes(batch.column("text"))
        text, listed = buffer.tobytes(), batch.column("cuts")
        row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
        start, size = (np.asarray(listed.flatten().field(f), np.int64) for f in ("start", "size"))
        start = start + offsets[row]
        depth = np.zeros(len(buffer) + 1, np.int32)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + size, -1)
        gone = np.zeros(256, bool)
        gone[1] = True
        flags = (np.cumsum(depth[:-1]) > 0).astype(np.uint8)
        a, b = arrays.spans(flags, gone, offsets)
        first = np.searchsorted(a, offsets)
        kept, removed = [], []
        for r in range(batch.num_rows):
            s, e = a[first[r] : first[r + 1]].tolist(), b[first[r] : first[r + 1]].tolist()
            kept.append(b"".join([text[x:y] for x, y in zip([int(offsets[r]), *e], [*s, int(offsets[r + 1])])]))
            removed.append(sum(e) - sum(s))
        names = [c for c in batch.schema.names if c not in ("text", "cuts")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(removed, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(kept, pa.binary())],
            [*names, "n_removed", "n_spans", "kept_bytes"],
        )


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes where something was removed (else null).

    ``docs`` needs doc_id and text. The bytes kept need not be whole characters.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    piece = "array<struct<anchor:bigint,digest:bigint,start:int,n:int>>"
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")
    found = stash(
        texts.mapInArrow(_pieces(window, gram), f"doc_id {kind}, text_key bigint, n_bytes bigint, whole_sha256 string, pieces {piece}"), "byte-pieces"
    )
    pieces = found.where("size(pieces) > 0").select("doc_id", "text_key", F.explode("pieces").alias("p")).select("doc_id", "text_key", "p.*")

    # Anchors that occur once are most of them and end here.
    anchors = stash(pieces.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    pieces = stash(perhaps_in(pieces, F.col("anchor"), anchors, F.col("anchor"), 26).join(anchors, "anchor", "left_semi"), "shared-pieces")
    paths = pieces.groupBy("anchor", "digest").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "start", "n")).alias("source"))
    paths = stash(paths, "paths")
    often = paths.where("times > 1").select("anchor", "digest")
    whole = pieces.join(often, ["anchor", "digest"]).select("doc_id", "text_key", "start", (F.col("n") + window - 1).alias("size"))

    branches = paths.groupBy("anchor").agg(F.count("*").alias("paths")).where("paths > 1").select("anchor")
    listed = paths.join(branches, "anchor").select("source.doc_id", "source.text_key", F.struct("anchor", "source.start", "source.n", (F.col("times") == 1).alias("once")).alias("piece"))
    listed = stash(listed.groupBy("doc_id", "text_key").agg(F.collect_list("piece").alias("pieces")), "branching")

    twice = stash(found.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "repeated-rows")

    def with_text(rows: DataFrame) -> DataFrame:
        """The rows with their texts; where rows of documents are repeated, one text is enough."""
        near = perhaps_in(texts, F.col("text_key"), rows, F.col("text_key"))
        near = rows.join(near, same(rows, near, "doc_id", "text_key")).select(*(rows[c] for c in rows.columns), near["text"])
        if twice.isEmpty():
            return near
        again = same(near, twice, "doc_id", "text_key")
        return near.join(twice, again, "left_anti").unionByName(near.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text_key"]))

    contents = with_text(listed).mapInArrow(
        _contents(window), f"doc_id {kind}, text_key bigint, anchor bigint, start int, n int, once boolean, content binary"
    )
    size = listed.agg(F.sum(F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, x: a + x["n"] + window - 1))).first()[0] or 0
    single = contents.repartition(max(1, -(-size // SHARD)), "anchor").mapInArrow(_shard(window, gram), f"doc_id {kind}, text_key bigint, start int, size int")
    cuts = whole.unionByName(single).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))
    cut = with_text(stash(cuts, "cuts")).mapInArrow(_kept, f"doc_id {kind}, text_key bigint, n_removed bigint, n_spans bigint, kept_bytes binary")
    return found.join(cut, same(found, cut, "doc_id", "text_key"), "left").select(
        found.doc_id, found.text_key, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce(F.sha2("kept_bytes", 256), "whole_sha256").alias("kept_sha256"), "kept_bytes",
    )


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
