"""Packing token sequences: first-fit decreasing on a tournament tree of bin capacities, per randomised group.

A document's ids (tokenizer, then an end id) are cut into pieces of ``size``; only its last piece can be shorter.
Pieces are dealt to groups by a hash of document and place, so a giant document is spread; each group of some
``GROUP`` pieces is packed alone: longest first, each piece into the first bin that holds it. The tree keeps the
largest free capacity below each node, so a piece takes log(bins) steps. Pieces carry lengths and checksums, not ids.

Null and empty texts are the end id alone. Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qapulse.llm import arrays, tokenise
from qapulse.llm.shared import documents, stash

SIZE, END = 4096, 2
#: Pieces in a group, about: bounds a task and leaves one partly filled bin in this many pieces.
GROUP = 20_000


def first_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are given longest first."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    tree = [size] * (2 * leaves)  # the winner of each match is the larger free capacity
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for at, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[at], offsets[at] = node - leaves, size - tree[node]
        tree[node] -= length
        while node > 1:
            node //= 2
            winner = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == winner:
                break
            tree[node] = winner
    return bins, offsets


def _pieces(path: str, size: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenise.encoder(path)
        for batch in arrays.portions(batches):
            ids, offsets = own.batch(batch.column("text"))
            ids = np.ascontiguousarray(ids, "<u4")
            last = np.array([end], "<u4")
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for row in range(batch.num_rows):
                part = np.concatenate([ids[offsets[row] : offsets[row + 1]], last])
                for begin in range(0, len(part), size):
                    piece = part[begin : begin + size]
                    rows.append(row)
                    starts.append(begin)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece))
                    totals.append(len(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def pack(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece. ``docs`` needs doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenise.vocabulary(vocabulary), size, end),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
    )
    pieces = stash(pieces, "pieces")  # tokens are made once; what follows moves some 30 bytes a piece
    whole = pieces.where(F.col("length") == size)
    parts = pieces.where(F.col("length") < size)
    groups = max(1, -(-parts.count() // group))

    def fit(rows: pa.Table) -> pa.Table:
        # Arrow keeps ids as they are: a pandas column of integers with a null among them would be rounded to doubles.
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end"))
        bins, offsets = first_fit(rows["length"].to_numpy(), size)
        sequences = 2 * (bins * groups + rows["pack_group"].to_numpy())
        return rows.drop_columns("pack_group").append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))

    names = "doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset".split(", ")
    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    # Copies of one document differ in their row number, so they are dealt out too.
    dealt = parts.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups).cast("bigint")))
    packed = dealt.groupBy("pack_group").applyInArrow(fit, fields)
    # A full piece is a sequence by itself; odd numbers are theirs.
    alone = whole.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.select(*names).unionByName(alone.select(*names))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
