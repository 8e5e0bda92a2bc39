"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id, encoded in place and written, one file a partition, in stripes with an index
every ``stride`` rows and a Bloom filter on doc_id. Readers take stripes in parallel; a lookup of some ids skips stripes by
statistics and filters. Each row also holds the number of its file and the ids before it there, so a document's
global start is its file's start (sums over two small columns, one row a file) plus that.

Null and empty texts are the end id alone; rows without doc_id come first; repeated rows are written once each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qapulse.llm import arrays, tokenise
from qapulse.llm.shared import documents
from qapulse.session import shared_dir

END = 1
STRIDE, STRIPE = 1000, 16 << 20


def _encoded(path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenise.encoder(path)
        part, before, row = TaskContext.get().partitionId(), 0, 0
        for batch in arrays.portions(batches):
            ids, offsets = own.batch(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
            lengths = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, part)),
                    pa.array(row + np.arange(batch.num_rows)),
                    pa.array(before + offsets[:-1]),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                ["doc_id", "file_no", "file_row", "file_start", "n_tokens", "ids"],
            )
            before, row = before + int(offsets[-1]), row + batch.num_rows

    return run


def write_tokens(
    docs: DataFrame, path: str, end: int = END, vocabulary: str | None = None, stride: int = STRIDE, stripe: int = STRIPE
) -> None:
    """Write doc_id, file_no, file_row, file_start, n_tokens and ids of ``docs`` (doc_id, text) in ascending doc_id order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(
        _encoded(tokenise.vocabulary(vocabulary), end),
        f"doc_id {kind}, file_no bigint, file_row bigint, file_start bigint, n_tokens bigint, ids array<int>",
    ).write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option(
        "orc.row.index.stride", stride
    ).option("orc.stripe.size", stripe).option("orc.compress", "ZLIB").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, stripe by stripe."""
    stored = spark.read.orc(path)
    # As many rows as partitions were written, 16 bytes each: some thousands however large the corpus is.
    files = stored.groupBy("file_no").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(files), "file_no").select(
        "doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids"
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by the unsigned crc32 of them as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("ids")
            ids = np.ascontiguousarray(held.values.to_numpy(), "<u4")
            places = held.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(places[:-1], places[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in batch.schema.names if n != "ids"), pa.array(sums, pa.int64())],
                [*(n for n in batch.schema.names if n != "ids"), "ids_crc32"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.mapInArrow(run, f"{fields}, ids_crc32 bigint")


def op10_tokens_orc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return checksums(read_tokens(spark, path))
