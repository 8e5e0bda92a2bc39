"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z. A window is ``window`` consecutive words of an item;
an item of fewer words is one window. In each window the smallest hash of ``gram`` words is its fingerprint, so
a document that shares a window shares its fingerprint at the same place. Training and test fingerprints are joined,
and each hit is extended to its whole window, whose words are compared by digest.

The benchmark may be of any size: what is broadcast is a bit set of fixed size over its fingerprints, which only
keeps most documents' windows out of the join. A fuller bit set costs time, never results.

Null and empty texts have no words. Rows of a document with the same text get the same result; a null ``item_id``
is listed as an empty string; further columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qapulse.llm import arrays
from qapulse.llm.shared import documents, same, stash, text_key

WINDOW, GRAM = 10, 5
BITS = 24

_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_HITS = "array<struct<print:bigint,start:int,size:int,digest:binary>>"


def _found(keep: Callable, sizes: list[int], window: int, gram: int, whole: bool) -> Callable:
    """Per row its number of words and the windows that ``keep`` lets through.

    ``sizes``: lengths of short items, whose windows documents are searched for too. ``whole``: the rows are items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.portions(batches):
            buffer, offsets = arrays.text_bytes(batch.column("text"))
            buffer = _LOWER[buffer]
            starts, ends = arrays.spans(buffer, _INSIDE, offsets)
            words = arrays.cut(arrays.prefix_hash(arrays.byte_values(buffer)), starts, ends)
            first = np.searchsorted(starts, offsets)
            counts = np.diff(first)
            row = np.repeat(np.arange(batch.num_rows), counts)
            prints, begins, lengths = [], [], []
            if len(words) >= window:
                at = np.flatnonzero(row[window - 1 :] == row[: len(row) - window + 1])
                grams = arrays.gram_hash(words, gram)
                chosen = grams[arrays.sliding_argmin(grams, window - gram + 1)[at]]
                mask = keep(chosen)
                prints.append(chosen[mask])
                begins.append(at[mask])
                lengths.append(np.full(mask.sum(), window))
            for size in range(1, window) if whole else sizes:
                if len(words) < size:
                    continue
                at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1])
                if whole:
                    at = at[counts[row[at]] == size]
                chosen = arrays.gram_hash(words, size)[at] ^ np.uint64(size)
                mask = keep(chosen)
                prints.append(chosen[mask])
                begins.append(at[mask])
                lengths.append(np.full(mask.sum(), size))
            prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
            begins = np.concatenate(begins) if begins else np.empty(0, np.int64)
            lengths = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
            order = np.argsort(begins, kind="stable")
            prints, begins, lengths = prints[order], begins[order], lengths[order]
            text = buffer.tobytes()
            digests = [
                blake2b(b" ".join([text[starts[i] : ends[i]] for i in range(b, b + n)]), digest_size=16).digest()
                for b, n in zip(begins.tolist(), lengths.tolist())
            ]
            hits = pa.StructArray.from_arrays(
                [
                    pa.array(prints.view(np.int64)),
                    pa.array((begins - first[row[begins]] if len(begins) else begins).astype(np.int32)),
                    pa.array(lengths.astype(np.int32)),
                    pa.array(digests, pa.binary()),
                ],
                ["print", "start", "size", "digest"],
            )
            places = np.searchsorted(begins, first).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in batch.schema.names if name != "text"),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(places), hits),
                ],
                [*(name for name in batch.schema.names if name != "text"), "n_words", "hits"],
            )

    return run


def _windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per distinct window and item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    every = _found(lambda x: np.ones(len(x), bool), [], window, gram, True)
    found = items.mapInArrow(every, f"item string, n_words bigint, hits {_HITS}")
    return found.select("item", F.explode("hits").alias("hit")).select("item", "hit.print", "hit.size", "hit.digest").distinct()


def _bit_set(windows: DataFrame) -> np.ndarray:
    """Which of 2**BITS remainders fingerprints have; at most 2**BITS / 64 rows reach the driver."""
    place = F.col("print").bitwiseAND((1 << BITS) - 1)
    rows = (
        windows.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, int(print & 63L))").alias("bit"))
        .groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect()
    )
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for word, held in rows:
        bits[word] = held
    return bits.view(np.uint64)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): per row of ``docs`` doc_id, text key and n_words; per row of hits a document's window
    (start and size in words) that occurs in the benchmark. ``docs`` needs doc_id and text."""
    spark = docs.sparkSession
    windows = stash(_windows(benchmark, window, gram), "benchmark-windows")
    sizes = sorted(r[0] for r in windows.where(F.col("size") < window).select("size").distinct().collect())
    shared = spark.sparkContext.broadcast(_bit_set(windows))

    def keep(prints: np.ndarray) -> np.ndarray:
        place = prints & np.uint64((1 << BITS) - 1)
        return (shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        _found(keep, sizes, window, gram, False), f"doc_id {kind}, text_key bigint, n_words bigint, hits {_HITS}"
    )
    found = stash(found, "document-windows")
    hits = found.where(F.size("hits") > 0).select("doc_id", "text_key", F.explode("hits").alias("hit")).select("doc_id", "text_key", "hit.*")
    hits = stash(hits.join(windows.select("print", "digest", "item"), ["print", "digest"]), "hits")
    return found.drop("hits"), hits.select("doc_id", "text_key", "start", "size", "item")


def _covered(places: str) -> F.Column:
    """Number of words under the sorted windows."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted ids as strings) and contaminated for each row of ``docs``."""
    found, hits = contamination(docs, benchmark, window, gram)
    per = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("places"), F.array_sort(F.collect_set("item")).alias("items")
    )
    return found.join(per, same(found, per, "doc_id", "text_key"), "left").select(
        found.doc_id, found.text_key, "n_words",
        F.coalesce(_covered("places"), F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("places").isNotNull().alias("contaminated"),
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )
