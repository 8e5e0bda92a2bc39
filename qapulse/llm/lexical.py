"""Ranked lexical search: dense blocked matrix products of item tiles and document impact tiles.

Terms are maximal runs of ASCII letters and digits and of all other characters above ASCII, only A-Z lowered. A document
holds an integer impact of each of its terms, a floor of the term's weight times a saturating function of its count; the score of
a document for an item is the sum of the impacts of the item's terms, each as often as the item has it (see :func:`search`).

Items are dealt into blocks whose terms take some ``BLOCK_BYTES``; each block is one pass over all documents with its vocabulary. That
pass keeps, per document, the counts of the block's terms. Then, in each task, tiles of documents meet
tiles of items (``SHAPE``): columns are the terms that both tiles hold, cut so that no partial sum of a product can reach 2**53. A
product in float64 is exact up to there, whatever order BLAS adds in; partial sums are added as 64-bit integers. An item keeps its
``k`` best documents of the task; those at the k-th score are all kept until ids decide. Tasks hand on k rows an
item, which are ranked in salted windows first.

Null texts have no terms; documents without a term of the item are not listed. Rows that share an ``item_id`` (null
included) are one item, whose terms add up; repeated rows of a document are ranked each. A null doc_id comes last
among equal scores. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qapulse.llm import arrays, terms
from qapulse.llm.shared import documents, stash

K = 10
#: Bytes of item terms in a block, about: what is broadcast. A longer item is a block with what its hash deals to it.
BLOCK_BYTES = 8_000_000
#: Items, documents and terms in a tile.
SHAPE = (256, 1024, 1024)
EXACT = 2**53
SALT = 64

_TABLE = terms.alphabet(digits=True)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrays.portions(batches):
        rows, words = terms.split(batch.column("text"), _TABLE)
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), words.cast(pa.string())], ["item_id", "term"])


def _term_counts(vocabulary) -> Callable:
    """Per document its number of terms and the (ascending) ids and counts of those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in arrays.portions(batches):
            rows, words = terms.split(batch.column("text"), _TABLE)
            ids = pc.index_in(words, value_set=known)
            held = np.asarray(ids.is_valid())
            keys = rows[held].astype(np.int64) * len(known) + ids.drop_null().to_numpy()
            keys, times = np.unique(keys, return_counts=True)
            places = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=np.int64) * len(known)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.bincount(rows, minlength=batch.num_rows)),
                    pa.ListArray.from_arrays(pa.array(places), pa.array((keys % max(1, len(known))).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(times)),
                ],
                ["doc_id", "n", "ids", "counts"],
            )

    return run


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms: 25 plus 75 times the length over the mean length, rounded down."""
    if len(n) and int(n.max()) * docs >= (1 << 62) // 75:
        return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)
    return 25 + 75 * n * docs // max(1, total)


class Items:
    """A tile of items as columns (term, count) with bounded products.

    A column's impact is below weight * 10**6 for each occurrence in the item. Columns are cut into tiles so that the sum of these bounds
    stays under ``EXACT`` for every item; a term that alone could pass it is split into columns with part of its count.
    """

    def __init__(self, items: np.ndarray, ids: np.ndarray, counts: np.ndarray, weights: np.ndarray, most: int, exact: int) -> None:
        self.items, row = np.unique(items, return_inverse=True)
        held = weights[ids] > 0
        row, ids, counts = row[held], ids[held], counts[held]
        once = weights[ids] * 1_000_000
        fits = np.maximum(1, (exact - 1) // np.maximum(1, once))
        copies = -(-counts // fits)
        layer = arrays.runs_of(copies)
        row, ids, counts, fits, once = (np.repeat(x, copies) for x in (row, ids, counts, fits, once))
        counts = np.minimum(counts - layer * fits, fits)
        keys, column = np.unique(ids * (int(layer.max(initial=0)) + 1) + layer, return_inverse=True)
        self.ids = keys // (int(layer.max(initial=0)) + 1)
        bound = np.zeros(len(keys), np.int64)
        np.maximum.at(bound, column, once * counts)
        cuts, used = [0], 0
        for at, own in enumerate(bound.tolist()):
            if at > cuts[-1] and (used + own >= exact or at - cuts[-1] == most):
                cuts.append(at)
                used = 0
            used += own
        self.tiles = list(zip(cuts, [*cuts[1:], len(keys)])) if len(keys) else []
        order = np.argsort(column, kind="stable")
        self.row, self.column, self.counts = row[order], column[order], counts[order]
        self.places = np.searchsorted(self.column, np.arange(len(keys) + 1))

    def matrix(self, begin: int, end: int) -> np.ndarray:
        out = np.zeros((len(self.items), end - begin))
        part = slice(self.places[begin], self.places[end])
        out[self.row[part], self.column[part] - begin] = self.counts[part]
        return out


def _scores(tile: Items, rows: np.ndarray, ids: np.ndarray, impacts: np.ndarray, count: int) -> np.ndarray:
    """Scores [item, document] of ``count`` documents with (row, term id, impact)."""
    total = np.zeros((len(tile.items), count), np.int64)
    order = np.argsort(ids, kind="stable")
    rows, ids, impacts = rows[order], ids[order], impacts[order]
    for begin, end in tile.tiles:
        own = tile.ids[begin:end]
        first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        shared = np.flatnonzero(last > first)  # columns no document of the tile holds are left out
        if not len(shared):
            continue
        sizes = (last - first)[shared]
        at = np.repeat(first[shared], sizes) + arrays.runs_of(sizes)
        dense = np.zeros((len(shared), count))
        dense[np.repeat(np.arange(len(shared)), sizes), rows[at]] = impacts[at]
        total += (tile.matrix(begin, end)[:, shared] @ dense).astype(np.int64)
    return total


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k first rows of each item by score and doc_id."""
    if not table.num_rows:
        return table
    order = pc.sort_indices(table, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")
    table = table.take(order)
    starts, ends = arrays.run_bounds(table.column("item").to_numpy())
    return table.filter(pa.array(arrays.runs_of(ends - starts) < k))


def _top(block, k: int, shape: tuple[int, int, int], exact: int) -> Callable:
    """The best documents of each item of the block among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item, term, times, weights, docs, total = block.value
        high, wide, deep = shape
        parts = (np.flatnonzero(item // high == n) for n in range(-(-len(names) // high)))
        tiles = [Items(item[part], term[part], times[part], weights, deep, exact) for part in parts]
        least = np.ones(len(names), np.int64)
        best = None
        for whole in batches:
            for begin in range(0, whole.num_rows, wide):
                batch = whole.slice(begin, wide)
                n = batch.column("n").to_numpy()
                lists = batch.column("ids")
                sizes = pc.list_value_length(lists).to_numpy()
                ids, counts = lists.flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy()
                rows = np.repeat(np.arange(batch.num_rows), sizes)
                m = lengths(n, docs, total)
                impacts = weights[ids] * (1_000_000_000 * counts // (1000 * counts + 8 * m[rows]))
                for tile in tiles:
                    scores = _scores(tile, rows, ids, impacts, batch.num_rows)
                    floor = least[tile.items]
                    if batch.num_rows > k:
                        floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                    x, y = np.nonzero(scores >= floor[:, None])
                    if not len(x):
                        continue
                    found = pa.table({"item": tile.items[x], "doc_id": batch.column("doc_id").take(pa.array(y)), "score": scores[x, y]})
                    best = _best(found if best is None else pa.concat_tables([best, found]), k)
                    owners, score = best.column("item").to_numpy(), best.column("score").to_numpy()
                    starts, ends = arrays.run_bounds(owners)
                    full = ends - starts == k
                    least[owners[starts[full]]] = score[ends[full] - 1]
        if best is not None and best.num_rows:
            best = best.combine_chunks()
            columns = [names.take(best.column("item")), best.column("doc_id"), best.column("score")]
            yield from pa.Table.from_arrays(columns, ["item_id", "doc_id", "score"]).to_batches()

    return run


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, asked: DataFrame, k: int, shape: tuple[int, int, int], exact: int) -> DataFrame:
    """The best documents of the items of one block; their terms are (item_id, term, n)."""
    spark = docs.sparkSession
    kinds = [x.schema[n].dataType.simpleString() for x, n in ((asked, "item_id"), (docs, "doc_id"))]
    held = asked.orderBy("item_id", "term").toArrow().combine_chunks()
    coded = held.column("term").combine_chunks().dictionary_encode()
    known, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    owners = held.column("item_id").combine_chunks()
    owners = owners.dictionary_encode(null_encoding="encode")
    found = docs.mapInArrow(
        _term_counts(spark.sparkContext.broadcast(known.cast(pa.large_string()))), f"doc_id {kinds[1]}, n bigint, ids array<int>, counts array<bigint>"
    )
    found = stash(found, "document-terms")
    docs_n, total = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(known), np.int64)
    for at, df in found.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        weights[at] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df + 1)))
    block = (owners.dictionary, owners.indices.to_numpy().astype(np.int64), term, held.column("n").to_numpy(), weights, docs_n, total)
    block = spark.sparkContext.broadcast(block)
    best = found.where(F.size("ids") > 0).mapInArrow(_top(block, k, shape, exact), f"item_id {kinds[0]}, doc_id {kinds[1]}, score bigint")
    return stash(best, "task-tops")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, shape: tuple[int, int, int] = SHAPE, exact: int = EXACT
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item with a score above 0.

    N counts the documents with a term, L their terms, df the documents with a term, tf its count in one of n terms. A term weighs
    ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and has the impact ``weight * (10**9 * tf div (1000 * tf + 8 * m))`` with
    ``m = 25 + 75 * n * N div L``. ``docs`` needs doc_id and text, ``items`` item_id and text.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term string")
    asked = stash(asked.groupBy("item_id", "term").agg(F.count("*").alias("n")), "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    docs = docs.select("doc_id", "text")
    tops = [_block(docs, asked.where(number == at), k, shape, exact) for at in range(blocks)]
    rows = reduce(DataFrame.union, tops)
    # Two levels: an item's rows, k from each task, never meet in one window at once.
    rows = _ranked(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT))), k, "item_id", "salt")
    return _ranked(rows, k, "item_id").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH
document_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
item_terms AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM document_terms GROUP BY doc_id),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf FROM document_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM held, whole GROUP BY term),
impacts AS (
  SELECT h.doc_id, h.term, w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (25 + (75 * s.n * whole.docs) // whole.total))) AS impact
  FROM held h JOIN weights w USING (term) JOIN sizes s USING (doc_id), whole),
scores AS (
  SELECT i.item_id, d.doc_id, CAST(sum(i.times * d.impact) AS BIGINT) AS score
  FROM item_terms i JOIN impacts d USING (term) GROUP BY i.item_id, d.doc_id),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
