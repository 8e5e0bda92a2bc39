"""MinHash near-duplicate classes by ProbMinHash.

A text is the multiset of its runs of five words (lower-cased letters and digits; a text of fewer words is one run). Runs
are weighted by how often they occur, and similarity is probability Jaccard,
``sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)``, which is plain Jaccard where nothing repeats.

Signature (ProbMinHash): each run is a Poisson process whose rate is its weight; each arrival hits one of ``SIZE`` registers, which
keep the earliest; a run stops once its next arrival is later than every register's. Two texts agree in a register with the
probability Jaccard. Registers are banded into buckets. Bands come in ``TURNS``: in a turn, every text of a bucket that
still holds several classes meets the bucket's first and, from the second turn, its neighbours. That merges most classes in
proportion to the texts. Then, in buckets of any band that keep several classes,
all pairs of different classes meet inside tasks, block by block of texts (:func:`_remaining`), so no pair that shares a
bucket goes untested unless it already is in one class. Pairs whose signatures agree in too few registers are dropped (a pair
at the threshold lies six deviations above that), the rest is verified on the texts.

Rows whose word sequences are equal are one node from the start, however many they are. Texts without words
are equal only if identical; a null text is alone. Repeated rows fall into one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qapulse.llm import arrays
from qapulse.llm.shared import documents, same, stash, text_key, without

RUN, ALIKE = 5, 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
#: Bands of each turn in which the texts of a bucket meet, the texts each meets before it besides the first, and the size of a dealt part.
TURNS, NEIGHBOURS, PART = ((0, 2), (2, 8)), 3, 4000
#: Rounds of labelling after a turn: enough for stars. A class with several labels yet costs tests that would be spared, no links.
ROUNDS = 2
#: Bytes of text in a part of a bucket whose remaining pairs meet, about; a longer text is a part with others of its hash.
PART_BYTES = 8_000_000
#: Registers two signatures must share to be verified: 0.55 of them. At similarity 0.8 fewer come once in 10**8 pairs.
AGREE = int(0.55 * SIZE)

_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Shingles:
    """The weighted runs of a column of texts: ``keys`` and ``weights`` by ``rows``, in row order."""

    def __init__(self, column: pa.Array, run: int = RUN) -> None:
        buffer, offsets = arrays.text_bytes(column)
        self.buffer = _LOWER[buffer]
        self.starts, self.ends = arrays.spans(self.buffer, _INSIDE, offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        words = arrays.cut(arrays.prefix_hash(arrays.byte_values(self.buffer)), self.starts, self.ends)
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        keys, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for size in range(1, run + 1):
            if len(words) < size:
                continue
            at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1])
            if size < run:
                at = at[self.counts[row[at]] == size]
            keys.append(arrays.gram_hash(words, size)[at])
            rows.append(row[at])
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        joined = arrays.mix(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, one, weights = np.unique(joined, return_index=True, return_counts=True)
        order = np.argsort(rows[one], kind="stable")
        self.keys, self.rows, self.weights = keys[one][order], rows[one][order], weights[order]

    def digests(self, column: pa.Array) -> list[bytes]:
        """Identity of each word sequence; b"" for null."""
        text, out = self.buffer.tobytes(), []
        starts, ends = self.starts.tolist(), self.ends.tolist()
        for row, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist())):
            if a < b:
                joined = b" ".join([text[s:e] for s, e in zip(starts[a:b], ends[a:b])])
                out.append(blake2b(joined, digest_size=16).digest())
            else:
                held = column[row].as_py()
                out.append(b"" if held is None else blake2b(held.encode(), digest_size=16, person=b"no words").digest())
        return out


def signatures(keys: np.ndarray, weights: np.ndarray, rows: np.ndarray, count: int, size: int = SIZE) -> np.ndarray:
    """Registers [row, size]: the run that arrived first in each."""
    earliest = np.full(count * size, np.inf)
    winner = np.zeros(count * size, np.uint64)
    times = np.zeros(len(keys))
    step = 0
    while len(keys):
        step += 1
        random = arrays.mix(keys + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
        times = times - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        place = rows * size + (arrays.mix(random) % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, place, times)
        won = times == earliest[place]
        winner[place[won]] = keys[won]
        going = times < earliest.reshape(count, size).max(axis=1)[rows]
        keys, weights, rows, times = keys[going], weights[going], rows[going], times[going]
    return winner.reshape(count, size)


def similarity(x_keys: np.ndarray, x: np.ndarray, y_keys: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets."""
    _, i, j = np.intersect1d(x_keys, y_keys, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = x[i].astype(float), y[j].astype(float)
    only_x, only_y = x.sum() - a.sum(), y.sum() - b.sum()
    order = np.argsort(-(a / b), kind="stable")
    a, b = a[order], b[order]
    upto = np.cumsum(a)
    return float((1 / ((only_x + upto) / a + (only_y + b.sum() - np.cumsum(b)) / b)).sum())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrays.portions(batches):
        texts = batch.column("text")
        held = Shingles(texts)
        registers = signatures(held.keys, held.weights, held.rows, batch.num_rows)
        bands = np.zeros((batch.num_rows, BANDS), np.uint64)
        for part in range(ROWS):
            bands = arrays.mix(bands + registers[:, part::ROWS][:, :BANDS] + np.arange(1, BANDS + 1, dtype=np.uint64))
        bands = bands[held.counts > 0]
        places = np.r_[0, np.cumsum((held.counts > 0) * BANDS)].astype(np.int32)
        sketch = (arrays.mix(registers) >> np.uint64(56)).astype(np.uint8)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in names),
                pa.array(held.digests(texts), pa.binary()),
                pa.ListArray.from_arrays(pa.array(places), pa.array(bands.ravel().view(np.int64))),
                pa.array([row.tobytes() for row in sketch], pa.binary()),
            ],
            [*names, "digest", "bands", "sketch"],
        )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, SIZE) for n in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= AGREE))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in arrays.portions(arrays.portions(iter([whole]), "text_a"), "text_b"):
            one, two = Shingles(batch.column("text_a")), Shingles(batch.column("text_b"))
            p, q = (np.searchsorted(s.rows, np.arange(batch.num_rows + 1)) for s in (one, two))
            alike = [
                similarity(one.keys[p[r] : p[r + 1]], one.weights[p[r] : p[r + 1]], two.keys[q[r] : q[r + 1]], two.weights[q[r] : q[r + 1]])
                for r in range(batch.num_rows)
            ]
            alike = np.array(alike)
            kept = alike >= ALIKE - 1e-9
            out = batch.select(["a", "b"]).filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(alike[kept])], ["a", "b", "alike"])


_BLOCK = ["bucket", "low", "high"]


def _grouped(batches: Iterator[pa.RecordBatch], held: Callable) -> Iterator[tuple[tuple, list]]:
    """Each block's key and what ``held`` makes of its rows, for batches sorted by block."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in _BLOCK])
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            own = tuple(names[:, begin].tolist())
            if own != key:
                if parts:
                    yield key, parts
                key, parts = own, []
            parts.append(held(batch.slice(begin, end - begin)))
    if parts:
        yield key, parts


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, each text of a pair to verify, and the other texts it is to be verified with.

    Texts of the left side meet those of the right side that have another label. A pair of two texts that are on both sides counts
    once, and only in the first bucket its texts share.
    """

    def held(part: pa.RecordBatch) -> tuple:
        node, label, right = (part.column(n).to_numpy(zero_copy_only=False) for n in ("node", "label", "right"))
        bands = part.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        return node.copy(), label.copy(), right.copy(), part.column("minor").to_numpy(zero_copy_only=False).copy(), bands.copy(), _matrix(part.column("sketch"), np.uint8, SIZE)

    for (bucket, low, high), parts in _grouped(batches, held):
        node, label, right, minor, bands, sketch = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(label, kind="stable")
        node, label, right, minor, bands, sketch = (x[order] for x in (node, label, right, minor, bands, sketch))
        left, right = np.flatnonzero(~right), np.flatnonzero(right)
        used = np.zeros(len(node), bool)
        others: list[np.ndarray] = [np.empty(0, np.int64)] * len(node)
        step = max(1, 20_000_000 // (SIZE * max(1, len(right))))
        for begin, end in zip(*arrays.run_bounds(label[left])):
            apart = right[label[right] != label[left[begin]]]
            for at in range(begin, end, step) if len(apart) else ():
                mine = left[at : min(at + step, end)]
                x, y = np.nonzero((sketch[mine][:, None] == sketch[apart][None]).sum(axis=2) >= AGREE)
                x, y = mine[x], apart[y]
                alike = bands[x] == bands[y]
                counts = (bands[x, alike.argmax(axis=1)] == bucket) & (~minor[x] | (node[x] < node[y]))
                x, y = x[counts], y[counts]
                used[x] = used[y] = True
                for a, b in zip(*arrays.run_bounds(x)):
                    others[x[a]] = node[y[a:b]]
        rows = np.r_[left[used[left]], right[used[right]]]
        rows = rows[np.unique(node[rows], return_index=True)[1]]  # a text of both sides once, with what it meets on the left
        if len(rows):
            lists = [others[r] for r in rows]
            places = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            key = [pa.array(np.full(len(rows), k), t) for k, t in zip((bucket, low, high), (pa.int64(), pa.int32(), pa.int32()))]
            columns = [*key, pa.array(node[rows]), pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(lists)))]
            yield pa.RecordBatch.from_arrays(columns, [*_BLOCK, "node", "others"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified pairs of each block; each text is cut into runs once, and what the block has linked already is left out."""

    def held(part: pa.RecordBatch) -> list[tuple]:
        out = []
        for batch in arrays.portions(iter([part])):
            runs = Shingles(batch.column("text"))
            cuts = np.searchsorted(runs.rows, np.arange(batch.num_rows + 1)).tolist()
            for node, others, a, b in zip(batch.column("node").to_pylist(), batch.column("others").to_pylist(), cuts, cuts[1:]):
                out.append((node, others, runs.keys[a:b].copy(), runs.weights[a:b].copy()))
        return out

    for _, parts in _grouped(batches, held):
        texts = {node: (keys, weights) for part in parts for node, _, keys, weights in part}
        parent = {node: node for node in texts}

        def root(node: int) -> int:
            while parent[node] != node:
                parent[node] = node = parent[parent[node]]
            return node

        found = []
        for node, others, *_ in (row for part in parts for row in part):
            for other in others:
                if root(node) != root(other) and (alike := similarity(*texts[node], *texts[other])) >= ALIKE - 1e-9:
                    parent[root(node)] = root(other)
                    found.append((min(node, other), max(node, other), alike))
        if found:
            a, b, alike = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64())], ["a", "b", "alike"])


def _blocks(members: DataFrame, labels: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of buckets with several classes, dealt into blocks.

    The left side of a bucket is all its texts, the right side those outside its largest class; both are dealt at random into parts
    bounded in texts and bytes, and each left part meets each right part in one task. So rows are about twice the texts
    of a bucket while those outside the largest class fit one part, and texts by right parts beyond; never pairs.
    """
    held = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = held.join(wanted.select("node", F.octet_length("text").alias("size")), "node").select("bucket", "node", "label", "size")
    classes = held.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    split = classes.groupBy("bucket").agg(
        F.max(F.struct("n", "size", "label")).alias("most"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size")
    )

    def parts(texts: F.Column, size: F.Column) -> F.Column:
        return F.ceil(F.greatest(texts / PART, size / PART_BYTES)).cast("int")

    split = split.where("classes > 1").select(
        "bucket", F.col("most.label").alias("major"), parts(F.col("n"), F.col("size")).alias("lefts"),
        parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("rights"),
    )
    held = held.join(split, "bucket").withColumn("minor", F.col("label") != F.col("major"))
    held = stash(held.join(nodes.select("node", "bands", "sketch"), "node"), "split-texts")

    def side(rows: DataFrame, own: str, other: str, right: bool) -> DataFrame:
        part, met = F.pmod(F.xxhash64("node", F.lit(own)), own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        low, high = (met.alias("low"), part.alias("high")) if right else (part.alias("low"), met.alias("high"))
        return rows.select("bucket", low, high, "node", "label", "minor", F.lit(right).alias("right"), "bands", "sketch")

    return side(held, "lefts", "rights", False).unionByName(side(held.where("minor"), "rights", "lefts", True))


def _remaining(members: DataFrame, labels: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links among all pairs of different classes that share a bucket; only the texts of pairs whose signatures agree are read."""
    blocks = _blocks(members, labels, nodes, wanted)
    key = "bucket bigint, low int, high int"
    pairs = blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(_block_pairs, f"{key}, node bigint, others array<bigint>")
    pairs = stash(pairs, "block-pairs").join(wanted.select("node", "text"), "node").select(*_BLOCK, "node", "others", "text")
    return stash(pairs.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(_block_links, "a bigint, b bigint, alike double"), "links")


def _links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that verify, with their similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = stash(pairs.mapInArrow(_agreeing, "a bigint, b bigint"), "candidates")
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return stash(pairs.mapInArrow(_verified, "a bigint, b bigint, alike double"), "links")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) of every node with a link (a, b): label is the smallest node it is connected with.

    Labels spread along links and then jump to the label of the label, so rounds grow with the logarithm of a path. After ``rounds``, if
    given, a label is some node of the same class: classes may still have several.
    """
    both = stash(links.select("a", "b").union(links.select("b", "a")).distinct(), "both-ways")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for done in count(1):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = stash(
            lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels"
        )
        labels = step.select("node", "label")
        if done == rounds or step.where("label != old").isEmpty():
            return labels


def _meetings(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) to test: in each bucket that still holds several classes, every text and the first of the bucket, and
    after the first turn every text and the ``NEIGHBOURS`` before it, if their classes differ. Each turn has its own order.

    For the neighbours a large bucket is dealt at random into parts of some ``PART`` texts, so none sits in one task.
    """
    turned = F.xxhash64("node", F.lit(turn))
    held = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = held.groupBy("bucket").agg(
        F.min(F.struct(turned.alias("place"), "node", "label")).alias("first"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    firsts = stash(firsts.where("low != high").select("bucket", F.col("first.node").alias("first"), F.col("first.label").alias("first_label")), "firsts")
    held = stash(held.join(firsts, "bucket").withColumn("part", F.pmod(turned, F.ceil(F.col("n") / PART))), "split-buckets")
    pairs = held.where("label != first_label").select("node", F.col("first").alias("other"))
    order = Window.partitionBy("bucket", "part").orderBy(turned)
    one = F.struct("node", "label")
    if turn:
        near = held.select("node", "label", F.array(*(F.lag(one, n).over(order) for n in range(1, NEIGHBOURS + 1))).alias("near"))
        near = near.select("node", F.explode(F.filter("near", lambda x: x["label"] != F.col("label"))).alias("other"))
        pairs = pairs.union(near.select("node", "other.node"))
    pairs = pairs.toDF("node", "other")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id (smallest doc_id of the class, if any), n_links (verified links of its text) for each row.

    ``docs`` needs doc_id and text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        _signed, f"doc_id {kind}, text_key bigint, digest binary, bands array<bigint>, sketch binary"
    )
    # A null text is equal to none: its node is its document's own.
    key = F.when(F.length("digest") > 0, F.hex("digest")).otherwise(F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    signed = stash(signed.withColumn("digest", key), "signatures")
    nodes = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stash(nodes.select("digest", "first.*", "least", "bands", "sketch").withColumn("node", F.monotonically_increasing_id()), "nodes")

    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stash(buckets.join(stash(shared, "buckets"), "bucket"), "members")

    # Only texts that share a bucket with another one are read again.
    wanted = members.select("node").distinct().join(nodes.select("node", "sketch", "doc_id", "text_key"), "node")
    texts = docs.select("doc_id", text_key().alias("text_key"), "text").where("text is not null")
    wanted = wanted.join(texts, same(wanted, texts, "doc_id", "text_key")).groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text"))
    wanted = stash(wanted, "texts")
    links, labels = None, members.select("node").distinct().withColumn("label", F.col("node"))
    for turn, (low, high) in enumerate(TURNS):
        found = _links(_meetings(members.where(F.col("band").between(low, high - 1)), labels, turn), wanted)
        links = found if links is None else stash(links.union(found).distinct(), "all-links")
        labels = components(links, ROUNDS)
    links = stash(links.union(_remaining(members, labels, nodes, wanted)).distinct(), "all-links")
    labels = components(links)

    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    placed = nodes.join(labels, "node", "left").join(degree, "node", "left").select(
        "digest", "least", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    placed = stash(placed, "placed")
    least = placed.groupBy("label").agg(F.min("least").alias("class_id"))
    placed = stash(placed.join(least, "label").select("digest", "class_id", "label", "n_links"), "classes")
    return signed.select("doc_id", "text_key", "digest").join(placed, "digest").select("doc_id", "text_key", "class_id", "n_links", "label")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that of the smallest doc_id (no id comes first)."""
    classes = near_duplicates(docs.select("doc_id", "text"))
    rows = stash(classes.groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("rows")), "class-rows")
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("label", "first.*")
    dropped = rows.join(first, same(rows, first, "label", "doc_id", "text_key"), "left_anti")
    return without(docs, stash(dropped, "dropped"), rows.where("rows > 1"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")
