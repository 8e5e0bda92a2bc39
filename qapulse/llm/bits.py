"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its elements, cut into segments of 16 bits; every segment is an index of its own. Two codes that differ in
less than m(s+1) bits agree, up to s bits, in one of the m segments. So the search radius of the segments grows,
s = 0, 1, 2, ...: each round looks up the segment values at exactly that distance from the query's, verifies whole
codes, and ends the queries whose (k+1)-th verified distance is below m(s+1): nothing unseen can be nearer.

Equal codes are one entry with their k+1 smallest ids, and equal query codes are searched once. A code is taken only in the first segment and
round that reach it, so no row is made twice. Which radius is enough is decided by the data; there is no cap.

A null embedding has no code: it is neither found nor searched for (null elements count as not positive; shorter vectors are filled with such).
Results are other ids, ordered by distance, then id; where fewer than k others exist, all are given. Rows without id are left out; rows of one id
stay different entries only if their codes differ. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qapulse.llm.shared import stash

K, BITS = 10, 16
#: Segment values a task looks up, about.
PROBES = 500_000


def sign_code(vector: Column, segments: int) -> Column:
    """Segments of 16 sign bits, the first element lowest."""
    signs = F.transform(F.sequence(F.lit(0), F.lit(segments * BITS - 1)), lambda i: F.when(F.get(vector, i) > 0, 1).otherwise(0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(segments - 1)),
        lambda s: F.aggregate(F.reverse(F.slice(signs, s * BITS + 1, BITS)), F.lit(0), lambda a, b: a * 2 + b),
    )


def _probes(radius: int) -> Callable:
    """All segment values at ``radius`` bits from a query's, in every segment."""
    values = np.arange(1 << BITS, dtype=np.uint32)
    masks = values[np.bitwise_count(values) == radius].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 200_000 // len(masks))
            for begin in range(0, batch.num_rows, step):
                rows = batch.slice(begin, step)
                held = rows.column("value").to_numpy(zero_copy_only=False).astype(np.int32)
                out = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), len(masks))))
                probed = pa.array((held[:, None] ^ masks[None, :]).ravel())
                yield pa.RecordBatch.from_arrays([*(out.column(n) for n in ("query", "code", "bound", "segment")), probed], ["query", "code", "bound", "segment", "value"])

    return run


def top_k(base: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, distance. ``base`` and ``queries`` need vec_id and embedding."""
    widest = base.agg(F.max(F.size("embedding"))).first()[0] or 1
    segments = -(-max(1, widest) // BITS)

    def coded(df: DataFrame) -> DataFrame:
        return df.where("vec_id is not null and embedding is not null").select("vec_id", sign_code(F.col("embedding"), segments).alias("code"))

    # The limit per code is applied in each task before the shuffle, so a hot code is small by then.
    least = Window.partitionBy("code").orderBy("vec_id")
    entries = coded(base).distinct().withColumn("at", F.row_number().over(least)).where(F.col("at") <= k + 1)
    entries = stash(entries.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "codes")
    index = stash(entries.select(F.posexplode("code").alias("segment", "value"), F.col("code").alias("found"), "ids"), "index")
    asked = stash(coded(queries).distinct(), "queries")
    # bound: the (k+1)-th distance so far; what is farther is not even handed on by the join.
    active = asked.select("code").distinct().withColumn("query", F.monotonically_increasing_id())
    active = stash(active.withColumn("bound", F.lit(segments * BITS)), "query-codes")
    named = active.drop("bound")
    best, done, waiting = None, [], active.count()
    for radius in range(BITS + 1):
        # Merged, as Spark cannot know how many values a radius makes and might broadcast them.
        apart = F.transform(F.arrays_zip("code", "found"), lambda x: F.bit_count(x["code"].bitwiseXOR(x["found"])))
        # A query's segments are some rows that become many: they are dealt out by what they will make.
        tasks = -(-waiting * segments * comb(BITS, radius) // PROBES)
        asking = active.select("query", "code", "bound", F.posexplode("code").alias("segment", "value"))
        seen = asking.repartition(max(1, tasks), "query", "segment").mapInArrow(
            _probes(radius), "query bigint, code array<int>, bound int, segment int, value int"
        ).join(index.hint("merge"), ["segment", "value"]).withColumn("apart", apart)
        first = (F.array_min("apart") == radius) & (F.array_position("apart", radius) == F.col("segment") + 1)
        distance = F.aggregate("apart", F.lit(0), lambda a, b: a + b)
        seen = seen.where(first & (distance <= F.col("bound"))).select("query", "found", "ids", distance.alias("distance"))
        if best is not None:
            seen = seen.unionByName(best.join(active.select("query"), "query"))
        near = Window.partitionBy("query").orderBy("distance", F.col("ids")[0], "found")
        best = stash(seen.withColumn("at", F.row_number().over(near)).where(F.col("at") <= k + 1).drop("at"), "nearest")
        covered = segments * (radius + 1) - 1
        reached = best.withColumn("n", F.sum(F.size("ids")).over(near)).where(F.col("n") >= k + 1)
        kth = stash(reached.groupBy("query").agg(F.min("distance").alias("kth")), "kth")
        ended = kth.where(F.col("kth") <= covered).select("query")
        if radius == BITS:
            done.append(best)
            break
        done.append(best.join(ended, "query"))
        active = active.join(kth, "query", "left").where(F.coalesce("kth", "bound") > covered)
        active = stash(active.select("query", "code", F.coalesce("kth", "bound").alias("bound")), "query-codes")
        if not (waiting := active.count()):
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = asked.select(F.col("vec_id").alias("query_id"), "code").join(named, "code").join(found, "query")
    found = found.select("query_id", "distance", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(base, base.where("vec_id % 20 = 0"))


ORACLE = f"""
WITH signs AS (
    SELECT vec_id, [CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END FOR i IN range(1, 65)] AS code
    FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
    SELECT q.vec_id AS query_id, b.vec_id, list_sum([abs(q.code[i] - b.code[i]) FOR i IN range(1, 65)])::INTEGER AS distance
    FROM signs q JOIN signs b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance
FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {K}
"""
