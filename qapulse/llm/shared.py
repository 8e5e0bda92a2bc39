"""What the operators share on the Spark side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qapulse.session import shared_dir
from qapulse.sources import storage


#: Tables that :func:`stash` wrote in this process and :func:`release` has not deleted.
_stashed: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far, once the results that read them are stored elsewhere; how many."""
    gone = 0
    while _stashed:
        storage.delete(spark, _stashed.pop())
        gone += 1
    return gone


def stash(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """The rows, written once to the shared folder and read again.

    It cuts lineage with files all executors see: a lost executor costs the rows it was making, not these.
    """
    path = shared_dir(df.sparkSession, label)
    _stashed.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(label: str) -> str:
    """A column name no input can have."""
    return f"_{label}_{uuid.uuid4().hex[:12]}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on several columns, which Spark still runs as an equi-join."""
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[name])
    return found


def text_key(text: str = "text") -> Column:
    """Identity of a text: rows of one document that hold the same text get the same result."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def perhaps_in(df: DataFrame, key: Column, members: DataFrame, member: Column, bits: int = 24, others: bool = False) -> DataFrame:
    """The rows of ``df`` whose key is among the members, and a few others; with ``others`` exactly the remaining rows.

    A bit set of fixed size (at most 2**bits / 64 rows of two longs, 4 MB for 24) is broadcast whatever the number of
    members; a fuller set lets more rows through, never fewer. It keeps wide rows out of the exact join that follows.
    """
    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << bits))

    word, held, at = fresh("word"), fresh("bits"), fresh("at")
    one = members.select(place(member).alias(at))
    table = one.groupBy(F.shiftright(at, 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, int({at} & 63L)))").alias(held))
    found = df.withColumn(at, place(key)).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(table), word, "left" if others else "inner")
    return found.where(F.expr(f"(coalesce({held}, 0L) & shiftleft(1L, int({at} & 63L))) {'=' if others else '!='} 0")).drop(at, word, held)


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` but for the (doc_id, text_key) of ``dropped``; of those of ``repeated`` one row each.

    Only rows that may be concerned are shuffled; all others, nearly all, pass as they are read.
    """
    key, other = fresh("key"), fresh("id")
    special = dropped.select("doc_id", "text_key")
    gone = special.select(F.col("doc_id").alias(other), "text_key")
    keyed = docs.withColumn(key, text_key())
    concerned = special if repeated is None else special.union(repeated.select("doc_id", "text_key"))
    near = perhaps_in(keyed, F.col(key), concerned, F.col("text_key"))
    near = near.join(gone, (near[key] == gone["text_key"]) & near["doc_id"].eqNullSafe(gone[other]), "left_anti")
    if repeated is not None:
        near = near.dropDuplicates(["doc_id", key])
    rest = perhaps_in(keyed, F.col(key), concerned, F.col("text_key"), others=True)
    return rest.unionByName(near).select(*docs.columns)
