"""Month-partitioned Parquet tables: write, verified idempotent ingest, views, guarded queries."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NullType, StringType, StructField, StructType

from qapulse.schemas import INGEST_ORDER, schema_of
from qapulse.session import shared_dir
from qapulse.sources import footers, storage
from qapulse.sources.xml_dump import (
    count_rows,
    partition_column,
    scan_dump_xml,
    verify_source,
    with_year_month,
)

log = logging.getLogger(__name__)

MAX_ROWS = 10_000_000


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table.lower()}"


def write_partitioned(
    rows: DataFrame, table: str, root: str, max_records_per_file: int = 20_000_000, mode: str = "errorifexists"
) -> int:
    """Write ``rows`` below ``root`` by ``year_month`` and return how many were written.

    The rebalance gathers a month's rows, but AQE splits a month too large for one task and merges
    small ones, so neither a hot month nor thousands of small files come out. The count is taken
    behind that shuffle, in the task that writes, where a retried task counts once. The commit
    marker is left to the caller: it must mean "verified".
    """
    keyed = with_year_month(rows, partition_column(table))
    counted = Observation()
    (
        keyed.hint("rebalance", "year_month")
        .observe(counted, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode).partitionBy("year_month")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        .parquet(table_path(root, table))
    )
    return counted.get["rows"]


def _staging(root: str) -> str:
    # Readers of the lake skip names that begin with an underscore.
    return f"{root.rstrip('/')}/_staging"


def ingest_table(
    spark: SparkSession, raw: str, root: str, table: str, keep_source: bool = True
) -> int | None:
    """Load one dump table; ``None`` if it was loaded before.

    The table is written to a staging folder, verified there, and its months are listed with their rows in a plan. Then month
    folders are moved to their place one by one, so readers see whole, verified months only. A load that was
    killed while writing starts anew; one killed while moving goes on with the months that are left, without reading the dump. Partitions
    of unknown origin (no marker and no plan) are refused.

    Unlike the dump's own files, sources are kept unless ``keep_source=False``.
    """
    schema_of(table)
    source, target = f"{raw.rstrip('/')}/{table}.xml", table_path(root, table)
    staged = table_path(_staging(root), table)
    marker, plan = f"{target}/_SUCCESS", f"{staged}/_PLAN"
    if storage.exists(spark, marker):
        log.info("[%s] _SUCCESS marker present, skipping", table)
        storage.delete(spark, staged)
        return None
    if not storage.exists(spark, plan):
        if storage.matches(spark, f"{target}/year_month=*"):
            raise RuntimeError(
                f"[{table}] Output has partitions but no _SUCCESS marker (partial run?): {target}"
            )
        verify_source(spark, source)
        storage.delete(spark, staged)
        storage.write_text(spark, plan, json.dumps(_stage(spark, source, root, table)))
    rows = json.loads(storage.read_text(spark, plan))
    _publish(spark, staged, target, rows)
    stored = footers.stored_rows(spark, target)
    if stored != sum(rows.values()):
        raise RuntimeError(f"[{table}] Verification failed: {sum(rows.values())} rows were staged, {stored} are stored")
    storage.touch(spark, marker)
    storage.delete(spark, staged)
    if not keep_source:
        storage.delete(spark, source)
    log.info("[%s] verified %d rows", table, stored)
    return stored


def _stage(spark: SparkSession, source: str, root: str, table: str) -> dict[str, int]:
    """Write a table to the staging folder and verify it; rows by month."""
    written = write_partitioned(scan_dump_xml(spark, source, table), table, _staging(root))
    rows = {r["year_month"]: r["n"] for r in footers.partition_rows(spark, table_path(_staging(root), table)).collect()}
    stored = sum(rows.values())
    if stored != written:
        # Only the source itself can tell a lost row from a counter disturbed by a lost executor.
        expected = count_rows(spark, source)
        if stored != expected:
            raise RuntimeError(
                f"[{table}] Verification failed: source has {expected} rows, Parquet has {stored}"
            )
    return rows


def _publish(spark: SparkSession, staged: str, target: str, months: Mapping[str, int]) -> None:
    """Move the staged months; what is staged still replaces what a broken move left in its place."""
    waiting = set(storage.subfolders(spark, staged))
    for month in sorted(months):
        folder = f"year_month={month}"
        if folder in waiting:
            storage.delete(spark, f"{target}/{folder}")
            storage.rename(spark, f"{staged}/{folder}", f"{target}/{folder}")


def ingest_all(
    spark: SparkSession, raw: str, root: str, keep_source: bool = True
) -> dict[str, int | None]:
    """Load every table, small ones first. Running it again loads only what is missing."""
    return {table: ingest_table(spark, raw, root, table, keep_source) for table in INGEST_ORDER}


def read_table(
    spark: SparkSession, root: str, table: str, merge_schema: bool = False
) -> DataFrame:
    """A stored table, columns matched by name.

    The declared schema spares a pass over the footers of every file; a column absent from a file
    reads as NULL. ``merge_schema`` makes that pass, for files with other columns or types.
    """
    if merge_schema:
        return spark.read.option("mergeSchema", "true").parquet(table_path(root, table))
    declared = StructType([*schema_of(table).fields, StructField("year_month", StringType())])
    return spark.read.schema(declared).parquet(table_path(root, table))


def register_tables(
    spark: SparkSession, root: str, merge_schema: bool = False, tables: Sequence[str] = INGEST_ORDER
) -> list[str]:
    """A temporary view per stored table; absent tables are skipped with a warning.

    Tables beyond the declared ones are read with the columns of their files.
    """
    registered = []
    for table in tables:
        try:
            stored = read_table(spark, root, table, merge_schema or table not in INGEST_ORDER)
            stored.createOrReplaceTempView(table.lower())
            registered.append(table.lower())
        except AnalysisException as reason:
            log.warning("No Parquet for %s: %s", table, reason.getCondition())
    return registered


def run_query(
    spark: SparkSession,
    sql: str,
    params: Mapping[str, object] | Sequence[object] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """A lazy parameterised query: ``:name`` markers with a mapping, ``?`` with a sequence.

    A lazy result needs no row guard. With ``max_rows`` the query runs at once, and only once: see :func:`spooled`.
    """
    args = None if params is None else dict(params) if isinstance(params, Mapping) else list(params)
    result = spark.sql(sql, args=args) if args else spark.sql(sql)
    return result if max_rows is None else spooled(result, max_rows)[0]


def spooled(result: DataFrame, max_rows: int) -> tuple[DataFrame, str]:
    """Execute ``result`` once into the shared folder and hand out the stored rows, in their order, with the folder's path.

    Rows are counted by the tasks that write them. If there are more than ``max_rows`` the stored ones are deleted and
    the query is refused; so are those of a query that fails. Columns are stored by position, so names may repeat.
    """
    spark, path = result.sparkSession, shared_dir(result.sparkSession, "query")
    names, fields = result.columns, result.schema.fields
    place, counted = "place", Observation()
    stored = result.toDF(*(f"c{i}" for i in range(len(names))))
    untyped = {f"c{i}": F.lit(None).cast("string") for i, f in enumerate(fields) if isinstance(f.dataType, NullType)}
    try:
        (
            stored.withColumns({**untyped, place: F.monotonically_increasing_id()})
            .observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        )
        if (found := counted.get["rows"]) > max_rows:
            raise RuntimeError(f"Query would return {found} rows, more than {max_rows}")
    except BaseException:
        storage.delete(spark, path)
        raise
    columns = [StructField(f"c{i}", StringType() if f"c{i}" in untyped else f.dataType) for i, f in enumerate(fields)]
    rows = spark.read.schema(StructType([*columns, StructField(place, LongType())])).parquet(path).orderBy(place)
    out = (F.lit(None) if f"c{i}" in untyped else F.col(f"c{i}") for i in range(len(names)))
    return rows.select(*(c.alias(n) for c, n in zip(out, names))), path


def fetch(
    spark: SparkSession,
    sql: str,
    params: Mapping[str, object] | Sequence[object] | None = None,
    max_rows: int = MAX_ROWS,
) -> pd.DataFrame:
    """Run a query once and bring its rows to the driver, unless there are more than ``max_rows``; nothing stays stored."""
    rows, path = spooled(run_query(spark, sql, params), max_rows)
    try:
        return rows.toPandas()
    finally:
        storage.delete(spark, path)


def preview(
    spark: SparkSession, sql: str, params: Mapping[str, object] | Sequence[object] | None = None
) -> DataFrame:
    """The first 20 rows of a query."""
    return run_query(spark, sql, params).limit(20)


def write_table_csv(
    result: DataFrame, directory: str, name: str, one_part: bool = False, max_rows: int | None = None
) -> str:
    """Write a table as CSV with headers below ``directory/name``, unless it has more than ``max_rows``.

    ``one_part`` is for small report tables that end in a sort: one file keeps their order.
    """
    target = f"{directory.rstrip('/')}/{name}"
    kept, path = (result, None) if max_rows is None else spooled(result, max_rows)
    parts = kept.coalesce(1) if one_part else kept
    parts.write.mode("overwrite").option("header", True).csv(target)
    if path:
        storage.delete(result.sparkSession, path)
    return target
