"""Read an archive table from its ``<row Attr="..."/>`` XML dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from qapulse.schemas import PARTITION_COLUMN, schema_of
from qapulse.sources.storage import exists, total_length

# What follows "<row": attributes or the end of the tag. Rules out "<rows>" and the file header.
_IS_ROW = r"^(?:\s+[^\s<>/=]|\s*/?>)"
_BLANK = " \t\r\n"


def source_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per row element.

    The built-in XML source reads a whole file in one task; a dump table is one file of up to
    hundreds of GB. The text source splits an uncompressed file at any size, with "<row" as the
    record separator (a raw "<" cannot occur inside an attribute value), in whatever line layout.
    """
    return spark.read.option("lineSep", "<row").text(path).where(F.col("value").rlike(_IS_ROW))


def scan_attributes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Attributes named in ``schema`` as strings; missing ones NULL, others ignored."""
    attributes = StructType([StructField(f"_{f.name}", StringType()) for f in schema.fields])
    # Closing tags of the row and its parents follow the first "</"; each step is linear in the record.
    inner = F.rtrim(F.substring_index("value", "</", 1), F.lit(_BLANK))
    inner = F.when(inner.endswith(">"), F.left(inner, F.length(inner) - 1)).otherwise(inner)
    inner = F.when(inner.endswith("/"), F.left(inner, F.length(inner) - 1)).otherwise(inner)
    element = F.concat(F.lit("<row"), inner, F.lit("/>"))
    parsed = source_records(spark, path).select(
        F.from_xml(element, attributes, {"mode": "FAILFAST"}).alias("row")
    )
    return parsed.select(*[F.col(f"row._{f.name}").alias(f.name) for f in schema.fields])


def coerce_rows(raw: DataFrame, schema: StructType, permissive: bool = False) -> DataFrame:
    """Cast string attributes to their declared types; empty or missing means NULL.

    A malformed number or timestamp fails the job, or becomes NULL if ``permissive``. ANSI casts fail
    by themselves; in a session without ANSI mode the failure is spelled out.
    """
    ansi = raw.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"

    def typed(field: StructField) -> Column:
        text = F.nullif(F.col(field.name), F.lit(""))
        if field.dataType == StringType():
            return text.alias(field.name)
        if ansi and not permissive:
            return text.cast(field.dataType).alias(field.name)
        value = text.try_cast(field.dataType)
        if not permissive:
            reason = F.concat(F.lit(f"Malformed {field.name}: "), text)
            value = F.coalesce(
                value, F.when(text.isNotNull(), F.raise_error(reason).cast(field.dataType))
            )
        return value.alias(field.name)

    return raw.select(*[typed(field) for field in schema.fields])


def scan_dump_xml(spark: SparkSession, path: str, table: str, permissive: bool = False) -> DataFrame:
    """Typed rows of one of the five archive tables."""
    schema = schema_of(table)
    if not exists(spark, path):
        raise FileNotFoundError(f"XML not found: {path}")
    return coerce_rows(scan_attributes(spark, path, schema), schema, permissive)


def count_rows(spark: SparkSession, path: str) -> int:
    return source_records(spark, path).count()


def verify_source(spark: SparkSession, path: str) -> None:
    """The dump exists, is not empty, and holds at least one row element."""
    if not exists(spark, path):
        raise RuntimeError(f"Expected source file does not exist: {path}")
    if total_length(spark, path) == 0:
        raise RuntimeError(f"Expected source file is empty: {path}")
    if source_records(spark, path).isEmpty():
        raise RuntimeError(f"No <row> elements found in {path}")


def with_year_month(rows: DataFrame, column: str | None) -> DataFrame:
    """Add the partition key: ``all`` for an undated table, ``unknown`` for a NULL date."""
    if column is None:
        return rows.withColumn("year_month", F.lit("all"))
    label = F.date_format(F.col(column), "yyyy-MM")
    return rows.withColumn("year_month", F.coalesce(label, F.lit("unknown")))


def partition_column(table: str) -> str | None:
    schema_of(table)
    return PARTITION_COLUMN[table]
