"""Archive tables derived from the star-schema test tables, to run every operator on given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qapulse.schemas import schema_of

#: Lines in a file of a written dump: some 100 MB of text.
RECORDS = 500_000

# One text for Spark and for the SQL oracle.
POSTS_SQL = """
SELECT o_orderkey * 10 AS Id,
       1 AS PostTypeId,
       CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 10 + 1 END AS AcceptedAnswerId,
       CAST(NULL AS BIGINT) AS ParentId,
       o_orderdate AS CreationDate,
       CAST(o_orderkey % 17 AS INT) - 3 AS Score,
       CAST(o_orderkey % 900 AS INT) AS ViewCount,
       CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS OwnerUserId,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS AnswerCount,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 7 AS INT) END AS CommentCount,
       CASE o_orderkey % 12
            WHEN 0 THEN 'How to use pandas merge' WHEN 1 THEN 'Best practice for caching'
            WHEN 2 THEN 'NullPointerException in Java' WHEN 3 THEN 'Function returns wrong result'
            WHEN 4 THEN 'Migrating from v1.2 to v2.0' WHEN 5 THEN 'Please review my snippet'
            WHEN 6 THEN 'Copilot wrote this loop' WHEN 7 THEN 'What is the difference between a and b'
            WHEN 8 THEN 'Tutorial on sorting' WHEN 9 THEN 'Sort a list'
            WHEN 10 THEN 'Bombard the server' END AS Title,
       CASE o_orderkey % 6
            WHEN 0 THEN '<python><pandas>' WHEN 1 THEN '<java><python>' WHEN 2 THEN '<javascript><html>'
            WHEN 3 THEN '<bash>' WHEN 4 THEN '<PYTHON>' END AS Tags,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            ELSE concat('<p>Order ', o_orderpriority, ' see <a href="u">doc</a> and <code>f()</code></p>',
                        CASE WHEN o_orderkey % 3 = 0 THEN '<pre><code>x = 1</code></pre>'
                             WHEN o_orderkey % 3 = 1 THEN '<pre><code>a &amp; b</code></pre><p>then</p><pre>longer block</pre>'
                             ELSE '' END) END AS Body
FROM orders
UNION ALL
SELECT l_orderkey * 10 + l_linenumber, 2, NULL, l_orderkey * 10, l_shipdate,
       CAST(l_quantity AS INT), NULL, l_suppkey, NULL, 0, NULL, NULL, '<p>answer</p>'
FROM lineitem
"""

USERS_SQL = """
SELECT o_custkey AS Id, CAST(o_custkey % 5000 AS INT) AS Reputation, MIN(o_orderdate) AS CreationDate,
       MAX(o_orderdate) AS LastAccessDate
FROM orders GROUP BY o_custkey
"""

COMMENTS_SQL = """
SELECT event_id AS Id, user_id * 10 AS PostId, CAST(event_id % 9 AS INT) AS Score,
       concat(event_type, ' & "', props, '" <', event_type, '>') AS Text, ts AS CreationDate, user_id AS UserId
FROM events
"""

POSTLINKS_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS Id, l_shipdate AS CreationDate, l_orderkey * 10 AS PostId,
       l_partkey * 10 AS RelatedPostId, CAST(l_linenumber % 3 + 1 AS INT) AS LinkTypeId
FROM lineitem
"""

TAGS_SQL = """
SELECT p_partkey AS Id, p_name AS TagName, p_size AS Count,
       CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 10 END AS ExcerptPostId
FROM part
"""

ARCHIVE_SQL = {
    "Posts": POSTS_SQL,
    "Users": USERS_SQL,
    "Comments": COMMENTS_SQL,
    "PostLinks": POSTLINKS_SQL,
    "Tags": TAGS_SQL,
}


def star_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One archive table over the Parquet files of ``sf_dir``."""
    inputs = {}
    for name in ("orders", "lineitem", "events", "part"):
        if f"FROM {name}\n" in ARCHIVE_SQL[table] or f"FROM {name} " in ARCHIVE_SQL[table]:
            inputs[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = ARCHIVE_SQL[table]
    for name in inputs:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **inputs)


def star_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "Posts")


def declared(rows: DataFrame, table: str) -> DataFrame:
    """Add the declared columns a derived table lacks, as NULL."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema_of(table).fields
        ]
    )


def write_xml(rows: DataFrame, path: str) -> None:
    """Rows as ``<row Attr="..."/>`` lines; NULLs are left out.

    Ten times as long as the tables they come from, the lines are compressed. A compressed file is read by one task, so it holds
    at most ``RECORDS`` of them.
    """

    def attribute(name: str, kind: str):
        text = F.col(name).cast("string")
        if kind.startswith("timestamp"):
            text = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if kind == "string":  # numbers and times have nothing to escape
            for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#xA;")):
                text = F.replace(text, F.lit(raw), F.lit(escaped))
        return F.concat(F.lit(f'{name}="'), text, F.lit('"'))

    line = F.concat(F.lit("  <row "), F.concat_ws(" ", *[attribute(*c) for c in rows.dtypes]), F.lit(" />"))
    rows.select(line.alias("value")).write.option("compression", "lz4").option("maxRecordsPerFile", RECORDS).text(path)
