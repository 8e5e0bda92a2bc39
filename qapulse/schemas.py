"""Declared schemas of the five archive tables and the column that drives month partitioning.

Names, order and types are fixed values of the archive format.
"""

from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_KINDS = {"id": LongType(), "int": IntegerType(), "time": TimestampNTZType(), "text": StringType()}


def _table(**columns: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]) for name, kind in columns.items()])


SCHEMAS = {
    "Posts": _table(
        Id="id", PostTypeId="int", AcceptedAnswerId="id", ParentId="id", CreationDate="time",
        Score="int", ViewCount="int", Body="text", OwnerUserId="id", LastEditorUserId="id",
        LastEditDate="time", LastActivityDate="time", Title="text", Tags="text", AnswerCount="int",
        CommentCount="int", FavoriteCount="int", ClosedDate="time", ContentLicense="text",
    ),
    "Users": _table(
        Id="id", Reputation="int", CreationDate="time", DisplayName="text", LastAccessDate="time",
        Location="text", AboutMe="text", Views="int", UpVotes="int", DownVotes="int", AccountId="id",
    ),
    "Comments": _table(
        Id="id", PostId="id", Score="int", Text="text", CreationDate="time", UserId="id",
        UserDisplayName="text", ContentLicense="text",
    ),
    "PostLinks": _table(
        Id="id", CreationDate="time", PostId="id", RelatedPostId="id", LinkTypeId="int",
    ),
    "Tags": _table(Id="id", TagName="text", Count="int", ExcerptPostId="id", WikiPostId="id"),
}

# None: the table has no date and is stored as the single partition "all".
PARTITION_COLUMN = {
    "Posts": "CreationDate",
    "Users": "CreationDate",
    "Comments": "CreationDate",
    "PostLinks": "CreationDate",
    "Tags": None,
}

# Small tables first, so that a broken dump shows before the long load starts.
INGEST_ORDER = ["Tags", "PostLinks", "Users", "Comments", "Posts"]


def schema_of(table: str) -> StructType:
    if table not in SCHEMAS:
        raise ValueError(f"Unknown table: {table}; expected one of {sorted(SCHEMAS)}")
    return SCHEMAS[table]
