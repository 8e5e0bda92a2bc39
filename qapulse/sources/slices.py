"""Column slices of the posts table inside the analysis window."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qapulse.constants import START
from qapulse.functions.calendar import ANSWER, questions, since

# The columns of each slice.
QUESTION_COLUMNS = [
    "Id", "Score", "Title", "Tags", "Body", "ViewCount", "OwnerUserId", "AnswerCount", "ClosedDate",
    "CommentCount", "CreationDate", "LastActivityDate", "AcceptedAnswerId",
]
ANSWER_COLUMNS = ["Id", "Score", "Body", "ParentId", "OwnerUserId", "CommentCount", "CreationDate"]


def questions_slice(posts: DataFrame, start: date = START) -> DataFrame:
    return questions(posts, start).select(*QUESTION_COLUMNS)


def answers_slice(posts: DataFrame, start: date = START) -> DataFrame:
    return since(posts.where(F.col("PostTypeId") == ANSWER), start).select(*ANSWER_COLUMNS)
