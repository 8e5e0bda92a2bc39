"""From documents to packed sequences: language, near-duplicates, benchmark passages, secrets, packing.

Each stage works on all rows its predecessor kept and returns the columns of documents, but for the last, which returns
pieces of sequences. What a stage decides takes effect: rejected and repeated documents and those that hold benchmark windows go,
``lang`` becomes the predicted language, secrets are masked (and ``n_chars`` counted anew). Columns whose names
a stage uses itself pass through under their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qapulse.llm import decontam, language, packing, probminhash, secrets
from qapulse.llm.shared import documents, fresh, stash, without


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with clashing columns under other names, and those names by their own."""
    clashing = {n: fresh(n) for n in docs.columns if n in names}
    return docs.withColumnsRenamed(clashing), clashing


def _columns(docs: DataFrame, names: dict[str, str], **changed) -> list:
    return [changed[n].alias(n) if n in changed else F.col(names.get(n, n)).alias(n) for n in docs.columns]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach."""
    samples = language.learn(docs.where(~language.held_out()))
    renamed, names = _aside(docs, "lang_pred", "score", "bits", "n_letters")
    found = language.identify(renamed, samples).where(language.accepted(samples))
    return found.select(*_columns(docs, names, lang=F.col("lang_pred")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return probminhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    found = decontam.decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stash(found.where("contaminated").select("doc_id", "text_key"), "contaminated"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    renamed, names = _aside(docs, "secret_spans", "masked_text")
    found = secrets.scan_secrets(renamed)
    return found.select(*_columns(docs, names, text=F.col("masked_text"), n_chars=F.length("masked_text").cast("bigint")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Cross-parsing, signatures and tokens cannot be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
