"""Each stage of the pipeline, and the registered queries."""

import os
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from qapulse.llm import decontam, secrets
from qapulse.llm.shared import stash

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stash(stage(spark, before, SF), name)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
        if name == "near_duplicates":
            kept = [r.text for r in after.collect()]
            assert gone and len(set(kept)) == len(kept)
        if name == "decontamination":
            found = decontam.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert gone == {r.doc_id for r in found.where("contaminated").collect()} != set()
        if name in ("language", "secrets"):
            assert not gone
        if name == "secrets":
            assert secrets.scan_secrets(after).where("size(secret_spans) > 0").count() == 0
            assert after.where(F.col("n_chars") != F.length("text")).count() == 0
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


@pytest.mark.parametrize("at", range(4))
def test_stages_take_messy_rows(spark, messy, nothing, at):
    stage = corpus_pipeline.STAGES[at][1]
    assert stage(spark, messy, SF).columns == messy.columns
    out = stage(spark, messy, SF).collect()
    assert out and stage(spark, nothing, SF).collect() == []
    ids = {(r.doc_id, r.n_chars) for r in out} if at != 3 else set()
    if at == 0:
        assert all(any(c.isalpha() for c in r.text) for r in out)
    if at == 1:  # copies of one document leave one row, and the smallest id stays
        assert sum(r.doc_id == 6 for r in out) <= 1 and ids


def test_every_query_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_the_rest_works_without_this_part(tmp_path):
    """As after its folders and the pipeline module are deleted."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('qapulse.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 80 and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", script, ROOT], check=True, cwd=tmp_path)
