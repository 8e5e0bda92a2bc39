import gzip
import hashlib
import json
import os
import time
import tracemalloc
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from qapulse.session import shared_dir
from qapulse.schemas import INGEST_ORDER, SCHEMAS
from qapulse.operators import validate
from qapulse.sources import file_digest, footers, lake, manifest, storage, xml_dump

TAGS = """<?xml version="1.0" encoding="utf-8"?>
<tags>
<row Id="71" TagName="gardening" Count="812" />
<row Id="93" TagName="beekeeping" Count="37" ExcerptPostId="5006" />
</tags>
"""
POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
<row Id="310" PostTypeId="1" CreationDate="2021-03-02T07:41:09.250" Score="-2" Title="Which hive?" />
<row Id="311" PostTypeId="2" ParentId="310" CreationDate="2021-03-31T23:59:59.999" Score="11" />
<row Id="402" PostTypeId="1" CreationDate="2021-07-19T18:20:00.000" Score="0" Title="Wax or foil" />
<row Id="415" PostTypeId="4" CreationDate="2021-07-20T00:00:00.007" Score="1" />
</posts>
"""
ONE_ROW = {
    "Tags": '<tags><row Id="8" TagName="soil" Count="64" /></tags>',
    "PostLinks": '<postlinks><row Id="77" CreationDate="2019-05-06T13:14:15.160" PostId="402" RelatedPostId="310" LinkTypeId="3" /></postlinks>',
    "Users": '<users><row Id="12" Reputation="908" CreationDate="2018-02-28T22:10:00.000" DisplayName="Mara" /></users>',
    "Comments": '<comments><row Id="900" PostId="311" Score="4" Text="smoke first" CreationDate="2021-04-01T06:00:00.000" /></comments>',
    "Posts": '<posts><row Id="310" PostTypeId="1" CreationDate="2021-03-02T07:41:09.250" Score="3" Title="Which hive?" /></posts>',
}


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()

    def write(**files):
        for table, text in files.items():
            (folder / f"{table}.xml").write_text(text, encoding="utf-8")
        return str(folder)

    return write


def rows_of(spark, path, table):
    return xml_dump.scan_dump_xml(spark, path, table).orderBy("Id").collect()


def test_rows_are_typed_and_empty_means_null(spark, raw):
    text = '<tags><row Id="17" TagName="mulch" Count="" ExcerptPostId="4410" WikiPostId="" Colour="brown"/></tags>'
    (row,) = rows_of(spark, raw(Tags=text) + "/Tags.xml", "Tags")
    assert row.asDict() == {"Id": 17, "TagName": "mulch", "Count": None, "ExcerptPostId": 4410, "WikiPostId": None}


def test_any_layout_and_all_escapes(spark, raw):
    text = (
        "<rows><row Id=\"1\"\n  TagName='a \"quoted\" &lt;row&gt; &amp;amp; é'/><row Id='2' TagName=\"x&#xA;y > z\"></row>"
        "  <row Id=\"3\" TagName=\"/>\" />\n\n</rows>"
    )
    got = rows_of(spark, raw(Tags=text) + "/Tags.xml", "Tags")
    assert [(r["Id"], r["TagName"]) for r in got] == [(1, 'a "quoted" <row> &amp; é'), (2, "x\ny > z"), (3, "/>")]


def test_one_large_file_is_split_over_tasks(spark, raw):
    body = "&lt;p&gt;é" * 200
    lines = "".join(f'  <row Id="{i}" Title="t{i}" Body="{body}" />\n' for i in range(3000))
    path = raw(Posts=f"<posts>\n{lines}</posts>\n") + "/Posts.xml"
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        posts = xml_dump.scan_dump_xml(spark, path, "Posts")
        assert posts.select(F.spark_partition_id()).distinct().count() > 2
        row = posts.agg(F.count("*"), F.count_distinct("Id"), F.sum("Id"), F.min(F.length("Body"))).first()
        assert tuple(row) == (3000, 3000, 3000 * 2999 // 2, 800)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_compressed_source(spark, tmp_path):
    path = tmp_path / "Tags.xml.gz"
    path.write_bytes(gzip.compress(TAGS.encode()))
    assert len(rows_of(spark, str(path), "Tags")) == 2


@pytest.mark.parametrize("bad", ['Id="x1"', 'Id="1" Count="9999999999"', "Id=1", 'Id="1" Id="2"'])
def test_malformed_rows_fail_the_job(spark, raw, bad):
    path = raw(Tags=f"<tags><row {bad} /></tags>") + "/Tags.xml"
    with pytest.raises(Exception):
        rows_of(spark, path, "Tags")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_malformed_values_fail_under_any_ansi_setting(spark, raw, ansi):
    path = raw(Posts='<posts><row Id="1" CreationDate="yesterday"/></posts>') + "/Posts.xml"
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="yesterday"):
            rows_of(spark, path, "Posts")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_permissive_coercion_gives_null(spark, raw):
    path = raw(Tags='<tags><row Id="x" TagName="t"/></tags>') + "/Tags.xml"
    assert xml_dump.scan_dump_xml(spark, path, "Tags", permissive=True).first()["Id"] is None


def test_unknown_table_and_missing_file(spark, tmp_path):
    with pytest.raises(ValueError, match="Unknown table"):
        xml_dump.scan_dump_xml(spark, str(tmp_path), "NotATable")
    with pytest.raises(FileNotFoundError):
        xml_dump.scan_dump_xml(spark, str(tmp_path / "none.xml"), "Tags")


def test_source_checks(spark, raw):
    folder = raw(Tags=TAGS, Users="", Posts="<posts></posts>")
    xml_dump.verify_source(spark, f"{folder}/Tags.xml")
    for name, reason in (("Users", "empty"), ("Posts", "No <row>"), ("Comments", "does not exist")):
        with pytest.raises(RuntimeError, match=reason):
            xml_dump.verify_source(spark, f"{folder}/{name}.xml")


def test_partition_keys(spark):
    rows = spark.createDataFrame([(1, datetime(2020, 2, 29, 23, 59)), (2, None)], "Id int, CreationDate timestamp_ntz")
    keyed = xml_dump.with_year_month(rows, "CreationDate").orderBy("Id").collect()
    assert [r["year_month"] for r in keyed] == ["2020-02", "unknown"]
    assert {r["year_month"] for r in xml_dump.with_year_month(rows, None).collect()} == {"all"}


def test_ingest_writes_month_partitions_once(spark, raw, tmp_path):
    folder, root = raw(Posts=POSTS, Tags=TAGS), str(tmp_path / "lake")
    assert lake.ingest_table(spark, folder, root, "Posts") == 4
    shown = sorted(n for n in os.listdir(f"{root}/posts") if not n.startswith("."))
    assert shown == ["_SUCCESS", "year_month=2021-03", "year_month=2021-07"]
    stored = lake.read_table(spark, root, "Posts")
    assert {r["year_month"]: r["count"] for r in stored.groupBy("year_month").count().collect()} == {"2021-03": 2, "2021-07": 2}
    assert stored.where("Id = 310").first()["CreationDate"] == datetime(2021, 3, 2, 7, 41, 9, 250000)
    assert lake.ingest_table(spark, folder, root, "Tags") == 2
    assert "year_month=all" in os.listdir(f"{root}/tags")
    # a second run loads nothing, and sources are still there
    assert lake.ingest_table(spark, folder, root, "Posts") is None
    assert os.path.exists(f"{folder}/Posts.xml")


def test_ingest_refuses_a_partial_load(spark, raw, tmp_path):
    root = tmp_path / "lake"
    (root / "tags" / "year_month=all").mkdir(parents=True)
    with pytest.raises(RuntimeError, match="(?i)_success marker"):
        lake.ingest_table(spark, raw(Tags=TAGS), str(root), "Tags")


def test_ingest_restarts_after_a_killed_first_write(spark, raw, tmp_path):
    root = tmp_path / "lake"
    (root / "tags" / "_temporary" / "0").mkdir(parents=True)
    assert lake.ingest_table(spark, raw(Tags=TAGS), str(root), "Tags") == 2
    assert lake.read_table(spark, str(root), "Tags").count() == 2


def test_a_load_killed_between_months_goes_on_with_the_rest(spark, raw, tmp_path, monkeypatch):
    folder, root = raw(Posts=POSTS), str(tmp_path / "lake")
    rename, moved = storage.rename, []

    def killed(spark, source, target):
        if moved:
            raise KeyboardInterrupt
        moved.append(target)
        rename(spark, source, target)

    monkeypatch.setattr(storage, "rename", killed)
    with pytest.raises(KeyboardInterrupt):
        lake.ingest_table(spark, folder, root, "Posts")
    assert os.listdir(f"{root}/posts") == ["year_month=2021-03"], "one whole month, and no marker"
    monkeypatch.setattr(storage, "rename", lambda *a: moved.append(a[2]) or rename(*a))
    os.remove(f"{folder}/Posts.xml")  # the dump is not needed any more
    assert lake.ingest_table(spark, folder, root, "Posts") == 4
    assert [os.path.basename(t) for t in moved] == ["year_month=2021-03", "year_month=2021-07"], "no month is moved twice"
    assert lake.read_table(spark, root, "Posts").count() == 4
    assert os.path.exists(f"{root}/posts/_SUCCESS") and not os.path.exists(f"{root}/_staging/posts")


def test_a_load_killed_while_writing_starts_anew_and_is_not_seen(spark, raw, tmp_path, monkeypatch):
    folder, root = raw(Posts=POSTS), str(tmp_path / "lake")
    write = storage.write_text
    monkeypatch.setattr(storage, "write_text", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        lake.ingest_table(spark, folder, root, "Posts")
    assert not os.path.exists(f"{root}/posts") and lake.register_tables(spark, root) == []
    monkeypatch.setattr(storage, "write_text", write)
    assert lake.ingest_table(spark, folder, root, "Posts") == 4 == lake.read_table(spark, root, "Posts").count()


def test_a_broken_move_is_done_again(spark, raw, tmp_path):
    """Where a file system moves file by file, a killed move leaves a month in both places."""
    folder, root = raw(Posts=POSTS), str(tmp_path / "lake")
    staged = f"{root}/_staging/posts"
    storage.write_text(spark, f"{staged}/_PLAN", json.dumps(lake._stage(spark, f"{folder}/Posts.xml", root, "Posts")))
    os.makedirs(f"{root}/posts/year_month=2021-03")
    assert lake.ingest_table(spark, folder, root, "Posts") == 4
    assert lake.read_table(spark, root, "Posts").groupBy("year_month").count().count() == 2


def test_counts_come_from_footers(spark, raw, tmp_path, plan_of):
    root = str(tmp_path / "lake")
    lake.ingest_table(spark, raw(Posts=POSTS), root, "Posts")
    counted = footers.partition_rows(spark, f"{root}/posts")
    assert "PushedAggregation: [COUNT(*)]" in plan_of(counted) and "PushedGroupBy: [year_month]" in plan_of(counted)
    assert {r.year_month: r.n for r in counted.collect()} == {"2021-03": 2, "2021-07": 2}
    assert "PushedAggregation" not in plan_of(lake.read_table(spark, root, "Posts").groupBy("year_month").count())


def test_a_stored_table_is_summarized_from_footers_and_its_outer_months(spark, tmp_path, plan_of):
    days = [f"20{y}-{m:02d}-{d:02d} 01:02:03.5" for y in (20, 21) for m in range(1, 13) for d in (3, 9)] + [None, None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "Id bigint, at string")
    comments = rows.select("Id", F.col("at").cast("timestamp_ntz").alias("CreationDate"))
    lake.write_partitioned(comments, "Comments", str(tmp_path))
    lake.write_partitioned(comments.select("Id"), "Tags", str(tmp_path))
    got = validate.summarize_stored(spark, str(tmp_path), "Comments")
    assert got.collect() == validate.summarize_table(lake.read_table(spark, str(tmp_path), "Comments"), "comments").collect()
    assert got.first()["partitions"] == 25 and "2020-01,2021-12" in plan_of(got).replace(" ", "")
    flat = validate.summarize_stored(spark, str(tmp_path), "Tags", has_dates=False)
    assert flat.collect() == validate.summarize_table(lake.read_table(spark, str(tmp_path), "Tags"), "tags", has_dates=False).collect()


def test_long_blanks_are_read_in_linear_time(spark, raw):
    blank = " " * 400_000
    path = raw(Posts=f'<posts><row Id="5" Body="a{blank}b" {blank} /> {blank} </posts>') + "/Posts.xml"
    begun = time.perf_counter()
    (row,) = rows_of(spark, path, "Posts")
    assert len(row["Body"]) == 400_002 and time.perf_counter() - begun < 10


def test_ingest_verifies_the_stored_rows(spark, raw, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    monkeypatch.setattr(lake.footers, "partition_rows", lambda *_: spark.createDataFrame([("all", 1)], "year_month string, n bigint"))
    with pytest.raises(RuntimeError, match="Verification failed"):
        lake.ingest_table(spark, raw(Tags=TAGS), root, "Tags")
    assert not os.path.exists(f"{root}/tags/_SUCCESS")


def test_a_disturbed_counter_does_not_fail_a_whole_load(spark, raw, tmp_path, monkeypatch):
    write = lake.write_partitioned
    monkeypatch.setattr(lake, "write_partitioned", lambda *a, **k: write(*a, **k) + 1)
    assert lake.ingest_table(spark, raw(Tags=TAGS), str(tmp_path / "lake"), "Tags") == 2


def test_source_can_be_dropped_after_success(spark, raw, tmp_path):
    folder = raw(Tags=TAGS)
    lake.ingest_table(spark, folder, str(tmp_path / "lake"), "Tags", keep_source=False)
    assert not os.path.exists(f"{folder}/Tags.xml")


def test_ingest_all_loads_five_tables(spark, raw, tmp_path):
    folder, root = raw(**ONE_ROW), str(tmp_path / "lake")
    assert lake.ingest_all(spark, folder, root) == dict.fromkeys(INGEST_ORDER, 1)
    assert lake.ingest_all(spark, folder, root) == dict.fromkeys(INGEST_ORDER)
    for table in SCHEMAS:
        assert os.path.exists(f"{root}/{table.lower()}/_SUCCESS")


def test_hot_month_is_split_over_files(spark, tmp_path):
    """One month with most rows must not end in one task."""
    rows = spark.range(200_000).select(
        F.col("id").alias("Id"),
        F.when(F.col("id") % 10 == 0, F.lit("2024-02-01")).otherwise("2024-01-01").cast("timestamp_ntz").alias("CreationDate"),
        F.sha2(F.col("id").cast("string"), 512).alias("Text"),
    ).repartition(8)
    advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 << 20))
    try:
        assert lake.write_partitioned(rows, "Comments", str(tmp_path)) == 200_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    hot = [f for f in os.listdir(tmp_path / "comments" / "year_month=2024-01") if f.endswith(".parquet")]
    assert len(hot) > 2
    assert not os.path.exists(tmp_path / "comments" / "_SUCCESS")


@pytest.fixture
def tags_lake(spark, raw, tmp_path):
    rows = '<row Id="4" TagName="oak" Count="9"/><row Id="6" TagName="ash" Count="31"/><row Id="7" TagName="elm" Count="30"/>'
    root = str(tmp_path / "lake")
    lake.ingest_table(spark, raw(Tags=f"<tags>{rows}</tags>"), root, "Tags")
    return root


def test_views_and_parameterised_queries(spark, tags_lake):
    assert lake.register_tables(spark, tags_lake) == ["tags"]
    got = lake.run_query(spark, "SELECT TagName FROM tags ORDER BY Id")
    assert [r[0] for r in got.collect()] == ["oak", "ash", "elm"]
    assert lake.run_query(spark, "SELECT * FROM tags WHERE Count >= ?", [30]).count() == 2
    assert lake.run_query(spark, "SELECT * FROM tags WHERE Count >= :low", {"low": 30}).count() == 2
    assert lake.preview(spark, "SELECT t.* FROM tags t, range(100)").count() == 20


def test_row_guard(spark, tags_lake, tmp_path, monkeypatch):
    lake.register_tables(spark, tags_lake)
    shared = tmp_path / "shared"
    monkeypatch.setattr(lake, "shared_dir", lambda spark, label: f"{shared}/{label}-{len(stored())}")

    def stored():
        return list(shared.glob("*")) if shared.exists() else []

    for guarded in (lake.run_query, lake.fetch):
        with pytest.raises(RuntimeError, match="(?i)would return 3 rows"):
            guarded(spark, "SELECT * FROM tags", max_rows=2)
    with pytest.raises(Exception, match="(?i)divi"):
        lake.run_query(spark, "SELECT 1 / (Count - Count) FROM tags", max_rows=9)
    assert not stored(), "a refused or failed query leaves nothing behind"
    assert len(lake.fetch(spark, "SELECT * FROM tags", max_rows=3)) == 3
    with pytest.raises(RuntimeError, match="(?i)would return"):
        lake.write_table_csv(spark.table("tags"), str(tmp_path), "t", max_rows=2)
    lake.write_table_csv(spark.table("tags"), str(tmp_path), "t", max_rows=3)
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").count() == 3
    assert not stored()
    assert lake.run_query(spark, "SELECT * FROM tags", max_rows=3).count() == 3
    assert len(stored()) == 1


def test_a_guarded_query_runs_once(spark, tags_lake):
    lake.register_tables(spark, tags_lake)
    text = "SELECT TagName AS x, Count AS x, NULL AS nothing, array(Id) AS many FROM tags ORDER BY TagName DESC"
    spark.sparkContext.setJobGroup("guarded", "one execution")
    try:
        ran = spark.range(1000).where("id % 2 = 0")
        rows, _ = lake.spooled(ran, 500)
        tracker = spark.sparkContext.statusTracker()
        (job,) = tracker.getJobIdsForGroup("guarded")
        assert len(tracker.getJobInfo(job).stageIds) == 1
        expected, got = spark.sql(text), lake.run_query(spark, text, max_rows=3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.id for r in rows.collect()] == list(range(0, 1000, 2))
    assert got.columns == expected.columns == ["x", "x", "nothing", "many"]
    assert [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in expected.schema]
    assert got.collect() == expected.collect()


def test_files_with_other_columns_merge_by_name(spark, tmp_path):
    for month, sql in (("2024-01", "SELECT 1 AS Id, 'a' AS TagName"), ("2024-02", "SELECT 2 AS Id, 5 AS Extra")):
        spark.sql(sql).write.parquet(f"{tmp_path}/tags/year_month={month}")
    merged = lake.read_table(spark, str(tmp_path), "Tags", merge_schema=True).orderBy("Id").collect()
    assert [(r["TagName"], r["Extra"]) for r in merged] == [("a", None), (None, 5)]


def test_row_digests(spark, tmp_path):
    frame = spark.range(500).withColumn("name", F.concat(F.lit("n"), F.col("id")))
    frame.coalesce(1).write.parquet(f"{tmp_path}/one")
    frame.orderBy(F.desc("id")).coalesce(1).write.parquet(f"{tmp_path}/two")
    frame.withColumn("name", F.when(F.col("id") != 9, F.col("name"))).coalesce(1).write.parquet(f"{tmp_path}/three")
    got = {p: manifest.row_manifest(spark, f"{tmp_path}/{p}").first() for p in ("one", "two", "three")}
    assert {r["row_count"] for r in got.values()} == {500}
    assert got["one"]["digest"] == got["two"]["digest"] != got["three"]["digest"]
    assert all(r["modified_at"] and r["size_bytes"] > 0 for r in got.values())
    total = sum(int(hashlib.md5(f"2:id{len(str(i))}:{i}4:name{len(str(i)) + 1}:n{i}".encode()).hexdigest()[:15], 16) for i in range(500))
    assert got["one"]["digest"] == str(total)
    (tmp_path / "dump.xml").write_text("<a>\n<b/>\n")
    (line,) = manifest.row_manifest(spark, f"{tmp_path}/dump.xml", "*.xml", "text").collect()
    assert (line["name"], line["row_count"], line["size_bytes"]) == ("dump.xml", 2, 9)
    (tmp_path / "empty").mkdir()
    with pytest.raises(RuntimeError, match="No files"):
        manifest.row_manifest(spark, str(tmp_path / "empty"), source="text").collect()


def one_digest(spark, path, frame):
    frame.coalesce(1).write.mode("overwrite").parquet(path)
    return manifest.row_manifest(spark, path).first()["digest"]


def test_different_rows_have_different_row_digests(spark, tmp_path):
    rows = [
        "SELECT 'x|=y' AS a, 'z' AS b", "SELECT 'x' AS a, 'y|=z' AS b", "SELECT 'x' AS a, 'y|=z' AS c", "SELECT 'z' AS a, 'x|=y' AS b",
        "SELECT '' AS a, 'z' AS b", "SELECT CAST(NULL AS STRING) AS a, 'z' AS b", "SELECT '1:b' AS a", "SELECT array('p, q') AS a", "SELECT array('p', 'q') AS a",
        "SELECT X'FF' AS a", "SELECT X'FE' AS a", "SELECT array(CAST(NULL AS STRING)) AS a", "SELECT array('null') AS a",
    ]
    digests = [one_digest(spark, f"{tmp_path}/t", spark.sql(text)) for text in rows]
    assert len(set(digests)) == len(rows)
    wider = one_digest(spark, f"{tmp_path}/t", spark.sql("SELECT 'z' AS b, CAST(NULL AS INT) AS more"))
    assert wider == digests[5], "a column without values is no difference"


def test_each_table_of_a_lake_has_its_own_columns(spark, tmp_path):
    spark.sql("SELECT id AS Id, 'a' AS Name FROM range(5)").write.parquet(f"{tmp_path}/tags/year_month=2024-01")
    spark.sql("SELECT id AS Id, 'b' AS Name, 7 AS Count FROM range(6)").write.parquet(f"{tmp_path}/tags/year_month=2024-02")
    spark.sql("SELECT id AS Other, X'00' AS Body FROM range(7)").write.parquet(f"{tmp_path}/posts")
    spark.range(0).coalesce(1).write.parquet(f"{tmp_path}/none")

    def taken():
        found = {}
        for r in manifest.row_manifest(spark, str(tmp_path)).collect():
            folder = r.path.split(f"{tmp_path}/")[1].rsplit("/", 1)[0]
            rows, digest = found.get(folder, (0, 0))
            found[folder] = (rows + r.row_count, digest + int(r.digest))
        return found

    before = taken()
    assert {p: n for p, (n, _) in before.items()} == {"tags/year_month=2024-01": 5, "tags/year_month=2024-02": 6, "posts": 7, "none": 0}
    spark.sql("SELECT id AS Id, 'b' AS Name, 8 AS Count FROM range(6)").write.mode("overwrite").parquet(f"{tmp_path}/tags/year_month=2024-02")
    spark.sql("SELECT id AS Other, X'01' AS Body FROM range(7)").write.mode("overwrite").parquet(f"{tmp_path}/posts")
    after = taken()
    changed = {p for p in before if before[p] != after[p]}
    assert changed == {"tags/year_month=2024-02", "posts"} and before["none"] == (0, 0)


def test_file_digests(spark, tmp_path):
    root = tmp_path / "dump"
    (root / "sub").mkdir(parents=True)
    (root / "hello.bin").write_bytes(b"hello world")
    (root / "sub" / "nothing.bin").write_bytes(b"")
    (root / "_SUCCESS").write_bytes(b"hidden")
    (root / "other.txt").write_bytes(b"another ending")
    rows = {r.name: r for r in manifest.dataset_manifest(spark, str(root), "*.bin").collect()}
    assert list(rows) == ["hello.bin", "nothing.bin"]
    assert rows["hello.bin"].sha256 == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert rows["nothing.bin"].sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows["hello.bin"].size_bytes, rows["nothing.bin"].size_bytes) == (11, 0) and rows["hello.bin"].modified_at
    assert manifest.dataset_manifest(spark, f"file:{root}").count() == 3
    assert manifest.dataset_manifest(spark, f"file://{root}/hello.bin").first().sha256 == rows["hello.bin"].sha256
    manifest.write_manifest(manifest.dataset_manifest(spark, str(root)), str(tmp_path / "manifest"))
    exported = spark.read.json(str(tmp_path / "manifest"))
    assert exported.count() == 3 and {"manifest_generated_at", "sha256"} <= set(exported.columns)
    for absent in ("*.none", "*"):
        with pytest.raises(Exception, match="No files"):
            manifest.dataset_manifest(spark, str(root if absent == "*.none" else tmp_path / "not there"), absent).collect()


def test_a_scheme_only_spark_knows_is_read_by_spark(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello world")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.m.link./d", f"file:{tmp_path}")
    assert not file_digest.readable("viewfs://m/d")
    (row,) = manifest.dataset_manifest(spark, "viewfs://m/d", "*.bin").collect()
    assert row.sha256 == hashlib.sha256(b"hello world").hexdigest()


def test_a_large_file_is_digested_in_bounded_memory(tmp_path):
    path, size = tmp_path / "sparse.bin", 3 << 30  # beyond what a single binary value can hold
    with path.open("wb") as file:
        file.truncate(size)
    reader = file_digest.FileDigests({"path": str(tmp_path)}).reader(None)
    (part,) = reader.partitions()
    tracemalloc.start()
    ((_, name, found, _, digest),) = reader.read(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = hashlib.sha256()
    for _ in range(size >> 20):
        whole.update(bytes(1 << 20))
    assert (name, found, digest) == ("sparse.bin", size, whole.hexdigest())
    assert peak < 8 << 20


def test_small_files_share_tasks_and_large_ones_do_not(tmp_path):
    for i in range(50):
        (tmp_path / f"{i}.bin").write_bytes(b"x")
    with (tmp_path / "large.bin").open("wb") as file:
        file.truncate(file_digest.SHARED_BYTES + 1)
    sizes = sorted(len(p.files) for p in file_digest.FileDigests({"path": str(tmp_path)}).reader(None).partitions())
    assert sizes == [1, 50]


def test_shared_dir_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://one:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Cluster, "x")
    Cluster.conf = {"spark.checkpoint.dir": "hdfs:///scratch"}
    assert shared_dir(Cluster, "x").startswith("hdfs:///scratch/qapulse/x-")


def test_a_written_dump_is_compressed_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from checks import star_posts

    monkeypatch.setattr(star_posts, "RECORDS", 100)
    rows = spark.range(1000).coalesce(1).select(
        F.col("id").alias("Id"), F.concat(F.lit('a < "b" & <c>\n'), "id").alias("TagName"), F.lit(None).cast("int").alias("Count")
    )
    star_posts.write_xml(rows, f"{tmp_path}/Tags.xml")
    parts = [p for p in (tmp_path / "Tags.xml").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 10 and sum(p.stat().st_size for p in parts) < 30_000  # some 60 KB of text
    got = xml_dump.scan_dump_xml(spark, f"{tmp_path}/Tags.xml", "Tags").select("Id", "TagName", "Count").collect()
    assert sorted(map(tuple, got)) == [(i, f'a < "b" & <c>\n{i}', None) for i in range(1000)]
