"""Every operator as a query over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.params import EARLY, MANIFEST_TABLES, ODD_BODY, PER_POST, RELEASE, START, report_columns, report_digits
from qapulse.functions import html, intents, tags
from qapulse.operators import breaks, counters, domains, features, figures, metrics, sampling, topics, validate
from qapulse.plans import reports
from checks.star_posts import declared, star_posts, star_table, write_xml
from qapulse.functions.calendar import month_label, questions
from qapulse.schemas import INGEST_ORDER, SCHEMAS
from qapulse.session import shared_dir
from qapulse.sources import lake, manifest, slices, xml_dump

QUANTILE_DIGITS = 3
STAT_DIGITS = 3


def _text_times(rows: DataFrame) -> DataFrame:
    """Timestamps as text: both engines print them alike."""
    return rows.select(
        *[
            F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
            if kind.startswith("timestamp")
            else F.col(name)
            for name, kind in rows.dtypes
        ]
    )


def _rounded(rows: DataFrame, digits: int, *names: str) -> DataFrame:
    """Interpolated and fitted values differ between engines in the last bits."""
    return rows.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in rows.columns])


def _latency(rows: DataFrame) -> DataFrame:
    return _rounded(rows, QUANTILE_DIGITS, "median_seconds", "p90_seconds")


def _dated(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return xml_dump.with_year_month(star_table(spark, sf, table), xml_dump.partition_column(table))


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {table.lower(): _dated(spark, sf, table) for table in SCHEMAS}


def _xml(spark: SparkSession, sf: str, *tables: str) -> str:
    raw = shared_dir(spark, "raw")
    for table in tables:
        write_xml(star_table(spark, sf, table), f"{raw}/{table}.xml")
    return raw


# --- sources and sinks ---------------------------------------------------------------------------


def scan_dump_xml(spark, sf):
    source = star_posts(spark, sf)
    raw = _xml(spark, sf, "Posts")
    rows = xml_dump.scan_dump_xml(spark, f"{raw}/Posts.xml", "Posts")
    return _text_times(rows.select(*source.columns))


def coerce_rows(spark, sf):
    posts = star_posts(spark, sf)
    raw = declared(posts, "Posts")
    texts = raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in raw.columns])
    return _text_times(xml_dump.coerce_rows(texts, SCHEMAS["Posts"]).select(*posts.columns))


def with_year_month(spark, sf):
    posts = star_posts(spark, sf)
    holes = posts.withColumn("CreationDate", F.when(F.col("Id") % 7 != 0, F.col("CreationDate")))
    return (
        xml_dump.with_year_month(holes, "CreationDate")
        .unionByName(xml_dump.with_year_month(posts, None))
        .groupBy("year_month")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _stored_posts(spark, sf) -> str:
    root = shared_dir(spark, "lake")
    lake.write_partitioned(declared(star_posts(spark, sf), "Posts"), "Posts", root)
    return root


def _by_partition(rows: DataFrame) -> DataFrame:
    return rows.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("Id").alias("ids"),
        F.sum(F.col("Score").cast("bigint")).alias("score"),
        F.sum(F.length("Body").cast("bigint")).alias("body_length"),
    )


def write_partitioned(spark, sf):
    return _by_partition(lake.read_table(spark, _stored_posts(spark, sf), "Posts"))


def ingest_table(spark, sf):
    root = shared_dir(spark, "lake")
    lake.ingest_table(spark, _xml(spark, sf, "Posts"), root, "Posts")
    return _by_partition(lake.read_table(spark, root, "Posts"))


def ingest_all(spark, sf):
    root = shared_dir(spark, "lake")
    raw = _xml(spark, sf, *INGEST_ORDER)
    lake.ingest_all(spark, raw, root)
    again = lake.ingest_all(spark, raw, root)
    parts = [
        lake.read_table(spark, root, table).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(table).alias("table_name"), "row_count", F.lit(again[table] is None).alias("skipped_again")
        )
        for table in INGEST_ORDER
    ]
    return reduce(DataFrame.unionByName, parts)


def verify_source(spark, sf):
    path = f"{_xml(spark, sf, 'Comments')}/Comments.xml"
    xml_dump.verify_source(spark, path)
    return xml_dump.source_records(spark, path).agg(F.count(F.lit(1)).alias("source_rows"))


def dataset_manifest(spark, sf):
    # All tables, bytes and rows. SQL has no file's bytes: a digest of 64 digits for every file is what can be compared.
    files = manifest.dataset_manifest(spark, sf, "*.parquet").select("path", F.regexp_like("sha256", F.lit("^[0-9a-f]{64}$")).alias("hashed"))
    columns = [c for own in MANIFEST_TABLES.values() for c in own]
    rows = manifest.row_manifest(spark, sf, "*.parquet", columns=columns).select("path", "name", "row_count", "digest")
    table = F.regexp_extract("path", r"/([^/]+\.parquet)(/[^/]*)?$", 1)  # a table may be one file or a folder of several
    bytes_ = files.groupBy(table.alias("name")).agg(F.bool_and("hashed").alias("bytes_hashed"))
    per = rows.groupBy(table.alias("name")).agg(
        F.sum("row_count").alias("row_count"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("digest")
    )
    return per.join(bytes_, "name").select("name", "row_count", "digest", "bytes_hashed")


def register_tables(spark, sf):
    root = shared_dir(spark, "lake")
    for table in INGEST_ORDER:
        lake.write_partitioned(declared(star_table(spark, sf, table), table), table, root)
    # A sixth table that is not there is skipped with a warning.
    found = lake.register_tables(spark, root, tables=[*INGEST_ORDER, "Badges"])
    return spark.sql(" UNION ALL ".join(f"SELECT '{t}' AS name, year_month, count(*) AS n FROM {t} GROUP BY 2" for t in found))


def run_query(spark, sf):
    star_posts(spark, sf).createOrReplaceTempView("posts")
    named = lake.run_query(
        spark,
        "SELECT Tags, count(*) AS n FROM posts WHERE Score >= :low AND CreationDate >= :start GROUP BY Tags",
        {"low": 5, "start": START},
    )
    positional = lake.run_query(
        spark, "SELECT Title AS Tags, count(*) AS n FROM posts WHERE ViewCount < ? GROUP BY Title", [300], 1000
    )
    return named.unionByName(positional)


def questions_slice(spark, sf):
    return _text_times(slices.questions_slice(declared(star_posts(spark, sf), "Posts"), START))


def answers_slice(spark, sf):
    return _text_times(slices.answers_slice(star_posts(spark, sf), START))


def preview(spark, sf):
    star_posts(spark, sf).createOrReplaceTempView("posts")
    return lake.preview(
        spark, "SELECT Id, Score, Title FROM posts WHERE PostTypeId = ? ORDER BY Score DESC, Id", [1]
    )


def write_table_csv(spark, sf):
    monthly = metrics.monthly_volume(star_posts(spark, sf), START)
    path = lake.write_table_csv(monthly, shared_dir(spark, "csv"), "monthly_volume.csv")
    return spark.read.option("header", True).schema(monthly.schema).csv(path)


# --- validation ----------------------------------------------------------------------------------


def summarize_table(spark, sf):
    return _text_times(validate.summarize_table(_dated(spark, sf, "Posts"), "posts"))


def partition_count(spark, sf):
    return validate.partition_count(_dated(spark, sf, "Posts"))


def questions_per_month(spark, sf):
    return validate.questions_per_month(star_posts(spark, sf), START)


def validation_summary(spark, sf):
    return _text_times(validate.validation_summary(_tables(spark, sf)))


def stored_summary(spark, sf):
    root = shared_dir(spark, "lake")
    for table in INGEST_ORDER:
        lake.write_partitioned(declared(star_table(spark, sf, table), table), table, root)
    return _text_times(validate.stored_summary(spark, root))


def validation_gaps(spark, sf):
    # A window opening years before the first question makes gaps.
    return validate.gap_summary(validate.questions_per_month(star_posts(spark, sf), EARLY))


def _report_contents(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Every value of every table of a report: numbers rounded, everything else as text."""
    parts = []
    for name, path in files.items():
        keys, numbers, texts = report_columns(name)
        rows = spark.read.option("header", True).csv(path)
        if name == PER_POST:  # many rows a month and no key: their sums
            rows = rows.groupBy("year_month").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in numbers])
        key = F.concat_ws("|", *keys)
        values = [F.struct(F.lit(c).alias("c"), F.round(F.col(c).cast("double"), report_digits(c)).alias("v"), F.lit(None).cast("string").alias("t")) for c in numbers]
        values += [F.struct(F.lit(c).alias("c"), F.lit(None).cast("double").alias("v"), F.substring(c, 1, 10).alias("t")) for c in texts]
        cell = F.explode(F.array(*values)).alias("x")
        parts.append(rows.select(F.lit(name).alias("report_table"), key.alias("row_key"), cell).select(
            "report_table", "row_key", F.col("x.c").alias("column_name"), F.col("x.v").alias("number"), F.col("x.t").alias("text")
        ))
    return reduce(DataFrame.unionByName, parts)


def validation_report(spark, sf):
    files = reports.validation_report(spark, _tables(spark, sf), shared_dir(spark, "report"), START)
    return _report_contents(spark, files)


# --- metrics, domains ----------------------------------------------------------------------------


def monthly_volume(spark, sf):
    return metrics.monthly_volume(star_posts(spark, sf), START)


def monthly_active_askers(spark, sf):
    return metrics.monthly_active_askers(star_posts(spark, sf), START)


def monthly_accepted_rate(spark, sf):
    return metrics.monthly_accepted_rate(star_posts(spark, sf), START)


def monthly_answer_coverage(spark, sf):
    return metrics.monthly_answer_coverage(star_posts(spark, sf), START)


def monthly_time_to_first_answer(spark, sf):
    return _latency(metrics.monthly_time_to_first_answer(star_posts(spark, sf), START))


def monthly_time_to_acceptance(spark, sf):
    return _latency(metrics.monthly_time_to_acceptance(star_posts(spark, sf), START))


def monthly_engagement(spark, sf):
    return metrics.monthly_engagement(star_posts(spark, sf), START)


def monthly_counters(spark, sf):
    return metrics.monthly_counters(star_posts(spark, sf), START)


def metrics_report(spark, sf):
    files = reports.metrics_report(spark, star_posts(spark, sf), shared_dir(spark, "report"), START)
    return _report_contents(spark, files)


def tag_domain(spark, sf):
    domain = tags.tag_domain(F.col("Tags")).alias("domain")
    return star_posts(spark, sf).groupBy("Tags", domain).agg(F.count(F.lit(1)).alias("n"))


def domain_volume(spark, sf):
    return domains.domain_volume(star_posts(spark, sf), START)


def domain_accepted_rate(spark, sf):
    return domains.domain_accepted_rate(star_posts(spark, sf), START)


def domain_coverage(spark, sf):
    return domains.domain_coverage(star_posts(spark, sf), START)


def domain_response_time(spark, sf):
    return _latency(domains.domain_response_time(star_posts(spark, sf), START))


def domain_engagement(spark, sf):
    return domains.domain_engagement(star_posts(spark, sf), START)


def domain_prepost_summary(spark, sf):
    return domains.domain_prepost_summary(star_posts(spark, sf), START, RELEASE)


def domain_volume_change(spark, sf):
    return domains.domain_volume_change(star_posts(spark, sf), START, RELEASE)


def domain_report(spark, sf):
    files = reports.domain_report(spark, star_posts(spark, sf), shared_dir(spark, "report"), START, RELEASE)
    return _report_contents(spark, files)


def activity_counters(spark, sf):
    return counters.activity_counters(star_posts(spark, sf), START, RELEASE)


def activity_report(spark, sf):
    files = reports.activity_report(spark, star_posts(spark, sf), shared_dir(spark, "report"), START, RELEASE)
    return _report_contents(spark, files)


# --- sampling, text features, intents ------------------------------------------------------------


def monthly_populations(spark, sf):
    return sampling.monthly_populations(star_posts(spark, sf), START)


def required_sample_size(spark, sf):
    # Populations from one to all of the orders of a customer, and their total per month.
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    sizes = orders.groupBy("o_custkey").agg((F.count(F.lit(1)) * 1000).alias("n"))
    return sampling.sample_plan(sizes, power=0.95, n_categories=9)


def monthly_sample_plan(spark, sf):
    return sampling.monthly_sample_plan(star_posts(spark, sf), START, power=0.95, n_categories=6)


def sample_plan_summary(spark, sf):
    return sampling.sample_plan_summary(monthly_sample_plan(spark, sf))


def stratified_monthly_sample(spark, sf):
    sample = sampling.stratified_monthly_sample(star_posts(spark, sf), START, ["Id", "Title"], n_categories=6)
    return metrics.labelled(sample)


def _odd(key: Column, found) -> Column:
    # NULL for a row without a key, as in SQL: the operators take a NULL body for an empty one. A condition around
    # them would have Spark evaluate their common parts again and again, the body itself if it were not bound.
    first, *others = [F.lit(part) for part in ODD_BODY.split("{}")]
    body = F.concat(first, *[part for other in others for part in (key.cast("string"), other)])
    return F.concat(F.transform(F.array(body), found)[0], F.left(key.cast("string"), F.lit(0)))


def body_prose(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = _odd(F.col("page_id"), html.body_prose)
    return pages.select("page_id", html.body_prose(F.col("html")).alias("prose"), odd.alias("odd_prose"))


def code_blocks(spark, sf):
    blocks = html.code_blocks(F.col("Body"))
    odd = _odd(F.col("Id"), lambda body: F.array_join(html.code_blocks(body), "|"))
    return star_posts(spark, sf).select(
        "Id", F.array_join(blocks, "|").alias("blocks"), F.size(blocks).alias("n"), odd.alias("odd_blocks")
    )


def odd_bodies(spark, sf):
    # Markup that a plain pattern gets wrong, and a body whose intent hangs on a reference, per supplier.
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("key"))
    odd = F.replace(F.lit(ODD_BODY), F.lit("{}"), F.col("key"))
    order = F.concat(F.lit("<p>Order "), F.col("key"), F.lit(" doesn&apos;t work</p>"))
    return intents.with_intent(suppliers, F.lit(None).cast("string"), html.body_prose(order)).select(
        "key", html.body_prose(odd).alias("prose"), F.array_join(html.code_blocks(odd), "|").alias("blocks"), "intent"
    )


def _feature(name: str):
    def query(spark, sf):
        asked = questions(star_posts(spark, sf), START)
        measured = features.with_features(asked, F.col("Title"), F.col("Body"), F.col("Tags"))
        return measured.select("Id", name)

    return query


def page_links(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", html.link_count(F.col("html")).alias("link_count"))


def per_post_features(spark, sf):
    return features.per_post_features(star_posts(spark, sf), START)


def monthly_feature_distributions(spark, sf):
    rows = features.monthly_feature_distributions(star_posts(spark, sf), START)
    return _rounded(rows, QUANTILE_DIGITS, *rows.columns[1:])


def features_report(spark, sf):
    files = reports.features_report(spark, star_posts(spark, sf), shared_dir(spark, "report"), START)
    return _report_contents(spark, files)


def classify_intent(spark, sf):
    asked = questions(star_posts(spark, sf), START)
    found = intents.with_intent(asked, F.col("Title"), html.body_prose(F.col("Body"))).select("Id", "intent")
    # A body whose intent hangs on a reference.
    key = F.coalesce(F.col("Id").cast("string"), F.lit(""))
    odd = F.concat(F.lit("<p>Order "), key, F.lit(" doesn&apos;t work</p>"))
    return intents.with_intent(found.withColumnRenamed("intent", "own"), F.lit(None).cast("string"), html.body_prose(odd)).select(
        "Id", F.col("own").alias("intent"), F.col("intent").alias("odd_intent")
    )


def per_post_intents(spark, sf):
    return topics.per_post_intents(star_posts(spark, sf), START)


def monthly_intent_distribution(spark, sf):
    return topics.monthly_intent_distribution(per_post_intents(spark, sf))


def monthly_intent_wide(spark, sf):
    return topics.monthly_intent_wide(per_post_intents(spark, sf))


def prepost_intent_summary(spark, sf):
    return topics.prepost_intent_summary(per_post_intents(spark, sf), RELEASE)


def topics_report(spark, sf):
    files = reports.topics_report(spark, star_posts(spark, sf), shared_dir(spark, "report"), START, RELEASE)
    return _report_contents(spark, files)


# --- structural breaks ---------------------------------------------------------------------------


def _series(spark, sf) -> DataFrame:
    return breaks.metric_series(star_posts(spark, sf), START)


def _order_series(spark, sf) -> DataFrame:
    """Many series: mean order value per priority and customer group by month."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")
    metric = F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_custkey") % 10).alias("metric")
    return orders.groupBy(metric, month).agg(F.avg("o_totalprice").alias("value"))


def _labelled_series(series: DataFrame) -> DataFrame:
    return series.select(
        "metric", month_label(F.col("month")).alias("year_month"), F.round("value", QUANTILE_DIGITS).alias("value")
    )


def metric_series(spark, sf):
    return _labelled_series(_series(spark, sf))


def stored_series(spark, sf):
    folder = shared_dir(spark, "report")
    reports.metrics_report(spark, star_posts(spark, sf), folder, START)
    return _labelled_series(breaks.stored_series(spark, folder))


def breakpoint_index(spark, sf):
    return breaks.breakpoint_index(_series(spark, sf), RELEASE)


def _chow_rounded(chow: DataFrame) -> DataFrame:
    return _rounded(chow, STAT_DIGITS, "f_statistic")


def chow_test(spark, sf):
    return _chow_rounded(breaks.chow_test(_series(spark, sf), RELEASE))


def chow_test_many(spark, sf):
    return _chow_rounded(breaks.chow_test(_order_series(spark, sf), RELEASE))


def cusum_test(spark, sf):
    return _rounded(breaks.cusum_test(_series(spark, sf), RELEASE), STAT_DIGITS, "cusum_max", "critical_5pct")


def _its_rounded(its: DataFrame) -> DataFrame:
    return _rounded(its, STAT_DIGITS, *[c for c in its.columns if c.endswith(("_coef", "_se"))])


def its_regression(spark, sf):
    return _its_rounded(breaks.its_regression(_series(spark, sf), RELEASE))


def its_regression_many(spark, sf):
    return _its_rounded(breaks.its_regression(_order_series(spark, sf), RELEASE))


def structural_break_report(spark, sf):
    files = reports.breaks_report(spark, star_posts(spark, sf), shared_dir(spark, "report"), START, RELEASE)
    return _report_contents(spark, files)


# --- tables behind the charts --------------------------------------------------------------------


def quality_band(spark, sf):
    return _rounded(figures.quality_band(star_posts(spark, sf), START), 9, "accepted_rate", "coverage_rate", "band")


def _hours(latency: DataFrame) -> DataFrame:
    return _rounded(figures.response_hours(latency), QUANTILE_DIGITS, "median_hours", "p90_hours")


def response_hours(spark, sf):
    posts = star_posts(spark, sf)
    parts = {
        "first_answer": metrics.monthly_time_to_first_answer.unordered(posts, START),
        "acceptance": metrics.monthly_time_to_acceptance.unordered(posts, START),
    }
    return reduce(
        DataFrame.unionByName, [_hours(rows).withColumn("kind", F.lit(kind)) for kind, rows in parts.items()]
    )


def domain_response_hours(spark, sf):
    return _hours(domains.domain_response_time(star_posts(spark, sf), START))


def complexity_prepost_change(spark, sf):
    rows = features.monthly_feature_distributions(star_posts(spark, sf), START)
    return _rounded(figures.complexity_prepost_change(rows, RELEASE), 6, "pre_mean", "post_mean", "pct_change")


def intent_stack(spark, sf):
    return _rounded(figures.intent_stack(monthly_intent_wide(spark, sf)), 9, "fraction", "cumulative")


def intent_prepost_compare(spark, sf):
    return figures.intent_prepost_compare(prepost_intent_summary(spark, sf))


def intent_trends(spark, sf):
    return figures.intent_trends(monthly_intent_distribution(spark, sf))


def ai_category_trends(spark, sf):
    return figures.ai_category_trends(monthly_intent_distribution(spark, sf))


def domain_volume_index(spark, sf):
    return _rounded(figures.domain_volume_index(domain_volume(spark, sf)), 9, "volume_index")


def domain_volume_change_rank(spark, sf):
    return figures.domain_volume_change_rank(domain_volume_change(spark, sf))


def its_fits(spark, sf):
    return _rounded(breaks.its_fits(_series(spark, sf), RELEASE), STAT_DIGITS, "observed", "fitted")


def cusum_paths(spark, sf):
    return _rounded(
        breaks.cusum_paths(_series(spark, sf), RELEASE), STAT_DIGITS, "cusum", "upper_bound", "lower_bound"
    )


def chow_summary(spark, sf):
    return _chow_rounded(figures.chow_summary(breaks.chow_test.unordered(_series(spark, sf), RELEASE)))


def its_coefficients(spark, sf):
    rows = figures.its_coefficients(breaks.its_regression.unordered(_series(spark, sf), RELEASE))
    return _rounded(rows, STAT_DIGITS, "coefficient", "p_value")


def period_summary(spark, sf):
    series = _series(spark, sf)
    parts = [
        figures.period_summary.unordered(series, stat, tail, RELEASE).withColumn("stat", F.lit(f"{stat}-{tail}"))
        for stat, tail in (("median", 0), ("mean", 6))
    ]
    return _rounded(reduce(DataFrame.unionByName, parts), QUANTILE_DIGITS, "pre_value", "post_value", "pct_change")


def questions_per_asker(spark, sf):
    return metrics.questions_per_asker(star_posts(spark, sf), START)


NAMES = [
    "scan_dump_xml", "coerce_rows", "with_year_month", "write_partitioned", "ingest_table", "ingest_all",
    "verify_source", "dataset_manifest", "register_tables", "run_query", "questions_slice", "answers_slice",
    "preview", "write_table_csv",
    "summarize_table", "partition_count", "questions_per_month", "validation_summary", "stored_summary", "validation_gaps",
    "validation_report",
    "monthly_volume", "monthly_active_askers", "monthly_accepted_rate", "monthly_answer_coverage",
    "monthly_time_to_first_answer", "monthly_time_to_acceptance", "monthly_engagement", "monthly_counters",
    "metrics_report",
    "tag_domain", "domain_volume", "domain_accepted_rate", "domain_coverage", "domain_response_time",
    "domain_engagement", "domain_prepost_summary", "domain_volume_change", "domain_report",
    "activity_counters", "activity_report",
    "monthly_populations", "required_sample_size", "monthly_sample_plan", "sample_plan_summary",
    "stratified_monthly_sample",
    "body_prose", "code_blocks", "odd_bodies", "page_links", "per_post_features", "monthly_feature_distributions",
    "features_report",
    "classify_intent", "per_post_intents", "monthly_intent_distribution", "monthly_intent_wide",
    "prepost_intent_summary", "topics_report",
    "metric_series", "stored_series", "breakpoint_index", "chow_test", "chow_test_many", "cusum_test", "its_regression",
    "its_regression_many", "structural_break_report",
    "quality_band", "response_hours", "domain_response_hours", "complexity_prepost_change", "intent_stack",
    "intent_prepost_compare", "intent_trends", "ai_category_trends", "domain_volume_index",
    "domain_volume_change_rank", "its_fits", "cusum_paths", "chow_summary", "its_coefficients",
    "period_summary", "questions_per_asker",
]
QUERIES = {name: globals()[name] for name in NAMES}
QUERIES.update({name: _feature(name) for name in features.FEATURES})
