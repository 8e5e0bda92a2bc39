"""The same results in plain SQL, written independently of the operators.

Fixed values (intent patterns, domain tags) and the SQL of the test archive are shared with the library and the adapter, so a wrong one would pass
on both sides: ``tests/test_text.py`` pins them.
"""

from __future__ import annotations

from checks.params import EARLY, MANIFEST_TABLES, ODD_BODY, PER_POST, RELEASE, START, report_columns, report_digits
from qapulse.functions.intents import CATEGORIES, DEFAULT_INTENT, INTENT_PATTERNS
from qapulse.functions.tags import DOMAIN_TAGS
from checks.star_posts import ARCHIVE_SQL, POSTS_SQL

_TIME = "'%Y-%m-%d %H:%M:%S.%f'"
_YM = "strftime(CreationDate, '%Y-%m')"
_IN = f"CreationDate >= DATE '{START}'"

# One named step each; a query lists the steps it needs, in order.
STEPS = {"posts": POSTS_SQL}
STEPS["q"] = f"SELECT *, {_YM} AS year_month FROM posts WHERE PostTypeId = 1 AND {_IN}"


def sql(body: str, *steps: str) -> str:
    listed = ", ".join(f"{name} AS ({STEPS[name]})" for name in steps)
    return f"WITH {listed} {body}" if steps else body


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DOMAIN_CASE = (
    "CASE "
    + " ".join(
        f"WHEN {' OR '.join(f'Tags LIKE {_quoted(f"%<{t}>%")}' for t in names)} THEN {_quoted(domain)}"
        for domain, names in DOMAIN_TAGS.items()
    )
    + " ELSE 'Other' END"
)
STEPS["qd"] = f"SELECT *, {DOMAIN_CASE} AS domain FROM q"

COVERAGE = "COUNT(*) FILTER (AnswerCount > 0) / COUNT(*) AS coverage_rate"
ACCEPTED = "COUNT(AcceptedAnswerId) / COUNT(*) AS accepted_rate"
MEANS = "AVG(Score) AS mean_score, COALESCE(SUM(CommentCount), 0) / COUNT(*) AS mean_comments"
VOLUME = (
    f"SELECT {_YM} AS year_month, COUNT(*) FILTER (PostTypeId = 1) AS question_count, "
    f"COUNT(*) FILTER (PostTypeId = 2) AS answer_count FROM posts WHERE {_IN} GROUP BY 1"
)
STEPS["volume"] = VOLUME
STEPS["askers"] = "SELECT year_month, COUNT(DISTINCT OwnerUserId) AS distinct_askers FROM q GROUP BY 1"
STEPS["accepted"] = f"SELECT year_month, COUNT(*) AS question_count, {ACCEPTED} FROM q GROUP BY 1"
STEPS["coverage"] = f"SELECT year_month, COUNT(*) AS question_count, {COVERAGE} FROM q GROUP BY 1"
STEPS["engagement"] = f"SELECT year_month, COUNT(*) AS question_count, {MEANS} FROM q GROUP BY 1"

STEPS["waits"] = (
    "SELECT q.Id, q.year_month, q.Tags, epoch(MIN(a.CreationDate) - q.CreationDate) AS s FROM q "
    "JOIN posts a ON a.ParentId = q.Id WHERE a.PostTypeId = 2 GROUP BY q.Id, q.CreationDate, q.year_month, q.Tags"
)
STEPS["accepts"] = (
    "SELECT q.year_month, epoch(a.CreationDate - q.CreationDate) AS s FROM q JOIN posts a ON a.Id = q.AcceptedAnswerId"
)
_QUANTILES = "MEDIAN(s) AS median_seconds, QUANTILE_CONT(s, 0.9) AS p90_seconds"
STEPS["ttfa"] = f"SELECT year_month, COUNT(*) AS answered_count, {_QUANTILES} FROM waits GROUP BY 1"
STEPS["tta"] = f"SELECT year_month, COUNT(*) AS accepted_count, {_QUANTILES} FROM accepts GROUP BY 1"
STEPS["domain_waits"] = (
    f"SELECT year_month, {DOMAIN_CASE} AS domain, COUNT(*) AS answered_count, {_QUANTILES} FROM waits GROUP BY 1, 2"
)
STEPS["domain_counts"] = "SELECT year_month, domain, COUNT(*) AS question_count FROM qd GROUP BY 1, 2"
_SECONDS = "ROUND(median_seconds, 3) AS median_seconds, ROUND(p90_seconds, 3) AS p90_seconds"
_HOURS = "ROUND(median_seconds / 3600, 3) AS median_hours, ROUND(p90_seconds / 3600, 3) AS p90_hours"

_MONTH_CUT = f"'{RELEASE:%Y-%m}'"
STEPS["change"] = (
    f"SELECT domain, AVG(CASE WHEN year_month < {_MONTH_CUT} THEN question_count END) AS pre_mean, "
    f"AVG(CASE WHEN year_month >= {_MONTH_CUT} THEN question_count END) AS post_mean, "
    f"CAST(SUM(CASE WHEN year_month < {_MONTH_CUT} THEN question_count END) AS BIGINT) AS pre_total, "
    f"CAST(SUM(CASE WHEN year_month >= {_MONTH_CUT} THEN question_count END) AS BIGINT) AS post_total "
    "FROM domain_counts GROUP BY 1"
)
CHANGE = (
    "SELECT domain, pre_mean, post_mean, (post_mean - pre_mean) / pre_mean * 100 AS pct_change_mean, "
    "pre_total, post_total FROM change WHERE pre_mean IS NOT NULL"
)

# Sample sizes: 1.959964 and so on are quantiles of the normal distribution.
_Z = {0.95: 1.6448536269514722, 0.975: 1.959963984540054, 6: 2.638257273476751, 9: 2.7729212946086634}


def _required(n: str, k: int) -> str:
    raw = (
        f"GREATEST(CEIL(POW(({_Z[0.975]} + {_Z[0.95]}) / 0.2, 2)), CEIL(POW({_Z[k]}, 2) * 0.25 / POW(0.02, 2)))"
    )
    return f"CAST(LEAST(CEIL({raw} * {n} / ({raw} + {n} - 1)), {n}) AS BIGINT)"


STEPS["pop"] = "SELECT year_month, COUNT(*) AS n FROM q GROUP BY 1"
for _k in (6, 9):
    STEPS[f"plan{_k}"] = f"SELECT year_month, n, {_required('n', _k)} AS required_n FROM pop"
    STEPS[f"sample{_k}"] = (
        "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year_month ORDER BY md5(CAST(Id AS VARCHAR)), Id) AS rn "
        f"FROM q) WHERE rn <= (SELECT MAX(required_n) FROM plan{_k})"
    )

_DECODED = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def _prose(html: str) -> str:
    shown = (
        f"regexp_replace(coalesce({html}, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
        "|<pre[^>]*>.*?</pre>', '<!>', 'g')"
    )
    nodes = f"list_transform(regexp_split_to_array({shown}, '<[^>]*>'), lambda x: trim({_DECODED.format('x')}, {_SPACE}))"
    return f"array_to_string(list_filter({nodes}, lambda x: x <> ''), ' ')"


def _blocks(html: str) -> str:
    found = f"regexp_extract_all(coalesce({html}, ''), '(?is)<pre[^>]*>(.*?)</pre>', 1)"
    plain = "regexp_replace(x, '<[^>]*>', '', 'g')"
    return f"list_transform({found}, lambda x: {_DECODED.format(plain)})"


FEATURE_SQL = {
    "title_length": "length(coalesce(Title, ''))",
    "body_prose_length": f"length({_prose('Body')})",
    "code_block_count": f"len({_blocks('Body')})",
    "code_block_total_length": f"coalesce(list_sum(list_transform({_blocks('Body')}, lambda b: length(b))), 0)",
    "link_count": "len(regexp_extract_all(coalesce(Body, ''), '(?i)<a\\s'))",
    "tag_count": "length(coalesce(Tags, '')) - length(replace(coalesce(Tags, ''), '<', ''))",
}
_FEATURES = ", ".join(f"CAST({text} AS INT) AS {name}" for name, text in FEATURE_SQL.items())
STEPS["features"] = f"SELECT {_FEATURES}, year_month FROM sample6"
STEPS["distributions"] = "SELECT year_month, " + ", ".join(
    f"CAST(MEDIAN({f}) AS DOUBLE) AS {f}_median, CAST(QUANTILE_CONT({f}, 0.9) AS DOUBLE) AS {f}_p90" for f in FEATURE_SQL
) + " FROM features GROUP BY 1"

_TEXT = f"coalesce(Title, '') || ' ' || {_prose('Body')}"
INTENT_CASE = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(body_text, {_quoted('(?i)' + pattern)}) THEN {_quoted(intent)}"
        for intent, pattern in INTENT_PATTERNS.items()
    )
    + f" ELSE {_quoted(DEFAULT_INTENT)} END"
)
STEPS["intents"] = (
    f"SELECT year_month, {INTENT_CASE} AS intent, Id AS post_id FROM (SELECT *, {_TEXT} AS body_text FROM sample9)"
)
STEPS["distribution"] = (
    "SELECT year_month, intent, COUNT(*) AS count, "
    "COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY year_month) AS fraction FROM intents GROUP BY 1, 2"
)
STEPS["wide"] = (
    "SELECT year_month, "
    + ", ".join(f"COUNT(*) FILTER (intent = '{c}') AS \"{c}\"" for c in CATEGORIES)
    + ", "
    + ", ".join(f"COUNT(*) FILTER (intent = '{c}')::DOUBLE / COUNT(*) AS \"{c}_fraction\"" for c in CATEGORIES)
    + " FROM intents GROUP BY 1"
)
STEPS["prepost"] = (
    "SELECT period, intent, COUNT(*) AS count, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY period) AS fraction "
    f"FROM (SELECT *, CASE WHEN year_month < {_MONTH_CUT} THEN 'pre' ELSE 'post' END AS period FROM intents) GROUP BY 1, 2"
)

STEPS["long"] = " UNION ALL ".join(
    f"SELECT year_month, '{c}' AS intent, \"{c}_fraction\" AS fraction FROM wide" for c in CATEGORIES
)

_SERIES = [
    ("volume", "question_count", "Question Volume"),
    ("volume", "answer_count", "Answer Volume"),
    ("askers", "distinct_askers", "Active Askers"),
    ("accepted", "accepted_rate", "Accepted Rate"),
    ("coverage", "coverage_rate", "Answer Coverage"),
    ("ttfa", "median_seconds", "Time to First Answer (med)"),
    ("tta", "median_seconds", "Time to Acceptance (med)"),
    ("engagement", "mean_score", "Mean Score"),
    ("engagement", "mean_comments", "Mean Comments"),
]
STEPS["series"] = " UNION ALL ".join(
    f"SELECT '{label}' AS metric, CAST(year_month || '-01' AS DATE) AS month, CAST({column} AS DOUBLE) AS value "
    f"FROM {table} WHERE {column} IS NOT NULL"
    for table, column, label in _SERIES
)
STEPS["many"] = (
    "SELECT o_orderpriority || '/' || CAST(o_custkey % 10 AS VARCHAR) AS metric, "
    "CAST(date_trunc('month', o_orderdate) AS DATE) AS month, AVG(o_totalprice) AS value FROM orders GROUP BY 1, 2"
)


def _p_value(t: str) -> str:
    """Two-sided t probability: the finite series, its coefficients through the gamma function."""
    c2 = f"(m / (m + {t} * {t}))"
    odd = (
        "list_sum(list_transform(range(0, CAST((m - 1) // 2 AS BIGINT)), lambda j: "
        f"EXP(LGAMMA(j + 1) - LGAMMA(j + 1.5)) * SQRT(PI()) / 2 * POW({c2}, j + 0.5)))"
    )
    even = (
        "list_sum(list_transform(range(0, CAST(m // 2 AS BIGINT)), lambda j: "
        f"EXP(LGAMMA(j + 0.5) - LGAMMA(j + 1)) / SQRT(PI()) * POW({c2}, j)))"
    )
    sine = f"(ABS({t}) / SQRT(m + {t} * {t}))"
    return (
        f"CASE WHEN m % 2 = 1 THEN 1 - 2 / PI() * (ATAN(ABS({t}) / SQRT(m)) + {sine} * COALESCE({odd}, 0)) "
        f"ELSE 1 - {sine} * COALESCE({even}, 0) END"
    )


def _plain_zero(number: str) -> str:
    """No negative zero, as Spark's ROUND."""
    return f"CASE WHEN {number} = 0 THEN 0.0 ELSE {number} END"


_TERMS = ["intercept", "trend", "level_change", "slope_change"]
_BREAK_STEPS = ["indexed", "fits", "chow", "terms", "its"]


def _add_break_steps(series: str) -> None:
    """Steps ``<series>_indexed`` and so on: positions, segment fits, F statistic, coefficients."""
    whole = "OVER (PARTITION BY metric)"
    STEPS[f"{series}_indexed"] = (
        f"SELECT *, GREATEST(1, LEAST(k, n - 2)) AS bp FROM (SELECT metric, month, value AS y, "
        f"ROW_NUMBER() OVER (PARTITION BY metric ORDER BY month) - 1 AS t, COUNT(*) {whole} AS n, "
        f"SUM(CASE WHEN month < DATE '{RELEASE}' THEN 1 ELSE 0 END) {whole} AS k FROM {series})"
    )
    parts = []
    for name, inside in (("all", "TRUE"), ("pre", "t < bp"), ("post", "t >= bp")):
        x = f"CASE WHEN {inside} THEN t END"
        parts.append(
            f"REGR_COUNT(y, {x}) AS n_{name}, REGR_AVGX(y, {x}) AS x_{name}, NULLIF(REGR_SXX(y, {x}), 0) AS sxx_{name}, "
            f"REGR_SLOPE(y, {x}) AS slope_{name}, REGR_INTERCEPT(y, {x}) AS cut_{name}, REGR_SYY(y, {x}) AS syy_{name}, "
            f"REGR_SYY(y, {x}) - POW(REGR_SXY(y, {x}), 2) / NULLIF(REGR_SXX(y, {x}), 0) AS rss_{name}"
        )
    STEPS[f"{series}_fits"] = (
        f"SELECT *, COALESCE(rss_pre, 0) + COALESCE(rss_post, 0) AS rss FROM (SELECT metric, n, CAST(bp AS BIGINT) AS bp, "
        f"n - 4 AS m, {', '.join(parts)}, strftime(MIN(CASE WHEN t >= bp THEN month END), '%Y-%m') AS breakpoint_month "
        f"FROM {series}_indexed GROUP BY metric, n, bp)"
    )
    STEPS[f"{series}_chow"] = (
        "SELECT metric, f AS f_statistic, POW(m / (m + 2 * f), m / 2) AS p_value, 2 AS df_numerator, "
        "m AS df_denominator, breakpoint_month FROM (SELECT *, CASE WHEN m > 0 THEN "
        f"((rss_all - rss) / 2) / (rss / m) END AS f FROM {series}_fits)"
    )
    STEPS[f"{series}_terms"] = (
        "SELECT *, cut_pre AS intercept_b, slope_pre AS trend_b, "
        "(cut_post + slope_post * bp) - (cut_pre + slope_pre * bp) AS level_change_b, "
        "slope_post - slope_pre AS slope_change_b, "
        "SQRT(mse * (1.0 / n_pre + x_pre * x_pre / sxx_pre)) AS intercept_s, SQRT(mse / sxx_pre) AS trend_s, "
        "SQRT(mse * (1.0 / n_pre + POW(bp - x_pre, 2) / sxx_pre + 1.0 / n_post + POW(bp - x_post, 2) / sxx_post)) "
        "AS level_change_s, SQRT(mse * (1 / sxx_pre + 1 / sxx_post)) AS slope_change_s "
        f"FROM (SELECT *, rss / CASE WHEN m > 0 THEN m END AS mse FROM {series}_fits)"
    )
    columns = ", ".join(
        f"{_plain_zero(f'ROUND(ROUND({x}_b, 6), 3)')} AS {x}_coef, ROUND(ROUND({x}_s, 6), 3) AS {x}_se, "
        f"{_plain_zero(f'ROUND({x}_b / {x}_s, 4)')} AS {x}_t, "
        f"{_plain_zero(f'ROUND({_p_value(f"({x}_b / {x}_s)")}, 6)')} AS {x}_p"
        for x in _TERMS
    )
    STEPS[f"{series}_its"] = (
        f"SELECT {columns}, ROUND(1 - rss / syy_all, 6) AS r_squared, n AS n_obs, breakpoint_month, metric "
        f"FROM {series}_terms"
    )


_add_break_steps("series")
_add_break_steps("many")

STEPS["paths"] = (
    "SELECT *, SQRT(SUM(r * r) OVER (PARTITION BY metric) / (n - 2)) AS sigma, "
    "SUM(r) OVER (PARTITION BY metric ORDER BY t) AS path FROM (SELECT i.*, i.y - f.cut_all - f.slope_all * i.t AS r "
    "FROM series_indexed i JOIN series_fits f USING (metric))"
)

POSTS = ("posts", "q")
DOMAIN = (*POSTS, "qd")
SAMPLE6 = (*POSTS, "pop", "plan6", "sample6")
FEATURES = (*SAMPLE6, "features")
INTENTS = (*POSTS, "pop", "plan9", "sample9", "intents")
SERIES = (
    *POSTS, "volume", "askers", "accepted", "coverage", "engagement", "waits", "accepts", "ttfa", "tta", "series",
)
BREAKS = (*SERIES, "series_indexed", "series_fits")

_CHOW = (
    "ROUND(ROUND(f_statistic, 4), 3) AS f_statistic, ROUND(p_value, 6) AS p_value"
)
_POST_COLUMNS = [
    "Id", "PostTypeId", "AcceptedAnswerId", "ParentId", f"strftime(CreationDate, {_TIME}) AS CreationDate", "Score",
    "ViewCount", "OwnerUserId", "AnswerCount", "CommentCount", "Title", "Tags", "Body",
]
_ALL_POSTS = sql(f"SELECT {', '.join(_POST_COLUMNS)} FROM posts", "posts")
_PARTITIONS = sql(
    f"SELECT {_YM} AS year_month, COUNT(*) AS n, COUNT(DISTINCT Id) AS ids, CAST(SUM(Score) AS BIGINT) AS score, "
    "CAST(SUM(length(Body)) AS BIGINT) AS body_length FROM posts GROUP BY 1",
    "posts",
)


def _summary(table: str, dated: bool) -> str:
    dates = (
        f"COUNT(DISTINCT {_YM}) AS partitions, strftime(MIN(CreationDate), {_TIME}) AS first_date, "
        f"strftime(MAX(CreationDate), {_TIME}) AS last_date"
        if dated
        else "1 AS partitions, CAST(NULL AS VARCHAR) AS first_date, CAST(NULL AS VARCHAR) AS last_date"
    )
    return f"SELECT '{table.lower()}' AS \"table\", COUNT(*) AS row_count, {dates} FROM ({ARCHIVE_SQL[table]})"


def _contents(tables: dict[str, str], *steps: str) -> str:
    """Every value of every table of a report, as checks.queries reads them from its files."""
    parts = []
    for name, body in tables.items():
        keys, numbers, texts = report_columns(name)
        if name == PER_POST:
            body = f"SELECT year_month, {', '.join(f'SUM({c}) AS {c}' for c in numbers)} FROM ({body}) GROUP BY 1"
        key = "concat_ws('|', " + ", ".join(f'"{k}"' for k in keys) + ")"
        cells = [(c, _plain_zero(f'ROUND(CAST("{c}" AS DOUBLE), {report_digits(c)})'), "CAST(NULL AS VARCHAR)") for c in numbers]
        cells += [(c, "CAST(NULL AS DOUBLE)", f'substr(CAST("{c}" AS VARCHAR), 1, 10)') for c in texts]
        parts += [
            f"SELECT '{name}' AS report_table, {key} AS row_key, '{c}' AS column_name, {number} AS number, {text} AS text FROM ({body})"
            for c, number, text in cells
        ]
    return sql(" UNION ALL ".join(parts), *steps)


# The first month starting on or after the window start.
_SPINE = (
    "SELECT strftime(d, '%Y-%m') AS year_month FROM (SELECT UNNEST(generate_series(TIMESTAMP '1996-04-01', "
    "CAST({0} || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)) AS d)"
)
_PER_MONTH = (
    "SELECT s.year_month, COALESCE(c.n, 0) AS question_count, COALESCE(c.n, 0) = 0 AS is_gap "
    f"FROM ({_SPINE.format('(SELECT MAX(year_month) FROM {0})')}) s "
    "LEFT JOIN (SELECT year_month, COUNT(*) AS n FROM {0} GROUP BY 1) c USING (year_month)"
)
STEPS["early"] = f"SELECT {_YM} AS year_month FROM posts WHERE PostTypeId = 1 AND CreationDate >= DATE '{EARLY}'"
_GAPS = _PER_MONTH.format("early").replace("1996-04-01", "1990-07-01")

_CUSUM = (
    "SELECT ROUND(ROUND(ABS(path) / sigma, 4), 3) AS cusum_max, strftime(month, '%Y-%m') AS cusum_max_month, "
    "ROUND(ROUND(0.948 * SQRT(n), 4), 3) AS critical_5pct, ABS(path) / sigma > 0.948 * SQRT(n) AS significant_5pct, "
    "metric FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY ABS(path) DESC, t) AS place FROM paths) "
    "WHERE place = 1"
)
_ALL_SUMMARIES = " UNION ALL ".join(
    _summary(t, t != "Tags") for t in ("Posts", "Users", "Comments", "PostLinks", "Tags")
)
_ACCEPTED_BY_DOMAIN = f"SELECT year_month, domain, COUNT(*) AS question_count, {ACCEPTED} FROM qd GROUP BY 1, 2"
_COVERAGE_BY_DOMAIN = f"SELECT year_month, domain, COUNT(*) AS question_count, {COVERAGE} FROM qd GROUP BY 1, 2"
_ENGAGEMENT_BY_DOMAIN = f"SELECT year_month, domain, COUNT(*) AS question_count, {MEANS} FROM qd GROUP BY 1, 2"
_DOMAIN_PREPOST = (
    f"SELECT domain, CASE WHEN CreationDate < '{RELEASE}' THEN 'pre' ELSE 'post' END AS period, "
    f"COUNT(*) AS question_count, {ACCEPTED}, {COVERAGE}, {MEANS} FROM qd GROUP BY 1, 2"
)


_METRIC_TABLES = {
    "monthly_volume.csv": "SELECT * FROM volume",
    "active_askers.csv": "SELECT * FROM askers",
    "accepted_rate.csv": "SELECT * FROM accepted",
    "answer_coverage.csv": "SELECT * FROM coverage",
    "time_to_first_answer.csv": "SELECT * FROM ttfa",
    "time_to_acceptance.csv": "SELECT * FROM tta",
    "engagement.csv": "SELECT * FROM engagement",
}
_DOMAIN_TABLES = {
    "domain_volume.csv": "SELECT * FROM domain_counts",
    "domain_accepted_rate.csv": _ACCEPTED_BY_DOMAIN,
    "domain_coverage.csv": _COVERAGE_BY_DOMAIN,
    "domain_engagement.csv": _ENGAGEMENT_BY_DOMAIN,
    "domain_response_time.csv": "SELECT * FROM domain_waits",
    "domain_prepost_summary.csv": _DOMAIN_PREPOST,
    "domain_volume_change.csv": CHANGE,
}
_DOMAIN_STEPS = (*DOMAIN, "domain_counts", "change", "waits", "domain_waits")


def _manifest() -> str:
    def one(table: str, columns: list[str]) -> str:
        cells = [f"coalesce('{len(c)}:{c}' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '')" for c in sorted(columns)]
        row = " || ".join(cells)
        return (
            f"SELECT '{table}.parquet' AS name, COUNT(*) AS row_count, "
            f"CAST(COALESCE(SUM(CAST('0x' || substr(md5({row}), 1, 15) AS HUGEINT)), 0) AS VARCHAR) AS digest, "
            f"true AS bytes_hashed FROM {table}"
        )

    return " UNION ALL ".join(one(t, c) for t, c in MANIFEST_TABLES.items())


ORACLE = {
    "dataset_manifest": _manifest(),
    "scan_dump_xml": _ALL_POSTS,
    "coerce_rows": _ALL_POSTS,
    "with_year_month": sql(
        f"SELECT CASE WHEN Id % 7 = 0 THEN 'unknown' ELSE {_YM} END AS year_month, COUNT(*) AS n FROM posts GROUP BY 1 "
        "UNION ALL SELECT 'all', COUNT(*) FROM posts",
        "posts",
    ),
    "write_partitioned": _PARTITIONS,
    "ingest_table": _PARTITIONS,
    "ingest_all": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, TRUE AS skipped_again FROM ({text})"
        for t, text in ARCHIVE_SQL.items()
    ),
    "verify_source": f"SELECT COUNT(*) AS source_rows FROM ({ARCHIVE_SQL['Comments']})",
    "register_tables": " UNION ALL ".join(
        f"SELECT '{t.lower()}' AS name, {'' if t == 'Tags' else _YM + ' AS'} {chr(39) + 'all' + chr(39) + ' AS' if t == 'Tags' else ''} year_month, "
        f"COUNT(*) AS n FROM ({ARCHIVE_SQL[t]}) GROUP BY 2"
        for t in ("Posts", "Users", "Comments", "PostLinks", "Tags")
    ),
    "run_query": sql(
        f"SELECT Tags, COUNT(*) AS n FROM posts WHERE Score >= 5 AND {_IN} GROUP BY 1 "
        "UNION ALL SELECT Title, COUNT(*) FROM posts WHERE ViewCount < 300 GROUP BY 1",
        "posts",
    ),
    "questions_slice": sql(
        "SELECT Id, Score, Title, Tags, Body, ViewCount, OwnerUserId, AnswerCount, CAST(NULL AS VARCHAR) AS ClosedDate, "
        f"CommentCount, strftime(CreationDate, {_TIME}) AS CreationDate, CAST(NULL AS VARCHAR) AS LastActivityDate, "
        "AcceptedAnswerId FROM q",
        *POSTS,
    ),
    "answers_slice": sql(
        f"SELECT Id, Score, Body, ParentId, OwnerUserId, CommentCount, strftime(CreationDate, {_TIME}) AS CreationDate "
        f"FROM posts WHERE PostTypeId = 2 AND {_IN}",
        "posts",
    ),
    "preview": sql("SELECT Id, Score, Title FROM posts WHERE PostTypeId = 1 ORDER BY Score DESC, Id LIMIT 20", "posts"),
    "write_table_csv": sql("SELECT * FROM volume", "posts", "volume"),
    "summarize_table": _summary("Posts", True),
    "partition_count": sql(f"SELECT COUNT(DISTINCT {_YM}) AS partitions FROM posts", "posts"),
    "questions_per_month": sql(_PER_MONTH.format("q"), *POSTS),
    "validation_summary": _ALL_SUMMARIES,
    "stored_summary": _ALL_SUMMARIES,
    "validation_gaps": sql(
        f"SELECT COUNT(*) AS months, COUNT(*) FILTER (is_gap) AS gaps FROM ({_GAPS})", "posts", "early"
    ),
    "validation_report": _contents(
        {"data_validation.csv": _ALL_SUMMARIES, "posts_per_month.csv": _PER_MONTH.format("q")}, *POSTS
    ),
    "monthly_volume": sql("SELECT * FROM volume", "posts", "volume"),
    "monthly_active_askers": sql("SELECT * FROM askers", *POSTS, "askers"),
    "monthly_accepted_rate": sql("SELECT * FROM accepted", *POSTS, "accepted"),
    "monthly_answer_coverage": sql("SELECT * FROM coverage", *POSTS, "coverage"),
    "monthly_time_to_first_answer": sql(
        f"SELECT year_month, answered_count, {_SECONDS} FROM ttfa", *POSTS, "waits", "ttfa"
    ),
    "monthly_time_to_acceptance": sql(
        f"SELECT year_month, accepted_count, {_SECONDS} FROM tta", *POSTS, "accepts", "tta"
    ),
    "monthly_engagement": sql("SELECT * FROM engagement", *POSTS, "engagement"),
    "monthly_counters": sql(
        "SELECT v.year_month, v.question_count, v.answer_count, distinct_askers, accepted_rate, coverage_rate, "
        "mean_score, mean_comments FROM volume v LEFT JOIN askers USING (year_month) LEFT JOIN accepted USING (year_month) "
        "LEFT JOIN coverage USING (year_month) LEFT JOIN engagement USING (year_month)",
        *POSTS, "volume", "askers", "accepted", "coverage", "engagement",
    ),
    "metrics_report": _contents(
        _METRIC_TABLES, *SERIES[:-1],
    ),
    "activity_report": _contents({**_METRIC_TABLES, **_DOMAIN_TABLES}, *dict.fromkeys((*SERIES[:-1], *_DOMAIN_STEPS))),
    "tag_domain": sql(f"SELECT Tags, {DOMAIN_CASE} AS domain, COUNT(*) AS n FROM posts GROUP BY 1, 2", "posts"),
    "domain_volume": sql("SELECT * FROM domain_counts", *DOMAIN, "domain_counts"),
    "domain_accepted_rate": sql(
        f"SELECT year_month, domain, COUNT(*) AS question_count, {ACCEPTED} FROM qd GROUP BY 1, 2", *DOMAIN
    ),
    "domain_coverage": sql(
        f"SELECT year_month, domain, COUNT(*) AS question_count, {COVERAGE} FROM qd GROUP BY 1, 2", *DOMAIN
    ),
    "domain_response_time": sql(
        f"SELECT year_month, domain, answered_count, {_SECONDS} FROM domain_waits", *POSTS, "waits", "domain_waits"
    ),
    "domain_engagement": sql(
        f"SELECT year_month, domain, COUNT(*) AS question_count, {MEANS} FROM qd GROUP BY 1, 2", *DOMAIN
    ),
    "domain_prepost_summary": sql(
        f"SELECT domain, CASE WHEN CreationDate < '{RELEASE}' THEN 'pre' ELSE 'post' END AS period, "
        f"COUNT(*) AS question_count, {ACCEPTED}, {COVERAGE}, {MEANS} FROM qd GROUP BY 1, 2",
        *DOMAIN,
    ),
    "domain_volume_change": sql(CHANGE, *DOMAIN, "domain_counts", "change"),
    "domain_report": _contents(_DOMAIN_TABLES, *_DOMAIN_STEPS),
    "activity_counters": sql(
        "SELECT 'month' AS level, v.year_month, NULL AS domain, NULL AS period, v.answer_count, v.question_count, accepted_rate, coverage_rate, "
        "mean_score, mean_comments, COALESCE(distinct_askers, 0) AS distinct_askers "
        "FROM volume v LEFT JOIN askers USING (year_month) LEFT JOIN accepted USING (year_month) "
        "LEFT JOIN coverage USING (year_month) LEFT JOIN engagement USING (year_month) "
        f"UNION ALL SELECT 'domain', year_month, domain, NULL, 0, COUNT(*), {ACCEPTED}, {COVERAGE}, {MEANS}, "
        "COUNT(DISTINCT OwnerUserId) FROM qd GROUP BY year_month, domain "
        f"UNION ALL SELECT 'period', NULL, domain, CASE WHEN CreationDate < '{RELEASE}' THEN 'pre' ELSE 'post' END AS p, 0, COUNT(*), "
        f"{ACCEPTED}, {COVERAGE}, {MEANS}, COUNT(DISTINCT OwnerUserId) FROM qd GROUP BY domain, p",
        *DOMAIN, "volume", "askers", "accepted", "coverage", "engagement",
    ),
    "monthly_populations": sql("SELECT * FROM pop", *POSTS, "pop"),
    "required_sample_size": (
        f"SELECT o_custkey, n, {_required('n', 9)} AS required_n "
        "FROM (SELECT o_custkey, COUNT(*) * 1000 AS n FROM orders GROUP BY 1)"
    ),
    "monthly_sample_plan": sql("SELECT * FROM plan6", *POSTS, "pop", "plan6"),
    "sample_plan_summary": sql(
        "SELECT COUNT(*) AS months, CAST(SUM(required_n) AS BIGINT) AS total_sampled, CAST(SUM(n) AS BIGINT) AS "
        "total_population, SUM(required_n)::DOUBLE / SUM(n) * 100 AS pct_sampled, COUNT(*) FILTER (required_n = n) AS "
        "full_enumeration_months FROM plan6",
        *POSTS, "pop", "plan6",
    ),
    "stratified_monthly_sample": sql("SELECT year_month, Id, Title FROM sample6", *SAMPLE6),
    "body_prose": f"SELECT page_id, {_prose('html')} AS prose, 'it isn''t ' || page_id || ' t''s k l' AS odd_prose FROM pages",
    "odd_bodies": (
        "SELECT CAST(s_suppkey AS VARCHAR) AS key, 'it isn''t ' || s_suppkey || ' t''s k l' AS prose, "
        "'ab' || s_suppkey || 'c|c' || chr(8807) || chr(824) AS blocks, 'Discrepancy' AS intent FROM supplier"
    ),
    "code_blocks": sql(
        f"SELECT Id, array_to_string(b, '|') AS blocks, CAST(len(b) AS INT) AS n, 'ab' || Id || 'c|c' || chr(8807) || chr(824) AS odd_blocks "
        f"FROM (SELECT Id, {_blocks('Body')} AS b FROM posts)",
        "posts",
    ),
    "page_links": "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS INT) AS link_count FROM pages",
    "per_post_features": sql("SELECT * FROM features", *FEATURES),
    "monthly_feature_distributions": sql(
        "SELECT year_month, "
        + ", ".join(f"ROUND({f}_{x}, 3) AS {f}_{x}" for f in FEATURE_SQL for x in ("median", "p90"))
        + " FROM distributions",
        *FEATURES, "distributions",
    ),
    "features_report": _contents(
        {"post_features.csv": "SELECT * FROM features", "lex_features.csv": "SELECT * FROM distributions"},
        *FEATURES, "distributions",
    ),
    "classify_intent": sql(
        f"SELECT Id, {INTENT_CASE} AS intent, 'Discrepancy' AS odd_intent FROM (SELECT Id, {_TEXT} AS body_text FROM q)", *POSTS
    ),
    "per_post_intents": sql("SELECT * FROM intents", *INTENTS),
    "monthly_intent_distribution": sql("SELECT * FROM distribution", *INTENTS, "distribution"),
    "monthly_intent_wide": sql("SELECT * FROM wide", *INTENTS, "wide"),
    "prepost_intent_summary": sql("SELECT * FROM prepost", *INTENTS, "prepost"),
    "topics_report": _contents(
        {
            "post_intents.csv": "SELECT * FROM intents",
            "monthly_intent_distribution.csv": "SELECT * FROM distribution",
            "monthly_intent_wide.csv": "SELECT * FROM wide",
            "prepost_intent_summary.csv": "SELECT * FROM prepost",
        },
        *INTENTS, "distribution", "wide", "prepost",
    ),
    **{
        name: sql("SELECT metric, strftime(month, '%Y-%m') AS year_month, ROUND(value, 3) AS value FROM series", *SERIES)
        for name in ("metric_series", "stored_series")
    },
    "breakpoint_index": sql("SELECT metric, n, bp AS breakpoint_index, breakpoint_month FROM series_fits", *BREAKS),
    "chow_test": sql(
        f"SELECT {_CHOW}, df_numerator, df_denominator, breakpoint_month, metric FROM series_chow", *BREAKS, "series_chow"
    ),
    "chow_test_many": sql(
        f"SELECT {_CHOW}, df_numerator, df_denominator, breakpoint_month, metric FROM many_chow",
        "many", "many_indexed", "many_fits", "many_chow",
    ),
    "cusum_test": sql(_CUSUM, *BREAKS, "paths"),
    "its_regression": sql("SELECT * FROM series_its", *BREAKS, "series_terms", "series_its"),
    "its_regression_many": sql(
        "SELECT * FROM many_its", "many", "many_indexed", "many_fits", "many_terms", "many_its"
    ),
    "quality_band": sql(
        "SELECT year_month, ROUND(accepted_rate, 9) AS accepted_rate, ROUND(coverage_rate, 9) AS coverage_rate, "
        "ROUND(coverage_rate - accepted_rate, 9) AS band FROM accepted JOIN coverage USING (year_month)",
        *POSTS, "accepted", "coverage",
    ),
    "response_hours": sql(
        f"SELECT year_month, {_HOURS}, 'first_answer' AS kind FROM ttfa "
        f"UNION ALL SELECT year_month, {_HOURS}, 'acceptance' FROM tta",
        *POSTS, "waits", "accepts", "ttfa", "tta",
    ),
    "domain_response_hours": sql(
        f"SELECT year_month, domain, {_HOURS} FROM domain_waits", *POSTS, "waits", "domain_waits"
    ),
    "complexity_prepost_change": sql(
        "SELECT feature, ROUND(pre_mean, 6) AS pre_mean, ROUND(post_mean, 6) AS post_mean, "
        "ROUND(CASE WHEN pre_mean = 0 THEN 0 ELSE (post_mean - pre_mean) / pre_mean * 100 END, 6) AS pct_change FROM ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, AVG({f}_median) FILTER (CAST(year_month || '-01' AS DATE) < DATE '{RELEASE}') AS pre_mean, "
            f"AVG({f}_median) FILTER (CAST(year_month || '-01' AS DATE) >= DATE '{RELEASE}') AS post_mean FROM distributions"
            for f in FEATURE_SQL
        )
        + ")",
        *FEATURES, "distributions",
    ),
}
ORACLE["structural_break_report"] = _contents(
    {
        "chow_test.csv": "SELECT metric, ROUND(f_statistic, 4) AS f_statistic, p_value, df_numerator, df_denominator, breakpoint_month FROM series_chow",
        "cusum_test.csv": _CUSUM,
        "its_regression.csv": "SELECT * FROM series_its",
    },
    *BREAKS, "series_chow", "paths", "series_terms", "series_its",
)
ORACLE["intent_stack"] = sql(
    "SELECT year_month, intent, CAST(place AS INT) AS stack_order, ROUND(fraction, 9) AS fraction, "
    "ROUND(SUM(fraction) OVER (PARTITION BY year_month ORDER BY place), 9) AS cumulative FROM long JOIN "
    "(SELECT intent, ROW_NUMBER() OVER (ORDER BY AVG(fraction) DESC, intent) AS place FROM long GROUP BY intent) "
    "USING (intent)",
    *INTENTS, "wide", "long",
)
ORACLE.update(
    {
        "intent_prepost_compare": sql(
            "SELECT intent, COALESCE(MAX(fraction) FILTER (period = 'pre'), 0) AS pre_fraction, "
            "COALESCE(MAX(fraction) FILTER (period = 'post'), 0) AS post_fraction FROM prepost GROUP BY 1",
            *INTENTS, "prepost",
        ),
        "intent_trends": sql("SELECT intent, year_month, fraction FROM distribution", *INTENTS, "distribution"),
        "ai_category_trends": sql(
            "SELECT intent, year_month, fraction FROM distribution "
            "WHERE intent IN ('Machine-Authored Discrepancy', 'Architectural Consensus')",
            *INTENTS, "distribution",
        ),
        "domain_volume_index": sql(
            "SELECT domain, year_month, question_count, ROUND(question_count / FIRST_VALUE(question_count) OVER "
            "(PARTITION BY domain ORDER BY year_month) * 100, 9) AS volume_index FROM domain_counts",
            *DOMAIN, "domain_counts",
        ),
        "domain_volume_change_rank": sql(
            f"SELECT * FROM ({CHANGE}) WHERE domain <> 'Other'", *DOMAIN, "domain_counts", "change"
        ),
        "its_fits": sql(
            "SELECT metric, strftime(month, '%Y-%m') AS year_month, ROUND(y, 3) AS observed, ROUND(CASE WHEN i.t < i.bp "
            "THEN cut_pre + slope_pre * t ELSE cut_post + slope_post * t END, 3) AS fitted, "
            "CASE WHEN i.t < i.bp THEN 'pre' ELSE 'post' END AS segment FROM series_indexed i JOIN series_fits USING (metric)",
            *BREAKS,
        ),
        "cusum_paths": sql(
            "SELECT metric, strftime(month, '%Y-%m') AS year_month, " + _plain_zero("ROUND(path / sigma, 3)") + " AS cusum, "
            "ROUND(0.948 * SQRT(n), 3) AS upper_bound, ROUND(-0.948 * SQRT(n), 3) AS lower_bound FROM paths",
            *BREAKS, "paths",
        ),
        "chow_summary": sql(
            f"SELECT metric, {_CHOW}, ROUND(p_value, 6) < 0.05 AS significant, CASE WHEN ROUND(p_value, 6) >= 0.0001 "
            "THEN 'p=' || printf('%.4f', ROUND(p_value, 6)) ELSE 'p<0.0001' END AS label FROM series_chow",
            *BREAKS, "series_chow",
        ),
        "its_coefficients": sql(
            " UNION ALL ".join(
                f"SELECT metric, '{x}' AS term, {_plain_zero(f'ROUND(ROUND({x}_b, 6), 3)')} AS coefficient, "
                f"{_plain_zero(f'ROUND(ROUND({_p_value(f"({x}_b / {x}_s)")}, 6), 3)')} AS p_value, "
                f"ROUND({_p_value(f'({x}_b / {x}_s)')}, 6) < 0.05 AS significant FROM series_terms"
                for x in ("level_change", "slope_change")
            ),
            *BREAKS, "series_terms",
        ),
        "period_summary": sql(
            " UNION ALL ".join(
                f"SELECT metric, ROUND(pre, 3) AS pre_value, ROUND(post, 3) AS post_value, "
                f"ROUND((post - pre) / pre * 100, 3) AS pct_change, '{stat.lower()}-{tail}' AS stat FROM "
                f"(SELECT metric, {call}(value) FILTER (month < DATE '{RELEASE}') AS pre, "
                f"{call}(value) FILTER (month >= DATE '{RELEASE}') AS post FROM (SELECT *, ROW_NUMBER() OVER "
                f"(PARTITION BY metric ORDER BY month DESC) AS age FROM series) WHERE age > {tail} GROUP BY metric)"
                for stat, call, tail in (("median", "MEDIAN", 0), ("mean", "AVG", 6))
            ),
            *SERIES,
        ),
        "questions_per_asker": sql(
            "SELECT year_month, question_count, distinct_askers, question_count / NULLIF(distinct_askers, 0) AS "
            "questions_per_asker FROM accepted JOIN askers USING (year_month)",
            *POSTS, "accepted", "askers",
        ),
    }
)
ORACLE.update(
    {name: sql(f"SELECT Id, CAST({text} AS INT) AS {name} FROM q", *POSTS) for name, text in FEATURE_SQL.items()}
)
