"""Window of the checked queries: mid-month start, late-month release, so that all cuts differ."""

from datetime import date

START = date(1996, 3, 15)
RELEASE = date(1998, 11, 20)
EARLY = date(1990, 6, 15)

#: Tables of the manifest query and their columns whose values print alike in both engines: all but lists of floats.
MANIFEST_TABLES = {
    "region": ["r_name", "r_regionkey"],
    "nation": ["n_name", "n_nationkey", "n_regionkey"],
    "customer": ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"],
    "supplier": ["s_acctbal", "s_name", "s_nationkey", "s_suppkey"],
    "part": ["p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type"],
    "orders": ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"],
    "lineitem": [
        "l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity",
        "l_returnflag", "l_shipdate", "l_suppkey", "l_tax",
    ],
    "events": ["event_id", "event_type", "props", "ts", "user_id", "value"],
    "documents": ["doc_id", "lang", "n_chars", "source", "text"],
    "embeddings": ["label", "vec_id"],
    "pages": ["html", "page_id", "url"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "role", "text", "turn"],
}

#: Markup that a plain pattern gets wrong; "{}" is replaced by a row's id.
ODD_BODY = (
    "<p>it isn&apos;t {}</p><pre>a<pre>b{}</pre>c</pre><p>t&#00000039;s</p><pre-x>k</pre-x> <script-y>l</script-y>"
    '<pre title="a>b">c&ngE;</pre>'
)

PER_POST = "post_features.csv"
_FEATURES = ["title_length", "body_prose_length", "code_block_count", "code_block_total_length", "link_count", "tag_count"]
_TERMS = ["intercept", "trend", "level_change", "slope_change"]
_MONTH, _DOMAIN_MONTH = ["year_month"], ["year_month", "domain"]
_LATENCY = ["median_seconds", "p90_seconds"]
#: file -> (key columns, numbers, texts)
_REPORTS = {
    "data_validation.csv": (["table"], ["row_count", "partitions"], ["first_date", "last_date"]),
    "posts_per_month.csv": (_MONTH, ["question_count"], ["is_gap"]),
    "monthly_volume.csv": (_MONTH, ["question_count", "answer_count"], []),
    "active_askers.csv": (_MONTH, ["distinct_askers"], []),
    "accepted_rate.csv": (_MONTH, ["question_count", "accepted_rate"], []),
    "answer_coverage.csv": (_MONTH, ["question_count", "coverage_rate"], []),
    "time_to_first_answer.csv": (_MONTH, ["answered_count", *_LATENCY], []),
    "time_to_acceptance.csv": (_MONTH, ["accepted_count", *_LATENCY], []),
    "engagement.csv": (_MONTH, ["question_count", "mean_score", "mean_comments"], []),
    "domain_volume.csv": (_DOMAIN_MONTH, ["question_count"], []),
    "domain_accepted_rate.csv": (_DOMAIN_MONTH, ["question_count", "accepted_rate"], []),
    "domain_coverage.csv": (_DOMAIN_MONTH, ["question_count", "coverage_rate"], []),
    "domain_engagement.csv": (_DOMAIN_MONTH, ["question_count", "mean_score", "mean_comments"], []),
    "domain_response_time.csv": (_DOMAIN_MONTH, ["answered_count", *_LATENCY], []),
    "domain_prepost_summary.csv": (
        ["domain", "period"], ["question_count", "accepted_rate", "coverage_rate", "mean_score", "mean_comments"], []
    ),
    "domain_volume_change.csv": (["domain"], ["pre_mean", "post_mean", "pct_change_mean", "pre_total", "post_total"], []),
    PER_POST: (_MONTH, _FEATURES, []),
    "lex_features.csv": (_MONTH, [f"{f}_{x}" for f in _FEATURES for x in ("median", "p90")], []),
    "post_intents.csv": (["post_id"], [], ["year_month", "intent"]),
    "monthly_intent_distribution.csv": (["year_month", "intent"], ["count", "fraction"], []),
    "prepost_intent_summary.csv": (["period", "intent"], ["count", "fraction"], []),
    "chow_test.csv": (["metric"], ["f_statistic", "p_value", "df_numerator", "df_denominator"], ["breakpoint_month"]),
    "cusum_test.csv": (["metric"], ["cusum_max", "critical_5pct"], ["cusum_max_month", "significant_5pct"]),
    "its_regression.csv": (
        ["metric"], [*[f"{t}_{x}" for t in _TERMS for x in ("coef", "se", "t", "p")], "r_squared", "n_obs"], ["breakpoint_month"]
    ),
}


def report_columns(name: str) -> tuple[list[str], list[str], list[str]]:
    if name == "monthly_intent_wide.csv":
        from qapulse.functions.intents import CATEGORIES

        return _MONTH, [c + x for c in CATEGORIES for x in ("", "_fraction")], []
    return _REPORTS[name]


def report_digits(column: str) -> int:
    """As far as values of the size of seconds and coefficients agree between engines."""
    return 3 if column.endswith(("seconds", "_coef", "_se", "f_statistic", "cusum_max", "critical_5pct")) else 4 if column.endswith("_t") else 6
