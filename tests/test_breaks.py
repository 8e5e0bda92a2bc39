import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from qapulse.functions.student import f_tail_two, t_two_sided
from qapulse.plans import reports
from qapulse.operators import breaks, domains, figures

# Three published monthly series, 2020-01 to 2026-03.
QUESTIONS = [
    146664, 145116, 155969, 182923, 186478, 171916, 166050, 148365, 141792, 141825, 134956, 133924, 139893, 131702,
    148783, 135901, 133832, 129018, 124017, 122117, 119803, 118925, 119170, 112194, 119354, 114030, 123495, 114260,
    116224, 111534, 110932, 112951, 103845, 106223, 109579, 96623, 97020, 85868, 87369, 68631, 66612, 63733, 62855,
    60190, 52839, 52428, 50367, 42416, 47701, 46057, 44803, 42473, 40158, 32014, 31500, 27863, 24793, 23221, 20846,
    17971, 18238, 15565, 15129, 12349, 11549, 9197, 7751, 5837, 6062, 5320, 4270, 3340, 2967, 2315, 2033,
]
ACCEPTED = [
    66937, 65586, 70017, 83542, 85436, 77394, 75641, 67892, 64304, 65299, 62032, 60588, 63290, 59326, 65764, 59516,
    58538, 55725, 53792, 53128, 51267, 51226, 50440, 46978, 50554, 46885, 49778, 46139, 46059, 44475, 44944, 45972,
    42357, 42859, 43077, 37859, 38020, 32889, 33011, 25182, 24344, 22649, 22536, 21685, 19053, 19015, 17914, 14865,
    17088, 16048, 15686, 14629, 13571, 10910, 11126, 9888, 8747, 8274, 7323, 6138, 6389, 5493, 5373, 4063, 3485, 2793,
    2535, 1942, 1768, 1641, 1293, 1035, 947, 740, 594,
]
ASKERS = [
    99609, 99328, 106631, 121775, 122999, 114336, 110207, 100490, 97148, 97353, 93520, 93053, 96689, 92690, 102728,
    95440, 93745, 90649, 87136, 85886, 85115, 84444, 85260, 80971, 85489, 82555, 89140, 83337, 84165, 80993, 80205,
    81297, 75885, 78245, 81602, 72712, 73343, 66775, 67728, 54493, 53093, 51231, 50253, 48329, 42936, 42892, 41344,
    35423, 39283, 38119, 37228, 35344, 33665, 27208, 26577, 23684, 21225, 19869, 17881, 15516, 15830, 13405, 13053,
    10709, 10007, 8003, 6734, 5115, 5438, 4759, 3838, 3011, 2622, 2077, 1776,
]
LONG = {
    "Question Volume": QUESTIONS,
    "Active Askers": ASKERS,
    "Accepted Rate": [a / q for a, q in zip(ACCEPTED, QUESTIONS)],
}


def frame(spark, series, first=date(2020, 1, 1)):
    rows = []
    for metric, values in series.items():
        for i, value in enumerate(values):
            k = first.year * 12 + first.month - 1 + i
            rows.append((metric, date(k // 12, k % 12 + 1, 1), None if value is None else float(value)))
    return spark.createDataFrame(rows, "metric string, month date, value double").where("value is not null")


@pytest.fixture(scope="module")
def published(spark):
    return frame(spark, LONG).cache()


def by_metric(df):
    return {r["metric"]: r.asDict() for r in df.collect()}


def test_published_chow(published):
    got = by_metric(breaks.chow_test(published))
    expected = {"Question Volume": (12.9158, 1.6e-05), "Active Askers": (30.2735, 0.0), "Accepted Rate": (4.8026, 0.011061)}
    for metric, (f, p) in expected.items():
        row = got[metric]
        assert (row["f_statistic"], row["p_value"]) == (pytest.approx(f, abs=1e-4), pytest.approx(p, abs=1e-6))
        assert (row["df_numerator"], row["df_denominator"], row["breakpoint_month"]) == (2, 71, "2022-12")


def test_published_cusum(published):
    got = by_metric(breaks.cusum_test(published))
    expected = {"Question Volume": (12.1227, "2023-03"), "Active Askers": (11.5756, "2023-03"), "Accepted Rate": (8.4785, "2024-06")}
    for metric, (peak, month) in expected.items():
        row = got[metric]
        assert (row["cusum_max"], row["cusum_max_month"]) == (pytest.approx(peak, abs=1e-4), month)
        assert (row["critical_5pct"], row["significant_5pct"]) == (8.2099, True)


def test_published_regression(published):
    got = by_metric(breaks.its_regression(published))
    row = got["Question Volume"]
    expected = {
        "intercept_coef": 163420.247619, "intercept_se": 2898.695875, "intercept_t": 56.3772, "intercept_p": 0.0,
        "trend_coef": -1825.12381, "trend_se": 146.593351, "trend_t": -12.4502, "trend_p": 0.0,
        "level_change_coef": -18960.291115, "level_change_se": 4067.63935, "level_change_t": -4.6613, "level_change_p": 1.4e-05,
        "slope_change_coef": -501.737635, "slope_change_se": 189.428654, "slope_change_t": -2.6487, "slope_change_p": 0.009951,
        "r_squared": 0.97552, "n_obs": 75,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, rel=1e-9, abs=1.1e-6 if not name.endswith("_t") else 1e-4), name
    rate = got["Accepted Rate"]
    assert rate["level_change_p"] == pytest.approx(0.004061, abs=1e-6)
    assert rate["slope_change_p"] == pytest.approx(0.641022, abs=1e-6)


def test_published_period_summary(published):
    got = by_metric(figures.period_summary(published))
    assert (got["Question Volume"]["pre_value"], got["Question Volume"]["post_value"]) == (129018, 29681.5)
    tail = by_metric(figures.period_summary(published, "mean", 6))["Accepted Rate"]
    assert (round(tail["pre_value"], 4), round(tail["post_value"], 4)) == (0.4325, 0.3504)


def ols(y, bp):
    n = len(y)
    t = np.arange(n, dtype=float)
    d = (t >= bp).astype(float)
    x = np.column_stack([np.ones(n), t, d, d * (t - bp)])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = float(np.sum((y - x @ beta) ** 2))
    se = np.sqrt(np.diag(rss / (n - 4) * np.linalg.inv(x.T @ x)))
    return beta, se, x @ beta


def test_many_series_match_least_squares(spark):
    rng = np.random.default_rng(3)
    lengths = [6, 7, 12, 41, 60]
    series = {f"s{n}": rng.normal(size=n).cumsum() + rng.normal() * 50 for n in lengths}
    df = frame(spark, series, date(2022, 8, 1))
    got, fits = by_metric(breaks.its_regression(df)), {}
    for r in breaks.its_fits(df).collect():
        fits.setdefault(r["metric"], []).append((r["year_month"], r["fitted"], r["segment"]))
    for metric, y in series.items():
        bp = max(1, min(4, len(y) - 2))  # 2022-12 is at position 4
        beta, se, fitted = ols(np.array(y), bp)
        for name, b, s in zip(["intercept", "trend", "level_change", "slope_change"], beta, se):
            assert got[metric][f"{name}_coef"] == pytest.approx(b, abs=1e-6)
            assert got[metric][f"{name}_se"] == pytest.approx(s, abs=1e-6)
        assert [f for _, f, _ in sorted(fits[metric])] == pytest.approx(list(fitted))
        assert [s for *_, s in sorted(fits[metric])].index("post") == bp


def test_degenerate_series_keep_a_row(spark):
    df = frame(spark, {"flat": [5.0] * 8, "line": [float(i) for i in range(8)], "short": [1, 2, 4], "one": [3]}, date(2022, 10, 1))
    chow, its, cusum = (by_metric(f(df)) for f in (breaks.chow_test, breaks.its_regression, breaks.cusum_test))
    assert set(chow) == set(its) == set(cusum) == {"flat", "line", "short", "one"}
    assert chow["flat"]["f_statistic"] == math.inf and chow["flat"]["p_value"] == 0.0
    assert chow["short"]["f_statistic"] is None and its["short"]["trend_p"] is None
    assert its["flat"]["r_squared"] == 0.0
    flat = cusum["flat"]
    assert (flat["cusum_max"], flat["cusum_max_month"], flat["critical_5pct"], flat["significant_5pct"]) == (0.0, "2022-10", None, False)


def test_breakpoint_is_clamped(spark):
    for first, expected in ((date(2023, 6, 1), 1), (date(2021, 1, 1), 8)):
        assert breaks.breakpoint_index(frame(spark, {"s": range(10)}, first)).first()["breakpoint_index"] == expected


def test_paths_end_at_zero_and_peak_at_the_maximum(published):
    paths = breaks.cusum_paths(published)
    last = paths.where("year_month = '2026-03'").agg(F.max(F.abs(F.col("cusum")))).first()[0]
    assert last == pytest.approx(0, abs=1e-8)
    peak = by_metric(paths.groupBy("metric").agg(F.max(F.abs(F.col("cusum"))).alias("peak")))
    for metric, row in by_metric(breaks.cusum_test(published)).items():
        assert row["cusum_max"] == pytest.approx(peak[metric]["peak"], abs=1e-4)


def t_tail(t, m, steps=200_000):
    """Two-sided probability by numeric integration of the density."""
    x = np.linspace(0, abs(t), steps)
    density = np.exp(math.lgamma((m + 1) / 2) - math.lgamma(m / 2)) / math.sqrt(m * math.pi) * (1 + x * x / m) ** (-(m + 1) / 2)
    return 1 - 2 * np.trapezoid(density, x)


def test_tail_probabilities(spark):
    cases = [(t, m) for m in (1, 2, 3, 4, 5, 8, 71) for t in (0.0, 0.3, -1.7, 4.0)]
    df = spark.createDataFrame([(float(t), float(m)) for t, m in cases], "t double, m double")
    got = [r[0] for r in df.select(t_two_sided(F.col("t"), F.col("m"))).collect()]
    assert got == pytest.approx([t_tail(t, m) for t, m in cases], abs=1e-8)
    one = df.limit(1).select(f_tail_two(F.lit(12.9158), F.lit(71.0)), f_tail_two(F.lit(float("inf")), F.lit(3.0))).first()
    assert one[0] == pytest.approx(1.6e-05, abs=1e-6) and one[1] == 0.0


def test_domain_change_and_index(spark):
    rows = [("2022-09", "A", 10), ("2022-10", "A", 20), ("2022-11", "A", 3), ("2022-12", "B", 5), ("2022-10", "C", 4), ("2022-10", "Other", 8)]
    volume = spark.createDataFrame(rows, "year_month string, domain string, question_count bigint")
    change = {r["domain"]: r for r in domains.volume_change(volume).collect()}
    assert set(change) == {"A", "C", "Other"}
    assert (change["A"]["pre_mean"], change["A"]["post_mean"], change["A"]["pct_change_mean"]) == (15.0, 3.0, -80.0)
    assert (change["C"]["post_mean"], change["C"]["post_total"]) == (None, None)
    assert [r["domain"] for r in figures.domain_volume_change_rank(domains.volume_change(volume)).collect()] == ["C", "A"]
    index = figures.domain_volume_index(volume).where("domain = 'A'").collect()
    assert [r["volume_index"] for r in index] == [100.0, 200.0, 30.0]


def test_published_domain_change(spark):
    volume = spark.createDataFrame(
        [("2022-10", "AI / ML", 738_564), ("2022-11", "AI / ML", 218_349)], "year_month string, domain string, question_count bigint"
    )
    row = domains.volume_change(volume).first()
    assert (row["pre_total"], row["post_total"]) == (738_564, 218_349)


def test_chart_tables(spark, published):
    summary = figures.chow_summary(breaks.chow_test(published)).collect()
    assert [r["metric"] for r in summary] == ["Accepted Rate", "Question Volume", "Active Askers"]
    assert [r["label"] for r in summary] == ["p=0.0111", "p<0.0001", "p<0.0001"]
    terms = figures.its_coefficients(breaks.its_regression(published)).collect()
    levels = [r for r in terms if r["term"] == "level_change"]
    assert [r["metric"] for r in levels] == ["Question Volume", "Active Askers", "Accepted Rate"]
    assert all(r["significant"] for r in levels)


def test_complexity_change_handles_a_zero_base(spark):
    from qapulse.operators.features import FEATURES

    columns = ", ".join(f"{f}_median double" for f in FEATURES)
    rows = [("2022-11", *[0.0, 10.0, 1.0, 4.0, 2.0, 5.0]), ("2022-12", *[3.0, 5.0, 1.0, 6.0, 3.0, 5.0])]
    df = spark.createDataFrame(rows, f"year_month string, {columns}")
    got = {r["feature"]: r["pct_change"] for r in figures.complexity_prepost_change(df).collect()}
    assert got["title_length"] == 0.0 and got["body_prose_length"] == -50.0 and got["code_block_total_length"] == 50.0


def test_published_tables_give_the_published_statistics(spark, published, tmp_path):
    """Stored monthly tables, some as a CSV file, one as Parquet; absent ones are skipped."""
    months = [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(len(QUESTIONS))]
    volume = "\n".join(["year_month,question_count,answer_count", *(f"{m},{q}," for m, q in zip(months, QUESTIONS))])
    (tmp_path / "monthly_volume.csv").write_text(volume + "\n")
    askers = spark.createDataFrame(list(zip(months, ASKERS)), "year_month string, distinct_askers bigint")
    askers.write.option("header", True).csv(f"{tmp_path}/active_askers.csv")
    rates = spark.createDataFrame(list(zip(months, LONG["Accepted Rate"])), "year_month string, accepted_rate double")
    rates.write.parquet(f"{tmp_path}/accepted_rate.parquet")
    series = breaks.stored_series(spark, str(tmp_path))
    assert {r[0] for r in series.select("metric").distinct().collect()} == set(LONG)
    for test in (breaks.chow_test, breaks.cusum_test, breaks.its_regression):
        assert by_metric(test(series)) == by_metric(test(published))
    files = reports.stored_breaks_report(spark, str(tmp_path), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(next(iter(files.values()))).count() == len(LONG)
    with pytest.raises(RuntimeError, match="No monthly tables"):
        breaks.stored_series(spark, str(tmp_path / "out"))
