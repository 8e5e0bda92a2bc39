"""Source divergence, URL filters and lexical search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from qapulse.llm import divergence, lexical, shared, urls

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def found(pattern, text):
    return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def audited(rows, least, top):
    rows = [(lang or "", source or "", found(LETTERS, text)) for lang, source, text in rows]
    out = Counter()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for r in rows if r[0] == lang for t in set(r[2]))
        kept = {t for t, n in docs.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, words in (r for r in rows if r[0] == lang):
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())

        def shares(count):
            return {t: 1 + 10**9 * (count[t] + 2) // (sum(count.values()) + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for a in counts:
            pairs = [(b, sum((p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t]) for t in kept)) for b in counts if b != a]
            own = [(t, (p[a][t] - q[t]) ** 2 // (p[a][t] + q[t])) for t in kept if counts[a][t] and p[a][t] > q[t]]
            for part, held, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                held.sort(key=lambda x: (-x[1], x[0].encode()))
                out.update((lang, a, part, item, value, rank) for rank, (item, value) in enumerate(held[:most], 1))
    return out


def test_divergence_of_odd_texts_in_small_ranges_and_blocks(spark, messy, nothing):
    rows = [(r.lang, r.source, r.text) for r in messy.select("lang", "source", "text").collect()]
    extra = [("en", f"s{i}", "one shared word more" if i % 3 else None) for i in range(9)] + [("xx", "only", "few words"), ("en", None, "ÀÉ é Zz\x00zz a1b")]
    more = messy.limit(0).unionByName(spark.createDataFrame(extra, "lang string, source string, text string"), allowMissingColumns=True)
    docs = messy.unionByName(more)
    for least, size, block in ((1, 50, 2), (3, 7, 3), (10, 20_000, 64)):
        got = Counter(tuple(r) for r in divergence.audit(docs, least, 4, size, block).collect())
        assert got == audited(rows + extra, least, 4)
    assert divergence.audit(nothing).collect() == []


def test_divergence_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()]
    assert Counter(tuple(r) for r in divergence.op11_source_divergence(spark, SF).collect()) == audited(rows, 10, 10)


def test_galloping_finds_what_a_set_finds():
    random_ = np.random.default_rng(3)
    for small, large in ((0, 9), (1, 1), (5, 4000), (300, 301), (2000, 2500), (900, 100_000)):
        a, b = (np.unique(random_.integers(0, 3 * large + 9, n)) for n in (small, large))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shares_stay_exact_beyond_64_bits(spark):
    counts, total, kept = [0, 10**10, 5 * 10**17], 6 * 10**17, 10**6
    exact = [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]
    assert divergence._shares(np.array(counts), total, kept).tolist() == exact
    df = spark.createDataFrame([(c, total, kept) for c in counts], "c bigint, t bigint, k bigint")
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("t"), F.col("k"))).collect()] == exact


def test_a_block_of_groups_is_sent_once_a_block_and_pairs_are_never_rows_before_they_are_priced(spark, documents_of, plan_of):
    docs = documents_of([(i, "some words here") for i in range(40)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id")))
    kept, groups = divergence.vocabulary(docs)
    plan = plan_of(divergence.divergence(kept, groups, block=8))
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def ranked(docs, items, k):
    own = [(d, Counter(found(TERMS, t))) for d, t in docs]
    n = sum(1 for _, c in own if c)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(found(TERMS, text))
    out = Counter()
    for item, terms in asked.items():
        scores = []
        for d, c in own:
            if c:
                m = 100 - 75 + 75 * sum(c.values()) * n // total
                score = sum(
                    times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, times in terms.items() if c[t]
                )
                scores.append((-score, d is None, d or 0, d)) if score > 0 else None
        out.update((item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1))
    return out


def test_search_of_odd_texts(spark, messy, messy_rows, nothing):
    base = messy_rows[6][1].split()
    items = [
        (1, " ".join(base[20:60])), (2, "one ONE, one!"), (3, None), (4, "..."), (None, " ".join(base[300:320])), (2, "five five the end"), (1, "é"),
        (5, "nowhere-to-be-found"), (6, messy_rows[20][1][:5000] + " x" * 900),
    ]
    benchmark = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id bigint, text string, score int, rank string")
    expected = ranked(messy_rows, items, 10)
    for options in ({}, {"block_bytes": 300}, {"shape": (2, 3, 5), "exact": 10**12}, {"shape": (1, 1, 1), "exact": 10**11}):
        assert Counter(tuple(r) for r in lexical.search(messy, benchmark, **options).collect()) == expected
    assert lexical.search(nothing, benchmark).collect() == []
    assert lexical.search(messy, benchmark.limit(0)).collect() == []


def test_search_query(spark, small_rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert Counter(tuple(r) for r in lexical.op13_lexical_search(spark, SF).collect()) == ranked(small_rows, items, 10)


def test_ties_at_the_last_rank_go_by_doc_id_across_tasks(spark, documents_of):
    docs = documents_of([(i, "the same words") for i in range(500)] + [(900, "other"), (901, "other")], parts=7)
    items = spark.createDataFrame([(1, "same"), (2, "words the same")], "item_id bigint, text string")
    got = lexical.search(docs, items, shape=(256, 16, 1024)).collect()
    assert {(r.item_id, r.rank, r.doc_id) for r in got} == {(i, n + 1, n) for i in (1, 2) for n in range(10)}


def test_partial_sums_are_bounded_and_split_counts_add_up():
    random_ = np.random.default_rng(4)
    weights = random_.integers(1, 14_000, 300)
    ids, counts = random_.choice(300, 250, replace=False), random_.integers(1, 10**9, 250)
    tile = lexical.Items(np.zeros(250, np.int64), ids, counts, weights, 64, lexical.EXACT)
    for begin, end in tile.tiles:
        assert end - begin <= 64
        bounds = tile.matrix(begin, end).astype(object) * weights[tile.ids[begin:end]] * 10**6
        assert bounds.sum() < lexical.EXACT or (end - begin == 1 and bounds.sum() < lexical.EXACT)
    added = defaultdict(int)
    for begin, end in tile.tiles:
        for at, n in zip(tile.ids[begin:end].tolist(), tile.matrix(begin, end)[0].tolist()):
            added[at] += int(n)
    assert added == dict(zip(ids.tolist(), counts.tolist()))


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "http://a.NET/x", "http://xnet/", "https://example.net/en/1", "https://EXAMPLE.net/EN/1",
    "https://a.example.net/en/", "https://example.net/en", "http://example.com/de/7?x=/fr/", "http://b.example.com?/de/", "http://org/fr/9.html#a", "http://a.org/fr",
    "http://user@org:80/fr/", "ftp://x://y/z", "http://a.org#/fr/", "line\nhttp://q.net/\n1", "http://ÄÖ.net/é/" + "9" * 30, "http://net" + "/long" * 3000,
]


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def fixed_rule(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def mined_rules(examples, least, confidence):
    """Every combination of tokens, by counting all subsets."""
    n, blocked = Counter(), Counter()
    for tokens, block in examples:
        for size in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), size):
                n[part] += 1
                blocked[part] += block
    rules = {p: (blocked[p] / n[p], blocked[p]) for p in n if blocked[p] >= least and blocked[p] / n[p] >= confidence}
    return {p: c for p, c in rules.items() if not any(set(q) < set(p) and rules[q][0] >= c[0] for q in rules)}


@pytest.fixture(scope="module")
def web():
    random_ = random.Random(8)
    pages, labels = [], []
    for i in range(400):
        host = random_.choice(["www.bad.example", "good.example", "m.good.example", "news.bad.example"])
        path = random_.choice(["/en/", "/de/", "/en/spam/"]) + str(i) + random_.choice(["", ".html", "/"])
        pages.append((i + 5000, f"https://{host}{path}" + random_.choice(["", "?utm_source=a", "#top"])))
        p = 0.9 if "spam" in path else 0.75 if "bad" in host and "/de/" in path else 0.08
        if i % 4:
            labels.append((i, int(random_.random() > 0.05), int(random_.random() < p), "x"))
    labels += [(3, None, None, "x"), (None, 0, 1, "x"), (7, 0, None, "x"), (7, 1, 0, "x")]
    return pages, labels


def tables(spark, web):
    pages = spark.createDataFrame([(i, u, "h", "p", "t") for i, u in web[0]], "page_id bigint, url string, host string, path string, tokens string")
    return pages, spark.createDataFrame(web[1], "doc_id bigint, quality int, toxic int, rule string")


def test_url_parts_and_fixed_rules(spark, web):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id bigint, url string").union(
        spark.createDataFrame([(None, "http://net/"), (0, None)], "page_id bigint, url string")
    )
    got = urls.judge(pages, tables(spark, web)[1].limit(0)).collect()
    expected = Counter()
    for i, url in [*enumerate(URLS * 2), (None, "http://net/"), (0, None)]:
        host, path = split_url(url)
        rule, verdict = fixed_rule(host, path)
        expected[(i, host, path, rule, verdict or "allow")] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected


def test_mined_rules_and_verdicts_equal_those_of_all_subsets(spark, web):
    pages, labels = tables(spark, web)
    host, path, rest = urls.parts(F.col("url"))
    tokens = {r.page_id: r.t for r in pages.select("page_id", urls.tokens(host, path, rest).alias("t")).collect()}
    assert tokens[web[0][0][0]] == sorted(set(tokens[web[0][0][0]]))
    block = defaultdict(bool)
    for d, quality, toxic, _ in web[1]:
        if d is not None and not (quality is None and toxic is None):
            block[d] |= bool(toxic) or quality == 0
    examples = [(tokens[i], block[i - 5000]) for i, _ in web[0] if i - 5000 in block]
    expected = mined_rules(examples, 10, 0.6)
    assert expected
    cut = pages.select(urls.parts(F.col("url"))[1].alias("path"), urls.tokens(host, path, rest).alias("tokens"))
    mined = urls.mine(urls.labelled(cut, labels), 0.0001, 0.6, 10, most=99).collect()
    assert {tuple(r.antecedent): round(r.confidence, 9) for r in mined} == {p: round(c[0], 9) for p, c in expected.items()}
    got = {r.page_id: (r.verdict, r.reason is not None) for r in urls.judge(pages, labels, (), 0.0001, 0.6).collect()}
    fits = {i: any(set(p) <= set(t) for p in expected) for i, t in tokens.items()}
    assert got == {i: ("block" if f else "allow", f) for i, f in fits.items()}
    assert 0 < sum(fits.values()) < len(fits)


def test_url_query_and_empty_tables(spark, web):
    pages, labels = tables(spark, web)
    assert urls.judge(pages.limit(0), labels).collect() == []
    read = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = urls.op12_url_filters(spark, SF)
    assert not any(word in got._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))
    rows = got.collect()
    assert len(rows) == len(read) and {r.page_id for r in rows} == set(read)
    for r in rows:
        assert (r.host, r.path) == split_url(read[r.page_id])
        rule, verdict = fixed_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.reason else "allow"))


def test_intermediate_tables_can_be_released(spark):
    kept = shared.stash(spark.range(5), "some")
    (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    assert kept.count() == 5 and shared.release(spark) >= 1 and shared.release(spark) == 0
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()


def test_a_rule_on_tokens_beyond_the_most_telling_ones_is_mined(spark):
    random_ = random.Random(12)
    examples = []
    for _ in range(600):
        # Ten tokens that tell a little each, one with its twin, and two that tell nothing alone and all together.
        x, y = random_.random() < 0.5, random_.random() < 0.5
        some = [f"t{i:02}" for i in range(10) if random_.random() < (0.45 if x == y else 0.2)]
        tokens = some + [t + "-twin" for t in some[:1]] + ["x"] * x + ["y"] * y
        examples.append((sorted(tokens), x == y))
    expected = mined_rules(examples, 10, 0.6)
    assert ("x", "y") in expected
    mined = urls.mine(spark.createDataFrame(examples, "tokens array<string>, block boolean"), 0.0001, 0.6, 10).collect()
    assert {tuple(r.antecedent): (round(r.confidence, 9), round(r.support * 600)) for r in mined} == {
        p: (round(c[0], 9), c[1]) for p, c in expected.items()
    }
