import hashlib
import html as stdlib_html
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from qapulse.functions import intents
from qapulse.functions.html import body_prose, code_blocks, decode_entities, link_count
from qapulse.functions.intents import INTENT_PATTERNS, with_intent
from qapulse.functions.tags import DOMAIN_TAGS, tag_domain
from qapulse.operators.features import FEATURES, feature_distributions, with_features

# Digests of the fixed values, joined by blanks (tags) or as they are (patterns).
PINNED_TAGS = {
    "Legacy Stable": "00e32edd",
    "Fast-Moving Web": "b60c92fb",
    "AI / ML": "4147860b",
}
PINNED_PATTERNS = {
    "Machine-Authored Discrepancy": "5516d936",
    "Architectural Consensus": "c8f75c4f",
    "Errors": "163f9383",
    "Discrepancy": "303223ba",
    "API Change": "73bbe3c2",
    "Review": "621408d5",
    "API Usage": "33fb8e02",
    "Conceptual": "40d23b37",
    "Learning": "c0217a58",
}


def split(spark, *bodies):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    got = rows.select("i", body_prose(F.col("b")).alias("prose"), code_blocks(F.col("b")).alias("code"))
    return [(r["prose"], r["code"]) for r in got.orderBy("i").collect()]


def test_prose_and_code_are_separated(spark):
    cases = {
        "<h2>Hive log</h2><pre>open\nclose</pre>after<pre><code>42</code></pre><i>end</i>": ("Hive log after end", ["open\nclose", "42"]),
        "<ul><li>run <code>ls -l</code></li><li>look</li></ul>": ("run ls -l look", []),
        "no markup at all": ("no markup at all", []),
        # nested, unbalanced and look-alike elements; '>' in an attribute
        "<pre>a<pre>b</pre>c</pre><p>t</p>": ("t", ["abc"]),
        "x<pre>1<pre>2</pre>3</pre>y</pre>z<pre>4</pre>": ("x y z", ["123", "4"]),
        "<pre>p<pre>q</pre>r": ("", ["pqr"]),
        "<pre><pre></pre></pre>w<pre>v</pre>": ("w", ["", "v"]),
        "<pre-x>kept</pre-x> <script-y>too</script-y>": ("kept too", []),
        '<pre title="a>b">c</pre>d': ("d", ["c"]),
        "": ("", []),
        None: ("", []),
        # a removed region separates its neighbours
        "left<pre>x</pre>right": ("left right", ["x"]),
        "left<!-- <b>no</b> -->right": ("left right", []),
        "<script>if (a < b) '</p>'</script>text<style>p{}</style>": ("text", []),
        # entities are decoded once, after tags are gone, and then stripped
        "<p>&nbsp;a &lt;b&gt; &amp;lt; &#39;q&#x27; &eacute;</p>": ("a <b> &lt; 'q' é", []),
        "<pre>if a &lt; b &amp;&amp; c:\n  <b>x</b></pre>": ("", ["if a < b && c:\n  x"]),
        # '>' inside an attribute, a bare '<', an unclosed block
        '<a title="a > b" href="u">t</a> 1 < 2': ("t 1 < 2", []),
        "<p>q</p><PRE class='x'>open": ("q", ["open"]),
        "<p>unknown &nosuch; &#0; & alone</p>": ("unknown &nosuch; &#0; & alone", []),
        "<p>isn&apos;t &#00000039;&#x000000027; &ngE; &#128;</p>": ("isn't '' \u2267\u0338 \x80", []),
    }
    assert split(spark, *cases) == list(cases.values())


def test_entities_match_the_standard_library(spark):
    texts = ["plain", "&amp;amp; &lt;", "&hearts;&#9829;&#x2665;", "a&copy;b&quot;", "&#128512; &notanentity; &&amp;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(decode_entities(F.col("t"))).collect()]
    assert got == [stdlib_html.unescape(t.replace("&notanentity;", "&amp;notanentity;")) for t in texts]


class _Text(HTMLParser):
    """Brute force: text nodes outside pre, script and style."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("pre", "script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag in ("pre", "script", "style")

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.nodes.append(data.strip())


def test_whole_pages_match_an_html_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in pages.select("html", body_prose(F.col("html")).alias("prose")).collect():
        parser = _Text()
        parser.feed(row["html"])
        assert row["prose"] == " ".join(parser.nodes)


@pytest.mark.parametrize(
    "title, body, tags, expected",
    [
        ("Why wax?", "<p>warm <b>wax</b></p><pre>melt(7)</pre>", "<bees><wax>", [8, 8, 1, 7, 0, 2]),
        ("", '<pre>12</pre><a href="u">go</a><pre>345</pre><a href="v">on</a>', "<x-y>", [0, 5, 2, 5, 2, 1]),
        (None, None, None, [0, 0, 0, 0, 0, 0]),
    ],
)
def test_features(spark, title, body, tags, expected):
    row = spark.createDataFrame([(title, body, tags)], "t string, b string, g string")
    measured = with_features(row, F.col("t"), F.col("b"), F.col("g")).first()
    assert [measured[f] for f in FEATURES] == expected


def test_links_are_counted_in_the_raw_body(spark):
    row = spark.createDataFrame([("<A HREF='x'> <a\n> <abbr> &lt;a <pre><a b></pre>",)], "b string")
    assert row.select(link_count(F.col("b"))).first()[0] == 3


def test_distributions_interpolate(spark):
    values = [3, 8, 8, 21, 55, 60, 2]
    frame = spark.createDataFrame([("2031-05", *[v] * 6) for v in values], "year_month string, " + ", ".join(f"{f} int" for f in FEATURES))
    (row,) = feature_distributions(frame).collect()
    for feature in FEATURES:
        assert row[f"{feature}_median"] == pytest.approx(np.median(values))
        assert row[f"{feature}_p90"] == pytest.approx(np.percentile(values, 90))


def test_intents_of_given_titles(spark):
    """Literal titles, so that a changed pattern shows."""
    cases = {
        "How to prune roses": "API Usage", "It doesn't work": "Discrepancy", "NullPointerException on start": "Errors",
        "Copilot suggested this": "Machine-Authored Discrepancy",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["intent"] for r in with_intent(rows, F.col("t"), F.lit("")).collect()}
    encoded = spark.createDataFrame([("<p>It doesn&apos;t work</p>",)], "b string")
    assert with_intent(encoded, F.lit(""), body_prose(F.col("b"))).first()["intent"] == "Discrepancy"
    assert got == cases


def test_intents_match_first_pattern_in_python(spark):
    titles = [
        "How to use pandas merge", "Best practice for caching", "NullPointerException in Java",
        "Function returns wrong result", "Migrating from v1.2 to v2.0", "Please review my snippet",
        "Copilot wrote this loop", "What is the difference between a and b", "Tutorial on sorting",
        "Sort a list", "Bombard the server", "It doesn’t work", "ERROR: É", "using café with x", "", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = [r["intent"] for r in with_intent(rows, F.col("t"), F.lit("")).orderBy("i").collect()]

    def expected(title):
        text = f"{title or ''} "
        return next((c for c, p in INTENT_PATTERNS.items() if re.search(p, text, re.I)), "API Usage")

    assert got == [expected(t) for t in titles]
    assert len(set(got)) == 9


def test_domain_precedence_and_exact_tags(spark):
    cases = {
        "<java><python>": "Legacy Stable", "<html><python>": "Fast-Moving Web", "<python>": "AI / ML",
        "<PYTHON>": "Other", "<javascript-x>": "Other", "<c++>": "Legacy Stable", "<.net>": "Legacy Stable",
        "<xnet>": "Other", "": "Other", None: "Other", "<a<css>": "Fast-Moving Web",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in rows.select(tag_domain(F.col("t"))).collect()] == list(cases.values())


def test_every_listed_tag_finds_its_domain(spark):
    pairs = [(f"<zz><{t}>", d) for d, tags in DOMAIN_TAGS.items() for t in tags]
    rows = spark.createDataFrame(pairs, "t string, d string")
    assert rows.where(tag_domain(F.col("t")) != F.col("d")).count() == 0


def test_quick_patterns_find_the_same_texts_as_the_given_ones():
    """Texts made of the alternatives themselves, whole, cut and joined, so that most near misses occur."""
    chance = random.Random(1)
    parts = ["a", " ", "\n", "ai ", "v3.1", "gpt4", "why ", "what's the difference", "doesn’t work", "new to x", "code", "I "]
    for pattern in intents.INTENT_PATTERNS.values():
        for text in intents._alternatives(pattern):
            plain = re.sub(r"[()?\[\]]", "", text.split("|")[0])
            for mark, sample in ((r"\s+", " "), (r"\s*", ""), (r"\s", " "), (r"\w+", "ab"), (r"\w", "x"), (r"\d+", "12"), (r"\d", "3"), (r"\b", "")):
                plain = plain.replace(mark, sample)
            parts.append(plain.replace("\\", ""))
    hits = 0
    for _ in range(4000):
        text = "".join(chance.choice(parts)[: chance.choice([99, 99, 4, 6])] + chance.choice(["", " ", "  ", "-"]) for _ in range(3))
        for intent, pattern in intents.INTENT_PATTERNS.items():
            found = bool(re.search(pattern, text))
            assert bool(re.search(intents.searchable(pattern), text)) == found, (intent, text)
            hits += found
    assert hits > 1000


def test_bodies_without_blocks_are_spared_the_work_on_blocks(spark):
    bodies = ["<p>a < pre b</p>", "<PRE>x</PRE>y", "<pRe\n>z</prE>", "<prefix>w</prefix>", "<pre", "", None, "</pre>q"]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(body_prose(F.col("b")), code_blocks(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a < pre b", []), ("y", ["x"]), ("", ["z"]), ("w", []), ("<pre", []), ("", []), ("", []), ("q", []),
    ]


class _Blocks(HTMLParser):
    """Brute force: the texts of outermost pre elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "pre":
            if not self.depth:
                self.blocks.append("")
            self.depth += 1

    def handle_endtag(self, tag):
        self.depth -= tag == "pre" and self.depth > 0

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_blocks_nested_at_any_depth_match_an_html_parser(spark):
    """Up to seven deep, so that both ways of finding blocks are taken."""
    chance = random.Random(5)

    def markup(depth):
        out = ""
        for _ in range(chance.randrange(4)):
            out += chance.choice(["t ", "&lt;x", "<i>u</i>", "&ngE;", "&#39;", "\n", ""])
            if depth and chance.random() < 0.7:
                out += chance.choice(["<pre>", "<PRE a='1>2'>"]) + markup(depth - 1) + chance.choice(["</pre>", "</Pre >"])
        return out

    bodies = [markup(chance.randrange(8)) for _ in range(600)]
    bodies += ["<pre>" * n + "x" + "</pre>" * n + "y<pre>z</pre>" for n in range(1, 9)]
    bodies += ["<pre>a" + "<pre>b</pre>" * n + "c</pre>d</pre><pre>e" for n in range(9)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    got = [r["blocks"] for r in rows.select("i", code_blocks(F.col("b")).alias("blocks")).orderBy("i").collect()]
    expected = []
    for body in bodies:
        parser = _Blocks()
        parser.feed(body)
        parser.close()
        expected.append(parser.blocks)
    assert got == expected
    assert sum(map(len, got)) > 500


def test_very_long_blocks(spark):
    bodies = ["<p>q</p><pre>" + "<b>x</b>\n" * 100_000 + "</pre>t", "<pre>" + "a<pre>b</pre>" * 2 + "c" * 500_000, "<div>" * 100_000 + "<PRE>x"]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(code_blocks(F.col("b")).alias("blocks")).collect()
    assert [r["blocks"] for r in rows] == [["x\n" * 100_000], ["abab" + "c" * 500_000], ["x"]]


def test_fixed_values_are_pinned():
    """The SQL of the checks uses these values too, so a changed one must fail here."""
    assert {d: len(tags) for d, tags in DOMAIN_TAGS.items()} == {"Legacy Stable": 22, "Fast-Moving Web": 25, "AI / ML": 26}
    assert list(DOMAIN_TAGS) == ["Legacy Stable", "Fast-Moving Web", "AI / ML"]
    joined = {d: hashlib.md5(" ".join(tags).encode()).hexdigest()[:8] for d, tags in DOMAIN_TAGS.items()}
    patterns = {i: hashlib.md5(p.encode()).hexdigest()[:8] for i, p in INTENT_PATTERNS.items()}
    assert (joined, patterns) == (PINNED_TAGS, PINNED_PATTERNS)
    assert list(INTENT_PATTERNS) == [
        "Machine-Authored Discrepancy", "Architectural Consensus", "Errors", "Discrepancy", "API Change", "Review", "API Usage", "Conceptual", "Learning",
    ]
