"""Language identification by held-out accuracy and brute-force parses; revisits against a loop."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qapulse.llm import language, revisits
from qapulse.llm.queries import op2_language

SF = "/root/testdata/sf0.01"


def phrases(text, sample):
    """Greedy longest matches."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


@pytest.mark.parametrize("dense", [1 << 25, 0])
def test_tables_parse_as_the_longest_matches_do(dense, monkeypatch):
    """Short texts, and texts of many blocks, in both forms of the table."""
    monkeypatch.setattr(language, "DENSE", dense)
    chance = random.Random(2)
    samples = tuple((name, "".join(chance.choice(letters) for _ in range(400))) for name, letters in (("x", "abcd "), ("y", "abxyz ")))
    model = language.Model(samples)
    assert (model.dense is None) == (dense == 0)
    texts = ["".join(chance.choice("abcdxyz  .,!") for _ in range(chance.choice([2, 90, 300, 1024, 1025, 5000]))) for _ in range(60)]
    texts += ["q" * 40, "a", "abcd" * 1500, samples[0][1] * 8]
    best, score, bits, letters = model.predict(pa.array(texts))
    for t, b, s, h in zip(texts, best, score, bits):
        squeezed = re.sub("[^a-z]+", " ", t)
        known = re.sub("[^abcdxyz ]", "?", squeezed)
        costs = [phrases(known, re.sub("[^a-z]+", " ", text)) * np.log2(max(2, len(re.sub("[^a-z]+", " ", text)))) / max(1, len(known)) for _, text in samples]
        if not any(c.isalpha() for c in t):
            assert b == -1 and s == 0
        else:
            assert h == pytest.approx(min(costs)) and b == int(np.argmin(costs)) and s == pytest.approx(1 - min(costs) / max(costs))


def test_six_scripts_are_told_apart(spark):
    """Languages of one script each, texts of the same invented words: no script shares symbols with another."""
    chance = random.Random(12)
    scripts = {"la": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 24), "ka": (0x10D0, 33), "hy": (0x561, 38), "he": (0x5D0, 27)}
    words = {
        f"{name}{n}": ["".join(chr(first + chance.randrange(size)) for _ in range(chance.randint(2, 8))) for _ in range(400)]
        for name, (first, size) in scripts.items() for n in range(2)
    }

    def text(lang, n):
        return " ".join(chance.choice(words[lang]) for _ in range(n))

    learned = [(lang, text(lang, 100)) for lang in words for _ in range(30)]
    samples = language.learn(spark.createDataFrame(learned, "lang string, text string"))
    asked = [(i, lang, text(lang, chance.choice([30, 300]))) for i, lang in enumerate(list(words) * 20)]
    found = language.identify(spark.createDataFrame(asked, "doc_id bigint, given string, text string"), samples)
    rows = found.withColumn("kept", language.accepted(samples)).collect()
    for lang in words:
        own = [r for r in rows if r.given == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.95 * len(own) and all(r.kept for r in own)
    assert {(r.lang_pred, r.rejected) for r in language.verdicts(found, samples).collect()} == {(r.lang_pred, 0) for r in rows}


def test_the_sample_is_no_head_of_texts(spark):
    """All texts of both languages begin with one header, longer than the sampled stretch."""
    header = "terms of use apply to this page and to all pages of the site " * 10
    rows = [(lang, header + " ".join(random.Random(i).choice(words) for _ in range(2000))) for i, (lang, words) in enumerate([("a", ["uno", "dos", "tres"]), ("b", ["eins", "zwei", "drei"])] * 20)]
    samples = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([(1, "dos tres uno dos"), (2, "zwei drei eins")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(asked, samples).collect()} == {1: "a", 2: "b"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op2_language(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(held) > 200 and sum(held) / len(held) > 0.97


def test_messy_documents(messy, messy_rows, nothing):
    samples = language.learn(messy)
    assert {name for name, *_ in samples} == {"en", "fr"}
    found = language.identify(messy, samples)
    assert found.columns == [*(c for c in messy.columns if c not in ("score",)), "lang_pred", "score", "bits", "n_letters"]
    for r in found.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) == lettered and (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    # labels and ids are no inputs of a prediction
    other = language.identify(messy.withColumn("lang", F.lit("fr")).withColumn("doc_id", F.lit(1)), samples)
    assert sorted(r.lang_pred for r in other.collect()) == sorted(r.lang_pred for r in found.collect())
    assert language.learn(nothing) == () and language.identify(nothing, samples).collect() == []
    assert {r.lang_pred for r in language.identify(messy, ()).collect()} == {"und"}


def test_texts_of_no_learned_language_are_not_accepted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chance = random.Random(4)
    noise = "".join(chance.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900))
    odd = spark.createDataFrame([(1, noise), (2, "中文" * 300), (3, "12 34"), (4, None)], "doc_id bigint, text string")
    samples = language.learn(docs)
    assert language.identify(odd, samples).where(language.accepted(samples)).count() == 0
    assert language.identify(docs, samples).where(~language.accepted(samples)).count() == 0


@pytest.mark.parametrize("url, name", [
    ("HTTP://user@WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#frag", "example.com/a/b?a=1&b=2"), ("https://example.com/a/b?a=1&b=2", "example.com/a/b?a=1&b=2"),
    ("http://www2.example.com", "example.com"), ("https://example.com:443/", "example.com"), ("http://example.com:8080/x", "example.com:8080/x"),
    ("", None), (None, None), ("#only", None),
])
def test_canonical_urls(spark, url, name):
    row = spark.createDataFrame([(url,)], "u string").select(revisits.canonical_url(F.col("u")).alias("c")).first()
    assert row.c == name


FIELDS = "record_id bigint, url string, ts bigint, status int, etag string, last_modified string, headers map<string,string>, payload string, part int, found string"


def resolved(rows):
    out = set()
    for r in rows:
        if r["status"] != 304:
            continue
        earlier = [
            f for f in rows if f["status"] == 200 and f["url"] and f["url"] == r["url"] and None not in (f["ts"], r["ts"])
            and (f["ts"], f["record_id"]) < (r["ts"], r["record_id"])
        ]
        full = max(earlier, key=lambda f: (f["ts"], f["record_id"]), default=None)
        if full is None:
            result = "missing"
        elif r["etag"] is not None:
            result = "matched" if full["etag"] is not None and r["etag"].removeprefix("W/") == full["etag"].removeprefix("W/") else "mismatch"
        elif r["last_modified"] is not None:
            result = "matched" if r["last_modified"] == full["last_modified"] else "mismatch"
        else:
            result = "unchecked"
        sent = dict(r["headers"] or {})
        if result in ("matched", "unchecked"):
            sent = {**(full["headers"] or {}), **{k: v for k, v in sent.items() if k in revisits.PERMITTED}}
            out.add((r["record_id"], result, full["record_id"], tuple(sorted(sent.items()))))
        else:
            out.add((r["record_id"], result, None, tuple(sorted(sent.items()))))
    return out


def test_revisits_with_a_hot_url(spark):
    chance = random.Random(6)
    rows = []
    for i in range(900):
        status = chance.choice([200, 304, 304, 404])
        rows.append({
            "record_id": i, "url": "h.example/hot" if i % 3 == 0 else chance.choice([None, "", *(f"h.example/{k}" for k in range(60))]),
            "ts": chance.choice([None, *([chance.randrange(200)] * 9)]), "status": status,
            "etag": chance.choice([None, "a", "W/a", "b"]), "last_modified": chance.choice([None, "m", "n"]),
            "headers": chance.choice([None, {"date": str(i), "server": "s"}, {"vary": "x", "content-length": "0", "etag": "t"}]),
            "payload": "p" if status == 200 else None, "part": 1, "found": "clash",
        })
    frame = spark.createDataFrame([tuple(r[f.split()[0]] for f in FIELDS.split(", ")) for r in rows], FIELDS)
    for parts in ("2", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = revisits.resolve_revisits(frame).collect()
        assert {(r.record_id, r.outcome, r.full_id, tuple(sorted(r.headers.items()))) for r in found} == resolved(rows)
        assert all((r.payload_sha256 is not None) == (r.full_id is not None) for r in found)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    twice = frame.where("status = 304").union(frame)
    assert revisits.resolve_revisits(twice).count() == 2 * frame.where("status = 304").count()
    assert revisits.resolve_revisits(frame.limit(0)).collect() == []
