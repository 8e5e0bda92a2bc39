"""Decontamination, secrets and tokens against brute force."""

import hashlib
import random
import re
import signal
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qapulse.llm import decontam, packing, secrets, tokenise, tokens_orc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = lowered(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else []:
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    sizes, out = {len(k) for k in windows}, []
    for d, text in rows:
        w, hit, found = lowered(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (items_of := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= items_of
        out.append((d, len(w), len(hit), ",".join(sorted(found)), bool(hit)))
    return Counter(out)


def test_decontamination(spark, messy, messy_rows, nothing):
    base = messy_rows[6][1].split()
    items = [
        (1, " ".join(base[20:60])), (10, "ONE, two!"), (2, " ".join(base[100:110])), (None, " ".join(base[300:320])), (3, None), (4, "..."),
        (2, " ".join(base[100:110])), (30, " ".join(base[15:25])), (77, "never seen in any document here at all or anywhere else"), (5, "é" * 400),
    ]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, print string")
    got = decontam.decontaminate(messy, benchmark)
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got.collect())
    assert got == contaminated(messy_rows, items)
    assert decontam.decontaminate(nothing, benchmark).collect() == []
    assert not decontam.decontaminate(messy, benchmark.limit(0)).where("contaminated").collect()


def test_decontamination_of_the_small_table(spark, documents_of, small_rows):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    got = decontam.decontaminate(documents_of(small_rows), spark.createDataFrame(items, "item_id bigint, text string"))
    expected = contaminated(small_rows, items)
    assert any(k[4] for k in expected)
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got.collect()) == expected


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(documents_of, messy_rows, nothing):
    chance = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    loose = "".join(chance.choice(alphabet) for _ in range(44))
    rows = messy_rows + [
        (100, f"é PassWord = 'abc.def=' token:secret=abcdefgh api_key : \"{'f' * 30}\" pass"),
        (101, "😀 AKIA" + "Q7" * 10 + " AKIAAKIA " + "0" * 23 + " " + "0123456789abcdef" * 2 + "g"),
        (102, f"key {loose} here, {hashlib.sha256(b'x').hexdigest()} and 123e4567-e89b-12d3-a456-426614174000"),
        (103, "some_long_identifier_of_words aVeryLongCamelCaseIdentifierName thththeousandnessonation"),
        (104, "token=" + loose), (105, "apikey=abcdef api_key='abcde'"),
    ]
    found = {(r.doc_id, r.text): r for r in secrets.scan_secrets(documents_of(rows)).collect()}
    for d, text in rows:
        spans = [(s.start, secrets.KINDS.index(s.kind), s.end) for s in found[d, text].secret_spans]
        assert spans == sorted(spans)
        assert [s for s in spans if s[1] < 3] == base_spans(text)
        hidden = found[d, text].masked_text
        assert (hidden is None) == (text is None) and (not spans) == (hidden == text)
    extra = {d: [s.kind for s in found[d, t].secret_spans if s.kind == "random"] for d, t in rows if d and d >= 100}
    assert extra == {100: [], 101: [], 102: ["random"], 103: [], 104: [], 105: []}
    assert loose not in found[102, rows[-4][1]].masked_text
    assert secrets.scan_secrets(nothing).collect() == []


def test_identifiers_are_told_in_linear_time():
    """The same strings as one that tries all splits, and long ones that it never refused."""
    slow = re.compile(r"[+/_=-]*((([A-Z]?[a-z]{3,}|[A-Z]{3,})+|[A-Za-z]{1,2}|[0-9]+)([+/_=-]+|$))*")
    chance = random.Random(31)
    for _ in range(30_000):
        text = "".join(chance.choice("aaaabBBB1_-") for _ in range(chance.randint(0, 12)))
        assert bool(slow.fullmatch(text)) == bool(secrets._IDENTIFIER.fullmatch(text)), text
    signal.alarm(30)  # the default action ends the process
    try:
        for text in ("a" * 100_000 + "1", "A" * 100_000 + "1", "aB" * 50_000 + "1", "abcDef" * 20_000 + "1", "-" * 100_000 + "a1"):
            assert not secrets._IDENTIFIER.fullmatch(text)
    finally:
        signal.alarm(0)


def test_random_strings_among_words():
    chance = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    path = secrets._path(None)
    for size in (32, 40, 64):
        for before, after in (("com/users/account-reset/confirmation/", ""), ("prefix_of_some_words_", ""), ("webhooks/incoming/", "/messages/delivery/status")):
            key = "".join(chance.choice(alphabet) for _ in range(size))
            text = f"é see {before}{key}{after} there"
            spans = secrets.scan_batch(pa.array([text]), path)[0]
            assert [k for _, k, _ in spans] == [3]
            assert sum(text.index(key) <= i < text.index(key) + size for i in range(spans[0][0], spans[0][2])) >= size - 4
            # The rest of a run of which a pattern covers a part.
            text = f"{'0123456789ab' * 2}/{key}"
            assert [k for _, k, _ in secrets.scan_batch(pa.array([text]), path)[0]] == [2, 3]
    for text in ("com/users/123e4567-e89b-12d3-a456-426614174000/confirmation", "some/path/to/aLongIdentifierOfWords/v2/and-more-of-it"):
        assert secrets.scan_batch(pa.array([text]), path) == [[]], text


@pytest.fixture(scope="module")
def library():
    return tokenise.encoder(tokenise.vocabulary(None)).library


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_cached_pieces_give_the_library_ids(library):
    chance = random.Random(3)
    parts = list("abcdeABCDE 019'<|>.,!?-_#\n\t\r éÉßüÜñ×÷ÿæøÅ") + [
        "é", "́", " ", " ", "\x1c", "\x0b", "İ", "Σ", "ς", "'s", "'LL", "'ve", "<|endoftext|>", "ﬁ", "中", "😀", "ª", "²", "½", "\x00",
        "\x85", "ſ", "각", "‍", "x" * 70, "don't",
    ]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 60))) for _ in range(3000)] + [None, ""]
    own = tokenise.Encoder(tokenise.vocabulary(None))
    for _ in range(2):  # the second time from the table
        ids, places = own.batch(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [encoded(library, t) for t in texts]


def test_one_text_of_more_pieces_than_are_kept(library, monkeypatch):
    monkeypatch.setattr(tokenise, "KEPT", 100)
    own = tokenise.Encoder(tokenise.vocabulary(None))
    texts = ["some words first", " ".join(f"w{i}x" + "abcdefghij"[i % 10] * (i % 7) + " é" + "ab" * (i % 30) for i in range(3000)), "some words after"]
    signal.alarm(60)  # the default action ends the process
    try:
        for text in texts * 2:
            ids, _ = own.batch(pa.array([text]))
            assert ids.tolist() == encoded(library, text)
            assert np.count_nonzero(own.table.keys) <= 100
    finally:
        signal.alarm(0)


def naive_fit(lengths, size):
    free, out = [], []
    for n in lengths:
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(size)
        out.append((at, size - free[at]))
        free[at] -= n
    return out


def test_first_fit_takes_the_first_bin():
    chance = random.Random(1)
    for n in (0, 1, 2, 3, 50, 300):
        lengths = sorted((chance.randint(1, 64) for _ in range(n)), reverse=True)
        bins, offsets = packing.first_fit(np.array(lengths, np.int64), 64)
        assert list(zip(bins.tolist(), offsets.tolist())) == naive_fit(lengths, 64)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(messy, messy_rows, nothing, library, size):
    rows = packing.pack(messy, size=size, group=40).collect()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    expected = Counter()
    for d, t in messy_rows:
        ids = [*encoded(library, t), 2]
        for a in range(0, len(ids), size):
            expected[d, a, len(ids[a : a + size]), crc(ids[a : a + size]), len(ids)] += 1
    assert pieces == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= size
    assert packing.pack(nothing).collect() == []


def stripe_streams(spark, file):
    """Kinds of the streams that the stripe footers of an ORC file list."""
    jvm = spark._jvm
    options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), options)
    rows = reader.rows()
    footers = [rows.readStripeFooter(stripe) for stripe in reader.getStripes()]
    kinds = [f.getStreams(i).getKind().toString() for f in footers for i in range(f.getStreamsCount())]
    rows.close()
    return kinds


def rows_read(df):
    """Rows that a query got out of its scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
        if plan.nodeName().endswith("QueryStage"):
            plan = plan.plan()
    return plan.metrics().apply("numOutputRows").value()


def test_orc_lookups_skip_stripes_and_row_groups(spark, documents_of, tmp_path):
    path = str(tmp_path / "many")
    tokens_orc.write_tokens(documents_of([(i, f"text number {i}") for i in range(0, 24_000, 2)]).coalesce(1), path)
    stored = spark.read.orc(path)
    assert rows_read(stored.select("doc_id", "n_tokens")) == 12_000
    assert 1 <= rows_read(stored.where("doc_id = 5000").select("doc_id", "n_tokens")) <= tokens_orc.STRIDE
    # An id between two stored ones is inside the range of a row group: only its Bloom filter can rule it out.
    assert rows_read(stored.where("doc_id = 5001").select("doc_id", "n_tokens")) == 0


def test_packing_keeps_wide_ids_beside_a_null(spark):
    ids = [2**53 + 1, 2**53 + 3, 2**60 + 1, -(2**55) - 1, None, 7]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string").coalesce(1)
    got = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)


def test_long_logs_of_secrets_are_scanned_in_linear_time():
    """Many base spans and many runs in one text."""
    line = "0123456789abcdef01234567 path/to/some/thing/with/words k9Q2xZ7vLp4TtW8sYb3RdN6f password: hunter2hunter2 "
    path = secrets._path(None)
    seconds = []
    for copies in (500, 4000, 32_000):
        begun = time.perf_counter()
        (found,) = secrets.scan_batch(pa.array([line * copies]), path)
        seconds.append(time.perf_counter() - begun)
        assert len(found) >= 3 * copies and found[:3] == [tuple(x) for x in found[:3]]
        assert {(s - len(line), k, e - len(line)) for s, k, e in found if len(line) <= s and e <= 2 * len(line)} == {
            (s, k, e) for s, k, e in found if e <= len(line)
        }
    assert seconds[2] < 20 * max(seconds[1], 0.2)  # eight times the text


def test_orc_round_trip(spark, messy, messy_rows, nothing, library, tmp_path):
    path = str(tmp_path / "tokens")
    tokens_orc.write_tokens(messy, path)
    rows = tokens_orc.read_tokens(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r["ids"])) for r in rows) == Counter((d, (*encoded(library, t), 1)) for d, t in messy_rows)
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])][:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    sums = Counter((r.doc_id, r.ids_crc32) for r in tokens_orc.checksums(tokens_orc.read_tokens(spark, path)).collect())
    assert sums == Counter((d, crc([*encoded(library, t), 1])) for d, t in messy_rows)
    import pyarrow.orc as orc

    files = [orc.ORCFile(f) for f in (tmp_path / "tokens").glob("*.orc")]
    assert all(f.row_index_stride == tokens_orc.STRIDE and f.compression == "ZLIB" for f in files)
    kinds = {kind for f in (tmp_path / "tokens").glob("*.orc") for kind in stripe_streams(spark, f)}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    assert spark.read.orc(path).where("doc_id = 20").select(F.size("ids")).count() == 1
    tokens_orc.write_tokens(nothing, str(tmp_path / "none"))
    assert spark.read.orc(str(tmp_path / "none")).count() == 0
