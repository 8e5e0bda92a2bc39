from random import Random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, hits int, pieces string, "
    "digest int, score string, anchor double, node string, label string, start string, size int"
)


def words(random, n, letters="abcdefghij"):
    return [" ".join("".join(random.choice(letters) for _ in range(random.randint(2, 7))) for _ in range(n))][0]


@pytest.fixture(scope="session")
def messy_rows():
    """Null, empty and very long texts, copies, near copies, shared passages, repeated rows, odd characters."""
    random = Random(5)
    shared, base, other = words(random, 90), words(random, 400), words(random, 300)
    near = base.split()
    near[200] = "changed"
    texts = [
        None, "", " \t\n", "!!! ???", "one", "One  two\tthree\x0bfour\x0cfive", base, base, base.upper(), " ".join(near), other,
        words(random, 30) + " " + shared + " " + words(random, 40), words(random, 50) + "\n" + shared, shared, shared + " " + shared,
        "ab" * 700, "a" * 1500, "é" * 400 + " ñandú œuvre 中文 emoji 😀 " + "é" * 350, base[:1500] + other[:900], "x " * 300,
        words(random, 60_000), other.replace(" ", "  "), "the end", None,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(6, base), (6, base), (6, other), (None, base), (None, None), (None, shared), (-3, shared)]
    return rows


@pytest.fixture(scope="session")
def documents_of(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use themselves."""

    def build(rows, parts=3):
        full = [(i, t, ["en", None, "fr"][k % 3], f"s{k % 2}", 0, "k", k, "p", k, "s", 0.5, "n", "l", "st", k) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def messy(documents_of, messy_rows):
    return documents_of(messy_rows)


@pytest.fixture(scope="session")
def nothing(documents_of):
    return documents_of([])


@pytest.fixture(scope="session")
def small_rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
