"""Secret scans: fixed patterns, and a token-efficiency test for strings no pattern names.

Patterns, leftmost and not overlapping per kind (letters A-Z in either case only in the first):

* assign: ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, group 2 of 6 characters or more
* access: ``AKIA[A-Z0-9]+`` of 20 or more
* hex: ``[0-9a-f]+`` of 24 or more

Method (kind ``random``): a run ``[A-Za-z0-9+/_=-]+`` of ``LEAST`` characters or more is split by a byte-level
vocabulary. Prose, even unknown words, takes more than ``RATIO`` characters a token; random strings take fewer. A run that
takes more as a whole, as words stand around a random string, is searched for stretches of ``LEAST`` characters or more that
take fewer. Digests of usual length, UUIDs, and identifiers made of plain words and numbers are left out; what a pattern
covers is cut out of a run before.

Null and empty texts have no spans. Places are code points, ends exclusive. Each row is judged alone, so repeated rows
and further columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qapulse.llm import arrays
from qapulse.llm.shared import documents

KINDS = ("assign", "access", "hex", "random")
LEAST, RATIO = 20, 2.0
MASK = "[SECRET]"

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_NAMES = ("passw", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# Words of one case (or one capital), numbers, and camel case made of such words, joined by the usual marks.
# Runs of one case are taken whole (possessively), so a run that does not fit is refused in linear time.
_IDENTIFIER = re.compile(
    r"[+/_=-]*+(?:(?:(?:(?:[A-Z]{3,}+|[A-Z])[a-z]{3,}+|[a-z]{3,}+|[A-Z]{3,}+)++|[A-Za-z]{1,2}|[0-9]++)(?:[+/_=-]++|$))*+"
)
_NAMED_PART = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9A-Fa-f]{32,128}+)(?![A-Za-z0-9])"
)

_HEX, _RUN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def _encoding(path: str):
    return arrays.one_model(("runs", path), lambda: _loaded(path))


def _loaded(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _named(run: str) -> bool:
    """Whether a run is a digest, a UUID or an identifier."""
    return bool(len(run) in _DIGEST_SIZES and _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run))


def _dense(sizes: list[int], ratio: float) -> list[tuple[int, int]]:
    """Stretches of tokens, as places in the run, of ``LEAST`` characters or more with fewer than ``ratio`` a token.

    A stretch starts where no stretch before it would help and ends where its lead is greatest, or as soon as it is long enough.
    """
    found, token, place = [], 0, 0
    while token < len(sizes):
        lead, most, size, best = 0.0, 0.0, 0, None
        at = token
        while at < len(sizes):
            lead += ratio - sizes[at]
            size += sizes[at]
            at += 1
            if lead <= 0:
                break
            if size >= LEAST and lead > most:
                most, best = lead, (at, size)
        if best:
            found.append((place, place + best[1]))
        token, size = best or (at, size)
        place += size
    return found


def random_parts(run: str, path: str, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Places of what takes few characters a token in a run and is no digest or identifier; the whole run if that does."""
    if _named(run):
        return []
    if len(run) < ratio * len(_encoding(path).encode_ordinary(run)):
        return [(0, len(run))]
    parts, begin = [], 0
    for cut in [*(m.span() for m in _NAMED_PART.finditer(run) if _named(m[0])), (len(run), len(run))]:
        rest = run[begin : cut[0]]
        if len(rest) >= LEAST:
            tokens = _encoding(path)
            sizes = [len(t) for t in tokens.decode_tokens_bytes(tokens.encode_ordinary(rest))]
            parts += [(begin + a, begin + b) for a, b in _dense(sizes, ratio) if not _named(rest[a:b])]
        begin = cut[1]
    return parts


def _joined(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that (start, kind, end) cover, in order."""
    starts, ends = [], []
    for start, _, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _outside(start: int, end: int, covered: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """What of [start, end) no covered stretch holds; only stretches that meet it are looked at."""
    left, (starts, ends) = [], covered
    for at in range(bisect_right(ends, start), len(starts)):
        if starts[at] >= end:
            break
        left.append((start, starts[at]))
        start = max(start, ends[at])
    return [(a, b) for a, b in [*left, (start, end)] if b - a >= LEAST]


def _character(part: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each byte of one text."""
    return np.r_[0, np.cumsum((part & 0xC0) != 0x80)][places]


def scan_batch(column: pa.Array, path: str) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, kind, end), in order."""
    buffer, offsets = arrays.text_bytes(column)
    found: list[list[tuple[int, int, int]]] = []
    for text in column.to_pylist():
        own: list[tuple[int, int, int]] = []
        if text:
            lowered = text.lower()
            if any(name in lowered for name in _NAMES):
                own += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
            if "AKIA" in text:
                own += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        found.append(own)
    for table, least, kind in ((_HEX, 24, 2), (_RUN, LEAST, 3)):
        starts, ends = arrays.spans(buffer, table, offsets)
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        rows = arrays.owner(starts, offsets)
        for begin, end in zip(*arrays.run_bounds(rows)):
            row = int(rows[begin])
            part = buffer[offsets[row] : offsets[row + 1]]
            s, e = starts[begin:end] - offsets[row], ends[begin:end] - offsets[row]
            covered = _joined(found[row]) if kind == 3 else None
            for a, b, x, y in zip(_character(part, s).tolist(), _character(part, e).tolist(), s.tolist(), e.tolist()):
                if kind == 2:
                    found[row].append((a, 2, b))
                else:
                    run = part[x:y].tobytes().decode()
                    for p, q in _outside(a, b, covered):
                        found[row] += [(p + u, 3, p + v) for u, v in random_parts(run[p - a : q - a], path)]
    return [sorted(own) for own in found]


def masked(text: str, own: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by :data:`MASK`."""
    parts, last = [], 0
    for start, _, end in own:
        if start >= last:
            parts += [text[last:start], MASK]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def _path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every row with its own columns, spans (array of kind, start, end), and the text masked; clashing names are replaced.

    ``vocabulary``: a tiktoken file that every executor has; by default the installed byte-level one of 50k.
    """
    names = [n for n in docs.columns if n not in ("secret_spans", "masked_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _path(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in arrays.portions(batches):
            texts = batch.column("text")
            spans = scan_batch(texts, path)
            changed = [masked(t, s) if s else t for t, s in zip(texts.to_pylist(), spans)]
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, kind), pa.array(changed, pa.string())], [*batch.schema.names, "secret_spans", "masked_text"]
            )

    kept = docs.select(*(docs[n] for n in names))
    made = "secret_spans array<struct<kind:string,start:int,end:int>>, masked_text string"
    schema = T.StructType([*kept.schema, *T.StructType.fromDDL(made)])
    return kept.mapInArrow(run, schema)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("secret_spans", lambda x: x["kind"] != "random")

    def counted(kind):
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("secret_spans").alias("spans"))
