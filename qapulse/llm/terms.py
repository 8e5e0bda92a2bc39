"""Terms of whole texts inside a task, exact strings rather than hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from qapulse.llm import arrays


def alphabet(digits: bool) -> np.ndarray:
    """Byte table for :func:`split`: ASCII letters (A-Z lowered), digits if wanted, all bytes of other characters; else blank."""
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    if digits:
        table[0x30:0x3A] = np.arange(0x30, 0x3A)
    return table


def split(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of each maximal run of bytes that ``table`` does not blank, in order; a null text has none."""
    buffer, offsets = arrays.text_bytes(column)
    mapped = np.ascontiguousarray(table[buffer])
    texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(mapped))
    lists = pc.split_pattern(texts, " ")
    rows, found = pc.list_parent_indices(lists), pc.list_flatten(lists)
    held = pc.greater(pc.binary_length(found), 0)
    return rows.filter(held).to_numpy(), found.filter(held)
