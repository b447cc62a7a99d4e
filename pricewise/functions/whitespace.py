"""Collapsing whitespace in texts, on Arrow batches.

A regular expression copies a text once more for every run of whitespace; here the bytes
of many texts are looked at together, and only the bytes that go are left out. UTF-8
keeps this exact: the bytes of a whitespace character occur nowhere else in a text.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every cleaning step comes here: workers get these functions with the task, wherever they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Python's ``str.isspace()``, one by one. Those of one byte are 9 to 13 and 28 to 32.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those of two and of three bytes, as numbers, and the first bytes that they have.
WIDE = {n: np.array([int.from_bytes(c.encode(), "big") for c in WS_CHARS if len(c.encode()) == n], np.uint32) for n in (2, 3)}
FIRST = {n: sorted({int(w) >> 8 * (n - 1) for w in WIDE[n]}) for n in WIDE}

#: Bytes of text that are looked at a time (a text is never parted).
STRETCH_BYTES = 1 << 20


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to whitespace characters."""
    found = (data - np.uint8(9) < 5) | (data - np.uint8(28) < 5)
    for size, codes in WIDE.items():
        first, last = FIRST[size][0], FIRST[size][-1]
        at = np.flatnonzero(data - np.uint8(first) <= last - first)
        at = at[at + size <= len(data)]
        code = np.zeros(len(at), np.uint32)
        for i in range(size):
            code = code << np.uint32(8) | data[at + i]
        at = at[np.isin(code, codes)]
        for i in range(size):
            found[at + i] = True
    return found


def collapse_runs(texts: pa.Array) -> pa.Array:
    """Every run of whitespace in a text becomes one space; null stays null."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    if not len(texts) or values is None or not values.size:
        return texts
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)
    out, ends = np.empty(offsets[-1] - offsets[0], np.uint8), np.zeros(len(offsets), width)
    at = size = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH_BYTES, "right")) - 1)
        part, own = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        space = spaces(part)
        again = np.zeros(len(part), bool)
        again[1:] = space[1:] & space[:-1]
        again[own[own < len(part)]] = False  # a run does not go on from the text before
        gone = np.flatnonzero(again)
        kept = np.where(space, np.uint8(32), part)
        if len(gone):
            kept = kept[~again]
        out[size : size + len(kept)] = kept
        ends[at + 1 : to + 1] = size + own[1:] - np.searchsorted(gone, own[1:])
        size, at = size + len(kept), to
    made = pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(ends), pa.py_buffer(out[:size])])
    return pc.if_else(texts.is_valid(), made, pa.scalar(None, texts.type)) if texts.null_count else made


def collapsed(text: Column) -> Column:
    """``re.sub(r'\\s+', ' ', s)``, with Python's whitespace."""

    @F.arrow_udf("string")
    def collapse(texts: pa.Array) -> pa.Array:
        return collapse_runs(texts)

    return collapse(text)
