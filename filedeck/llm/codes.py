"""Whole Arrow batches of texts as one array of code points, for work on characters in NumPy."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@cache
def classes() -> np.ndarray:
    """For each code point: 1 letter, 2 decimal or other digit, 0 anything else."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))
        if c[0] in "LN":
            out[i] = 1 if c[0] == "L" else 2
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(texts: list[str | None], nfkc: bool, lower: bool = True) -> np.ndarray:
    """Code points of all texts, each followed by 0; nulls count as empty, a 0 within a text becomes a blank."""
    s = ["" if t is None else t.replace("\0", " ") for t in texts]
    if nfkc:  # one by one: a text that is in this form already is only looked at
        s = [unicodedata.normalize("NFKC", t) for t in s]
    s = "\0".join(s) + "\0"
    if lower:
        s = s.lower()
    return np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Parts of a batch whose texts hold about `most` characters together; a single longer text comes alone."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
