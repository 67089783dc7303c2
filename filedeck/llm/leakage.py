"""Evaluation passages in training documents, by suffix arrays.

Texts are read as their letters and digits only (NFKC, lower case). The documents are cut into
shards; each shard gets a sorted array of suffixes, and every suffix of every passage is
binary-searched in it. The arrays are sparse: with a shortest reported match of `shortest`
characters, a suffix is kept at every STRIDE-th character of a document, because any match that
long holds a kept position within its first STRIDE characters and at least shortest - STRIDE + 1
characters after it. Suffixes are compared on that many characters, then each hit is extended in
both directions to its full length on the real characters, so nothing is missed and nothing is
reported that does not match.

The passages are written once to the shared checkpoint folder, by Spark's tasks; none goes through the driver. There is one pass
over the documents: each task makes the suffix array of a shard once and streams the passages past it in blocks of at most
BLOCK characters. Hits are followed AT_ONCE at a time and reduced to the best of each document and passage, so a run of characters
that many passages and documents share costs time but no memory. Nulls and texts shorter than `shortest` match nothing; equal
passages report each of their ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filedeck.llm.codes import classes, joined, slices
from filedeck.session import checkpoint_folder, cut

STRIDE = 16
#: Characters of passages that are searched for at once.
BLOCK = 4_000_000
#: Hits followed at once.
AT_ONCE = 1_000_000
#: Characters of documents in one suffix array.
SHARD = 8_000_000


def characters(texts: list[str | None]) -> np.ndarray:
    """Letters and digits of the texts, each text ended by 0."""
    c = joined(texts, nfkc=True)
    return c[(classes()[c] > 0) | (c == 0)]


def _keys(c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n characters from each place as bytes in sorting order (two a character; others than the
    first 65,536 fold onto them, which the later comparison of real characters settles)."""
    low = (c & 0xFFFF).astype(">u2")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(low, n)[at]).view(f"S{2 * n}").ravel()


def _text_of(c: np.ndarray) -> np.ndarray:
    """The number of the text that each character belongs to."""
    return np.cumsum(np.r_[0, c[:-1] == 0])


def _places(c: np.ndarray, n: int, stride: int) -> np.ndarray:
    """Places at every stride-th character of a text with n characters of that text from there on."""
    ends = np.flatnonzero(c == 0)
    starts = np.r_[0, ends[:-1] + 1]
    counts = np.maximum(0, (ends - starts - n) // stride + 1)
    first = np.repeat(starts, counts)
    return first + stride * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))


def _extend(c: np.ndarray, p: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many characters further (step 1) or back (step -1) c from x and p from y agree within their texts."""
    n, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(open_):
        i, j = x[open_] + step * (n[open_] + (step < 0)), y[open_] + step * (n[open_] + (step < 0))
        fine = (i >= 0) & (j >= 0) & (i < len(c)) & (j < len(p))
        fine[fine] = (c[i[fine]] == p[j[fine]]) & (c[i[fine]] != 0)
        open_ = open_[fine]
        n[open_] += 1
    return n


def _best(found: list[np.ndarray]) -> list[np.ndarray]:
    """Of matches (text, passage, length, x, y) the longest of each text and passage, the first of equals."""
    text, passage, length, x, y = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((y, x, -length, passage, text))
    text, passage, length, x, y = (v[order] for v in (text, passage, length, x, y))
    first = np.r_[True, (text[1:] != text[:-1]) | (passage[1:] != passage[:-1])] if len(text) else np.zeros(0, bool)
    return [v[first] for v in (text, passage, length, x, y)]


class Block:
    """Passages whose suffixes are ready to be searched for, in sorted order so that neighbouring searches touch neighbouring suffixes."""

    def __init__(self, ids: np.ndarray, texts: list[str], n: int):
        self.ids, self.c = ids, characters(texts)
        self.text, self.starts = _text_of(self.c), np.r_[0, np.flatnonzero(self.c == 0) + 1]
        at = _places(self.c, n, 1)
        keys = _keys(self.c, at, n) if len(at) else np.zeros(0, f"S{2 * n}")
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]


class Shard:
    """Documents and the sorted array of their sparse suffixes."""

    def __init__(self, texts: list[str | None], n: int, stride: int):
        self.c = characters(texts)
        self.text, self.starts = _text_of(self.c), np.r_[0, np.flatnonzero(self.c == 0) + 1]
        at = _places(self.c, n, stride)
        keys = _keys(self.c, at, n) if len(at) else np.zeros(0, f"S{2 * n}")
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def matches(self, block: Block, shortest: int, at_once: int = AT_ONCE) -> list[np.ndarray]:
        """[text, passage, length, place in text, place in passage] of the longest match of each pair."""
        best = [np.zeros(0, np.int64)] * 5
        low, high = np.searchsorted(self.keys, block.keys, "left"), np.searchsorted(self.keys, block.keys, "right")
        hits = np.flatnonzero(high > low)
        low, counts, own = low[hits], (high - low)[hits], block.at[hits]
        ends = np.cumsum(counts)
        a = 0
        while a < len(hits):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once, "right")))
            n = counts[a:b]
            y = np.repeat(own[a:b], n)
            x = self.at[np.repeat(low[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            back = _extend(self.c, block.c, x, y, -1)
            x, y = np.unique(np.stack([x - back, y - back], 1), axis=0).T
            length = _extend(self.c, block.c, x, y, 1)
            keep = length >= shortest
            x, y, length = x[keep], y[keep], length[keep]
            text, passage = self.text[x], block.text[y]
            best = _best([best, [text, passage, length, x - self.starts[text], y - block.starts[passage]]])
            a = b
        return best


def _blocks(files: list[str], n: int, most: int):
    """The passages in the files, block after block."""
    ids, texts, size = [], [], 0
    for uri in files:
        system, path = pa.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1024, columns=["id", "passage"]):
                for i, text in zip(batch.column("id").to_pylist(), batch.column("passage").to_pylist()):
                    if ids and size + len(text) > most:
                        yield Block(np.array(ids, np.int64), texts, n)
                        ids, texts, size = [], [], 0
                    ids.append(i), texts.append(text)
                    size += len(text)
    if ids:
        yield Block(np.array(ids, np.int64), texts, n)


def _search(files: list[str], shortest: int, stride: int, most: int):
    def run(batches):
        n = shortest - stride + 1
        kept = None  # a single block stays ready from shard to shard
        for whole in batches:
            for batch in slices(whole, "text", SHARD):
                shard, seen = Shard(batch.column("text").to_pylist(), n, stride), 0
                for block in [kept] if kept else _blocks(files, n, most):
                    text, passage, length, x, y = shard.matches(block, shortest)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(text)), pa.array(block.ids[passage]), *(pa.array(v) for v in (length, x, y))], ["doc_id", "item_id", "length", "doc_at", "item_at"])
                    seen += 1
                if seen == 1:
                    kept = block

    return run


def leaks(documents: DataFrame, items: DataFrame, shortest: int = 60, stride: int = STRIDE, block: int = BLOCK) -> DataFrame:
    """documents (id bigint, text), items (id bigint, passage) -> (doc_id, item_id, length, doc_at, item_at).

    One row for each document and item with at least `shortest` letters or digits in a row in common:
    the longest such match (the first of equals) and where it begins, counted in letters and digits."""
    spark, stride = documents.sparkSession, min(stride, shortest)
    texts = documents.select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/leakage-{uuid.uuid4().hex}"
    items.filter("passage is not null").select(F.col("id").cast("bigint").alias("id"), F.col("passage").cast("string").alias("passage")).write.parquet(folder)
    try:
        files = sorted(spark.read.schema("id bigint, passage string").parquet(folder).inputFiles())
        return cut(texts.mapInArrow(_search(files, shortest, stride, block), "doc_id bigint, item_id bigint, length bigint, doc_at bigint, item_at bigint"))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without_leaks(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no passage, with all their columns."""
    return documents.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
