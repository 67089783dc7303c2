"""Near-duplicate texts by covering locality-sensitive hashing.

A text is the set of its distinct pairs of neighbouring words (or longer shingles). The set is
sketched by minimum hashes: PARTS blocks of seven positions, two texts agreeing at a position with
the probability of their Jaccard similarity. In each block the seven positions are numbered by the
non-zero vectors p of {0,1}^3 and the seven masks are the non-zero vectors v of {0,1}^3: mask v keeps
the four positions with odd <p, v>. Any two differing positions leave at least one mask untouched,
so two sketches that differ in at most 3 * PARTS - 1 positions collide under some mask: some block
holds at most two of the differences. Collisions whose one-bit minimum hashes agree well enough, the same check for
buckets of every size, are candidates; each is then judged exactly.

Texts are cut into shingles once; sketches, keys and flags are made from the kept sets. Texts with the same set form one
class and enter once, so copies never meet in a bucket. A bucket above BUCKET classes (a shared template, say) is
not compared pair by pair: its classes get a second covering with minimum hashes of their own, under which only
similar ones meet again. What is above BUCKET in that one too is split into blocks and all pairs of blocks are compared, each
pair in its own group, so nothing is dropped.

Nulls, empty texts and texts with fewer than `least` shingles take no part. Ties do not arise:
every pair is judged by itself. Further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filedeck.llm.codes import classes as letter_classes
from filedeck.llm.codes import joined, mix, slices
from filedeck.operators.skew import salted_join
from filedeck.session import cut

#: Sketch blocks; with 10 a pair of similarity 0.6 is missed with a probability of about 0.002.
PARTS = 10
#: Texts in one bucket that are compared in one go.
BUCKET = 256
POINTS = np.arange(1, 8)
#: MASKS[v - 1]: the four positions of a block that mask v keeps.
MASKS = np.array([[p - 1 for p in POINTS if bin(p & v).count("1") % 2] for v in POINTS])
FLAGS = 64
NO_ID = -(2**63)
#: Bytes kept of a shingle's hash where two sets are compared.
KEPT = 5
#: Characters that one task turns into sets at once.
AT_ONCE = 4_000_000


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order. Words are runs of letters or digits of the lower-cased
    text, read after deleting every comma between two ASCII digits."""
    c = joined(texts, nfkc=False)
    digit = (c >= 48) & (c <= 57)
    comma = c == 44
    comma[1:] &= digit[:-1]
    comma[:-1] &= digit[1:]
    c = c[~comma]
    kind = letter_classes()[c] > 0
    edge = np.diff(kind.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last code is 0, so every word ends
    text = np.cumsum(c == 0)[starts]
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        size, at, left = ends - starts, starts.copy(), np.arange(len(starts))
        k = 0
        while len(left):  # one step for each character of the longest word still open
            h[left] = mix(h[left] * np.uint64(0x9E3779B97F4A7C15) + c[at[left] + k])
            k += 1
            left = left[size[left] > k]
    return text, h


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct and sorted by text and hash."""
    text, h = _word_hashes(texts)
    n = max(0, len(h) - size + 1)
    run = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    same = text[:n] == text[len(text) - n :] if n else np.zeros(0, bool)
    text, run = text[:n][same], run[same]
    order = np.lexsort((run, text))
    text, run = text[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    return text[new], run[new]


def _sets_of(batch: pa.RecordBatch, size: int, least: int):
    """(row of the batch, class hash, flat hashes, starts, sizes) of the texts with enough shingles."""
    text, flat = shingle_sets(batch.column("text").to_pylist(), size)
    n = np.bincount(text, minlength=batch.num_rows)
    rows = np.flatnonzero(n >= least)
    flat = flat[np.isin(text, rows)] if len(rows) < (n > 0).sum() else flat
    size_of = n[rows]
    starts = np.r_[0, np.cumsum(size_of)[:-1]].astype(np.int64)
    if not len(rows):
        return rows, None, flat, starts, size_of
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts) + size_of.astype(np.uint64))
    return rows, h.view(np.int64), flat, starts, size_of


def _seeds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def sketch(flat: np.ndarray, starts: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Minimum hashes [texts, 7 * parts]; flat: all sets one after the other, starts: where each begins."""
    flat = mix(flat)
    out = np.empty((len(starts), 7 * parts), np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(_seeds(7 * parts, seed), _seeds(7 * parts, seed + 1))):
            h = (flat ^ b) * a
            out[:, i] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
    return out


def keys_of(sketches: np.ndarray, parts: int) -> np.ndarray:
    """Bucket keys [texts, 7 * parts], one for each mask of each block."""
    out = np.empty_like(sketches)
    with np.errstate(over="ignore"):
        for part in range(parts):
            block = mix(sketches[:, 7 * part : 7 * part + 7])
            for v, mask in enumerate(MASKS):
                h = np.full(len(sketches), 7 * part + v + 1, np.uint64)
                for p in mask:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + block[:, p])
                out[:, 7 * part + v] = h
    return out


def flags_of(flat: np.ndarray, starts: np.ndarray, seed: int = 91) -> np.ndarray:
    """64 one-bit minimum hashes of each text as one number: bits of similar texts mostly agree."""
    flat = mix(flat)
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(_seeds(FLAGS, seed), _seeds(FLAGS, seed + 1))):
            h = (flat ^ b) * a
            out |= (mix(np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)) & np.uint64(1)) << np.uint64(i)
    return out


def _shingled(size: int, least: int):
    """(id, class, n, s) of each text that takes part; s, its hashes packed to KEPT bytes each, once for each class in a batch."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", AT_ONCE):
                rows, h, flat, starts, n = _sets_of(batch, size, least)
                if not len(rows):
                    continue
                _, first = np.unique(h, return_index=True)
                own = np.zeros(len(rows), bool)
                own[first] = True
                data = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[np.repeat(own, n), :KEPT]).tobytes()
                offsets = (np.r_[0, np.cumsum(np.where(own, n, 0))] * KEPT).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [pa.array(own).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(h), pa.array(n.astype(np.int32)), packed], ["id", "class", "n", "s"])

    return run


def _emit(parts: int, seed: int):
    """(class, s) -> a row (key, id, flags) for each mask of each class."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                flat, n = _unpack(batch.column("s"))
                starts = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
                keys, flags = keys_of(sketch(flat, starts, parts, seed), parts), flags_of(flat, starts).view(np.int64)
                name, m = batch.column("class").to_numpy(zero_copy_only=False), keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(name, m)), pa.array(np.repeat(flags, m))], ["key", "id", "flags"])

    return run


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat hashes, sizes) of a column of packed sets."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // KEPT
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEPT)
    flat = np.zeros((len(raw), 8), np.uint8)
    flat[:, :KEPT] = raw
    return flat.view(np.uint64).ravel(), sizes


def _judge(threshold: float):
    """Rows (id_a, id_b, s_a, s_b) become (id_a, id_b, similarity) where it reaches the threshold."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                (x, nx), (y, ny) = _unpack(batch.column("s_a")), _unpack(batch.column("s_b"))
                pair = np.r_[np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)]
                h = np.r_[x, y]
                order = np.lexsort((h, pair))
                h, pair = h[order], pair[order]
                twice = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
                both = np.bincount(pair[1:][twice], minlength=len(nx))
                j = both / (nx + ny - both)
                fine = pa.array(np.flatnonzero(j >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column("id_a").take(fine), batch.column("id_b").take(fine), pa.array(j[j >= threshold])], ["id_a", "id_b", "similarity"])

    return run


def _unlike(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) > limit


def _pairs(limit: int, bucket: int):
    """Runs of equal keys in sorted batches become pairs; a run above `bucket` leaves its rows with b null."""

    def hot(ids, key, flags):
        return ids, np.full(len(ids), NO_ID), key, flags

    def of(key, ids, flags, hot_key):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        large = (size > bucket) | (key[edge[:-1]] == hot_key if hot_key is not None else False)
        out = []
        for n in np.unique(size[(size > 1) & ~large]):
            at = edge[:-1][(size == n) & ~large]
            i, j = np.triu_indices(n, 1)
            step = max(1, 2_000_000 // len(i))
            for s in range(0, len(at), step):
                x, y = (at[s : s + step, None] + i).ravel(), (at[s : s + step, None] + j).ravel()
                fine = (ids[x] != ids[y]) & ~_unlike(flags[x], flags[y], limit)
                x, y = ids[x[fine]], ids[y[fine]]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                none = np.zeros(len(both), np.int64)
                out.append((both[:, 0], both[:, 1], none, none))
        out += [hot(ids[at : at + n], key[at : at + n], flags[at : at + n]) for at, n in zip(edge[:-1][large], size[large])]
        return _batch(*map(np.concatenate, zip(*out))) if out else None

    def run(batches):
        rest = hot_key = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "flags")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            last = np.searchsorted(now[0], now[0][-1])  # the last run may go on in the next batch
            if last and (out := of(*(x[:last] for x in now), hot_key)):
                yield out
            rest = [x[last:] for x in now]
            if len(rest[0]) > 50_000:  # a hot run: its rows go out as they come
                key, ids, flags = rest
                yield _batch(*hot(ids[:-1], key[:-1], flags[:-1]))
                rest, hot_key = [x[-1:] for x in rest], key[-1]
        if rest is not None and len(rest[0]) and (out := of(*rest, hot_key)):
            yield out

    return run


def _batch(a, b, key, flags) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b == NO_ID), pa.array(key, pa.int64()), pa.array(flags, pa.int64())], ["id_a", "id_b", "key", "flags"])


def _met(sets: DataFrame, parts: int, seed: int, limit: int, bucket: int) -> DataFrame:
    """(id_a, id_b, key, flags): pairs that meet in a bucket; rows of buckets above `bucket` with id_b null."""
    keyed = sets.mapInArrow(_emit(parts, seed), "key bigint, id bigint, flags bigint")
    ordered = keyed.repartition("key").sortWithinPartitions("key")
    return cut(ordered.mapInArrow(_pairs(limit, bucket), "id_a bigint, id_b bigint, key bigint, flags bigint").distinct())


def _blocks(hot: DataFrame, bucket: int, limit: int) -> DataFrame:
    """The pairs of rows (key, id, flags) of large buckets that the one-bit check lets through, by blocks: each pair of blocks is a group of its own."""
    sized = hot.join(hot.groupBy("key").agg(F.ceil(F.count("*") / bucket).cast("int").alias("n")), "key")
    own = sized.withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("n")).cast("int"))
    spread = own.select("key", "id", "flags", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    at = spread.select("key", "id", "flags", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    left = at.filter("own = x").select("key", "x", "y", F.col("id").alias("l"), F.col("flags").alias("f"))
    right = at.filter("own = y").select("key", "x", "y", F.col("id").alias("r"), F.col("flags").alias("g"))
    alike = (F.col("l") != F.col("r")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= limit)
    met = left.join(right, ["key", "x", "y"]).filter(alike)
    return met.select(F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b"))


def similar_pairs(texts: DataFrame, threshold: float = 0.8, least: int = 1, size: int = 5, parts: int = PARTS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """texts (id bigint unique, text) -> (pairs of classes (id_a, id_b, similarity), members (id, class, n)).

    A class holds the texts with the very same shingle set; it is named by a 64-bit hash of the set.
    Similarity is Jaccard over `size`-word shingles (their hashes, KEPT bytes long), taken for every candidate.
    Texts with fewer than `least` shingles, nulls and blanks are in neither table."""
    texts = texts.select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    shingled = cut(texts.mapInArrow(_shingled(size, max(least, 1)), "id bigint, class bigint, n int, s binary"))
    sets = shingled.filter("s is not null").select("class", "s").dropDuplicates(["class"])
    # One-bit hashes differ with probability (1 - j) / 2: four deviations beyond the mean of a pair at the threshold.
    p = (1 - threshold) / 2
    limit = int(np.ceil(FLAGS * p + 3.6 * np.sqrt(FLAGS * p * (1 - p))))
    met = _met(shingled.filter("s is not null").select("class", "s"), parts, 7, limit, bucket)
    candidates = met.filter("id_b is not null").select("id_a", "id_b")
    hot = met.filter("id_b is null")
    if not hot.isEmpty():
        again = _met(sets.join(hot.select(F.col("id_a").alias("class")).distinct(), "class", "left_semi"), parts, 1007, limit, bucket)
        rest = again.filter("id_b is null").select("key", F.col("id_a").alias("id"), "flags")
        candidates = candidates.unionByName(again.filter("id_b is not null").select("id_a", "id_b")).unionByName(_blocks(rest, bucket, limit))
    candidates = candidates.distinct()
    left = sets.select(F.col("class").alias("id_a"), F.col("s").alias("s_a"))
    right = sets.select(F.col("class").alias("id_b"), F.col("s").alias("s_b"))
    near = candidates.join(left, "id_a").join(right, "id_b").filter(F.least(F.length("s_a"), F.length("s_b")) >= threshold * F.greatest(F.length("s_a"), F.length("s_b")))
    return near.select("id_a", "id_b", "s_a", "s_b").mapInArrow(_judge(threshold), "id_a bigint, id_b bigint, similarity double"), shingled.select("id", "class", "n")


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of ids from pairs of classes, and the pairs within each class of copies; a class of many copies over many tasks."""
    left = members.select(F.col("class").alias("id_a"), F.col("id").alias("a"))
    right = members.select(F.col("class").alias("id_b"), F.col("id").alias("b"))
    half = salted_join(left, pairs.select("id_a", "id_b"), ["id_a"]).select("a", "id_b")
    across = salted_join(right, half, ["id_b"]).select("a", "b")
    several = members.groupBy("class").count().filter("count > 1").select("class")
    copies = members.join(several, "class", "left_semi")
    within = salted_join(copies.select("class", F.col("id").alias("a")), copies.select("class", F.col("id").alias("b")), ["class"]).filter("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each text that takes part: id, its class (smallest id with the same set), copies in
    the class, and links to other texts, without expanding copies into pairs."""
    sizes = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    both = pairs.select(F.col("id_a").alias("class"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("class"), F.col("id_a").alias("other")))
    linked = both.join(sizes.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("others"))
    rows = salted_join(members, sizes.join(linked, "class", "left"), ["class"])
    return rows.select("id", "class_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
