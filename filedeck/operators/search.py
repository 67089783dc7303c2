"""Batches of queries against a corpus: dense, sparse and word search, fusion and re-ranking.

Every candidate list is (query_id, id, score, rank): scores rounded to six places, ties to the smaller
id, ranks from 1. A filter value that is null or '' means no filter."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filedeck.functions.text import PARTICLES, TOKEN, strip_particle, terms, tokens
from filedeck.functions.vectors import cosine, usable
from filedeck.session import cut

RRF_K = 60
DENSE_WEIGHT, SPARSE_WEIGHT = 0.7, 0.3
POOL, TOP, CANDIDATES = 20, 5, 100
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of the corpus and queries in one block of the dense search, and queries multiplied at once.
ROWS, QUERIES, DENSE_AT_ONCE = 4096, 2048, 512
#: Rows of the corpus and queries in one block of the sparse search, and queries scored at once.
SPARSE_ROWS, SPARSE_QUERIES, AT_ONCE = 4096, 4096, 256
#: Queries whose lists one task holds: k places of two numbers each, and as many that wait to be merged.
TOGETHER = 32_768
#: Weights of at least this much have products above 0.
LEAST = 1e-150


def ranked(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query; each task cuts its own rows to k before the shuffle."""
    s = scored.withColumn("score", F.round("score", 6))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Best:
    """The k best rows so far of each query of a block, in the order of ranked(); it grows no further, however many rows come."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        #: The score a row needs at least to be added.
        self.least = np.full(len(query_ids), -np.inf)
        self.kept, self.waiting, self.n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], [], 0

    def floor(self, scores: np.ndarray, at: slice, common: np.ndarray | None = None) -> np.ndarray:
        """The score before rounding from which a row of `scores` (a row for each query of `at`) may be among the k best; common: the rows that count."""
        low, over = self.least[at].copy(), scores.shape[1] - self.k
        if over > 0 and (new := np.isneginf(low)).any():
            if common is not None:
                new[new] = common[new].sum(1) > self.k
            part = scores[new] if common is None else np.where(common[new], scores[new], -np.inf)
            low[new] = np.partition(part, over, axis=1)[:, over]
        return low - 1e-6

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.waiting.append((q, ids, scores))
        self.n += len(q)
        if self.n > self.k * len(self.query_ids):
            self.merge()

    def merge(self) -> None:
        q, ids, scores = (np.concatenate(x) for x in zip(*self.kept, *self.waiting))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        fine = place < self.k
        self.least[q[place == self.k - 1]] = scores[place == self.k - 1]
        self.kept, self.waiting, self.n = [(q[fine], ids[fine], scores[fine])], [], 0

    def rows(self):
        """(query_id, id, score) in batches; a score of -inf is none."""
        self.merge()
        q, ids, scores = self.kept[0]
        for at in range(0, len(q), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.query_ids[q[part]]), pa.array(ids[part]), pa.array(scores[part], mask=np.isneginf(scores[part]))], ["query_id", "id", "score"])


def _meet(queries: DataFrame, corpus: DataFrame, pack, rows: int, query_rows: int, compare) -> DataFrame:
    """(query_id, id, score): the k best rows of each query in each part of the corpus. Queries (id, ...) and corpus (id, ...) are packed into
    blocks and every block meets every other; a task holds the lists of its queries, so that is all it hands on.
    The corpus is read once for each TOGETHER queries."""
    spark = corpus.sparkSession
    groups = -(-queries.count() // TOGETHER) or 1
    (schema, run), (_, run_queries) = pack(rows), pack(query_rows)
    right = queries.repartition(groups).mapInArrow(run_queries, schema)
    left = corpus.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, schema)
    # by hint: the join must not be turned round, a task's queries meet its part of the corpus block by block
    met = left.select(F.struct("*").alias("c")).hint("shuffle_replicate_nl").crossJoin(right.select(F.struct("*").alias("q")))
    return met.mapInArrow(compare, "query_id bigint, id bigint, score double")


def _each(batches, k: int, score):
    """The lists of a task's queries; score(query block, corpus block, best) adds to them. A block of queries is made ready once."""
    best: dict[bytes, tuple] = {}
    for batch in batches:
        for n in range(batch.num_rows):
            c, q = batch.column("c")[n].as_py(), batch.column("q")[n].as_py()
            if q["ids"] not in best:
                best[q["ids"]] = ({}, Best(np.frombuffer(q["ids"], np.int64), k))
            score(q, c, *best[q["ids"]])
    for _, b in best.values():
        yield from b.rows()
    best.clear()
    pa.default_memory_pool().release_unused()  # the worker stays for later tasks


# Dense


def _blocks(rows: int):
    """Blocks of vectors as delivered: floats stay four bytes long on their way to every other block."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                v = b.column("v").flatten().to_numpy(zero_copy_only=False)
                v = v if v.dtype == np.float32 else v.astype(np.float64)
                ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([v.tobytes()]), pa.array([v.dtype.str])], ["ids", "v", "kind"])

    return "ids binary, v binary, kind string", run


def _unit(block: dict) -> np.ndarray:
    """The vectors of a block at unit length."""
    v = np.frombuffer(block["v"], block["kind"]).astype(np.float64).reshape(len(block["ids"]) // 8, -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _compare(k: int):
    def run(batches):
        last = {}  # a block of the corpus meets the blocks of queries one after the other

        def score(q, c, made, best):
            if not made:
                made["v"] = _unit(q)
            if last.get("ids") != c["ids"]:
                last.update(ids=c["ids"], v=_unit(c))
            ids = np.frombuffer(c["ids"], np.int64)
            for at in range(0, len(best.query_ids), DENSE_AT_ONCE):
                queries = slice(at, min(at + DENSE_AT_ONCE, len(best.query_ids)))
                s = made["v"][queries] @ last["v"].T
                i, j = np.nonzero(s >= best.floor(s, queries)[:, None])
                best.add(i + at, ids[j], np.round(s[i, j], 6))

        yield from _each(batches, k, score)

    return run


def dense(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """queries (query_id bigint unique, embedding), corpus (id bigint unique, embedding) -> exact cosine top k.

    Both sides meet in blocks of vectors, each pair of blocks one matrix product; a task hands on k rows
    a query. Null and all-zero vectors take no part; all vectors must have one length."""
    ready = lambda df, key: df.filter(usable(F.col("embedding"))).select(F.col(key).cast("bigint").alias("id"), F.col("embedding").alias("v"))
    return ranked(_meet(ready(queries, "query_id"), ready(corpus, "id"), _blocks, ROWS, QUERIES, _compare(k)), k)


def split_queries(queries: DataFrame, by: str) -> tuple[DataFrame, DataFrame | None]:
    """(queries with a filter value, those without one or None): null and '' mean no filter. Looks at the queries only."""
    free = F.coalesce(F.col(by).cast("string"), F.lit("")) == ""
    without = queries.filter(free)
    return queries.filter(~free), None if without.isEmpty() else without


def dense_filtered(queries: DataFrame, corpus: DataFrame, by: str, k: int = CANDIDATES) -> DataFrame:
    """As dense, among the corpus rows with the query's value of `by`; the filter comes before the cut. Queries
    without a value meet the whole corpus in blocks."""
    some, free = split_queries(queries, by)
    found = ranked(_within(some, corpus, by), k)
    return found.unionByName(dense(free, corpus, k)) if free is not None else found


def _within(queries: DataFrame, corpus: DataFrame, by: str) -> DataFrame:
    q = queries.filter(usable(F.col("embedding"))).select("query_id", by, F.col("embedding").alias("q"))
    c = corpus.filter(usable(F.col("embedding"))).select("id", by, F.col("embedding").alias("v"))
    return q.join(c, by).select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score"))


# Sparse


def postings(corpus: DataFrame, *keep: str) -> DataFrame:
    """corpus (id, sparse map) -> (token, id, weight, ...); rows stay rows, no list of a token is gathered."""
    return corpus.filter("sparse is not null").select("id", *keep, F.explode("sparse").alias("token", "weight"))


def rounded(scores: np.ndarray) -> np.ndarray:
    """Six places, halves of the shortest decimal form away from zero, as ranked() rounds."""
    x = np.abs(scores) * 1e6
    out = np.where(x < 2**52, np.copysign(np.floor(x + 0.5) / 1e6, scores), scores)
    for i in np.flatnonzero((np.abs(x - np.floor(x) - 0.5) < 1e-3) & (x < 2**52)):
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _posting_blocks(rows: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                tokens, weights = b.column("tokens"), b.column("weights").flatten()
                of = np.repeat(np.arange(b.num_rows, dtype=np.int32), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                chars = pa.concat_arrays([tokens.flatten().cast(pa.string())])
                ends = np.cumsum(pc.binary_length(chars).to_numpy(zero_copy_only=False), dtype=np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays([0, len(chars)], chars), "")[0].as_buffer().to_pybytes() if len(chars) else b""
                w = weights.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is nan
                parts = [b.column("id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), of.tobytes(), np.r_[np.int32(0), ends].astype(np.int32).tobytes(), text, w.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["ids", "of", "ends", "chars", "weights"])

    return "ids binary, of binary, ends binary, chars binary, weights binary", run


def _tokens(block: dict) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(block["ends"]) // 4 - 1, pa.py_buffer(block["ends"]), pa.py_buffer(block["chars"]))


def _multiply(k: int):
    def ready(q: dict, n: int) -> dict:
        """Postings of the queries by slice and token, and where those of each token begin in each slice."""
        coded = _tokens(q).dictionary_encode()
        code, of, weight = coded.indices.to_numpy(zero_copy_only=False), np.frombuffer(q["of"], np.int32), np.frombuffer(q["weights"])
        kinds = len(coded.dictionary)
        key = of // AT_ONCE * np.int64(kinds) + code
        order = np.argsort(key, kind="stable")
        slices = -(-n // AT_ONCE)
        return {"names": coded.dictionary, "of": of[order] % AT_ONCE, "weight": weight[order], "first": np.searchsorted(key[order], np.arange(slices * kinds + 1)), "kinds": kinds, "slices": slices}

    def score(q, c, made, best):
        if not made:
            made |= ready(q, len(best.query_ids))
        ids, kinds = np.frombuffer(c["ids"], np.int64), made["kinds"]
        code = pc.index_in(_tokens(c), value_set=made["names"])
        have = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        code = code.take(pa.array(have)).to_numpy(zero_copy_only=False).astype(np.int64)
        of, weight = np.frombuffer(c["of"], np.int32)[have].astype(np.int64), np.frombuffer(c["weights"])[have]
        for x in range(made["slices"]):
            a = made["first"][x * kinds + code]
            n = made["first"][x * kinds + code + 1] - a
            at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            products = np.repeat(weight, n) * made["weight"][at]
            cell = made["of"][at] * np.int64(len(ids)) + np.repeat(of, n)
            queries = slice(x * AT_ONCE, min((x + 1) * AT_ONCE, len(best.query_ids)))
            shape = (queries.stop - queries.start, len(ids))
            if len(products) and not products.min() >= LEAST:  # products of no worth: rows with a common token are told by counts
                worth = ~np.isnan(products)
                s = np.bincount(cell, np.where(worth, products, 0.0), shape[0] * shape[1])
                s[np.bincount(cell[worth], minlength=len(s)) == 0] = -np.inf
                common = np.bincount(cell, minlength=len(s)).reshape(shape) > 0
                s = s.reshape(shape)
            else:
                s = np.bincount(cell, products, shape[0] * shape[1]).reshape(shape)
                common = s > 0
            low = best.floor(s, queries, common)
            i, j = np.nonzero(common & (s >= low[:, None]))
            best.add(i + queries.start, ids[j], rounded(s[i, j]))

    return lambda batches: _each(batches, k, score)


def sparse(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, by: str | None = None) -> DataFrame:
    """queries (query_id bigint unique, sparse map), corpus (id bigint unique, sparse map) -> top k by the inner product of token weights.

    Only rows with a token in common appear; a null weight adds nothing. Both sides meet in blocks, as in dense: products
    are added up within a block and a task hands on k rows a query.
    With `by`, postings of another value are left out before scoring, but for queries without a value."""
    if by is None:
        ready = lambda df, key: df.filter("sparse is not null").select(F.col(key).cast("bigint").alias("id"), F.map_keys("sparse").alias("tokens"), F.map_values("sparse").alias("weights"))
        return ranked(_meet(ready(queries, "query_id"), ready(corpus, "id"), _posting_blocks, SPARSE_ROWS, SPARSE_QUERIES, _multiply(k)), k)
    some, free = split_queries(queries, by)
    found = ranked(_products(some, corpus, by), k)
    return found.unionByName(sparse(free, corpus, k)) if free is not None else found


def _products(queries: DataFrame, corpus: DataFrame, *keep: str) -> DataFrame:
    """Products are added up in the order of the row's own tokens, as in blocks: a sum hangs on its order where it ends in a half."""
    q = postings(queries.withColumnRenamed("query_id", "id"), *keep).select(*keep, "token", F.col("id").alias("query_id"), F.col("weight").alias("q"))
    c = corpus.filter("sparse is not null").select("id", *keep, F.posexplode("sparse").alias("place", "token", "weight"))
    met = q.join(c, ["token", *keep]).select("query_id", "id", F.struct("place", (F.col("q") * F.col("weight")).alias("product")).alias("part"))
    parts = met.groupBy("query_id", "id").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # no more of them than the row has tokens
    worth = F.filter(F.col("parts.product"), lambda x: x.isNotNull())
    return parts.select("query_id", "id", F.when(F.size(worth) > 0, F.aggregate(worth, F.lit(0.0), lambda s, x: s + x)).alias("score"))


# Words


def split_texts(texts: DataFrame, *keep: str) -> DataFrame:
    """texts (id, text) -> (id, t): the tokens of each text without their particles; a null text has none."""
    return texts.select("id", *keep, terms(F.coalesce("text", F.lit(""))).alias("t"))


def token_rows(split: DataFrame, *keep: str) -> DataFrame:
    """(id, len, token) of split texts: a row for each token; len counts the text's tokens."""
    # explode_outer: for explode Spark would split every text twice, first to drop those without a token
    return split.select("id", *keep, F.size("t").alias("len"), F.explode_outer("t").alias("token")).filter("token is not null")


def corpus_size(split: DataFrame) -> DataFrame:
    """One row: n_docs and their average length in tokens."""
    return split.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avg_len"))


def document_frequency(split: DataFrame) -> DataFrame:
    """(token, df), counted before the shuffle as far as each task goes: a text's repeats fall out in its row."""
    once = split.select(F.explode_outer(F.array_distinct("t")).alias("token"))
    return once.filter("token is not null").groupBy("token").agg(F.count("*").alias("df"))


def idf(split: DataFrame) -> DataFrame:
    """(token, idf): ln(N - df + 0.5) - ln(df + 0.5); below zero a quarter of the mean over the vocabulary."""
    raw = document_frequency(split).crossJoin(F.broadcast(corpus_size(split)))  # one row
    raw = raw.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, texts: DataFrame, k: int = CANDIDATES, by: str | None = None) -> DataFrame:
    """queries (query_id, text[, by]), texts (id, text[, by]) -> Okapi top k.

    Repeated query tokens count each time. Statistics are of all texts, also with a filter; a query without a filter value
    meets all texts. Rows without any query token score 0 and fill the list up to k, smallest ids first. Texts are
    split into tokens once."""
    keep = [by] if by else []
    split = cut(split_texts(texts, *keep))
    q = token_rows(split_texts(queries.withColumnRenamed("query_id", "id"), *keep), *keep).groupBy("id", *keep, "token").agg(F.count("*").alias("times"))
    asked = q.select("token").distinct()
    tf = token_rows(split, *keep).join(asked, "token", "left_semi").groupBy("id", *keep, "len", "token").agg(F.count("*").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighted = tf.join(idf(split).join(asked, "token", "left_semi"), "token").crossJoin(F.broadcast(corpus_size(split))).select("id", *keep, "token", weight.alias("w"))  # one row
    some, free = split_queries(queries, by) if by else (None, queries)
    scored = []
    if by:
        mine = q.filter(F.coalesce(F.col(by), F.lit("")) != "").withColumnRenamed("id", "query_id")
        scored += [_weights(mine.join(weighted, ["token", by])), _fill(some, texts, k, by)]
    if free is not None:
        mine = (q.filter(F.coalesce(F.col(by), F.lit("")) == "").drop(by) if by else q).withColumnRenamed("id", "query_id")
        scored += [_weights(mine.join(weighted.drop(*keep), "token")), _fill(free, texts, k, None)]
    both = reduce(DataFrame.unionByName, scored).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return ranked(both, k)


def _weights(met: DataFrame) -> DataFrame:
    return met.groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("times")).alias("score"))


def _fill(queries: DataFrame, texts: DataFrame, k: int, by: str | None) -> DataFrame:
    """The k smallest ids as rows of score 0: more than the scored rows can push out of the list are never needed."""
    if by is None:
        few = texts.select("id").orderBy("id").limit(k)
        return queries.select("query_id").crossJoin(F.broadcast(few)).select("query_id", "id", F.lit(0.0).alias("score"))  # k rows
    few = texts.select(by, "id").withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("id"))).filter(F.col("n") <= k)
    return queries.select("query_id", by).join(few, by).select("query_id", "id", F.lit(0.0).alias("score"))


# Fusion


def rrf(lists: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over the lists that hold a row."""
    rows = _union(lists)
    return ranked(rows.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score")), k)


def _union(lists: list[DataFrame]) -> DataFrame:
    out = None
    for n, df in enumerate(lists):
        part = df.select("query_id", "id", "score", "rank", F.lit(n).alias("list"))
        out = part if out is None else out.unionByName(part)
    return out


def scaled(lists: list[DataFrame]) -> DataFrame:
    """(query_id, id, list, scaled): scores from 0 to 1 within each query's list; all 0 where the scores are equal."""
    w = Window.partitionBy("query_id", "list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return _union(lists).select("query_id", "id", "list", ((F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0)).alias("scaled"))


def weighted(lists: list[DataFrame], weights: list[float], k: int) -> DataFrame:
    """Weighted sum of scaled scores; a list that lacks a row adds 0, as its worst row does."""
    w = F.array(*(F.lit(float(x)) for x in weights))[F.col("list")]
    return ranked(scaled(lists).groupBy("query_id", "id").agg(F.sum(w * F.col("scaled")).alias("score")), k)


def sweep(first: DataFrame, second: DataFrame, weights: list[float], k: int) -> DataFrame:
    """weighted() for several weights of the first list, the second getting the rest; the lists are made once."""
    rows = scaled([first, second]).withColumn("w", F.explode(F.array(*(F.lit(float(w)) for w in weights))))
    part = F.when(F.col("list") == 0, F.col("w")).otherwise(1 - F.col("w")) * F.col("scaled")
    return ranked(rows.groupBy("w", "query_id", "id").agg(F.sum(part).alias("score")), k, ("w", "query_id")).withColumnRenamed("w", "weight")


def overlap(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(query_id, n_common) of two lists' first k rows, 0 included."""
    # one pass over both: each list is made once
    rows = _union([first, second]).filter(F.col("rank") <= k).groupBy("query_id", "id").agg((F.min("list") < F.max("list")).alias("both"))
    return rows.groupBy("query_id").agg(F.count_if("both").alias("n_common"))


def hybrid(dense_list: DataFrame, sparse_list: DataFrame, k: int = TOP) -> DataFrame:
    """Dense and sparse candidates fused 0.7 to 0.3."""
    return weighted([dense_list, sparse_list], [DENSE_WEIGHT, SPARSE_WEIGHT], k)


def hybrid_within(queries: DataFrame, corpus: DataFrame, by: str, k: int = TOP) -> DataFrame:
    """Fusion over all rows with the query's value of `by`, without a candidate cut: rows without a common token
    have a sparse score of 0, and scores are scaled over all of them. Rows without a usable vector take no part.
    Queries without a value are answered by hybrid() over the candidates of the whole corpus."""
    queries, free = split_queries(queries, by)
    both = _within(queries, corpus, by).select("query_id", "id", F.round("score", 6).alias("score"))
    q = postings(queries.withColumnRenamed("query_id", "id"), by).select(by, "token", F.col("id").alias("query_id"), F.col("weight").alias("q"))
    met = q.join(postings(corpus, by), ["token", by]).groupBy("query_id", "id").agg(F.round(F.sum(F.col("q") * F.col("weight")), 6).alias("s"))
    zero = both.join(met, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("s", F.lit(0.0)).alias("score"))
    found = weighted([x.withColumn("rank", F.lit(0)) for x in (both, zero)], [DENSE_WEIGHT, SPARSE_WEIGHT], k)
    return found.unionByName(hybrid(dense(free, corpus), sparse(free, corpus), k)) if free is not None else found


def fetch(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """The hits with their rows' columns: texts are read only for what was ranked."""
    return hits.join(rows, "id")


# Re-ranking


def overlap_score(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's distinct tokens that the text holds."""
    q = F.array_distinct(F.transform(tokens(question), strip_particle))
    return F.size(F.array_intersect(q, F.transform(tokens(text), strip_particle))) / F.greatest(F.size(q), F.lit(1))


def rerank(hits: DataFrame, score: Column, k: int = TOP) -> DataFrame:
    """hits (query_id, id, score, ...) in the order of another score, cut to k; `score` itself stays as it was."""
    s = hits.withColumn("rerank_score", F.round(score, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), F.asc("id"))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def scored_by(hits: DataFrame, scorer, question: str = "question", text: str = "text") -> DataFrame:
    """hits with `model_score` from scorer(list of questions, list of texts) -> scores, called a batch at a time.

    `scorer` is made once in each task by calling scorer(); it may hold a model."""

    def run(frames):
        model = scorer()
        for f in frames:
            f["model_score"] = np.asarray(model(f[question].tolist(), f[text].tolist()), float)
            yield f

    schema = ", ".join(f"`{n}` {t}" for n, t in hits.dtypes)
    return hits.mapInPandas(run, f"{schema}, model_score double")


# Embedding


class HashingEmbedder:
    """A stand-in for an embedding model: token counts hashed to `size` places at unit length (zeros for no token),
    and token shares as sparse weights. A real model takes its place by the same call."""

    def __init__(self, size: int = 64):
        self.size = size
        self.token = re.compile(TOKEN)
        self.ends = re.compile(f"^(.{{2,}}?)(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})$")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[dict[str, float]]]:
        dense, weights = np.zeros((len(texts), self.size), np.float32), []
        for i, text in enumerate(texts):
            n = Counter(self.ends.sub(r"\1", t) for t in self.token.findall(text))
            for t, c in n.items():
                dense[i, zlib.crc32(t.encode()) % self.size] += c
            weights.append({t: c / n.total() for t, c in n.items()})
        return dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12), weights


def embedded(rows: DataFrame, text: str, model, batch: int = 32) -> DataFrame:
    """rows with `embedding` and `sparse` from model() -> callable(texts), made once in each task, `batch` texts a call.

    A null text counts as empty. Order and other columns stay."""

    def run(frames):
        m = model()
        for f in frames:
            texts = [t or "" for t in f[text]]
            dense, weights = [], []
            for at in range(0, len(texts), batch):
                d, w = m(texts[at : at + batch])
                dense += list(d)
                weights += w
            f["embedding"], f["sparse"] = dense, weights
            yield f

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, embedding array<float>, sparse map<string, double>")
