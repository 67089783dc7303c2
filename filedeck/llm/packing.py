"""Documents into containers of fixed token capacity.

Spark counts how many items there are of each length: at most `capacity` rows, whatever the number of
documents. On that histogram the configuration linear program is solved: how often to use each way of
filling a container, so that every item has a place and the containers are as few as possible.

The solution is by multiplicative weights. Each length has a weight, which falls by the factor
exp(-RATE * share) as that share of its items is covered; the best knapsack under the weights is the next
configuration. No step covers more than STEP of a length (the width of the program) or more than is left of
it, so nothing is covered twice and the steps end with every length covered in full. Each round is one Spark
job: its tasks price slight variations of the weights by dynamic programming over the capacity and hand back the
best filling for each variation and the best ones that hold chosen lengths. The last TAIL of the tokens, too few
lengths for full containers, is covered by best fit. Weights divided by the best knapsack's worth are a
solution of the dual program, so each round bounds the optimum from below; `Program` tells value and bound.

The fractions are rounded at random, then up as far as items are left; what they leave is a smaller
program, solved and rounded in the same way (PASSES programs in all). The rest, some hundredths, is filled by the same
pricing in whole numbers. Each length's items are then numbered in Spark, hot lengths over many
tasks, and every item finds its container from its number alone.

Only items above the capacity are split: into full pieces and a rest. Items of size 0 go to any
container. A null or negative size is unknown and is counted from the text with a public tokenizer, a
null text having none. An empty table gives an empty result; repeated rows are items of their own.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filedeck.session import cut

CAPACITY = 2048
#: Largest share of a length's items that one step covers, and how fast weights fall with what is covered.
STEP, RATE = 0.4, 2.0
#: Fillings are used down to this share of the best one's worth before the weights are priced again.
WORTH = 0.8
#: Share of the tokens that best fit covers at the program's end; programs solved one after the other.
TAIL, PASSES = 0.04, 2
#: Tasks of a pricing job, variations of the weights that a task prices, and fillings made of each.
TASKS, PRICED, FORCED = 8, 4, 64
#: Items of one length that one task numbers.
GROUP = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

Filling = tuple[np.ndarray, np.ndarray]  # indexes of lengths, how often each


def knapsacks(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of values and each room up to the capacity: the most that sizes (ascending, any number of
    each) in that room are worth, and the size to take first (-1: none, the room one smaller does as well)."""
    m, rows = len(values), np.arange(len(values))
    worth, index = np.full((m, capacity + 1), -np.inf, np.float32), np.full(capacity + 1, -1)
    worth[:, sizes], index[sizes] = values, np.arange(len(sizes))  # by size, so that a room's choices are two slices
    back, first = np.zeros((m, capacity + 1), np.float32), np.full((m, capacity + 1), -1, np.int32)  # back[:, capacity - c]: best in room c
    sums = np.empty((m, capacity), np.float32)
    for c in range(int(sizes[0]), capacity + 1):
        v = np.add(worth[:, 1 : c + 1], back[:, capacity - c + 1 :], out=sums[:, :c])
        i = v.argmax(1)
        top, before = v[rows, i], back[:, capacity - c + 1]
        better = top > before
        back[:, capacity - c] = np.where(better, top, before)
        first[:, c] = np.where(better, index[i + 1], -1)
    return back[:, ::-1], first


def traced(first: list[int], sizes: np.ndarray, room: int) -> list[int]:
    """The sizes that the table of knapsacks takes in a room."""
    out = []
    while room > 0:
        i = first[room]
        if i < 0:
            room -= 1
        else:
            out.append(i)
            room -= int(sizes[i])
    return out


def _price(sizes: np.ndarray, weights: np.ndarray, capacity: int, seed: int):
    """(top, filling): the worth of the best knapsack under the weights (first task) and fillings of high worth."""

    def run(batches):
        for batch in batches:
            for task in batch.column("id").to_pylist():
                rng = np.random.default_rng([seed, task])
                noise = 0.05 * rng.normal(size=(PRICED, len(sizes)))
                if task == 0:
                    noise[0] = 0
                best, first = knapsacks(sizes, (weights * np.exp(noise)).astype(np.float32), capacity)
                found = []
                for row in first:
                    row = row.tolist()
                    found.append(traced(row, sizes, capacity))
                    for i in rng.choice(len(sizes), FORCED - 1, p=weights / weights.sum()).tolist():
                        found.append([i, *traced(row, sizes, capacity - int(sizes[i]))])
                top = float(best[0, capacity]) if task == 0 else None
                yield pa.RecordBatch.from_arrays([pa.array([top] * len(found), pa.float64()), pa.array(found, pa.list_(pa.int32()))], ["top", "filling"])

    return run


def priced(spark: SparkSession, sizes: np.ndarray, weights: np.ndarray, capacity: int, seed: int) -> tuple[float, list[Filling]]:
    """One pricing job: the worth of the best knapsack, and TASKS * PRICED * FORCED fillings as indexes and numbers."""
    made = spark.range(0, TASKS, 1, TASKS).mapInArrow(_price(sizes, weights, capacity, seed), "top double, filling array<int>").toArrow()
    distinct = sorted({tuple(sorted(f)) for f in made.column("filling").to_pylist()})
    top = next(t for t in made.column("top").to_pylist() if t is not None)
    counted = [Counter(f) for f in distinct]
    return top, [(np.array(list(c)), np.array(list(c.values()))) for c in counted]


@dataclass
class Program:
    """A solution of the configuration program: `use` is how often (a fraction) each filling is used."""

    use: list[tuple[Filling, float]] = field(default_factory=list)
    value: float = 0.0
    bound: float = 0.0
    rounds: int = 0


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size goes to one container, the largest that fits and is left first."""
    a, room = np.zeros(len(sizes), np.int64), capacity
    while True:
        fits = np.flatnonzero((sizes <= room) & (left > a))
        if not len(fits):
            return a
        i = fits[-1]
        n = max(1, min(room // int(sizes[i]), int(left[i] - a[i])))
        a[i] += n
        room -= n * int(sizes[i])


def linear_program(spark: SparkSession, sizes: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 0) -> Program:
    """Fractional use of fillings that covers every count in full, and a lower bound of the best such use."""
    need, tokens = counts.astype(float), float((sizes * counts).sum())
    left, out = need.copy(), Program(bound=tokens / capacity)

    def use(at: np.ndarray, a: np.ndarray, times: float):
        now = left[at] - a * times
        left[at] = np.where(now < 1e-9, 0, now)
        out.use.append(((at, a), times))
        out.value += times

    while (sizes * left).sum() > TAIL * tokens:
        some = np.flatnonzero(left)
        weights = sizes[some] * (1 + sizes[some] / capacity) * np.exp(-RATE * (1 - left[some] / need[some]))
        top, found = priced(spark, sizes[some], weights, capacity, seed + out.rounds)
        out.bound = max(out.bound, float((need[some] * weights).sum() / top))
        out.rounds += 1
        worth = np.array([(weights[at] * a).sum() for at, a in found])
        for k in np.argsort(-worth, kind="stable"):
            at, a = some[found[k][0]], found[k][1]
            most = (left[at] / a).min()
            if most > 0 and worth[k] >= WORTH * worth.max():
                use(at, a, min((STEP * need[at] / a).min(), most))
    while left.any():
        a = best_fit(sizes, np.ceil(left), capacity)
        at = np.flatnonzero(a)
        use(at, a[at], (left[at] / a[at]).min())
    return out


class Fill:
    """Whole containers that hold every item exactly, and how they came about."""

    def __init__(self, spark: SparkSession, sizes: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY):
        self.sizes, self.capacity = sizes, capacity
        self.left = counts.astype(np.int64).copy()
        self.taken: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.programs: list[Program] = []
        self.rounded = 0
        rng = np.random.default_rng(5)
        for n in range(PASSES):
            some = np.flatnonzero(self.left)
            if not len(some):
                break
            program = linear_program(spark, sizes[some], self.left[some], capacity, 1000 * n)
            self.programs.append(program)
            self.round(program, some, rng)
        self.rounded = self.n
        self.rest(spark)

    @property
    def n(self) -> int:
        return sum(times for _, _, times in self.taken)

    def take(self, at: np.ndarray, a: np.ndarray, times: int) -> None:
        times = min(times, int((self.left[at] // a).min()))
        if times > 0:
            self.left[at] -= a * times
            self.taken.append((at, a, times))

    def round(self, program: Program, some: np.ndarray, rng: np.random.Generator) -> None:
        """Each use rounded up or down at random with its fraction as chance, then full containers rounded up."""
        ordered = sorted(program.use, key=lambda u: -u[1])
        for (at, a), times in ordered:
            self.take(some[at], a, int(times + rng.random()))
        for (at, a), times in ordered:
            if (self.sizes[some[at]] * a).sum() >= 0.99 * self.capacity:
                self.take(some[at], a, int(np.ceil(times)))

    def rest(self, spark: SparkSession) -> None:
        """The items left, by the same pricing in whole numbers while it finds full containers, then by best fit."""
        seed, slack = 10**6, self.capacity // 256
        while self.left.any():
            some, before = np.flatnonzero(self.left), self.n
            s = self.sizes[some]
            room = int((s * self.left[some]).sum()) // self.capacity
            if room >= 4 and slack < self.capacity // 4:
                _, found = priced(spark, s, s * (1 + s / self.capacity), self.capacity, seed)
                seed += 1
                for at, a in sorted(found, key=lambda f: -len(f[0])):
                    if (s[at] * a).sum() >= self.capacity - slack:
                        self.take(some[at], a, int(self.left.max()))
            if self.n - before <= room // 8:  # few full ones: some containers by best fit, then less is asked for
                for _ in range(max(1, room // 8)):
                    a = best_fit(self.sizes, self.left, self.capacity)
                    at = np.flatnonzero(a)
                    if len(at):
                        self.take(at, a[at], 1)
                slack *= 2


class Plan:
    """For each length, which numbers go to which containers; its size depends on the capacity only."""

    def __init__(self, sizes: np.ndarray, filled: list[tuple[np.ndarray, np.ndarray, int]], capacity: int):
        self.n = sum(t for _, _, t in filled)
        given = np.zeros(capacity + 1, np.int64)
        rows, base = [], 0
        for at, a, times in filled:
            for i, k in zip(at, a):
                rows.append((int(sizes[i]) << 44 | int(given[sizes[i]]), base, int(k)))
                given[sizes[i]] += int(k) * times
            base += times
        rows.sort()
        self.start, self.base, self.per = (np.array([r[j] for r in rows], np.int64) for j in range(3))

    def container(self, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        key = (size << 44) | number
        at = np.searchsorted(self.start, key, "right") - 1
        return self.base[at] + (key - self.start[at]) // self.per[at]


def _count_tokens(path: str):
    def run(frames):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for f in frames:
            texts = [x or "" for x in f["text"]]
            f["size"] = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
            yield f[["doc_id", "size"]]

    return run


def items(documents: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece_no, tokens): the documents, those above the capacity in pieces."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("size"), F.col("text").cast("string").alias("text"))
    known = rows.filter("size >= 0").select("doc_id", "size")
    counted = rows.filter("size is null or size < 0").select("doc_id", "text").mapInPandas(_count_tokens(tokenizer), "doc_id bigint, size bigint")
    sized = known.unionByName(counted)
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("size") - 1) / capacity), F.lit(0)).cast("int")))
    return sized.select("doc_id", "size", pieces.alias("piece")).select("doc_id", (F.col("piece") + 1).alias("piece_no"), F.least(F.col("size") - F.col("piece").cast("bigint") * capacity, F.lit(capacity)).alias("tokens"))


def _place(plan):
    def run(batches):
        p: Plan = plan.value
        for b in batches:
            size, number = b.column("tokens").to_numpy(zero_copy_only=False), b.column("number").to_numpy(zero_copy_only=False)
            place = np.where(size > 0, p.container(size, number) if len(p.start) else 0, number % max(p.n, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece_no"), b.column("tokens"), pa.array(place)], ["doc_id", "piece_no", "tokens", "container"])

    return run


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(lengths above 0, numbers of items) of items(): at most capacity + 1 rows reach the driver."""
    found = rows.filter("tokens > 0").groupBy("tokens").count().orderBy("tokens").toPandas()
    return found["tokens"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents (doc_id bigint, n_tokens, text) -> (doc_id, piece_no, tokens, container), every item in one container.

    Containers are numbered from 0 without gaps and hold at most `capacity` tokens."""
    rows = cut(items(documents, capacity, tokenizer))
    sizes, counts = histogram(rows)
    spark = documents.sparkSession
    plan = spark.sparkContext.broadcast(Plan(sizes, Fill(spark, sizes, counts, capacity).taken, capacity))
    most = rows.groupBy("tokens").count().agg(F.max("count")).first()[0] or 0
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(max(1, -(-most // GROUP)))))
    offsets = salted.groupBy("tokens", "salt").count()
    before = F.sum("count").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("tokens", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = salted.withColumn("own", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece_no")))
    placed = numbered.join(offsets, ["tokens", "salt"]).withColumn("number", F.col("before") + F.col("own") - 1)
    return placed.select("doc_id", "piece_no", "tokens", "number").mapInArrow(_place(plan), "doc_id bigint, piece_no int, tokens bigint, container bigint")


def program_figures(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row about the first program and its rounding: lengths, tokens, value and lower bound of the program, the share of
    the tokens it covers, rounds of pricing, containers in all, and how many of them came from rounding the programs."""
    spark = documents.sparkSession
    sizes, counts = histogram(items(documents, capacity, tokenizer))
    filled = Fill(spark, sizes, counts, capacity)
    first = filled.programs[0] if filled.programs else Program()
    used = sum(float(times) * float((sizes[at] * a).sum()) for (at, a), times in first.use)
    row = (len(sizes), int((sizes * counts).sum()), float(first.value), float(first.bound), used / max(1.0, float((sizes * counts).sum())), first.rounds, filled.n, filled.rounded)
    return spark.createDataFrame([row], "lengths bigint, tokens bigint, value double, bound double, covered double, rounds bigint, containers bigint, rounded bigint")


def containers(assigned: DataFrame) -> DataFrame:
    """(container, n_items, tokens, unused) of an assignment at the standard capacity."""
    return assigned.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(CAPACITY) - F.col("tokens"))
