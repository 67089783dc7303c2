"""The most similar vectors of every vector, along shifted Hilbert curves.

Vectors of the same direction (equal after scaling to 16 bits a component) form one class. Each of CURVES curves
projects the classes on AXES random directions, shifts and scales them by the table's own mean and spread, and orders
them by the Hilbert index of the grid cell (a hash that differs by curve within a cell).
Spark range-partitions the classes by (curve, key) and sorts them; a partition is read in windows of WINDOW rows by rank, and each window is
compared with itself and with the next one by matrix products, so a vector meets all that stand within WINDOW places of it;
only the border between two partitions parts neighbouring windows. A partition holds about SPAN windows, so their number follows from
the number of classes. The lists of all curves are merged, and the k best by their cosine stay (the rerank). A class travels with its
k + 1 smallest ids, so a list names ids from the start and needs no join; only classes of several members are joined
with their members. Work and data grow in proportion to the table.

The accuracy lost is that of a pair which stands more than a window apart on every curve. `exact_ids` compares
a stated set of queries with all rows in blocks; `recall` measures the curves against it.

Results name the class members with the smallest ids, so a table full of copies makes no long list. Null, all-zero,
non-finite and wrongly sized vectors and rows without an id take no part. Ties go to the smaller id. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filedeck.llm.codes import mix
from filedeck.operators.skew import salted_join
from filedeck.session import checkpoint_folder, cut

#: Curves, axes of a curve and bits of an axis; rows of a window and windows of a partition.
CURVES, AXES, BITS, WINDOW, SPAN = 8, 8, 8, 8192, 8
#: Rows and columns of the tile that is compared at once.
ROWS = 512
#: Classes of one task of the exact search.
GROUP = 16_384


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points [n, axes] with `bits` bits an axis (Skilling 2004)."""
    x = x.astype(np.uint64).T.copy()
    axes = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(axes):
            high = (x[i] & q) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= np.uint64(1)
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out


def usable(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the vectors that take part."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.zeros((0, size))
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(-1, size)
    n = np.sqrt((v * v).sum(1))
    fine = np.isfinite(n) & (n > 0)
    return rows[fine], v[fine] / n[fine, None]


def scaled(v: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers, each to its own scale."""
    return np.round(v * (32767 / np.abs(v).max(1, keepdims=True))).astype(np.int16)


def class_of(q: np.ndarray) -> np.ndarray:
    """A 64-bit name of each scaled vector."""
    h = np.zeros(len(q), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + q[:, i].astype(np.uint64) + np.uint64(i))
    return h.view(np.int64)


def _classes(size: int):
    """(lead, class, v): each class in a batch once, with its smallest id."""

    def run(batches):
        for batch in batches:
            rows, v = usable(batch.column("embedding"), size)
            if not len(rows):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[rows]
            order = np.argsort(ids, kind="stable")
            q = scaled(v[order])
            name, first = np.unique(class_of(q), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][first]), pa.array(name), _binary(q[first])], ["lead", "class", "v"])

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _ranks(key: np.ndarray) -> np.ndarray:
    """Place of each element of a sorted array among its equals."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))


def _unit(column: pa.Array, size: int) -> np.ndarray:
    v = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, size).astype(np.float32)
    return v / np.sqrt((v.astype(np.float64) ** 2).sum(1))[:, None].astype(np.float32)


def _stream(files: list[str], size: int, most: int = 16 * 1024):
    """(classes, unit vectors) of all files, in their order."""
    for uri in files:
        system, path = pa.fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(most, columns=["class", "v"]):
                yield batch.column("class").to_numpy(zero_copy_only=False), _unit(batch.column("v"), size)


def _true(fine: np.ndarray) -> np.ndarray:
    """Places of the few true values of a boolean array, looked for in eights."""
    flat = fine.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = flat.view(np.uint64).nonzero()[0]
    row, bit = flat.reshape(-1, 8)[eights].nonzero()
    return eights[row] * 8 + bit


class Best:
    """The k best others of each of some vectors so far, the first met first among equals."""

    def __init__(self, name: np.ndarray, v: np.ndarray, k: int, floor: float):
        self.name, self.v, self.k, self.floor = name, v, k, np.float32(floor)
        self.cosine = np.full((len(v), k), np.nextafter(np.float32(floor), np.float32(-4)))
        self.near, self.known = np.zeros((len(v), k), np.int64), np.zeros((len(v), k), bool)
        self.least = self.cosine[:, -1].copy()  # what the next one must be above
        self.rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_rest = 0

    def meet(self, name: np.ndarray, w: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Compare with the vectors w, which no earlier call had; their cosines."""
        s = np.matmul(self.v, w.T, out=out[: len(self.v), : len(w)])
        self.look(name, s)
        return s

    def look(self, name: np.ndarray, s: np.ndarray, across: bool = False) -> None:
        """Take what is good enough of cosines [own vectors, others] with others of these names; across: [others, own vectors]."""
        if self.floor > -1 and s.max() < self.floor:  # with a floor most tiles hold nothing
            return
        fine = s > (self.least if across else self.least[:, None])
        n = np.count_nonzero(fine)
        if not n:
            return
        if len(name) > self.k + 1 and n > 4 * self.k * len(self.v):  # k + 1: one may be the vector itself
            least = np.partition(s.T if across else s, -self.k - 1, axis=1)[:, -self.k - 1]
            fine &= s >= (least if across else least[:, None])
        i, j = np.divmod(_true(fine), s.shape[1])
        x = s[i, j]
        i, j = (j, name[i]) if across else (i, name[j])
        other = self.name[i] != j
        self.rest.append((i[other], j[other], x[other]))
        self.n_rest += int(other.sum())
        if self.n_rest > len(self.v) * self.k // 2:
            self.merge()

    def merge(self) -> None:
        if not self.n_rest:
            return
        i, j, x = (np.concatenate(c) for c in zip(*self.rest))
        self.rest, self.n_rest, k = [], 0, self.k
        u = np.unique(i)
        old, col = np.nonzero(self.known[u])
        old = u[old]
        i, j, x = np.r_[old, i], np.r_[self.near[old, col], j], np.r_[self.cosine[old, col], x]
        order = np.argsort(4.0 * i - x, kind="stable")  # by i, then the highest cosine, then those met first
        i, j, x = i[order], j[order], x[order]
        rank = _ranks(i)
        keep = rank < k
        i, j, x, rank = i[keep], j[keep], x[keep], rank[keep]
        self.near[i, rank], self.cosine[i, rank], self.known[i, rank] = j, x, True
        self.least[u] = self.cosine[u, -1]


def _search(files: list[str], size: int, k: int, floor: float, window: int):
    """Classes of a task -> the k best others of each among all classes in the files."""

    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        for at in range(0, table.num_rows if table else 0, GROUP):
            part = table.slice(at, GROUP).combine_chunks()
            name, v = part.column("class").to_numpy(), _unit(part.column("v"), size)
            best = [Best(name[a : a + ROWS], v[a : a + ROWS], k, floor) for a in range(0, len(v), ROWS)]
            out = np.empty((ROWS, window), np.float32)
            for names, w in _stream(files, size):
                for b in best:
                    for c in range(0, len(w), window):
                        b.meet(names[c : c + window], w[c : c + window], out)
            for b in best:
                b.merge()
                i, r = np.nonzero(b.known)
                yield pa.RecordBatch.from_arrays([pa.array(b.name[i]), pa.array(b.near[i, r]), pa.array(b.cosine[i, r].astype(np.float64))], ["class", "near", "cosine"])

    return run


def _names(size: int):
    def run(batches):
        for batch in batches:
            rows, v = usable(batch.column("embedding"), size)
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(class_of(scaled(v)))], ["id", "class"])

    return run


def _stored(vectors: DataFrame, size: int) -> DataFrame:
    """(class, lead, v): each class once, with its smallest id."""
    return vectors.mapInArrow(_classes(size), "lead bigint, class bigint, v binary").groupBy("class").agg(F.min("lead").alias("lead"), F.first("v").alias("v"))


def class_hits(vectors: DataFrame, k: int, size: int, floor: float, window: int, asked: DataFrame | None = None) -> DataFrame:
    """(class, near, cosine): the k best other classes of each class (or each class in `asked`); cosines good to about 1e-6."""
    spark = vectors.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/nearest-{uuid.uuid4().hex}"
    _stored(vectors, size).orderBy("lead").write.parquet(folder)
    try:
        stored = spark.read.schema("class bigint, lead bigint, v binary").parquet(folder)
        files = sorted(stored.inputFiles())  # by name, and so by lead
        mine = stored.join(asked.select("class").distinct(), "class", "left_semi") if asked is not None else stored
        tasks = max(4 * spark.sparkContext.defaultParallelism, -(-mine.count() // GROUP))
        return cut(mine.select("class", "v").repartition(tasks, "class").mapInArrow(_search(files, size, k, floor, window), "class bigint, near bigint, cosine double"))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Along curves


def directions(curve: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(orthonormal directions [size, axes], shift of each axis in cells of the coarsest grid) of a curve."""
    r = np.random.default_rng([11, curve])
    q, _ = np.linalg.qr(r.normal(size=(size, min(AXES, size))))
    return q, r.uniform(-0.5, 0.5, q.shape[1])


def _moments(size: int):
    """(n, s, ss): number of vectors and sums of their components and of products of components."""

    def run(batches):
        n, s, ss = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                v = _unit(batch.column("v"), size).astype(np.float64)
                n, s, ss = n + len(v), s + v.sum(0), ss + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "ss"])

    return run


def moments(stored: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) of all unit vectors; size squared numbers a task are summed in Spark."""
    rows = stored.select("v").mapInArrow(_moments(size), "n bigint, s array<double>, ss array<double>")
    both = rows.select("n", F.posexplode(F.concat("s", "ss")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").toPandas()
    n = int(both["n"].iloc[0]) if len(both) else 0
    x = both["x"].to_numpy() / max(n, 1)
    mean = x[:size] if n else np.zeros(size)
    return mean, (x[size:].reshape(size, size) if n else np.zeros((size, size))) - np.outer(mean, mean), n


def curve_keys(v: np.ndarray, curve: int, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Place of each unit vector on a curve, as numbers in its order."""
    q, shift = directions(curve, v.shape[1])
    spread = np.sqrt(np.maximum(np.einsum("ia,ij,ja->a", q, covariance, q), 1e-12))
    x = (v - mean) @ q / spread + shift
    cell = np.clip((x + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
    h = hilbert(cell, BITS)
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _firsts(size: int, k: int):
    """(class, id, v): the k + 1 smallest ids of each class in a batch."""

    def run(batches):
        for batch in batches:
            rows, v = usable(batch.column("embedding"), size)
            if not len(rows):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[rows]
            q = scaled(v)
            name = class_of(q)
            order = np.lexsort((ids, name))
            at = order[_ranks(name[order]) <= k]
            yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(ids[at]), _binary(q[at])], ["class", "id", "v"])

    return run


def _along(size: int, curves: int, mean: np.ndarray, covariance: np.ndarray):
    """(curve, key, ids, v): each class once for each curve."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(batch.column("v"), size).astype(np.float64)
            ends = batch.column("ids").offsets.to_numpy()
            ends = ((ends - ends[0]) * 8).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(batch.column("ids").flatten().to_numpy().tobytes())])
            for c in range(curves):
                key = curve_keys(v, c, mean, covariance)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(key), ids, batch.column("v")], ["curve", "key", "ids", "v"])

    return run


#: The cosine of an empty place in a list.
NONE = np.float32(-4)


def _best(near: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best entries of each row, ties to the smaller id."""
    order = np.argsort(near, axis=1, kind="stable")
    near, cosine = np.take_along_axis(near, order, 1), np.take_along_axis(cosine, order, 1)
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(near, order, 1), np.take_along_axis(cosine, order, 1)


def _packed(near: np.ndarray, cosine: np.ndarray) -> pa.Array:
    """Lists [rows, k] as bytes: the first byte of all entries, then the second and so on, as leading zeros of ids then stand
    together and Spark's compression removes them."""
    planes = [x.view(np.uint8).reshape(*x.shape, x.itemsize).transpose(0, 2, 1).reshape(len(x), -1) for x in map(np.ascontiguousarray, (near, cosine))]
    return _binary(np.concatenate(planes, axis=1))


def _unpacked(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 12 * k)
    near, cosine = (np.ascontiguousarray(p.reshape(len(x), -1, k).transpose(0, 2, 1)) for p in (x[:, : 8 * k], x[:, 8 * k :]))
    return near.view(np.int64)[:, :, 0], cosine.view(np.float32)[:, :, 0]


class Copies:
    """The first ids of those classes that have several: by the smallest, at most `most` of each."""

    def __init__(self, lead: np.ndarray, ids: np.ndarray, fine: np.ndarray):
        self.lead, self.ids, self.fine = lead, ids, fine

    @classmethod
    def of(cls, n: np.ndarray, flat: np.ndarray, most: int) -> Copies:
        """From the number of ids of each class and all ids."""
        at, start = np.flatnonzero(n > 1), np.cumsum(n) - n
        at = at[np.argsort(flat[start[at]])]
        fine = np.arange(most) < n[at, None]
        return cls(flat[start[at]], np.where(fine, flat[np.minimum(start[at, None] + np.arange(most), len(flat) - 1)], 0), fine)

    @classmethod
    def together(cls, parts: list[Copies]) -> Copies:
        lead = np.concatenate([p.lead for p in parts])
        order = np.argsort(lead, kind="stable")
        return cls(lead[order], np.concatenate([p.ids for p in parts])[order], np.concatenate([p.fine for p in parts])[order])

    def find(self, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it among these classes, its row)."""
        if not len(self.lead):
            return np.zeros(lead.shape, bool), np.zeros(lead.shape, np.int64)
        at = np.minimum(np.searchsorted(self.lead, lead), len(self.lead) - 1)
        return self.lead[at] == lead, at

    def named(self, near: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists [rows, k] of classes -> the k best ids of each."""
        k = near.shape[1]
        many, at = self.find(near)
        many &= cosine != NONE
        rows = np.flatnonzero(many.any(1))
        best = _best(near, cosine, k)
        if len(rows):
            shape = (len(rows), k, self.ids.shape[1])
            one = np.arange(shape[2]) == 0
            ids = np.where(many[rows, :, None], self.ids[at[rows]], near[rows, :, None])
            fine = np.where(many[rows, :, None], self.fine[at[rows]], one)
            c = np.where(fine, np.broadcast_to(cosine[rows, :, None], shape), NONE)
            best[0][rows], best[1][rows] = _best(ids.reshape(len(rows), -1), c.reshape(len(rows), -1), k)
        return best


def _windows(size: int, k: int, floor: float, window: int):
    """Sorted rows of a partition -> (lead, many, list): the smallest id of each class, whether it has several, and the k best
    ids of other classes in its window and its neighbours."""

    def blocks(name, v):
        return [Best(name[a : a + ROWS], v[a : a + ROWS], k, floor) for a in range(0, len(name), ROWS)]

    def done(made: list[Best], copies: list[Copies]):
        together = Copies.together(copies) if copies else None
        for b in made:
            b.merge()
            at = np.flatnonzero(b.known.any(1))
            if len(at):
                near, cosine = together.named(b.near[at], np.where(b.known[at], b.cosine[at], NONE))
                many, _ = together.find(b.name[at])
                yield pa.RecordBatch.from_arrays([pa.array(b.name[at]), pa.array(many), _packed(near, cosine)], ["lead", "many", "list"])

    def run(batches):
        out = np.empty((ROWS, ROWS), np.float32)
        last, before, copies = None, [], []  # copies: of up to three windows, the last one and its neighbours
        for curve, name, v, own in _runs(batches, size, window, k + 1):
            made = blocks(name, v)
            for i, a in enumerate(made):
                for b in made[i:]:
                    s = a.meet(b.name, b.v, out)
                    if b is not a:
                        b.look(a.name, s, across=True)
                for b in before if curve == last else []:
                    b.look(a.name, a.meet(b.name, b.v, out), across=True)
            yield from done(before, [*copies, own] if curve == last else copies)
            last, before, copies = curve, made, [*copies[-1:], own] if curve == last else [own]
        yield from done(before, copies)

    return run


def _runs(batches, size: int, window: int, most: int):
    """(curve, smallest ids, unit vectors, copies): `window` rows of one curve at a time, its last one with what is left."""
    kept: list[pa.RecordBatch] = []
    n = 0

    def whole(rows: pa.Table):
        curve = rows.column("curve").to_numpy()
        for part in np.split(np.arange(len(curve)), np.flatnonzero(np.diff(curve)) + 1):
            if len(part):
                t = rows.slice(int(part[0]), len(part)).combine_chunks()
                ids = t.column("ids").to_pylist()
                count, flat = np.array([len(x) for x in ids]) // 8, np.frombuffer(b"".join(ids), np.int64)
                yield int(curve[part[0]]), flat[np.cumsum(count) - count], _unit(t.column("v"), size), Copies.of(count, flat, most)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, window - n)
            kept.append(piece)
            n, at = n + piece.num_rows, at + piece.num_rows
            if n == window:
                yield from whole(pa.Table.from_batches(kept))
                kept, n = [], 0
    if n:
        yield from whole(pa.Table.from_batches(kept))


def _merged(k: int):
    """Rows (lead, many, list) sorted by lead, one of each curve at most -> the k best different ids of each lead."""

    def best(rows: pa.Table):
        name = rows.column("lead").to_numpy()
        near, cosine = _unpacked(rows.column("list"), k)
        rank = _ranks(name)
        first = np.flatnonzero(rank == 0)
        wide = np.cumsum(rank == 0) - 1, rank
        all_near, all_cosine = np.zeros((len(first), rank.max() + 1, k), np.int64), np.full((len(first), rank.max() + 1, k), NONE)
        all_near[wide], all_cosine[wide] = near, cosine
        near, cosine = _best(all_near.reshape(len(first), -1), all_cosine.reshape(len(first), -1), all_near.shape[1] * k)
        order = np.argsort(near, axis=1, kind="stable")  # of one id the best cosine comes first
        near, cosine = np.take_along_axis(near, order, 1), np.take_along_axis(cosine, order, 1)
        again = (near[:, 1:] == near[:, :-1]) & (cosine[:, :-1] != NONE)
        cosine[:, 1:][again] = NONE
        lists = _packed(*_best(near, cosine, k))
        return pa.RecordBatch.from_arrays([pa.array(name[first]), rows.column("many").combine_chunks().take(pa.array(first)), lists], ["lead", "many", "list"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            name = rows.column("lead").to_numpy()
            last = int(np.searchsorted(name, name[-1]))  # the last class may go on in the next batch
            if last:
                yield best(rows.slice(0, last))
            kept = rows.slice(last)
        if kept is not None:
            yield best(kept)

    return run


def _entries(k: int):
    """(lead, list) -> (id, near_id, cosine, rank)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near, cosine = _unpacked(batch.column("list"), k)
                i, r = np.nonzero(cosine != NONE)
                x = np.minimum(cosine[i, r].astype(np.float64), 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("lead").take(pa.array(i)), pa.array(near[i, r]), pa.array(x), pa.array((r + 1).astype(np.int32))], ["id", "near_id", "cosine", "rank"])

    return run


def curve_lists(stored: DataFrame, k: int, size: int, floor: float, curves: int, window: int) -> DataFrame:
    """Classes (ids, v) -> (lead, many, list): the k best ids of other classes for each class, by its smallest id, packed."""
    mean, covariance, n = moments(stored, size)
    tasks = curves * max(1, -(-n // (SPAN * window)))
    placed = stored.select("ids", "v").mapInArrow(_along(size, curves, mean, covariance), "curve int, key bigint, ids binary, v binary")
    order = [F.col("curve"), F.col("key"), F.xxhash64("ids", "curve")]
    ordered = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    lists = ordered.mapInArrow(_windows(size, k, floor, window), "lead bigint, many boolean, list binary")
    return cut(lists.repartition(tasks, "lead").sortWithinPartitions("lead").mapInArrow(_merged(k), "lead bigint, many boolean, list binary"))


def _first(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def _named(members: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(id, near_id, cosine, rank) from hits between classes; a class of many copies is spread over many tasks."""
    few = _first(members, "class", [F.asc("id")], k + 1).select("class", F.col("id").alias("near_id"))
    reached = hits.unionByName(few.select("class", F.col("class").alias("near"), F.lit(1.0).alias("cosine")).distinct())
    named = reached.join(few.withColumnRenamed("class", "near"), "near").select("class", "near_id", "cosine")
    best = cut(_first(named, "class", [F.desc("cosine"), F.asc("near_id")], k + 1).select("class", "near_id", "cosine"))
    rows = salted_join(members, best, ["class"]).filter("id <> near_id")
    return _first(rows, "id", [F.desc("cosine"), F.asc("near_id")], k).select("id", "near_id", "cosine", "rank")


def _members(vectors: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(vectors (id, embedding), the class of each usable one)."""
    vectors = vectors.select(F.col("id").cast("bigint").alias("id"), "embedding").filter("id is not null")
    return vectors, cut(vectors.mapInArrow(_names(size), "id bigint, class bigint"))


def near_ids(vectors: DataFrame, k: int = 10, size: int = 64, floor: float = -2.0, window: int = ROWS, asked: Column | None = None) -> DataFrame:
    """vectors (id bigint unique, embedding) -> (id, near_id, cosine, rank): of every usable vector the k others
    with the highest cosine of all, and at least `floor`, by comparing all with all in blocks. window: columns of the
    block compared at once; asked: a condition on id, of the vectors whose lists are wanted.

    Work grows with the number of lists times the number of vectors: this is the yardstick for `curve_ids`.
    Copies are told apart by id: they are each other's nearest, the smallest ids first."""
    vectors, members = _members(vectors, size)
    wanted = members.filter(asked) if asked is not None else None
    named = _named(members, class_hits(vectors, k, size, floor, window, wanted), k)
    return named.filter(asked) if asked is not None else named


def curve_ids(vectors: DataFrame, k: int = 10, size: int = 64, floor: float = -2.0, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """As near_ids, of the others that stand near on some of the curves: nearly all, with work in proportion to the table."""
    vectors, members = _members(vectors, size)
    firsts = _first(vectors.mapInArrow(_firsts(size, k), "class bigint, id bigint, v binary"), "class", [F.asc("id")], k + 1)
    stored = cut(firsts.groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))  # k + 1 ids at most
    lists = curve_lists(stored, k, size, floor, curves, window)
    entry = "id bigint, near_id bigint, cosine double, rank int"
    single = lists.filter("not many").select("lead", "list").mapInArrow(_entries(k), entry)
    far = lists.filter("many").select("lead", "list").mapInArrow(_entries(k), entry).groupBy(F.col("id").alias("lead"))
    far = far.agg(F.collect_list(F.struct((-F.col("cosine")).alias("less"), "near_id")).alias("far"))  # k at most
    own = stored.filter(F.size("ids") > 1).select("class", F.col("ids")[0].alias("lead"), F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("less"), i.alias("near_id"))).alias("own"))
    near = F.sort_array(F.when(F.col("far").isNull(), F.col("own")).otherwise(F.concat("own", "far")))
    copied = salted_join(members, own.join(far, "lead", "left").select("class", near.alias("near")), ["class"])
    copied = copied.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["near_id"] != F.col("id")), 1, k)).alias("at", "x"))
    return single.unionByName(copied.select("id", "x.near_id", (-F.col("x.less")).alias("cosine"), (F.col("at") + 1).alias("rank")))


def recall(vectors: DataFrame, asked: Column, k: int = 10, size: int = 64, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """One row (lists, pairs, found, recall): how many of the exact neighbours of the vectors asked for the curves find."""
    exact = near_ids(vectors, k, size, asked=asked).select("id", "near_id")
    found = exact.join(curve_ids(vectors, k, size, curves=curves, window=window).filter(asked).select("id", "near_id"), ["id", "near_id"], "left_semi")
    counts = exact.agg(F.countDistinct("id").alias("lists"), F.count("*").alias("pairs")).join(found.agg(F.count("*").alias("found")))  # one row each
    return counts.withColumn("recall", F.col("found") / F.col("pairs"))


def _cosines(batches):
    """(id_a, id_b, x, y) -> (id_a, id_b, cosine) in double precision."""
    for batch in batches:
        if batch.num_rows:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            yield pa.RecordBatch.from_arrays([batch.column("id_a"), batch.column("id_b"), pa.array(cosine)], ["id_a", "id_b", "cosine"])


def pairs_of(near: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, cosine) of the pairs in lists (id, near_id) with cosine >= least in double precision."""
    pairs = cut(near.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct())
    v = vectors.select(F.col("id").cast("bigint").alias("id"), "embedding")
    both = pairs.join(v.select(F.col("id").alias("id_a"), F.col("embedding").alias("x")), "id_a").join(v.select(F.col("id").alias("id_b"), F.col("embedding").alias("y")), "id_b")
    return both.select("id_a", "id_b", "x", "y").mapInArrow(_cosines, "id_a bigint, id_b bigint, cosine double").filter(F.col("cosine") >= least)


def similar_pairs(vectors: DataFrame, least: float, k: int = 10, size: int = 64, window: int = ROWS) -> DataFrame:
    """(id_a, id_b, cosine) with cosine >= least in double precision, where one is among the k nearest of the other, exact as near_ids."""
    return pairs_of(near_ids(vectors, k, size, least - 1e-4, window), vectors, least)


def curve_pairs(vectors: DataFrame, least: float, k: int = 10, size: int = 64, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """As similar_pairs, along the curves."""
    return pairs_of(curve_ids(vectors, k, size, least - 1e-4, curves, window), vectors, least)
