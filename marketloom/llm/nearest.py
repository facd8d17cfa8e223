"""Approximate nearest neighbours by learned partitions: a balanced partitioning of a neighbour graph, and a small classifier that routes vectors to its parts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NO_ID = 2**63 - 1  # sorts last, as a null id does


# ---- the model, from a bounded sample ----


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, up to rounding."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T


def half(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> np.ndarray:
    """A cut of a graph (edges a-b, both ways) in two sides of equal size: the median of its second eigenvector, then swaps of pairs while fewer edges are cut."""
    degree = np.bincount(a, minlength=n)
    root = np.sqrt(np.maximum(degree, 1e-9))
    first, v = root / np.linalg.norm(root), rng.standard_normal(n)
    for _ in range(rounds):
        v -= first * (first @ v)
        v /= np.linalg.norm(v) + 1e-30
        v = 0.5 * v + 0.5 * np.bincount(b, weights=(v / root)[a], minlength=n) / root
    side = np.zeros(n, bool)
    side[np.lexsort((np.arange(n), v / root))[n // 2 :]] = True
    for _ in range(20):
        apart = side[a] != side[b]
        gain = 2 * np.bincount(a, weights=apart, minlength=n) - degree
        here, there = (m[np.argsort(-gain[m], kind="stable")] for m in (np.flatnonzero(~side), np.flatnonzero(side)))
        pairs = min(len(here), len(there))
        swap = int((gain[here[:pairs]] + gain[there[:pairs]] > 0).sum())
        while swap:
            new = side.copy()
            new[here[:swap]], new[there[:swap]] = True, False
            if (new[a] != new[b]).sum() < apart.sum():
                break
            swap //= 2
        if not swap:
            return side
        side = new
    return side


def balanced(n: int, a: np.ndarray, b: np.ndarray, depth: int, seed: int = 0) -> np.ndarray:
    """Parts 0 to 2**depth - 1 of a graph's nodes, alike in size up to one, by halving again and again."""
    rng, part = np.random.default_rng(seed), np.zeros(n, np.int64)
    for _ in range(depth):
        finer = part * 2
        for p in range(part.max(initial=0) + 1):
            own, at = np.flatnonzero(part == p), np.full(n, -1)
            at[own] = np.arange(len(own))
            inside = (at[a] >= 0) & (at[b] >= 0)
            finer[own] += half(len(own), at[a[inside]], at[b[inside]], rng)
        part = finer
    return part


@dataclass(frozen=True)
class Model:
    """A classifier with one hidden layer. weights is None if there is one part only. reach: parts are probed by falling probability until they hold so much of it."""

    dimension: int
    parts: int
    centre: np.ndarray
    scale: float
    weights: tuple | None
    reach: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones((len(x), 1))
        w, u, v, z = self.weights
        out = np.maximum(0, (x - self.centre) / self.scale @ w + u) @ v + z
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(1)

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) for the parts that each row is sent to, at least one."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        earlier = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
        row, rank = np.nonzero((earlier < self.reach) | (np.arange(p.shape[1]) == 0))
        return row, order[row, rank]


def fitted(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 15, step: float = 0.003, decay: float = 1e-4, seed: int = 0) -> tuple:
    """Weights of the classifier, fitted to shares of parts (a row of goal each) by cross entropy and moment-averaged gradient steps."""
    rng, (n, d), parts = np.random.default_rng(seed), x.shape, goal.shape[1]
    w = [rng.standard_normal((d, hidden)) * math.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]
    mean, square, t = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 128):
            rows = x[order[k : k + 128]]
            h = np.maximum(0, rows @ w[0] + w[1])
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            out = (p / p.sum(1, keepdims=True) - goal[order[k : k + 128]]) / len(rows)
            back = (out @ w[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((rows.T @ back + decay * w[0], back.sum(0), h.T @ out + decay * w[2], out.sum(0))):
                mean[j], square[j] = 0.9 * mean[j] + 0.1 * g, 0.999 * square[j] + 0.001 * g * g
                w[j] = w[j] - step * (mean[j] / (1 - 0.9**t)) / (np.sqrt(square[j] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def neighbours(df: DataFrame, x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k nearest other rows of each row of x (bounded, it goes along with the tasks), in blocks of rows as tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column("id").to_pylist():
                d = squared(x[start : start + block], x)
                d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(d))), pa.array(near.tolist(), pa.list_(pa.int64()))], names=["row", "near"])

    blocks = df.sparkSession.range(0, len(x), block, numPartitions=max(1, -(-len(x) // block)))
    out = np.zeros((len(x), k), np.int64)
    for r in blocks.mapInArrow(run, "row long, near array<long>").collect():
        out[r.row] = r.near
    return out


def fit(vectors: DataFrame, k: int = 10, sample: int = 8192, part_rows: int = 128, recall: float = 0.95, seed: int = 0) -> Model:
    """A model from at most ``sample`` rows of ``usable`` vectors, drawn by a hash of row and vector; copies in it count once.

    The sample's graph of k neighbours is cut into parts of about ``part_rows``, at most 64 of them; the classifier learns, for seven rows of eight, where they and their neighbours lie.
    For the eighth row, reach is the least share of probability at which ``recall`` of its true neighbours in the sample are in the parts probed. Fewer than 4 * part_rows rows: one part."""
    drawn = vectors.select("vector").orderBy(F.xxhash64("vector", "row"), "row").limit(sample).collect()
    x = np.unique(np.array([np.frombuffer(r.vector) for r in drawn]), axis=0) if drawn else np.zeros((0, 1))
    x = x[np.random.default_rng(seed).permutation(len(x))]
    centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = float(np.sqrt(((x - centre) ** 2).mean())) or 1.0 if len(x) else 1.0
    depth = min(6, int(math.log2(max(1, len(x) // part_rows))))
    if depth < 2:
        return Model(x.shape[1], 1, centre, scale, None, 1.0)
    near, n, parts = neighbours(vectors, x, k), len(x), 1 << depth
    a, b = np.repeat(np.arange(n), k), near.ravel()
    part = balanced(n, np.concatenate([a, b]), np.concatenate([b, a]), depth, seed)
    goal = np.zeros((n, parts))
    np.add.at(goal, (a, part[b]), 1.0)
    goal[np.arange(n), part] += k / 2
    learned = np.arange(n) % 8 != 0
    model = Model(x.shape[1], parts, centre, scale, fitted((x[learned] - centre) / scale, goal[learned] / goal[learned].sum(1, keepdims=True), seed=seed), 1.0)
    at, p = model.part_of(x), model.probabilities(x[~learned])
    own = np.take_along_axis(p, at[near[~learned]], 1)
    earlier = (p[:, None, :] * (p[:, None, :] > own[:, :, None])).sum(2)
    reach = float(np.quantile(earlier, recall, method="higher")) + 1e-9
    return Model(model.dimension, parts, centre, scale, model.weights, reach)


# ---- index and search ----


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, id, vector (its doubles as bytes) of the rows that take part: not null, not zero, without null or non-finite components, and of the length that most such rows have (of equally many, the longer)."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & sound)
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.col("count").desc(), F.col("length").desc()).limit(1).collect()
    rows = rows.where(F.size("v") == (length[0]["length"] if length else 0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = b.column("v").flatten().to_numpy(zero_copy_only=False), np.arange(b.num_rows)
            width = len(flat) // max(1, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array([flat[i * width : (i + 1) * width].tobytes() for i in ends], pa.binary())], names=["row", "id", "vector"])

    return rows.mapInArrow(packed, "row long, id long, vector binary")


def matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


@dataclass(frozen=True)
class Index:
    """vectors: part, row, id, vector of every row that takes part, written in the shared folder."""

    vectors: DataFrame
    model: Model


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> Index:
    """Every usable row in the part that the classifier finds likeliest. how: see ``fit``."""
    vectors = written(usable(df, id_col, vector_col))
    model = fit(vectors, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = model.part_of(matrix(b.column("vector"), model.dimension))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *b.columns], names=["part", "row", "id", "vector"])

    return Index(written(vectors.mapInArrow(run, "part int, row long, id long, vector binary")), model)


def _sizes(df: DataFrame, parts: int, most: int) -> list[int]:
    """For each part, in how many slices of about ``most`` rows it is cut."""
    held = {r.part: r["count"] for r in df.groupBy("part").count().collect()}
    return [max(1, -(-held.get(p, 0) // most)) for p in range(parts)]


def _slices(counts: list[int]) -> Column:
    return F.element_at(F.lit(counts), F.col("part") + 1)


def nearest_of(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's place, distance) of the k nearest vectors of each query but itself, ties to the smaller id, then row.

    Of copies of one vector the k + 1 of smallest id are enough for any query here. Products of matrices choose, with a margin for their rounding; differences decide."""
    order = np.lexsort((x_row, x_id))
    _, same = np.unique(x[order].view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    group = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(same[group]) > 0]))
    nth = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    kept = np.sort(order[group[nth <= k]])
    x, x_id, x_row, out = x[kept], x_id[kept], x_row[kept], []
    step = max(1, min(256, 2_000_000 // len(x)))
    for at in range(0, len(q), step):
        part, of = q[at : at + step], q_row[at : at + step]
        d = squared(part, x)
        d[of[:, None] == x_row[None]] = np.inf
        edge = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        margin = 1e-11 * ((part * part).sum(1) + (x * x).sum(1).max()) + 1e-300
        i, j = np.nonzero((d <= (edge + margin)[:, None]) & np.isfinite(d))
        true = np.sqrt(((part[i] - x[j]) ** 2).sum(1))
        order = np.lexsort((x_row[j], x_id[j], true, i))
        i, j, true = i[order], j[order], true[order]
        first = np.searchsorted(i, np.arange(len(part)))
        best = np.arange(len(i)) - first[i] < k
        out.append((at + i[best], kept[j[best]], true[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(of: Index, queries: Column, k: int = 10, slice_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of each row of the index for which ``queries`` (over its id) holds, itself left out.

    score is the Euclidean distance in doubles; nearest first, ties to the smaller id, nulls last, then rows as they stand. A row whose id is repeated is a query of its own.
    A query goes to its likeliest parts. Parts and their queries are cut into slices of about ``slice_rows`` by hashes of rows, and each pair of slices is a group
    of its own, so that a part with a third of all rows, or a vector with that many copies, is many small tasks. Without queries or vectors there are no rows."""
    model, width = of.model, of.model.dimension

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, part = model.routes(matrix(b.column("vector"), width))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(c.take(pa.array(row)) for c in (b.column("row"), b.column("id"), b.column("vector")))], names=["part", "q_row", "q_id", "q"])

    routed = written(of.vectors.where(queries).select("row", "id", "vector").mapInArrow(route, "part int, q_row long, q_id long, q binary"))
    x_slices, q_slices = _sizes(of.vectors, model.parts, slice_rows), _sizes(routed, model.parts, slice_rows)
    every = lambda counts: F.explode(F.sequence(F.lit(0), _slices(counts) - 1))
    xs = of.vectors.select("*", F.pmod(F.xxhash64("row"), _slices(x_slices)).cast("int").alias("xs"), every(q_slices).alias("qs"))
    qs = routed.select("*", F.pmod(F.xxhash64("q_row"), _slices(q_slices)).cast("int").alias("qs"), every(x_slices).alias("xs"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["q_row", "query_id", "row", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.float64())], names=names)
        ids = left.column("id").fill_null(NO_ID).to_numpy()
        i, j, score = nearest_of(matrix(right.column("q"), width), right.column("q_row").to_numpy(), matrix(left.column("vector"), width), ids, left.column("row").to_numpy(), k)
        i, j = pa.array(i), pa.array(j)
        return pa.table([right.column("q_row").take(i), right.column("q_id").take(i), left.column("row").take(j), left.column("id").take(j), pa.array(score)], names=names)

    found = xs.groupBy("part", "xs", "qs").cogroup(qs.groupBy("part", "xs", "qs")).applyInArrow(meet, "q_row long, query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("q_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
