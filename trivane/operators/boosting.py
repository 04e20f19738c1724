"""Second-order gradient-boosted trees, learnt by Spark.

Quantile edges are found once and rows become bin codes, which are written with their margin. A level of a tree is one pass: each task walks its rows down the
tree as far as it has grown, sums gradients and Hessians by node, feature and bin, and those few sums are added by Spark.
The driver picks the splits from that table, whose size is nodes x features x bins whatever the rows. Trees that are newer than the written margins travel
with the pass; every few trees the margins are written anew. Sums are whole multiples of 2^-32, so that trees do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.operators.steps import written

#: Gradients and Hessians are whole multiples of 1 / FIXED.
FIXED = float(1 << 32)


@dataclass(frozen=True)
class BoostParams:
    """The reference set-up of trees, depth, rate, sampling and regularisation. rewrite: trees between two writes of the margins."""

    trees: int = 400
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.85
    columns: float = 0.85
    least_weight: float = 2.0
    penalty: float = 1.0
    gamma: float = 0.0
    bins: int = 256
    seed: int = 42
    rewrite: int = 8


@dataclass(frozen=True)
class Tree:
    """Node i sends codes <= cut[i] of feature[i] to 2 i + 1, others to 2 i + 2; feature -1 is a leaf (or not there) with its value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Node where each row's walk ends."""
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, 2 * at + 1 + (codes[rows, np.maximum(f, 0)] > self.cut[at]), at)


@dataclass(frozen=True)
class Forest:
    """edges[j]: ascending cuts of feature j; a value's code is the number of cuts below it."""

    edges: list[np.ndarray]
    trees: list[Tree]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16) if x.shape[1] else np.zeros(x.shape, np.int16)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes))
        for t in self.trees:
            total += t.value[t.place(codes)]
        return total


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) of each 64-bit key and the seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def quantile_edges(df: DataFrame, vector: str, width: int, bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """Distinct approximate quantiles of each component, at most bins - 1; the largest value is no cut."""
    shares = f"array({', '.join(f'{i / bins}D' for i in range(1, bins))})"
    found = df.agg(*[F.expr(f"percentile_approx({vector}[{j}], {shares}, {accuracy})").alias(f"e{j}") for j in range(width)], *[F.expr(f"max({vector}[{j}])").alias(f"m{j}") for j in range(width)]).first()
    return [np.array(sorted({float(v) for v in (found[f"e{j}"] or []) if v < found[f"m{j}"]})) for j in range(width)]


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss: (gradient, Hessian) as whole numbers of 1 / FIXED."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.rint((p - y) * FIXED).astype(np.int64), np.rint(np.maximum(p * (1 - p), 1e-16) * FIXED).astype(np.int64)


def level_sums(codes: np.ndarray, y: np.ndarray, margin: np.ndarray, keys: np.ndarray, tree: Tree, depth: int, features: list[int], number: int, bins: int, p: BoostParams) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian sums [node of the level, feature, bin] of one batch of rows."""
    first = (1 << depth) - 1
    g_all, h_all = (np.zeros(((first + 1) * len(features), bins), np.int64) for _ in range(2))
    node = tree.place(codes) - first
    use = np.flatnonzero((node >= 0) & (_mixed(keys, p.seed * 1_000_003 + number) < p.rows))
    if len(use):
        g, h = gradients(y[use], margin[use])
        for i, f in enumerate(features):
            slot = (node[use] * len(features) + i) * bins + codes[use, f]
            # bincount adds doubles: two halves keep the sums of a batch exact.
            for out, v in ((g_all, g), (h_all, h)):
                high = v >> 16
                out += (np.bincount(slot, high, out.size).astype(np.int64) * (1 << 16) + np.bincount(slot, v - (high << 16), out.size).astype(np.int64)).reshape(out.shape)
    return g_all.reshape(first + 1, len(features), bins), h_all.reshape(first + 1, len(features), bins)


def split_level(tree: Tree, depth: int, g: np.ndarray, h: np.ndarray, features: list[int], p: BoostParams) -> int:
    """Split the level's nodes and give their children values; number of splits. Of equal gains the first feature's lowest cut wins."""
    first, splits = (1 << depth) - 1, 0
    value = lambda gs, hs: -p.rate * gs / (hs + p.penalty)
    for node in range(g.shape[0]):
        at = first + node
        if at and tree.feature[(at - 1) // 2] < 0:
            continue
        gs, hs = g[node, 0].sum() / FIXED, h[node, 0].sum() / FIXED
        if not at:
            tree.value[0] = value(gs, hs)
        left_g, left_h = np.cumsum(g[node], 1)[:, :-1] / FIXED, np.cumsum(h[node], 1)[:, :-1] / FIXED
        right_g, right_h = gs - left_g, hs - left_h
        gain = (left_g**2 / (left_h + p.penalty) + right_g**2 / (right_h + p.penalty) - gs**2 / (hs + p.penalty)) / 2 - p.gamma
        gain[(left_h < p.least_weight) | (right_h < p.least_weight)] = 0
        gain = np.round(gain, 9)
        best = int(gain.argmax()) if gain.size else 0
        if gain.size and gain.flat[best] > 1e-6:
            i, cut = divmod(best, gain.shape[1])
            tree.feature[at], tree.cut[at] = features[i], cut
            tree.value[2 * at + 1], tree.value[2 * at + 2] = value(left_g[i, cut], left_h[i, cut]), value(right_g[i, cut], right_h[i, cut])
            splits += 1
    return splits


def columns_of(width: int, number: int, p: BoostParams) -> list[int]:
    """Features that a tree may use, at least one."""
    rng = np.random.default_rng([p.seed, number])
    return sorted(rng.permutation(width)[: max(1, int(p.columns * width))].tolist())


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int16).reshape(-1, width)
    return (codes, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))


def _coded(df: DataFrame, edges: list[np.ndarray], vector: str, label: str, key: str) -> DataFrame:
    """codes binary, y, margin double, key long."""
    width, forest = len(edges), Forest(edges, [])
    shared = df.sparkSession.sparkContext.broadcast(forest)  # features x bins numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            codes = shared.value.codes(x)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(np.zeros(len(x))), batch.column(2)], names=["codes", "y", "margin", "key"])

    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("key"))
    return rows.where(F.col("y").isNotNull() & (F.size("x") == width) & ~F.exists("x", lambda v: v.isNull())).mapInArrow(run, "codes binary, y double, margin double, key long")


def _sums(rows: DataFrame, tree: Tree, depth: int, features: list[int], number: int, fresh: list[Tree], width: int, bins: int, p: BoostParams) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast((tree, fresh))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, new = shared.value
        newer, total = Forest([], new), None
        for batch in batches:
            if batch.num_rows:
                codes, y, margin, keys = _read(batch, width)
                part = level_sums(codes, y, margin + newer.margins(codes), keys.astype(np.int64).view(np.uint64), own, depth, features, number, bins, p)
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            g, h = (t.ravel() for t in total)
            some = np.flatnonzero((g != 0) | (h != 0))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(g[some]), pa.array(h[some])], names=["slot", "g", "h"])

    found = rows.mapInArrow(run, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    shape = (1 << depth, len(features), bins)
    out = [np.zeros(shape, np.int64) for _ in range(2)]
    slot = found.column("slot").to_numpy()
    for a, c in zip(out, ("g", "h"), strict=True):
        a.ravel()[slot] = found.column(c).to_numpy()
    return out[0], out[1]


def boost(df: DataFrame, label: str, key: str, vector: str = "vec", params: BoostParams = BoostParams()) -> Forest:
    """Trees learnt from the rows of ``df`` with a label and a vector (array of numbers of one length without nulls); the first margin is 0.

    ``key`` chooses the rows of each tree by a hash. Rows that repeat count as often; one label only gives trees that lean to it; no rows give no trees.
    """
    p = params
    some = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.size(vector).alias("n")).first()
    if some is None:
        return Forest([], [])
    width = some["n"]
    edges = quantile_edges(df.where(F.col(label).isNotNull()), vector, width, p.bins)
    bins = max([len(e) for e in edges], default=0) + 1
    rows, forest, fresh = written(_coded(df, edges, vector, label, key), "codes"), Forest(edges, []), []
    for number in range(p.trees):
        tree, features = Tree.empty(p.depth), columns_of(width, number, p)
        for depth in range(p.depth):
            g, h = _sums(rows, tree, depth, features, number, fresh, width, bins, p)
            if not split_level(tree, depth, g, h, features, p):
                break
        forest.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == p.rewrite and number + 1 < p.trees:
            rows, fresh = written(_with_margins(rows, fresh, width), "codes"), []
    return forest


def _with_margins(rows: DataFrame, fresh: list[Tree], width: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, margin, _ = _read(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin + Forest([], shared.value).margins(codes)), batch.column(3)], names=["codes", "y", "margin", "key"])

    return rows.mapInArrow(run, rows.schema)


def with_probability(df: DataFrame, forest: Forest, vector: str = "vec", name: str = "p") -> DataFrame:
    """``df`` with the probability of label 1 (0.5 without trees)."""
    if not forest.trees:
        return df.withColumn(name, F.lit(0.5))
    shared, at, names = df.sparkSession.sparkContext.broadcast(forest), df.columns.index(vector), [*df.columns, name]
    width = len(forest.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            margin = shared.value.margins(shared.value.codes(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-margin)))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def importance(forest: Forest, names: list[str]) -> list[tuple[str, int]]:
    """Splits of each feature over all trees."""
    return [(n, int(sum((t.feature == i).sum() for t in forest.trees))) for i, n in enumerate(names)]

