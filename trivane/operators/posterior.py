"""Posterior probabilities from nearest neighbours: plain, kernel-weighted, with category penalties, per bucket.

Training rows are dealt to cells (the nearest of some pivots, or a bucket), a cell to parts of PART rows, its
queries to blocks. A query meets the parts of the cells that can hold a neighbour: by the triangle inequality, those
not farther than the distance within which the cells' radii promise k rows. A task compares one block with one
part by a matrix product in Arrow batches and keeps the k best of each query, so that no pair is a row before that.
Neither side passes through the driver. In few dimensions (nearby.LOW) the search is that of nearby.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trivane.functions.expressions import kernel
from trivane.operators import nearby
from trivane.operators.steps import written

#: Training rows of a part, queries of a block, and pivots at most (their vectors go to all tasks).
PART, QUERY_BLOCK, PIVOTS = 1 << 15, 1 << 13, 4096


def nearest(
    train: DataFrame, queries: DataFrame, k: int, train_id: str, query_id: str, vector: str = "vec", label: str = "y", categories: list[str] | None = None,
    category_weight: float = 0.0, digits: int = 12, answer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """query, neighbour, y, d, mismatches, rank: the k nearest training rows of each query by Euclidean distance, ties by id.

    With categories each one that differs (missing equals missing) adds category_weight to the distance. Ids are integers. Distances are
    rounded to ``digits`` places before they are ranked, so that ties do not depend on the order of sums. Rows without a vector
    neither ask nor answer; no training rows give no rows. With ``answer`` what it makes of these rows, query by query: in few dimensions it is asked once for equal queries.
    """
    t, q = _train(train, train_id, vector, label, categories or []), _queries(queries, query_id, vector, categories or [])
    t, q = written(t, "train"), written(q, "queries")
    some = t.first()
    if some is None or 0 < len(some["tv"]) <= nearby.LOW:
        return nearby.search(t.where(nearby.finite("tv")).withColumn("cell", F.lit(0)), q.where(nearby.finite("qv")).withColumn("cell", F.lit(0)), k, categories or [], category_weight, digits, answer)
    pivots = min(PIVOTS, -(-t.count() // PART))
    if pivots <= 1:
        t, q = t.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0))
    else:
        t, q = _by_pivot(t, q, pivots, k, category_weight * len(categories or []))
    found = _ranked(_meet(t, q, k, categories or [], category_weight, digits), k)
    return found if answer is None else answer(found)


def _train(df: DataFrame, id_col: str, vector: str, label: str, cats: list[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("tid"), F.col(label).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("tv"), *_filled(cats)).where("tv is not null")


def _queries(df: DataFrame, id_col: str, vector: str, cats: list[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("qv"), *_filled(cats)).where("qv is not null")


def _filled(cats: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias(c) for c in cats]


def _by_pivot(t: DataFrame, q: DataFrame, pivots: int, k: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with cell int: training rows once, queries once for each cell that may hold one of their k nearest.

    ``slack`` is the most that categories add to a distance.
    """
    centres = np.array([r["tv"] for r in t.select("tid", "tv").orderBy(F.xxhash64("tid"), "tid").limit(pivots).collect()], float)
    shared = t.sparkSession.sparkContext.broadcast(centres)

    def gaps(vectors: pd.Series, to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for lo in range(0, len(vectors), 1024):
            x = np.array(vectors.iloc[lo : lo + 1024].tolist(), float).reshape(-1, to.shape[1])
            d = np.maximum((x * x).sum(1)[:, None] + (to * to).sum(1)[None, :] - 2 * x @ to.T, 0)
            yield lo, np.sqrt(d)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, gap = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            for lo, d in gaps(frame["tv"], shared.value):
                cell[lo : lo + len(d)], gap[lo : lo + len(d)] = d.argmin(1), d.min(1)
            yield frame.assign(cell=cell, gap=gap)

    placed = written(t.mapInPandas(place, T.StructType([*t.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])), "placed")
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).orderBy("cell").collect()  # one row a pivot
    used = t.sparkSession.sparkContext.broadcast((centres[[r["cell"] for r in found]], np.array([r["cell"] for r in found]), np.array([r["n"] for r in found]), np.array([r["radius"] for r in found])))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, cell, n, radius = used.value
        for frame in frames:
            lists: list[list[int]] = []
            for _, d in gaps(frame["qv"], to):
                far = d + radius
                order = far.argsort(1)
                enough = np.minimum((n[order].cumsum(1) < k).sum(1), len(n) - 1)
                # The product's distances may be off in the last places.
                within = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1) + slack + 1e-6 * (1 + far.max())
                lists += [cell[use].tolist() for use in d - radius <= within]
            yield frame.assign(cells=lists)

    asked = q.mapInPandas(ask, T.StructType([*q.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    return placed.drop("gap"), asked.withColumn("cell", F.explode("cells")).drop("cells")


def _meet(t: DataFrame, q: DataFrame, k: int, cats: list[str], weight: float, digits: int) -> DataFrame:
    """query, neighbour, y, d, mismatches: the k best of every part for each of its cell's queries. Both sides are written first, as each is read twice."""
    t, q = written(t, "train"), written(q, "queries")
    parts = t.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    blocks = q.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    grid = parts.join(blocks, "cell")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(grid, "cell").withColumn("block", F.expr("cast(pmod(xxhash64(qid), blocks) as int)")).withColumn("part", each("parts")).drop("parts", "blocks")
    right = t.join(grid, "cell").withColumn("part", F.expr("cast(pmod(xxhash64(tid), parts) as int)")).withColumn("block", each("blocks")).drop("parts", "blocks")
    names = ["query", "neighbour", "y", "d", "mismatches"]

    def vectors(table: pa.Table, name: str) -> np.ndarray:
        column = table.column(name).combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))

    def best(asking: pa.Table, rows: pa.Table) -> pa.Table:
        if not asking.num_rows or not rows.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())], names=names)
        v, x = vectors(asking, "qv"), vectors(rows, "tv")
        tid, y, ids = rows.column("tid").to_numpy(), rows.column("y").to_numpy(), asking.column("qid").to_numpy()
        codes = [np.unique(np.concatenate([np.array(side.column(c).to_pylist(), object) for side in (asking, rows)]), return_inverse=True)[1] for c in cats]
        out = [_nearest_rows(v[i : i + 256], x, tid, k, [(c[: len(v)][i : i + 256], c[len(v) :]) for c in codes], weight, digits) for i in range(0, len(v), 256)]
        at, d, miss = (np.concatenate(z) for z in zip(*out, strict=True))
        per = min(k, len(x))
        return pa.table([pa.array(np.repeat(ids, per)), pa.array(tid[at]), pa.array(y[at]), pa.array(d), pa.array(miss.astype(np.int32))], names=names)

    keys, tasks = ["cell", "block", "part"], int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes are much work here: a number of partitions that is asked for is not made smaller at run time.
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query bigint, neighbour bigint, y double, d double, mismatches int")


def _nearest_rows(v: np.ndarray, x: np.ndarray, tid: np.ndarray, k: int, codes: list[tuple[np.ndarray, np.ndarray]], weight: float, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, distance, mismatches) of the min(k, rows) best rows of each v, v by v.

    A matrix product finds candidates fast; after the first block only those that may be nearer than the k-th best so far
    are looked at again, and their distances summed exactly.
    """
    n, size, norm = len(v), max(2048, 4 * k), (v * v).sum(1)
    at, d, miss, of = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bound = np.full(n, np.inf)
    for lo in range(0, len(x), size):
        w = x[lo : lo + size]
        square = norm[:, None] + (w * w).sum(1)[None, :] - 2 * v @ w.T
        slack = 1e-9 * (1 + norm.max(initial=0) + float((w * w).sum(1).max(initial=0)))
        wrong = np.zeros(square.shape, np.int64) if codes else None
        for a, b in codes:
            wrong += a[:, None] != b[None, lo : lo + size]
        if np.isinf(bound).all() and len(w) > k:
            rough = np.sqrt(np.maximum(square, 0)) + weight * wrong if codes else square
            reach = np.partition(rough, k - 1, 1)[:, k - 1]
            near = rough <= reach[:, None] + (np.sqrt(slack) if codes else slack)
        elif codes:
            near = np.sqrt(np.maximum(square - slack, 0)) + weight * wrong <= bound[:, None]
        else:
            near = square <= (bound * bound)[:, None] + slack
        i, j = np.nonzero(near)
        if not len(i):
            continue
        gap = v[i] - w[j]
        extra = wrong[i, j] if codes else np.zeros(len(i), np.int64)
        exact = np.round(np.sqrt((gap * gap).sum(1)) + weight * extra, digits)
        of, at, d, miss = np.concatenate((of, i)), np.concatenate((at, lo + j)), np.concatenate((d, exact)), np.concatenate((miss, extra))
        order = np.lexsort((tid[at], d, of))
        of, at, d, miss = of[order], at[order], d[order], miss[order]
        first = np.searchsorted(of, np.arange(n))
        keep = np.arange(len(of)) - first[of] < k
        of, at, d, miss = of[keep], at[keep], d[keep], miss[keep]
        count = np.bincount(of, minlength=n)
        full = np.flatnonzero(count >= k)
        last = np.cumsum(count) - 1
        # Distances are rounded: an equal one may still win by its id.
        bound[full] = d[last[full]] + 2 * 10.0**-digits
    return at, d, miss


def nearest_in_cells(train: DataFrame, queries: DataFrame, k: int, digits: int = 12, answer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query, neighbour, y, d, mismatches, rank: the k nearest rows of train(tid, y, tv, cell) for each of queries(qid, qv, cell) in its own cell, or ``answer`` of them. Ids of queries are unique.

    Both sides are read some times over: they should be tables. Vectors are finite throughout.
    """
    some = train.first()
    if some is None or 0 < len(some["tv"]) <= nearby.LOW:
        return nearby.search(train, queries, k, [], 0.0, digits, answer)
    found = _ranked(_meet(train, queries, k, [], 0.0, digits), k)
    return found if answer is None else answer(found)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def clipped(p: Column, lo: float = 0.01, hi: float = 0.99) -> Column:
    return F.least(F.greatest(p, F.lit(lo)), F.lit(hi))


def counted_posterior(neighbours: DataFrame) -> DataFrame:
    """query, p: (positives + 1) / (k + 2), held to [0.01, 0.99]."""
    return neighbours.groupBy("query").agg(clipped((F.sum("y") + 1) / (F.count("*") + 2)).alias("p"))


@dataclass(frozen=True)
class KernelParams:
    """bandwidth, or scale times the distance of the farthest neighbour (1e-6 at least). penalty multiplies the weight for each category that differs."""

    name: str = "gaussian"
    bandwidth: float | None = None
    scale: float = 1.0
    penalty: float = 1.0


def kernel_posterior(neighbours: DataFrame, params: KernelParams = KernelParams()) -> DataFrame:
    """query, p: (S+ + 1) / (S+ + S- + 2) of the kernel weights, held to [0.01, 0.99]. If all weights of a query are zero they are one."""
    by = Window.partitionBy("query")
    h = F.lit(params.bandwidth) if params.bandwidth is not None else F.greatest(F.max("d").over(by) * params.scale, F.lit(1e-6))
    w = neighbours.withColumn("w", kernel(params.name, F.col("d") / h))
    w = w.withColumn("w", F.when(F.sum("w").over(by) <= 0, 1.0).otherwise(F.col("w")))
    penalty = min(max(params.penalty, 0.0), 1.0)
    if penalty < 1:
        w = w.withColumn("w", F.col("w") * F.pow(F.lit(max(penalty, 1e-3)), F.col("mismatches")))
    return w.groupBy("query").agg(clipped((F.sum(F.col("w") * F.col("y")) + 1) / (F.sum("w") + 2)).alias("p"))


def mean_posterior(neighbours: DataFrame) -> DataFrame:
    """query, p: mean label of the neighbours, not smoothed."""
    return neighbours.groupBy("query").agg(F.avg("y").alias("p"))


def with_default(queries: DataFrame, posterior: DataFrame, query_id: str) -> DataFrame:
    """Queries without a posterior (no training rows) have 0.5."""
    return queries.select(F.col(query_id).cast("long").alias("query")).join(posterior, "query", "left").select("query", F.coalesce("p", F.lit(0.5)).alias("p"))


def cap_buckets(train: DataFrame, bucket: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each bucket, chosen by MD5 of key and seed."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return train.withColumn("__r", F.row_number().over(Window.partitionBy(bucket).orderBy(h, key))).where(F.col("__r") <= most).drop("__r")


def nearest_in_bucket(train: DataFrame, queries: DataFrame, k: int, train_id: str, query_id: str, bucket: str, columns: list[str], label: str = "y", least: int = 1, most: int = 50_000, fallback: DataFrame | None = None) -> DataFrame:
    """query, p, source ('bucket' or 'global'): mean label of the k nearest capped training rows of the query's bucket; of all capped rows (or of the rows in ``fallback``) if the bucket has fewer than ``least``.

    A bucket has at most ``most`` training rows. Buckets are the cells of the search, so both sides are split where a bucket is large.
    """
    vec = lambda df: df.withColumn("vec", F.array(*[F.col(c).cast("double") for c in columns]))
    t = written(cap_buckets(train, bucket, train_id, most), "capped")
    known = t.groupBy(bucket).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(bucket)
    own_t = vec(t).select(F.col(train_id).cast("long").alias("tid"), F.col(label).cast("double").alias("y"), F.col("vec").alias("tv"), F.col(bucket).alias("cell"))
    own_q = vec(queries.join(known, bucket, "left_semi")).select(F.col(query_id).cast("long").alias("qid"), F.col("vec").alias("qv"), F.col(bucket).alias("cell"))
    own = nearest_in_cells(own_t.where(nearby.finite("tv")), written(own_q.where(nearby.finite("qv")), "queries"), k, 9, mean_posterior).withColumn("source", F.lit("bucket"))
    rest = written(vec(queries.join(known, bucket, "left_anti")), "rest")
    if rest.isEmpty():
        return own
    other = nearest(vec(t if fallback is None else fallback).withColumn("y", F.col(label)), rest, k, train_id, query_id, digits=9, answer=mean_posterior).withColumn("source", F.lit("global"))
    return own.unionByName(other)


@dataclass(frozen=True)
class NeighbourTable:
    """The k nearest training rows of fixed queries, kept up as training rows arrive.

    New rows meet all queries once; what they give is a segment of at most k rows a query, and the answer is the k best over the segments. Without ``keep``
    a new segment is merged with the one before, so that there is one table of k rows a query; with it the newest ``keep`` segments stay
    apart and the oldest is dropped whole (a sliding history). Work is in proportion to the new rows, whatever has been learnt before.
    """

    queries: DataFrame
    k: int
    train_id: str
    query_id: str
    label: str = "y"
    vector: str = "vec"
    categories: tuple[str, ...] = ()
    category_weight: float = 0.0
    digits: int = 12
    keep: int | None = None
    segments: tuple[DataFrame, ...] = ()

    def add(self, rows: DataFrame) -> NeighbourTable:
        """The table after ``rows``, whose ids are new."""
        found = nearest(rows, self.queries, self.k, self.train_id, self.query_id, self.vector, self.label, list(self.categories), self.category_weight, self.digits)
        if self.keep is not None:
            return replace(self, segments=(*self.segments, written(found, "segment"))[-self.keep :])
        merged = _best_of([*self.segments, found], self.k) if self.segments else found
        return replace(self, segments=(written(merged, "segment"),))

    def neighbours(self) -> DataFrame:
        """query, neighbour, y, d, mismatches, rank, as nearest() over all rows that count."""
        if not self.segments:
            raise ValueError("no rows yet")
        return _best_of(list(self.segments), self.k) if len(self.segments) > 1 else self.segments[0]


def _best_of(segments: list[DataFrame], k: int) -> DataFrame:
    all_ = segments[0]
    for s in segments[1:]:
        all_ = all_.unionByName(s)
    return _ranked(all_.drop("rank"), k)


@dataclass
class PosteriorBuffer:
    """Training rows of a posterior that follows a stream: the newest ``size`` rows (sliding), or a keyed hash sample of all (reservoir).

    A sliding buffer is a list of segments, one a batch: only the new batch is written, and a segment that has no row left is dropped whole. Brute-force search needs
    no index, so a rebuild is a new choice of rows. ``interval`` rows between rebuilds shrink after drift. ``estimator`` (rows, queries, query id ->
    query, p) takes the place of the neighbours' kernel posterior where a user has another one.
    """

    size: int = 8192
    interval: int = 512
    policy: str = "sliding"
    rows: DataFrame | None = None
    since: int = 0
    rebuilds: int = 0
    frozen: DataFrame | None = field(default=None, repr=False)
    shrink: float = 0.5
    least_interval: int = 1
    estimator: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None
    segments: tuple[tuple[DataFrame, int], ...] = ()

    def add(self, batch: DataFrame, order: str, drift: bool = False) -> PosteriorBuffer:
        """``order`` must rise from batch to batch."""
        batch = written(batch, "batch")
        new = batch.count()
        segments = self.segments
        if self.policy == "sliding":
            segments = (*segments, (batch, new))
            while len(segments) > 1 and sum(n for _, n in segments[1:]) >= self.size:
                segments = segments[1:]
            rest = self.size - sum(n for _, n in segments[1:])
            oldest, n = segments[0]
            kept = oldest if n <= rest else oldest.orderBy(F.desc(order)).limit(rest)
            for s, _ in segments[1:]:
                kept = kept.unionByName(s)
        else:
            all_ = batch if self.rows is None else self.rows.unionByName(batch)
            kept = written(all_.orderBy(F.md5(F.col(order).cast("string")), order).limit(self.size), "buffer")
        n = self.since + new
        interval = max(self.least_interval, int(self.interval * self.shrink)) if drift else self.interval
        rebuild = drift or n >= interval or self.frozen is None
        return replace(self, rows=kept, since=0 if rebuild else n, rebuilds=self.rebuilds + rebuild, frozen=kept if rebuild else self.frozen, segments=segments)

    def predict(self, queries: DataFrame, k: int, train_id: str, query_id: str, params: KernelParams = KernelParams()) -> DataFrame:
        if self.frozen is None:
            raise ValueError("no rows yet")
        if self.estimator is not None:
            return with_default(queries, self.estimator(self.frozen, queries, query_id), query_id)
        return with_default(queries, kernel_posterior(nearest(self.frozen, queries, k, train_id, query_id), params), query_id)
