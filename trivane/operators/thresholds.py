"""Threshold search, smoothing and adaptation.

A search never evaluates row by row and pair by pair: rows are counted once by the
place of their probability among the grid's thresholds, which leaves a table of at most a few
hundred rows, and every pair is a sum over that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.functions.expressions import region
from trivane.operators.steps import written
from trivane.operators.threeway import ObjectiveParams


def grid_range(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to stop (half a step further at most), held to [0, 1]; ends may come in either order."""
    if step <= 0:
        raise ValueError("step must be positive")
    lo, hi = min(start, stop), max(start, stop)
    n = int(math.floor((hi + step / 2 - lo) / step - 1e-12)) + 1
    return [round(min(max(lo + i * step, 0.0), 1.0), 10) for i in range(max(n, 0))]


def limit_range(values: list[float], centre: float, radius: float) -> list[float]:
    """The values within radius of the centre, or the nearest one if there is none."""
    near = [v for v in values if abs(v - centre) <= radius + 1e-12]
    return near or [min(values, key=lambda v: (abs(v - centre), v))]


@dataclass(frozen=True)
class Grid:
    alphas: tuple[float, ...] = tuple(grid_range(0.5, 0.92, 0.025))
    betas: tuple[float, ...] = tuple(grid_range(0.0, 0.4, 0.02))
    gap: float = 0.05
    min_coverage: float = 0.0
    max_bnd: float = 1.0
    objective: str = "cost"
    c_fn: float = 1.0
    c_fp: float = 1.0
    c_bnd: float = 0.5
    fbeta: float = 1.0


def _place(p: Column, grid: Grid) -> dict[str, Column]:
    """Number of alphas the value reaches, and of betas it does not exceed."""
    count = lambda values, test: F.size(F.filter(F.array(*[F.lit(float(v)) for v in sorted(set(values))]), test))
    return {"ia": count(grid.alphas, lambda v: v <= p), "ib": count(grid.betas, lambda v: v >= p)}


def grid_counts(probs: DataFrame, grid: Grid, keys: list[str], pos: str = "p_pos", neg: str = "p_neg", bnd: str = "p_bnd") -> DataFrame:
    """keys, ia, ib, n, s_pos, s_neg, s_bnd: the only pass over the rows."""
    return probs.groupBy(*keys, *[c.alias(k) for k, c in _place(F.col(pos), grid).items()]).agg(F.count("*").alias("n"), F.sum(pos).alias("s_pos"), F.sum(neg).alias("s_neg"), F.sum(bnd).alias("s_bnd"))


def grid_scores(probs: DataFrame, grid: Grid, keys: list[str] | None = None, pos: str = "p_pos", neg: str = "p_neg", bnd: str = "p_bnd") -> DataFrame:
    """keys, alpha, beta, score, coverage, bnd_ratio, feasible for every pair of the grid. score is the cost, or minus F-beta."""
    keys = keys or []
    cells = grid_counts(probs, grid, keys, pos, neg, bnd)
    a, b = sorted(set(grid.alphas)), sorted(set(grid.betas))
    pairs = [(float(x), i + 1, float(y), len(b) - j) for i, x in enumerate(a) for j, y in enumerate(b)]
    table = probs.sparkSession.createDataFrame(pairs, "alpha double, need_a int, beta double, need_b int")
    joined = cells.join(F.broadcast(table), F.lit(True))
    # A value reaches alpha number i if it reaches at least i of them, and is at most beta number j if it is at most all from j on.
    is_pos, is_neg = F.col("ia") >= F.col("need_a"), F.col("ib") >= F.col("need_b")
    is_bnd = ~is_pos & ~is_neg
    s = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0.0))
    n = F.greatest(F.sum("n"), F.lit(1))
    sums = joined.groupBy(*keys, "alpha", "beta").agg(
        s(is_neg, "s_pos").alias("fn"), s(is_pos, "s_neg").alias("fp"), s(is_pos, "s_pos").alias("tp"), s(is_bnd, "s_bnd").alias("bd"),
        (s(is_pos, "n") / n).alias("coverage"), (s(is_bnd, "n") / n).alias("bnd_ratio"), n.alias("rows"),
    )
    if grid.objective == "cost":
        score = (grid.c_fn * F.col("fn") + grid.c_fp * F.col("fp") + grid.c_bnd * F.col("bd")) / F.col("rows")
    else:
        floor = lambda x: F.greatest(x, F.lit(1e-6))
        p, r, b2 = F.col("tp") / floor(F.col("tp") + F.col("fp")), F.col("tp") / floor(F.col("tp") + F.col("fn")), grid.fbeta**2
        score = -(1 + b2) * p * r / floor(b2 * p + r)
    feasible = (F.col("alpha") >= F.col("beta") + grid.gap - 1e-12) & (F.col("coverage") >= grid.min_coverage) & (F.col("bnd_ratio") <= grid.max_bnd)
    return sums.select(*keys, "alpha", "beta", score.alias("score"), "coverage", "bnd_ratio", feasible.alias("feasible"))


def select_alpha_beta(probs: DataFrame, grid: Grid = Grid(), keys: list[str] | None = None, digits: int = 12, **columns) -> DataFrame:
    """keys, alpha, beta, best, second, delta, feasible_count: the feasible pair of the least score, of equal ones the least alpha, then beta.

    Scores are compared to ``digits`` places. Without a feasible pair: the greatest alpha and the greatest beta that leaves the gap.
    """
    keys = keys or []
    scored = grid_scores(probs, grid, keys, **columns).withColumn("score", F.round("score", digits))
    order = Window.partitionBy(*keys).orderBy((~F.col("feasible")).cast("int"), "score", "alpha", "beta")
    ranked = scored.withColumn("r", F.row_number().over(order)).where("r <= 2 or feasible")
    first, second = (F.max(F.when((F.col("r") == i) & F.col("feasible"), F.struct("score", "alpha", "beta"))) for i in (1, 2))
    out = ranked.groupBy(*keys).agg(first.alias("x"), second.alias("y"), F.sum(F.col("feasible").cast("int")).cast("int").alias("feasible_count"))
    a = max(grid.alphas)
    return out.select(
        *keys, F.coalesce("x.alpha", F.lit(a)).alias("alpha"), F.coalesce("x.beta", F.lit(min(max(grid.betas), a - grid.gap))).alias("beta"),
        F.col("x.score").alias("best"), F.col("y.score").alias("second"), (F.col("y.score") - F.col("x.score")).alias("delta"), "feasible_count",
    )


def ema_clip(raw: float, previous: float | None, rate: float, cap: float) -> float:
    """Exponential average with the previous value, its step held to cap and itself to [0, 1]; the first passes."""
    if previous is None:
        return raw
    step = min(max(rate * raw + (1 - rate) * previous - previous, -cap), cap)
    return min(max(previous + step, 0.0), 1.0)


def ema_clip_trace(windows: DataFrame, order: str, values: list[str], rate: float, cap: float) -> DataFrame:
    """order, values and value_smoothed of one row a window. Windows number as many as months, so one fold over their array is bounded."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[F.col(v).cast("double").alias(v) for v in values])))
    kind = ", ".join(f"{v}: double" for v in values)
    start = F.array().cast(f"array<struct<{order}: {windows.schema[order].dataType.simpleString()}, {kind}, {', '.join(f'{v}_smoothed: double' for v in values)}>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))

        def smooth(v):
            prev = last[f"{v}_smoothed"]
            move = F.least(F.greatest(rate * x[v] + (1 - rate) * prev - prev, F.lit(-cap)), F.lit(cap))
            return F.when(prev.isNull(), x[v]).otherwise(F.least(F.greatest(prev + move, F.lit(0.0)), F.lit(1.0))).alias(f"{v}_smoothed")

        return F.concat(acc, F.array(F.struct(x[order].alias(order), *[x[v].alias(v) for v in values], *[smooth(v) for v in values])))

    return windows.agg(rows.alias("r")).select(F.explode(F.aggregate("r", start, step)).alias("w")).select("w.*")


def enforce_gap(alpha: float, beta: float, gap: float) -> tuple[float, float]:
    """Thresholds at least gap apart around their middle, in [0, 0.999]."""
    if alpha - beta < gap:
        middle = (alpha + beta) / 2
        alpha, beta = middle + gap / 2, middle - gap / 2
    return min(max(alpha, 0.0), 0.999), min(max(beta, 0.0), 0.999)


def enforce_gap_columns(alpha, beta, gap: float) -> tuple[Column, Column]:
    a, b = F.col(alpha), F.col(beta)
    near, middle = a - b < gap, (a + b) / 2
    hold = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(0.999))
    return hold(F.when(near, middle + gap / 2).otherwise(a)), hold(F.when(near, middle - gap / 2).otherwise(b))


def running_median(windows: DataFrame, order: str, value: str, last: int, name: str = "median") -> DataFrame:
    """Add the median of the last ``last`` windows, this one included."""
    return windows.withColumn(name, F.expr(f"percentile({value}, 0.5) over (order by {order} rows between {last - 1} preceding and current row)"))


def rule_thresholds(df: DataFrame, keys: list[str], label: str, p: str, q_pos: float = 0.7, q_neg: float = 0.3, least: int = 0) -> DataFrame:
    """keys, n, alpha, beta: the q_pos quantile of the positives and the q_neg quantile of the negatives (of all rows if there are none), for keys with ``least`` rows or more."""
    pos, neg = F.when(F.col(label) == 1, F.col(p)), F.when(F.col(label) == 0, F.col(p))
    q = lambda c, x: F.percentile(c, F.lit(x))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(q(pos, q_pos), q(F.col(p), q_pos), F.lit(0.7)).alias("alpha"), F.coalesce(q(neg, q_neg), q(F.col(p), q_neg), F.lit(0.3)).alias("beta")
    )
    return out.where(F.col("n") >= least)


def blend(prior: tuple[float, float] | None, now: tuple[float, float], weight: float, gap: float) -> tuple[float, float]:
    if prior is None:
        return enforce_gap(*now, gap)
    return enforce_gap(*(weight * a + (1 - weight) * b for a, b in zip(prior, now, strict=True)), gap)


def learn_global(df: DataFrame, year: str, label: str, p: str, quantiles=(0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95), weights=(1.0, 1.0, 1.0, 1.0), target: float = 0.2, bnd: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """alpha, beta, score, mean_F1, mean_BAC, mean_BND, var_F1 for pairs of quantiles of p, best first.

    score = w1 F1 + w2 BAC - w3 |BND - target| - w4 var(F1) over years. Rows are counted once by year, label
    and place among the candidates.
    """
    cuts = sorted(set(df.agg(F.expr(f"percentile(`{p}`, array({', '.join(map(str, quantiles))}))").alias("q")).first()["q"]))
    grid = Grid(alphas=tuple(cuts), betas=tuple(cuts))
    cells = df.groupBy(year, label, *[c.alias(k) for k, c in _place(F.col(p), grid).items()]).agg(F.count("*").alias("n"))
    pairs = [(float(x), i + 1, float(y), len(cuts) - j) for i, x in enumerate(cuts) for j, y in enumerate(cuts) if x > y]
    table = df.sparkSession.createDataFrame(pairs or [], "alpha double, need_a int, beta double, need_b int")
    j = cells.join(F.broadcast(table), F.lit(True))
    pos, neg, y = F.col("ia") >= F.col("need_a"), F.col("ib") >= F.col("need_b"), F.col(label) == 1
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("double")
    t = j.groupBy(year, "alpha", "beta").agg(s(y & pos).alias("tp"), s(~y & pos).alias("fp"), s(y & ~pos).alias("fn"), s(~y & ~pos).alias("tn"), s(~pos & ~neg).alias("bd"), F.sum("n").alias("n"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, special = div(F.col("tp"), F.col("tp") + F.col("fn")), div(F.col("tn"), F.col("tn") + F.col("fp"))
    both = ((F.col("tp") + F.col("fn")) > 0) & ((F.col("tn") + F.col("fp")) > 0)
    per = t.select(year, "alpha", "beta", div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("F1"), F.when(both, (recall + special) / 2).otherwise(recall + special).alias("BAC"), (F.col("bd") / F.col("n")).alias("BND"))
    m = per.groupBy("alpha", "beta").agg(F.avg("F1").alias("mean_F1"), F.avg("BAC").alias("mean_BAC"), F.avg("BND").alias("mean_BND"), F.coalesce(F.var_pop("F1"), F.lit(0.0)).alias("var_F1"))
    score = weights[0] * F.col("mean_F1") + weights[1] * F.col("mean_BAC") - weights[2] * F.abs(F.col("mean_BND") - target) - weights[3] * F.col("var_F1")
    return m.where(F.col("mean_BND").between(*bnd)).select("alpha", "beta", score.alias("score"), "mean_F1", "mean_BAC", "mean_BND", "var_F1").orderBy(F.desc("score"), "alpha", "beta")


# ---- searches that step on the driver, each step one aggregation ---------------------


@dataclass(frozen=True)
class SwarmParams:
    particles: int = 20
    rounds: int = 20
    w_max: float = 0.9
    w_min: float = 0.4
    c1: float = 1.4
    c2: float = 1.4
    seed: int = 42
    stall: int = 0
    learn_gamma: bool = False


def _chain(x: np.ndarray, layers: int) -> np.ndarray:
    """Alphas do not rise and betas do not fall from layer to layer; all in [0, 1]."""
    x = np.clip(x, 0, 1)
    x[:, :layers] = np.minimum.accumulate(x[:, :layers], axis=1)
    x[:, layers : 2 * layers] = np.maximum.accumulate(x[:, layers : 2 * layers], axis=1)
    return x


@dataclass
class SwarmResult:
    alphas: list[float]
    betas: list[float]
    gamma: float
    fitness: float
    history: list[float] = field(default_factory=list)


def _swarm_steps(layers: int, params: SwarmParams, start: np.ndarray | None) -> Generator[np.ndarray, np.ndarray, SwarmResult]:
    """Yields the particles of each round and takes their fitness."""
    rng = np.random.default_rng(params.seed)
    dims = 2 * layers + 1
    x = np.hstack((rng.uniform(0.5, 0.95, (params.particles, layers)), rng.uniform(0.05, 0.5, (params.particles, layers)), rng.uniform(0.3, 0.7, (params.particles, 1))))
    if start is not None:
        x[0] = start
    if not params.learn_gamma:
        x[:, -1] = 0.5 if start is None else start[-1]
    x = _chain(x, layers)
    v = np.zeros((params.particles, dims))
    own, own_f = x.copy(), np.full(params.particles, np.inf)
    history: list[float] = []
    quiet = 0
    for r in range(params.rounds):
        f = yield x
        better = f < own_f
        own[better], own_f[better] = x[better], f[better]
        best = own[own_f.argmin()]
        quiet = quiet + 1 if history and own_f.min() >= history[-1] - 1e-9 else 0
        history.append(float(own_f.min()))
        if params.stall and quiet >= params.stall:
            break
        w = params.w_max - (params.w_max - params.w_min) * r / max(1, params.rounds - 1)
        v = w * v + params.c1 * rng.random(x.shape) * (own - x) + params.c2 * rng.random(x.shape) * (best - x)
        if not params.learn_gamma:
            v[:, -1] = 0
        x = _chain(x + v, layers)
    b = own[own_f.argmin()]
    return SwarmResult(b[:layers].tolist(), b[layers : 2 * layers].tolist(), float(b[-1]), float(own_f.min()), history)


def swarms(fitness: Callable[[dict[object, np.ndarray]], dict[object, np.ndarray]], groups: list, layers: int, params: SwarmParams = SwarmParams(), starts: dict | None = None) -> dict[object, SwarmResult]:
    """A particle swarm for each group, all in step: ``fitness`` gets the particles of every group that is not done yet and gives theirs, to be minimised."""
    running = {g: _swarm_steps(layers, params, (starts or {}).get(g)) for g in groups}
    asked = {g: next(s) for g, s in running.items()}
    out: dict[object, SwarmResult] = {}
    while asked:
        found, now = fitness(asked), {}
        for g in asked:
            try:
                now[g] = running[g].send(found[g])
            except StopIteration as end:
                out[g] = end.value
        asked = now
    return out


def swarm(fitness: Callable[[np.ndarray], np.ndarray], layers: int, params: SwarmParams = SwarmParams(), start: np.ndarray | None = None) -> SwarmResult:
    """Particle swarm for ``fitness`` of rows (alphas, betas, gamma), minimised."""
    return swarms(lambda x: {0: fitness(x[0])}, [0], layers, params, {} if start is None else {0: start})[0]


#: Regrets are summed as whole multiples of 1 / FIXED. Sums of a layer: counts of label 1 and 0 accepted, deferred and rejected, regret of false accepts and false rejects, counts of label 1 and 0.
FIXED, SLOTS = float(1 << 24), 10


def _layer_sums(p: np.ndarray, y: np.ndarray, n: np.ndarray, alphas: np.ndarray, betas: np.ndarray, measure: ObjectiveParams) -> np.ndarray:
    """[particle, slot] over counted cells: rows are sorted once, and each pair of thresholds is two places in the order."""
    known = ~np.isnan(p)
    order = np.argsort(p[known], kind="stable")
    q, one, m = p[known][order], y[known][order] == 1, n[known][order]
    up = (1 - np.exp(-measure.theta_pos * np.maximum(2 * q - 1, 0))) ** measure.theta_pos
    un = (1 - np.exp(-measure.theta_neg * np.maximum(1 - 2 * q, 0))) ** measure.theta_neg
    regret = lambda d: np.rint((1 - np.exp(-measure.sigma * np.maximum(d, 0))) * FIXED).astype(np.int64)
    run = lambda v: np.concatenate(([0], np.cumsum(v)))
    n1, n0 = run(np.where(one, m, 0)), run(np.where(one, 0, m))
    false_up, false_down = run(np.where(one, 0, m * regret(un - up))), run(np.where(one, m * regret(up - un), 0))
    a, b = np.searchsorted(q, alphas, "left"), np.searchsorted(q, betas, "right")
    b = np.minimum(a, b)  # what both thresholds take is accepted
    end = len(q)
    parts = [n1[end] - n1[a], n1[a] - n1[b], n1[b], n0[end] - n0[a], n0[a] - n0[b], n0[b], false_up[end] - false_up[a], false_down[b]]
    whole = [np.full(len(a), n[y == 1].sum()), np.full(len(a), n[y != 1].sum())]
    return np.stack([*parts, *whole], 1).astype(np.int64)


def objective_sums(cells: DataFrame, by: str, levels: list[str], label: str, count: str, particles: dict[object, np.ndarray], measure: ObjectiveParams) -> dict[object, np.ndarray]:
    """[particle, layer, slot] of each group: tasks sum their cells by particle, Spark adds those few sums. Particles and groups are few (they travel to all tasks)."""
    shared = cells.sparkSession.sparkContext.broadcast(particles)
    kind, layers = cells.schema[by].dataType.simpleString(), len(levels) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), object)
            y, n = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            ps = [batch.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(layers + 1)]
            for g in dict.fromkeys(groups.tolist()):
                x, rows = shared.value.get(g), groups == g
                if x is None:
                    continue
                own = [_layer_sums(p[rows], y[rows], n[rows], x[:, i] if i < layers else x[:, -1], x[:, layers + i] if i < layers else np.nextafter(x[:, -1], -np.inf), measure) for i, p in enumerate(ps)]
                total[g] = total.get(g, 0) + np.stack(own, 1)
        for g, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * t.size, batch.column(0).type), pa.array(np.arange(t.size)), pa.array(t.ravel())], names=["g", "slot", "v"])

    rows = cells.where(F.col(label).isNotNull()).select(by, F.col(label).cast("int").alias("y"), F.col(count).cast("long").alias("n"), *[F.col(p).cast("double") for p in levels])
    found = rows.mapInArrow(run, f"g {kind}, slot long, v long").groupBy("g", "slot").agg(F.sum("v").alias("v")).collect()
    out = {g: np.zeros(len(x) * (layers + 1) * SLOTS, np.int64) for g, x in particles.items()}
    for r in found:
        out[r["g"]][r["slot"]] = r["v"]
    return {g: v.reshape(len(particles[g]), layers + 1, SLOTS) for g, v in out.items()}


def objective_of_sums(sums: np.ndarray, x: np.ndarray, q: ObjectiveParams = ObjectiveParams()) -> np.ndarray:
    """The objective of each particle from its sums."""
    layers = sums.shape[1] - 1
    s = sums.astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) > 0)

    def entropy(w1: np.ndarray, w0: np.ndarray) -> np.ndarray:
        a, b = share(w1, w1 + w0), share(w0, w1 + w0)
        return -sum(v * np.log2(v, out=np.zeros(v.shape), where=v > 0) for v in (a, b))

    def regret(t: np.ndarray) -> np.ndarray:
        if q.regret == "utility":
            fp, fn = share(t[:, 6] / FIXED, t[:, 3]), share(t[:, 7] / FIXED, t[:, 2])
            return q.theta_pos * fp + q.theta_neg * fn
        bend = lambda v: 1 - np.exp(-q.sigma * v)
        return q.theta_pos * bend(share(t[:, 3], t[:, 0] + t[:, 3])) + q.theta_neg * bend(share(t[:, 2], t[:, 2] + t[:, 5]))

    total = regret(s[:, layers])
    for i in range(layers):
        t, c = s[:, i], (q.c1, q.c0)
        w1, w0 = c[0] * t[:, 8], c[1] * t[:, 9]
        gain = entropy(w1, w0)
        for k in range(3):
            a, b = c[0] * t[:, k], c[1] * t[:, 3 + k]
            gain = gain - share(a + b, w1 + w0) * entropy(a, b)
        deferred = share(t[:, 1] + t[:, 4], t[:, 8] + t[:, 9])
        total = total - gain + regret(t) + np.where(deferred < q.xi_min, q.penalty_large, 0) + np.where(x[:, i] < x[:, layers + i] + q.gap, q.penalty_large, 0)
    return total


def learn_thresholds_by(df: DataFrame, by: str, levels: list[str], label: str, params: SwarmParams = SwarmParams(), measure: ObjectiveParams = ObjectiveParams(), starts: dict | None = None) -> dict[object, SwarmResult]:
    """A swarm over the three-way objective for each value of ``by`` (few, none null), all in step: a round is one pass over counted cells and one small sum. Rows without a label do not count."""
    cells = written(df.groupBy(by, label, *levels).agg(F.count("*").alias("__n")), "cells")
    groups = sorted(r[0] for r in cells.select(by).distinct().collect())

    def fitness(x: dict[object, np.ndarray]) -> dict[object, np.ndarray]:
        sums = objective_sums(cells, by, levels, label, "__n", x, measure)
        return {g: objective_of_sums(sums[g], x[g], measure) for g in x}

    return swarms(fitness, groups, len(levels) - 1, params, starts)


def learn_thresholds(df: DataFrame, levels: list[str], label: str, params: SwarmParams = SwarmParams(), measure: ObjectiveParams = ObjectiveParams(), start: np.ndarray | None = None) -> SwarmResult:
    """The same over all rows, as one group."""
    found = learn_thresholds_by(df.withColumn("__all", F.lit(0)), "__all", levels, label, params, measure, {} if start is None else {0: start})
    return found[0] if found else swarm(lambda x: np.zeros(len(x)), len(levels) - 1, params, start)


def adapt_windowed(df: DataFrame, levels: list[str], label: str, p: str, previous: SwarmResult | None, params: SwarmParams = SwarmParams(), least: int = 30) -> SwarmResult:
    """Swarm held to the window's size (particles and rounds), starting from the last thresholds; too small a window goes by the rule."""
    n = df.count()
    if n < least:
        r = rule_thresholds(df, [], label, p).first() if n else None
        a, b = enforce_gap(r["alpha"], r["beta"], 0.05) if r else (0.7, 0.3)
        layers = len(levels) - 1
        return SwarmResult([a] * layers, [b] * layers, 0.5, math.inf)
    own = SwarmParams(max(4, min(params.particles, n // 20)), max(3, min(params.rounds, n // 50)), 0.7, 0.4, 1.4, 1.2, params.seed, 3, params.learn_gamma)
    start = None if previous is None else np.array([*previous.alphas, *previous.betas, previous.gamma])
    return learn_thresholds(df, levels, label, own, start=start)


@dataclass
class HistogramState:
    """Decayed histograms of p by label, the last thresholds and replayed windows."""

    bins: int = 32
    pos: np.ndarray | None = None
    neg: np.ndarray | None = None
    tau: float = 0.5
    alpha: float = 0.7
    beta: float = 0.3
    replay: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def label_histograms(df: DataFrame, keys: list[str], label: str, p: str, bins: int = 32) -> DataFrame:
    """keys, bin, pos, neg."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).between(0, 1)).groupBy(*keys, b.alias("bin")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))


def histogram_quantile(counts: np.ndarray, q: float, default: float) -> float:
    """Quantile of a weighted histogram on [0, 1], interpolated inside its bin."""
    total = counts.sum()
    if total <= 0:
        return default
    run, target = np.cumsum(counts), q * total
    i = min(int(np.searchsorted(run, target, side="right")), len(counts) - 1)
    before = run[i - 1] if i else 0.0
    inside = (target - before) / counts[i] if counts[i] > 0 else 0.0
    return float(min(max((i + min(max(inside, 0.0), 1.0)) / len(counts), 0.0), 1.0))


def histogram_quantiles(hist: DataFrame, keys: list[str], count: str, q: float, bins: int) -> DataFrame:
    """keys, quantile: the same over a table of bins."""
    w = Window.partitionBy(*keys).orderBy("bin")
    run = hist.withColumns({"c": F.sum(count).over(w), "t": F.sum(count).over(Window.partitionBy(*keys)) * q}).where((F.col("c") > F.col("t")) & (F.col("t") >= 0) & (F.col(count) > 0))
    first = run.groupBy(*keys).agg(F.min(F.struct("bin", "c", "t", F.col(count).alias("n"))).alias("x"))
    return first.select(*keys, ((F.col("x.bin") + (F.col("x.t") - F.col("x.c") + F.col("x.n")) / F.col("x.n")) / bins).alias("quantile"))


def adapt_histogram(state: HistogramState, pos: np.ndarray, neg: np.ndarray, drifted: bool = False, decay: float = 0.9, q_pos: float = 0.3, q_neg: float = 0.7, c_fn: float = 1.0, c_fp: float = 1.0, step: float = 0.05, hysteresis: float = 0.005, target_bnd: float = 0.2, nudge: float = 0.1, keep: int = 8) -> HistogramState:
    """One window's step: decayed histograms, tau by cost, quantiles around it, steps held, small moves ignored, the deferred share pulled to its target. Drift widens the deferred region."""
    p = pos + (decay * state.pos if state.pos is not None else 0)
    n = neg + (decay * state.neg if state.neg is not None else 0)
    edges = np.arange(1, len(p)) / len(p)
    cost = c_fn * np.cumsum(p)[:-1] + c_fp * (n.sum() - np.cumsum(n)[:-1])
    tau = 0.8 * state.tau + 0.2 * float(edges[int(cost.argmin())]) if p.sum() and n.sum() else state.tau
    alpha, beta = max(histogram_quantile(p, q_pos, state.alpha), tau), min(histogram_quantile(n, q_neg, state.beta), tau)
    all_ = p + n
    centre = (np.arange(len(p)) + 0.5) / len(p)
    share = all_[(centre < alpha) & (centre > beta)].sum() / max(all_.sum(), 1e-9)
    pull = nudge * (target_bnd - share)
    alpha, beta = alpha + pull / 2, beta - pull / 2
    if drifted:
        alpha, beta = alpha + step / 2, beta - step / 2

    def move(new: float, old: float) -> float:
        d = min(max(new - old, -step), step)
        return old if abs(d) < hysteresis else old + d

    alpha, beta = enforce_gap(move(alpha, state.alpha), move(beta, state.beta), 0.02)
    return HistogramState(state.bins, p, n, tau, alpha, beta, [*state.replay, (pos, neg)][-keep:])


def calibrate_replay(state: HistogramState, c_fn: float = 1.0, c_fp: float = 1.0, radius: float = 0.1, rate: float = 0.3) -> HistogramState:
    """Move tau towards the cut within radius that costs least over the replayed windows."""
    if not state.replay:
        return state
    p, n = sum(x for x, _ in state.replay), sum(y for _, y in state.replay)
    edges = np.arange(1, len(p)) / len(p)
    cost = c_fn * np.cumsum(p)[:-1] + c_fp * (n.sum() - np.cumsum(n)[:-1])
    near = np.abs(edges - state.tau) <= radius
    if not near.any():
        return state
    best = float(edges[near][int(cost[near].argmin())])
    return HistogramState(state.bins, state.pos, state.neg, (1 - rate) * state.tau + rate * best, state.alpha, state.beta, state.replay)


def smooth(raw: list[float], previous: float | None, rate: float = 0.3, last: int = 5) -> float:
    """Half the exponential average, half the median of the last raw values."""
    ema = raw[-1] if previous is None else rate * raw[-1] + (1 - rate) * previous
    return 0.5 * ema + 0.5 * float(np.median(raw[-last:]))


def decided_region(df: DataFrame, p: str, alpha: str, beta: str, name: str = "region") -> DataFrame:
    """Add the region by thresholds that are columns."""
    return df.withColumn(name, region(p, F.col(alpha), F.col(beta)))
