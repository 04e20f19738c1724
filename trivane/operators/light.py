"""Thresholds by decayed histograms of each level and label, and their calibration over replayed windows.

A window is read once for its histograms and once for its measures; what moves the thresholds is a state of a few arrays. Windows are replayed as counted
cells of the levels' probabilities and the label. The three-way objective is a sum over levels, so that one pass over those cells
with every pair of candidates gives all that a search by coordinates asks for.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.operators.steps import written
from trivane.operators.thresholds import SwarmResult, histogram_quantile, objective_of_sums, objective_sums
from trivane.operators.threeway import ObjectiveParams

#: Bounds of the shares that quantiles are taken at, in quiet and in safe windows and in calibration, and the step of a safe window.
QUIET = {"alpha": (0.45, 0.95), "beta": (0.05, 0.55), "gamma": (0.2, 0.9)}
SAFE = {"alpha": (0.4, 0.95), "beta": (0.05, 0.6), "gamma": (0.2, 0.9)}
TRIED = {"alpha": (0.05, 0.95), "beta": (0.02, 0.8), "gamma": (0.1, 0.95)}
SAFE_STEP, LEAN, PULL = 0.05, 0.1, 0.05


@dataclass(frozen=True)
class LightParams:
    """decay of the histograms and averages (gamma's own may differ), median of so many windows, step and hysteresis of a threshold, target share of deferred rows, replayed windows, and the calibration's grid."""

    bins: int = 256
    decay: float = 0.6
    decay_gamma: float | None = None
    median: int = 3
    step: float = 0.05
    hysteresis: float = 0.01
    gap: float = 0.01
    target_bnd: float | None = None
    replay: int = 20
    every: int = 10
    grid_step: float = 0.02
    grid_radius: int = 2
    measure: ObjectiveParams = ObjectiveParams()


@dataclass(frozen=True)
class LightState:
    """Histograms [level, bin], shares that quantiles are taken at, last thresholds before smoothing, raw and averaged thresholds, replayed cells."""

    pos: np.ndarray
    neg: np.ndarray
    tau_alpha: np.ndarray
    tau_beta: np.ndarray
    tau_gamma: float = 0.5
    last: tuple[np.ndarray, np.ndarray] | None = None
    raw: tuple[np.ndarray, ...] = ()
    average: np.ndarray | None = None
    replay: tuple[DataFrame, ...] = field(default=(), repr=False)
    windows: int = 0

    @staticmethod
    def start(levels: int, params: LightParams) -> LightState:
        bins = max(32, params.bins)
        return LightState(np.zeros((levels, bins)), np.zeros((levels, bins)), np.full(levels, 0.7), np.full(levels, 0.3))


def _gap(alpha: np.ndarray, beta: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    middle, near = (alpha + beta) / 2, alpha - beta < gap
    a, b = np.where(near, middle + gap / 2, alpha), np.where(near, middle - gap / 2, beta)
    return np.clip(a, 0, 0.999), np.clip(b, 0, 0.999)


def level_histograms(df: DataFrame, levels: list[str], label: str, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts [level, bin] of label 1 and of others; values outside [0, 1] and null count in none. One aggregation, at most levels x bins rows."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(p).cast("double").alias("p")) for i, p in enumerate(levels)])).alias("e")
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    one = F.when(F.col("y") == 1, 1).otherwise(0)
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), each).select("y", "e.*").where("p between 0 and 1")
    out = np.zeros((2, len(levels), bins))
    for r in rows.groupBy("level", b.alias("bin")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg")).collect():
        out[0, r["level"], r["bin"]], out[1, r["level"], r["bin"]] = r["pos"], r["neg"]
    return out[0], out[1]


def counted(df: DataFrame, levels: list[str], label: str) -> DataFrame:
    """Cells of equal rows, written: label, levels, __n and __all (0)."""
    return written(df.where(F.col(label).isNotNull()).groupBy(label, *levels).agg(F.count("*").alias("__n")).withColumn("__all", F.lit(0)), "cells")


def _measured(cells: DataFrame, levels: list[str], label: str, x: np.ndarray, measure: ObjectiveParams) -> np.ndarray:
    return objective_sums(cells, "__all", levels, label, "__n", {0: x}, measure)[0]


def light_step(state: LightState, df: DataFrame, levels: list[str], label: str, params: LightParams = LightParams(), safe: bool = False) -> tuple[SwarmResult, LightState]:
    """(thresholds of all layers but the last, and gamma; the state after the window ``df``). The last level accepts at gamma.

    safe, as after drift, moves the shares towards a wider acceptance; else they lean to the dearer error. A window without rows leaves histograms decayed
    and thresholds where they were.
    """
    q, m = params, params.measure
    cells = counted(df, levels, label)
    pos, neg = level_histograms(df, levels, label, state.pos.shape[1])
    pos, neg = q.decay * state.pos + (1 - q.decay) * pos, q.decay * state.neg + (1 - q.decay) * neg
    lean = -SAFE_STEP if safe else (m.theta_pos / max(m.theta_pos + m.theta_neg, 1e-6) - 0.5) * LEAN
    bound = SAFE if safe else QUIET
    tau_a, tau_b = np.clip(state.tau_alpha + lean, *bound["alpha"]), np.clip(state.tau_beta - lean, *bound["beta"])
    tau_g = float(np.clip(state.tau_gamma + (lean if safe else lean / 2), *bound["gamma"]))
    before = state.last or (np.full(len(levels), np.nan), np.full(len(levels), np.nan))
    own = []
    for hist, tau, old, default in ((pos, tau_a, before[0], 0.7), (neg, tau_b, before[1], 0.3)):
        new = np.array([histogram_quantile(h, float(t), default if np.isnan(o) else float(o)) for h, t, o in zip(hist, tau, old, strict=True)])
        if state.last is not None:
            move = np.clip(new - old, -q.step, q.step)
            new = np.where(np.abs(move) < q.hysteresis, old, old + move)
        own.append(new)
    alpha, beta = last = _gap(*own, q.gap)
    gamma = histogram_quantile(pos[-1] + neg[-1], tau_g, 0.5)
    layers = len(levels) - 1
    if q.target_bnd is not None and layers:
        s = _measured(cells, levels, label, np.array([[*alpha[:layers], *beta[:layers], gamma]]), m)[0, :layers].astype(float)
        share = float(np.mean((s[:, 1] + s[:, 4]) / np.maximum(s[:, 8] + s[:, 9], 1)))
        pull = float(np.clip(q.target_bnd - share, -PULL, PULL))
        alpha, beta = alpha.copy(), beta.copy()
        alpha[:layers], beta[:layers] = np.clip(alpha[:layers] + pull, q.gap, 0.999), np.clip(beta[:layers] - pull, 0, 0.999)
        alpha, beta = _gap(alpha, beta, q.gap)
    now = np.concatenate((alpha, beta, [gamma]))
    raw = (*state.raw, now)[-max(q.median, 1) :]
    rate = np.full(len(now), q.decay)
    rate[-1] = q.decay if q.decay_gamma is None else q.decay_gamma
    average = rate * now + (1 - rate) * (now if state.average is None else state.average)
    smooth = (average + np.median(np.stack(raw), axis=0)) / 2
    n = len(levels)
    a, b = _gap(smooth[:n], smooth[n : 2 * n], q.gap)
    x = np.array([[*a[:layers], *b[:layers], smooth[-1]]])
    fitness = float(objective_of_sums(_measured(cells, levels, label, x, m), x, m)[0])
    after = replace(state, pos=pos, neg=neg, tau_alpha=tau_a, tau_beta=tau_b, tau_gamma=tau_g, last=last, raw=raw, average=average, replay=(*state.replay, cells)[-max(q.replay, 1) :], windows=state.windows + 1)
    return SwarmResult(a[:layers].tolist(), b[:layers].tolist(), float(smooth[-1]), fitness), after


def calibrate(state: LightState, levels: list[str], label: str, params: LightParams = LightParams()) -> tuple[bool, LightState]:
    """(whether a better choice was found, the state with its shares moved towards it): a search by coordinates over the replayed windows.

    Each share is tried at 2 grid_radius + 1 places: first alpha's of every layer, then beta's, then gamma's; thresholds are the exact quantiles of all
    replayed rows. Of equal values the one before stays.
    """
    if not state.replay:
        return False, state
    cells = state.replay[0]
    for c in state.replay[1:]:
        cells = cells.unionByName(c)
    q, layers, m = params, len(levels) - 1, params.measure
    shift = [s * q.grid_step for s in range(-q.grid_radius, q.grid_radius + 1)]
    # The share that is held now comes first: it is what the others are compared with.
    tried = lambda tau, which: np.array([tau, *np.clip([tau + s for s in shift], *TRIED[which])])
    shares = {("alpha", i): tried(state.tau_alpha[i], "alpha") for i in range(layers)} | {("beta", i): tried(state.tau_beta[i], "beta") for i in range(layers)} | {("gamma", layers): tried(state.tau_gamma, "gamma")}
    asked = []
    for (which, i), taus in shares.items():
        at = F.array(*[F.lit(float(np.clip(t, 0.01, 0.99))) for t in taus])
        p = F.col(levels[i])
        own = p if which == "gamma" else F.when(F.col(label) == (1 if which == "alpha" else 0), p)
        asked.append(F.coalesce(F.percentile(own, at, F.col("__n")), F.percentile(p, at, F.col("__n"))).alias(f"{which}{i}"))
    cut = cells.agg(*asked).first().asDict()
    if any(v is None for v in cut.values()):
        return False, state
    places = len(shift) + 1
    x = np.zeros((places * places, 2 * layers + 1))
    for row in range(len(x)):
        i, j = divmod(row, places)
        for layer in range(layers):
            x[row, layer], x[row, layers + layer] = (float(v) for v in _gap(np.array(cut[f"alpha{layer}"][i]), np.array(cut[f"beta{layer}"][j]), q.gap))
        x[row, -1] = cut[f"gamma{layers}"][j]
    sums = _measured(cells, levels, label, x, m)
    none = np.zeros_like(sums[:, :1])
    # The objective of one layer beside a last layer without rows is that layer's part of the sum.
    part = [objective_of_sums(np.concatenate((sums[:, k : k + 1], none), 1), x[:, [k, layers + k, -1]], m).reshape(places, places) for k in range(layers)]
    end = objective_of_sums(sums[:, layers:], x, m)[:places]
    best = {k: 0 for k in shares}
    total = lambda at: sum(part[k][at["alpha", k], at["beta", k]] for k in range(layers)) + end[at["gamma", layers]]
    fit = total(best)
    for key in shares:
        for c in range(1, places):
            other = best | {key: c}
            if total(other) < fit - 1e-12:
                best, fit = other, total(other)
    if not any(best.values()):
        return False, state
    tau_a, tau_b = state.tau_alpha.copy(), state.tau_beta.copy()
    for (which, i), at in best.items():
        if which != "gamma":
            tau = tau_a if which == "alpha" else tau_b
            tau[i] = q.decay * tau[i] + (1 - q.decay) * shares[which, i][at]
    tau_g = q.decay * state.tau_gamma + (1 - q.decay) * shares["gamma", layers][best["gamma", layers]]
    return True, replace(state, tau_alpha=tau_a, tau_beta=tau_b, tau_gamma=float(tau_g))
