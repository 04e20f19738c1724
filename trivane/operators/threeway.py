"""Measures of three-way decisions: information, regret, cost, coverage, and sequential layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions.expressions import region
from trivane.operators.encoding import log2_or_zero


def _sum(c: Column, v: Column | float = 1.0) -> Column:
    return F.sum(F.when(c, v).otherwise(0.0))


def masks(df: DataFrame, p: str, alpha: float, beta: float) -> DataFrame:
    """Add in_pos, in_neg, in_bnd. Accept and reject overlap where alpha <= beta; defer is neither."""
    pos, neg = F.col(p) >= alpha, F.col(p) <= beta
    return df.withColumns({"in_pos": pos, "in_neg": neg, "in_bnd": ~pos & ~neg})


def _entropy(w1: Column, w0: Column) -> Column:
    total = w1 + w0
    a, b = F.when(total > 0, w1 / total).otherwise(0.0), F.when(total > 0, w0 / total).otherwise(0.0)
    return -(a * log2_or_zero(a) + b * log2_or_zero(b))


def _mean(c: Column, v: Column, weight: Column) -> Column:
    return F.try_divide(_sum(c, v * weight), _sum(c, weight))


def information_gain(label: str, p: str, alpha: float, beta: float, c1: float = 1.0, c0: float = 1.0, weight: Column | None = None) -> Column:
    """Aggregate: weighted binary entropy less that of the three regions. Classes weigh c1 and c0, rows ``weight`` (1)."""
    y, r, w = F.col(label) == 1, region(p, alpha, beta), F.lit(1.0) if weight is None else weight
    w1, w0 = _sum(y, c1 * w), _sum(~y, c0 * w)
    gain = _entropy(w1, w0)
    for k in (1, 0, -1):
        a, b = _sum(y & (r == k), c1 * w), _sum(~y & (r == k), c0 * w)
        gain = gain - F.when(w1 + w0 > 0, (a + b) / (w1 + w0)).otherwise(0.0) * _entropy(a, b)
    return gain


def utility_regret(label: str, p: str, alpha: float, beta: float, theta_pos: float = 2.0, theta_neg: float = 1.0, sigma: float = 3.0, weight: Column | None = None) -> Column:
    """Aggregate: theta_pos times the mean regret of false accepts plus theta_neg times that of false rejects."""
    h = 2 * F.col(p) - 1
    up = F.pow(1 - F.exp(-theta_pos * F.greatest(h, F.lit(0.0))), F.lit(theta_pos))
    un = F.pow(1 - F.exp(-theta_neg * F.greatest(-h, F.lit(0.0))), F.lit(theta_neg))
    regret = lambda d: 1 - F.exp(-sigma * F.greatest(d, F.lit(0.0)))
    r, y = region(p, alpha, beta), F.col(label) == 1
    w = F.lit(1.0) if weight is None else weight
    fp, fn = _mean(~y & (r == 1), regret(un - up), w), _mean(y & (r == -1), regret(up - un), w)
    return theta_pos * F.coalesce(fp, F.lit(0.0)) + theta_neg * F.coalesce(fn, F.lit(0.0))


def rate_regret(label: str, p: str, alpha: float, beta: float, theta_pos: float = 2.0, theta_neg: float = 1.0, sigma: float = 3.0, weight: Column | None = None) -> Column:
    """Aggregate: the same of the shares of wrong rows among the accepted and the rejected."""
    r, y = region(p, alpha, beta), F.col(label) == 1
    w = F.lit(1.0) if weight is None else weight
    share = lambda wrong, all_: F.coalesce(F.try_divide(_sum(wrong, w), _sum(all_, w)), F.lit(0.0))
    bend = lambda x: 1 - F.exp(-sigma * x)
    return theta_pos * bend(share(~y & (r == 1), r == 1)) + theta_neg * bend(share(y & (r == -1), r == -1))


@dataclass(frozen=True)
class ObjectiveParams:
    c1: float = 1.0
    c0: float = 1.0
    theta_pos: float = 2.0
    theta_neg: float = 1.0
    sigma: float = 3.0
    xi_min: float = 0.0
    penalty_large: float = 1e6
    gap: float = 0.01
    regret: str = "utility"


def objective(levels: list[str], label: str, alphas: list[float], betas: list[float], gamma: float = 0.5, params: ObjectiveParams = ObjectiveParams(), weight: Column | None = None) -> Column:
    """Aggregate to minimise: regret less information gain of all layers but the last, regret of a binary last layer, and penalties.

    levels name the probability columns. A layer whose share of deferred rows is under xi_min, or whose
    alpha is under beta + gap, costs penalty_large.
    """
    q = params
    regret = utility_regret if q.regret == "utility" else rate_regret
    total = F.lit(0.0)
    for p, a, b in zip(levels[:-1], alphas, betas, strict=True):
        total = total - information_gain(label, p, a, b, q.c1, q.c0, weight) + regret(label, p, a, b, q.theta_pos, q.theta_neg, q.sigma, weight)
        deferred = _mean(F.lit(True), F.when(region(p, a, b) == 0, 1.0).otherwise(0.0), F.lit(1.0) if weight is None else weight)
        total = total + F.when(deferred < q.xi_min, q.penalty_large).otherwise(0.0)
        if a < b + q.gap:
            total = total + q.penalty_large
    # The last layer accepts at gamma and rejects under it.
    last = levels[-1]
    return total + regret(label, last, gamma, _below(gamma), q.theta_pos, q.theta_neg, q.sigma, weight)


def _below(x: float) -> float:
    import math

    return math.nextafter(x, -math.inf)


def expected_cost(pos: str, neg: str, bnd: str, alpha: float, beta: float, c_fn: float = 1.0, c_fp: float = 1.0, c_bnd: float = 0.5) -> Column:
    """Aggregate: mean expected cost of the decisions on the accept probability."""
    p = F.col(pos)
    is_pos, is_neg = p >= alpha, p <= beta
    total = c_fn * _sum(is_neg, p) + c_fp * _sum(is_pos, F.col(neg)) + c_bnd * _sum(~is_pos & ~is_neg, F.col(bnd))
    return total / F.greatest(F.count("*"), F.lit(1))


def expected_fbeta(pos: str, neg: str, alpha: float, beta: float, b: float = 1.0) -> Column:
    """Aggregate: F-beta of the expected counts; denominators are at least 1e-6."""
    p = F.col(pos)
    tp, fp, fn = _sum(p >= alpha, p), _sum(p >= alpha, F.col(neg)), _sum(p <= beta, p)
    precision, recall = tp / F.greatest(tp + fp, F.lit(1e-6)), tp / F.greatest(tp + fn, F.lit(1e-6))
    return (1 + b * b) * precision * recall / F.greatest(b * b * precision + recall, F.lit(1e-6))


def coverage(p: str, alpha: float, beta: float) -> tuple[Column, Column]:
    """Aggregates: share accepted, share deferred."""
    r = region(p, alpha, beta)
    return F.avg((r == 1).cast("double")), F.avg((r == 0).cast("double"))


def boundary_ratio(levels: list[str], alphas: list[float], betas: list[float]) -> Column:
    """Aggregate: mean over levels of the share strictly between the thresholds."""
    parts = [F.avg(((F.col(p) > b) & (F.col(p) < a)).cast("double")) for p, a, b in zip(levels, alphas, betas, strict=True)]
    return sum(parts, F.lit(0.0)) / len(parts)


def sequential_decision(df: DataFrame, levels: list[str], alphas: list[float], betas: list[float], gamma: float = 0.5) -> DataFrame:
    """Add layer1, layer2, ... (regions; null where an earlier layer decided) and predicted int. The last layer decides at gamma."""
    out, open_, result = df, F.lit(True), F.lit(None).cast("int")
    for k, (p, a, b) in enumerate(zip(levels[:-1], alphas, betas, strict=True), 1):
        r = region(p, a, b)
        out = out.withColumn(f"layer{k}", F.when(open_, r))
        result = F.coalesce(result, F.when(F.col(f"layer{k}") == 1, 1).when(F.col(f"layer{k}") == -1, 0))
        open_ = F.coalesce(F.col(f"layer{k}") == 0, F.lit(False))
    k = len(levels)
    out = out.withColumn(f"layer{k}", F.when(open_, F.when(F.col(levels[-1]) >= gamma, 1).otherwise(-1)))
    return out.withColumn("predicted", F.coalesce(result, (F.col(f"layer{k}") == 1).cast("int")))


def metrics_by_year(df: DataFrame, year: str, label: str, p: str, alpha: float, beta: float) -> DataFrame:
    """year, F1, BAC, BND: deferred rows count as rejected in F1 and BAC."""
    from trivane.operators.metrics import classification_metrics

    r = df.withColumn("__pred", (F.col(p) >= alpha).cast("int"))
    m = classification_metrics(r, [year], label, "__pred").select(year, "F1", "BAC")
    return m.join(r.groupBy(year).agg(coverage(p, alpha, beta)[1].alias("BND")), year)


def years_summary(by_year: DataFrame) -> DataFrame:
    """mean_F1, mean_BAC, mean_BND and var_F1 (population) over years."""
    return by_year.agg(F.avg("F1").alias("mean_F1"), F.avg("BAC").alias("mean_BAC"), F.avg("BND").alias("mean_BND"), F.coalesce(F.var_pop("F1"), F.lit(0.0)).alias("var_F1"))
