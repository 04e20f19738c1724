"""Distribution drift (PSI, TV, KS), window detectors (KSWIN, ADWIN), severity and reactions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.operators.ordered import running_sums


def fixed_bins(df: DataFrame, p: str, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, bin, n: counts in equal bins of [0, 1], the last one closed; values outside count in no bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).between(0, 1)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def psi_tv(base: DataFrame, current: DataFrame, p: str, keys: list[str] | None = None, bins: int = 10) -> DataFrame:
    """keys (of ``current``), psi, tv against the one baseline: shares of the bins, at least 1e-6."""
    keys = keys or []
    spine = base.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    share = lambda df, k, name: (lambda c: c.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*k))).drop("n"))(fixed_bins(df, p, k, bins))
    b = spine.join(F.broadcast(share(base, [], "b")), "bin", "left")
    cells = current.select(*keys).distinct().join(F.broadcast(b), F.lit(True)) if keys else b
    both = cells.join(share(current, keys, "c"), [*keys, "bin"], "left")
    x, y = F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(1e-6)), F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(1e-6))
    return both.groupBy(*keys).agg(F.sum((y - x) * F.log(y / x)).alias("psi"), (F.sum(F.abs(y - x)) / 2).alias("tv"))


def psi_quantile(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """psi over the distinct quantile cuts of the reference. Values outside the cuts are in no bin but count in the total; empty bins have 1e-6."""
    cuts = reference.agg(F.expr(f"percentile(`{column}`, array({', '.join(str(i / bins) for i in range(bins + 1))}))").alias("q")).first()["q"]
    edges = sorted(set(cuts))
    return _psi_edges(reference, current, column, edges)


def _psi_edges(reference: DataFrame, current: DataFrame, column: str, edges: list[float]) -> DataFrame:
    last = len(edges) - 2

    def count(i: int) -> Column:
        upper = F.col(column) <= edges[i + 1] if i == last else F.col(column) < edges[i + 1]
        return F.sum(F.when((F.col(column) >= edges[i]) & upper, 1).otherwise(0)).alias(f"b{i}")

    shares = lambda d: d.agg(F.count("*").alias("n"), *[count(i) for i in range(last + 1)])
    r, c = shares(reference), shares(current)
    r, c = r.select(*[F.col(x).alias(f"r_{x}") for x in r.columns]), c.select(*[F.col(x).alias(f"c_{x}") for x in c.columns])
    part = lambda s, i: F.when(F.col(f"{s}_b{i}") == 0, 1e-6).otherwise(F.col(f"{s}_b{i}") / F.col(f"{s}_n"))
    total = sum(((part("c", i) - part("r", i)) * F.log(part("c", i) / part("r", i)) for i in range(last + 1)), F.lit(0.0))
    return r.join(F.broadcast(c), F.lit(True)).select(total.alias("psi"))


def ks_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """ks: greatest gap of the two samples' distribution functions. Values are counted first and ordered in ranges."""
    both = a.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(column).cast("double"), F.lit(0), F.lit(1)))
    counts = both.where("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = running_sums(counts, ["v"], {"ca": F.col("a"), "cb": F.col("b")}).join(F.broadcast(n), F.lit(True))
    return run.agg(F.coalesce(F.max(F.abs(F.try_divide(F.col("ca"), F.col("na")) - F.try_divide(F.col("cb"), F.col("nb")))), F.lit(0.0)).alias("ks"))


def monitor(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """column, ks, psi of each numeric column; their means are the monitor's values. All columns go through one plan as rows."""

    def long(df: DataFrame, a: int, b: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.explode(cells).alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b")).select("x.*", "a", "b")

    both = long(reference, 1, 0).union(long(current, 0, 1))
    counts = both.groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known = counts.where("v is not null")
    w = Window.orderBy("column").rowsBetween(Window.unboundedPreceding, -1)  # a row a column
    sums = known.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    sums = sums.withColumns({"pa": F.coalesce(F.sum("na").over(w), F.lit(0)), "pb": F.coalesce(F.sum("nb").over(w), F.lit(0))})
    run = running_sums(known, ["column", "v"], {"ca": F.col("a"), "cb": F.col("b")}).join(F.broadcast(sums), "column")
    gap = F.abs(F.try_divide(F.col("ca") - F.col("pa"), F.col("na")) - F.try_divide(F.col("cb") - F.col("pb"), F.col("nb")))
    ks = run.groupBy("column").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))
    cuts = F.expr(f"array_distinct(array_sort(percentile(v, array({', '.join(str(i / bins) for i in range(bins + 1))}))))")
    edges = long(reference, 1, 0).groupBy("column").agg(cuts.alias("e"))
    bin_ = F.least(F.size(F.filter("e", lambda x: x <= F.col("v"))), F.size("e") - 1) - 1
    inside = known.join(F.broadcast(edges), "column").where((F.col("v") >= F.element_at("e", 1)) & (F.col("v") <= F.element_at("e", -1)))
    cells = inside.groupBy("column", bin_.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    spine = edges.where(F.size("e") > 1).select("column", F.explode(F.sequence(F.lit(0), F.size("e") - 2)).alias("bin"))
    all_ = counts.groupBy("column").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))
    shares = spine.join(cells, ["column", "bin"], "left").join(F.broadcast(all_), "column")
    x, y = (F.when(F.coalesce(c, F.lit(0)) == 0, 1e-6).otherwise(F.col(c) / F.col(f"r{c}")) for c in ("a", "b"))
    psi = shares.groupBy("column").agg(F.sum((y - x) * F.log(y / x)).alias("psi"))
    return ks.join(psi, "column", "left").select("column", "ks", F.coalesce("psi", F.lit(0.0)).alias("psi"))


# ---- detectors over ordered values -------------------------------------------------


def ks_statistic(a: list[float], b: list[float]) -> float:
    """Two-sample KS distance, right-continuous at ties."""
    import bisect

    x, y = sorted(a), sorted(b)
    return max((abs(bisect.bisect_right(x, v) / len(x) - bisect.bisect_right(y, v) / len(y)) for v in {*x, *y}), default=0.0)


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic p-value: the Kolmogorov series of up to 100 terms."""
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * d
    if x <= 0:
        return 1.0
    total = 0.0
    for k in range(1, 101):
        term = 2 * (-1) ** (k - 1) * math.exp(-2 * k * k * x * x)
        total += term
        if abs(term) < 1e-10:
            break
    return min(max(total, 0.0), 1.0)


@dataclass(frozen=True)
class DetectorConfig:
    """method kswin or adwin. window: values kept; stat: the newest ones kswin compares; delta: adwin's confidence; cooldown: values after an event without a test."""

    method: str = "kswin"
    window: int = 100
    stat: int = 30
    significance: float = 0.005
    delta: float = 0.002
    least: int = 5
    cooldown: int = 0

    def __post_init__(self):
        if self.method not in ("kswin", "adwin") or self.window < 2 or not 0 < self.stat < self.window:
            raise ValueError(f"no such detector: {self}")


@dataclass
class Detector:
    """Values seen so far and the place of the last event; update() gives an event's value or None."""

    config: DetectorConfig
    values: list[float] = field(default_factory=list)
    last: int | None = None

    def update(self, value: float, index: int) -> float | None:
        c = self.config
        self.values = [*self.values, float(value)][-c.window :]
        if self.last is not None and index - self.last <= c.cooldown:
            return None
        found = self._kswin() if c.method == "kswin" else self._adwin()
        if found is not None:
            self.last = index
        return found

    def _kswin(self) -> float | None:
        c, v = self.config, self.values
        if len(v) < max(2 * c.stat, c.window // 2):
            return None
        old, new = v[: -c.stat], v[-c.stat :]
        d = ks_statistic(old, new)
        if ks_p_value(d, len(old), len(new)) >= c.significance:
            return None
        self.values = new
        return d

    def _adwin(self) -> float | None:
        c, v = self.config, self.values
        best, at, left, total = 0.0, 0, 0.0, sum(v)
        for k in range(1, len(v)):
            left += v[k - 1]
            if k < c.least or len(v) - k < c.least:
                continue
            gap = abs(left / k - (total - left) / (len(v) - k))
            margin = gap - math.sqrt(0.5 * (1 / k + 1 / (len(v) - k)) * math.log(2 / c.delta))
            if margin > best:
                best, at = margin, k
        if not at:
            return None
        gap = abs(sum(v[:at]) / at - sum(v[at:]) / (len(v) - at))
        self.values = v[at:]
        return gap


def detect_by_key(df: DataFrame, key: str, order: list[str], value: str, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """key, index long, value double: the events of each key's values in order.

    A detector depends on all its past, so a key's values pass through one task in
    order; only the window is held in memory.
    """
    kind = df.schema[key].dataType.simpleString()
    ordered = df.select(key, *[c for c in order if c != key], F.col(value).cast("double").alias("__value")).where("__value is not null").repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        now, detector, index = None, None, 0
        for frame in batches:
            out = []
            for k, v in zip(frame[key], frame["__value"], strict=True):
                if detector is None or k != now:
                    now, detector, index = k, Detector(config), 0
                if (found := detector.update(v, index)) is not None:
                    out.append((k, index, found))
                index += 1
            yield pd.DataFrame(out, columns=[key, "index", "value"])

    return ordered.mapInPandas(run, f"`{key}` {kind}, index bigint, value double")


def adwin_cut(df: DataFrame, order: list[str], value: str, delta: float = 0.002, least: int = 5) -> DataFrame:
    """One row at most: n_left, gap, margin of the best cut of all values in order, if its margin is positive. One pass of running sums."""
    n_total = df.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    run = running_sums(df, order, {"k": F.lit(1).cast("long"), "s": F.col(value).cast("double")}).select("k", "s").join(F.broadcast(n_total), F.lit(True))
    m = F.col("n") - F.col("k")
    run = run.where((F.col("k") >= least) & (m >= least))
    gap = F.abs(F.col("s") / F.col("k") - (F.col("total") - F.col("s")) / m)
    margin = gap - F.sqrt(0.5 * (1 / F.col("k") + 1 / m) * math.log(2 / delta))
    best = run.select(F.struct(margin.alias("margin"), (-F.col("k")).alias("minus"), gap.alias("gap")).alias("b")).agg(F.max("b").alias("b"))
    return best.where("b.margin > 0").select((-F.col("b.minus")).alias("n_left"), F.col("b.gap").alias("gap"), F.col("b.margin").alias("margin"))


# ---- severity, levels, reactions ---------------------------------------------------


@dataclass(frozen=True)
class DriftThresholds:
    """(warn, alert) of each statistic; posrate is a shift of the positive rate."""

    psi: tuple[float, float] = (0.1, 0.2)
    tv: tuple[float, float] = (0.1, 0.2)
    posrate: tuple[float, float] = (0.05, 0.1)
    perf_drop: tuple[float, float] = (0.05, 0.1)


def severity(psi, tv, posrate, perf_drop, t: DriftThresholds = DriftThresholds()) -> Column:
    """0, 1 (any warning) or 2 (any alert)."""
    parts = [F.when(F.col(c) >= hi, 2).when(F.col(c) >= lo, 1).otherwise(0) for c, (lo, hi) in ((psi, t.psi), (tv, t.tv), (posrate, t.posrate), (perf_drop, t.perf_drop))]
    return F.greatest(*parts).cast("int")


def refine_level(level, psi, tv, posrate, perf_drop, dead=(0.05, 0.02, 0.01, 0.005), strong=(0.25, 0.15, 0.05, 0.02)) -> Column:
    """S1 and S2 become NONE if every statistic is under ``dead``; S2 becomes S1 if every one is under ``strong``."""
    x = [F.col(c) for c in (psi, tv, posrate, perf_drop)]
    under = lambda lim: (x[0] < lim[0]) & (x[1] < lim[1]) & (x[2] < lim[2]) & (x[3] < lim[3])
    lv = F.col(level)
    return F.when(lv.isin("S1", "S2") & under(dead), "NONE").when((lv == "S2") & under(strong), "S1").otherwise(lv)


#: Limits on psi, tv, shift of the rate and drop of F1 under which a level is refined.
DEAD, STRONG = (0.05, 0.02, 0.01, 0.005), (0.25, 0.15, 0.05, 0.02)


def refined(level: str, values: tuple[float, float, float, float], dead: tuple[float, ...] = DEAD, strong: tuple[float, ...] = STRONG) -> str:
    """refine_level of one window."""
    if level in ("S1", "S2") and all(v < x for v, x in zip(values, dead, strict=True)):
        return "NONE"
    return "S1" if level == "S2" and all(v < x for v, x in zip(values, strong, strict=True)) else level


@dataclass(frozen=True)
class DriftState:
    """Streaks of warnings and alerts, windows of cooldown left, and what reactions have changed."""

    warn: int = 0
    alert: int = 0
    cooldown: int = 0
    sigma: float = 1.0
    sigma_step: int = 0
    keep_ratio: float = 0.3
    keep_gap: float = 0.05
    bnd_cap: float = 0.3
    step_cap: float = 0.1
    redo: bool = False
    rebuild: bool = False


def next_level(state: DriftState, severity: int, debounce: int = 1, decay_streaks: bool = False) -> tuple[str, DriftState]:
    """Level NONE, S1, S2 or S3 and the new state.

    A streak of ``debounce`` alerts is S3, a shorter one S2; a warning is S1. decay_streaks takes one
    off each streak first on every window, under which two or more are never reached.
    """
    s = replace(state, warn=max(0, state.warn - 1), alert=max(0, state.alert - 1)) if decay_streaks else state
    cool = max(0, s.cooldown - 1)
    if cool > 0:
        return "NONE", replace(s, cooldown=cool)
    s = replace(s, cooldown=cool)
    if severity == 0:
        return "NONE", replace(s, warn=0, alert=0)
    warn, alert = s.warn + 1, s.alert + 1 if severity == 2 else 0
    level = "S3" if severity == 2 and alert >= max(debounce, 1) and (debounce > 1 or alert > 1) else "S2" if severity == 2 else "S1"
    return level, replace(s, warn=warn, alert=alert)


def react(state: DriftState, level: str, factors: tuple[float, ...] = (0.9, 1.1), cooldown: int = 3) -> DriftState:
    """S1 turns sigma by the next factor; S2 rebuilds references with more history; S3 also tightens the constraints and starts a cooldown."""
    if level == "S1":
        return replace(state, sigma=state.sigma * factors[state.sigma_step % len(factors)], sigma_step=state.sigma_step + 1, redo=True)
    if level == "S2":
        return replace(state, rebuild=True, keep_ratio=min(1.0, state.keep_ratio * 1.5), redo=True)
    if level == "S3":
        return replace(state, rebuild=True, keep_gap=state.keep_gap * 1.2, bnd_cap=state.bnd_cap * 0.9, step_cap=state.step_cap * 0.8, cooldown=cooldown, warn=0, alert=0, redo=True)
    return replace(state, redo=False, rebuild=False)


def composite_signal(mean_p: Column, ks: Column, psi: Column) -> Column:
    return 0.6 * mean_p + 0.3 * ks + 0.1 * psi


#: Factors of the weights' multiplier after S3, S2 and S1, and how it falls in quiet windows.
MULTIPLIERS, CALM = {"S3": 1.5, "S2": 1.3, "S1": 1.15}, 0.9
_STATE = {"warn": "int", "alert": "int", "cooldown": "int", "sigma": "double", "sigma_step": "int", "keep_ratio": "double", "keep_gap": "double", "bnd_cap": "double", "step_cap": "double", "multiplier": "double"}


def _step_state(s: Column, severity: Column, debounce: int, decay_streaks: bool, factors: tuple[float, ...], cooldown: int) -> tuple[Column, dict[str, Column]]:
    """(level, new state) of one window as columns: next_level, react and the weights' multiplier in one step."""
    less = lambda c: F.greatest(c - 1, F.lit(0))
    warn, alert = (less(s["warn"]), less(s["alert"])) if decay_streaks else (s["warn"], s["alert"])
    cool = less(s["cooldown"])
    resting = cool > 0
    warn_now = F.when(resting, warn).otherwise(F.when(severity == 0, 0).otherwise(warn + 1))
    alert_now = F.when(resting, alert).otherwise(F.when(severity == 2, alert + 1).otherwise(0))
    strong = (alert_now >= max(debounce, 1)) & (F.lit(debounce > 1) | (alert_now > 1))
    level = F.when(resting | (severity == 0), "NONE").when(severity == 1, "S1").when(strong, "S3").otherwise("S2")
    one, two, three = level == "S1", level == "S2", level == "S3"
    factor = F.element_at(F.array(*[F.lit(float(f)) for f in factors]), (s["sigma_step"] % len(factors)).cast("int") + 1)
    up = F.when(three, MULTIPLIERS["S3"]).when(two, MULTIPLIERS["S2"]).when(one, MULTIPLIERS["S1"])
    return level, {
        "warn": F.when(three, 0).otherwise(warn_now), "alert": F.when(three, 0).otherwise(alert_now), "cooldown": F.when(three, cooldown).otherwise(cool),
        "sigma": F.when(one, s["sigma"] * factor).otherwise(s["sigma"]), "sigma_step": s["sigma_step"] + one.cast("int"),
        "keep_ratio": F.when(two, F.least(F.lit(1.0), s["keep_ratio"] * 1.5)).otherwise(s["keep_ratio"]), "keep_gap": F.when(three, s["keep_gap"] * 1.2).otherwise(s["keep_gap"]),
        "bnd_cap": F.when(three, s["bnd_cap"] * 0.9).otherwise(s["bnd_cap"]), "step_cap": F.when(three, s["step_cap"] * 0.8).otherwise(s["step_cap"]),
        "multiplier": F.when(level == "NONE", F.greatest(F.lit(1.0), s["multiplier"] * CALM)).otherwise(F.greatest(s["multiplier"], up)),
    }


def reaction_fold(windows: DataFrame, order: str, severity: str, by: list[str] | None = None, start: DriftState = DriftState(), debounce: int = 1, decay_streaks: bool = False, factors: tuple[float, ...] = (0.9, 1.1), cooldown: int = 3) -> DataFrame:
    """by, order, level and the state after each window (streaks, cooldown, what the reactions have changed, the weights' multiplier): one fold over the ordered windows of each run.

    Windows are as many as months, so a run's array is bounded. A null severity counts as 0; windows of equal order are taken by severity.
    """
    kind = windows.schema[order].dataType.simpleString()
    row = f"struct<{order}:{kind},level:string,{','.join(f'{k}:{v}' for k, v in _STATE.items())}>"
    zero = F.struct(*[F.lit(getattr(start, k) if k != "multiplier" else 1.0).cast(v).alias(k) for k, v in _STATE.items()])

    def step(acc: Column, x: Column) -> Column:
        level, new = _step_state(acc["state"], F.coalesce(x["s"], F.lit(0)), debounce, decay_streaks, factors, cooldown)
        values = [new[k].cast(v).alias(k) for k, v in _STATE.items()]
        return F.struct(F.struct(*values).alias("state"), F.concat(acc["out"], F.array(F.struct(x["o"].alias(order), level.alias("level"), *values))).alias("out"))

    listed = windows.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(severity).cast("int").alias("s")))).alias("w"))
    begin = F.struct(zero.alias("state"), F.array().cast(f"array<{row}>").alias("out"))
    return listed.select(*(by or []), F.explode(F.aggregate("w", begin, step)["out"]).alias("r")).select(*(by or []), "r.*")
