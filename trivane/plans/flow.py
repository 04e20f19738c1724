"""The rolling three-way flow: period by period with delayed labels, seasonal references, searched thresholds and drift reactions.

Each period depends on the decisions before it, so the driver steps through the periods;
everything that grows with the data stays in DataFrames. Rows are enriched once, a
period's probabilities are written once, and past decisions are an expression
over them, so lineage stays short.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trivane.functions.expressions import three_way
from trivane.operators.bucketing import BucketConfig, ReferenceConfig, assign_buckets, bucket_stats, reference_set, similarity_to_references
from trivane.operators.drift import DEAD, STRONG, DriftState, DriftThresholds, next_level, psi_tv, react, refined
from trivane.operators.encoding import z_scores
from trivane.operators.metrics import METRICS, classification_metrics, yearly
from trivane.operators.posterior import KernelParams, NeighbourTable, kernel_posterior
from trivane.operators.steps import written
from trivane.operators.thresholds import Grid, ema_clip, enforce_gap, limit_range, select_alpha_beta
from trivane.operators.windows import SeasonWeights, drift_multiplier, plan_years, record_weight
from trivane.sources.tables import write_csv


@dataclass(frozen=True)
class FlowConfig:
    """numeric and categories (column -> weight) are the similarity's; seasons: periods a year."""

    numeric: tuple[str, ...]
    categories: dict[str, float]
    buckets: BucketConfig
    references: ReferenceConfig = ReferenceConfig()
    grid: Grid = Grid()
    weights: SeasonWeights = SeasonWeights()
    drift: DriftThresholds = DriftThresholds()
    seasons: int = 12
    history_cap: int = 8
    recent: int = 3
    k: int = 10
    kernel: KernelParams = KernelParams("epanechnikov", penalty=0.3)
    sigma: float = 1.0
    ema: float = 0.6
    step_cap: float = 0.1
    search_radius: float = 0.1
    debounce: int = 1
    reset_after: int = 60
    factors: tuple[float, ...] = (0.9, 1.1)
    refit: bool = True
    dead: tuple[float, float, float, float] = DEAD
    strong: tuple[float, float, float, float] = STRONG


@dataclass
class FlowResult:
    """The flow's tables; warmup_buckets counts the warm-up rows by bucket. Means of the similarities and probabilities are in window_metrics."""

    threshold_trace: DataFrame
    window_metrics: DataFrame
    drift_events: DataFrame
    metrics_by_year: DataFrame
    warmup_buckets: DataFrame
    windows: list[int] = field(default_factory=list)


#: What each window's mean is reported of.
MEANS = ("e_pos", "e_neg", "p_pos", "p_neg", "p_bnd")
#: File names of the tables that save() writes.
TABLES = {"threshold_trace": "threshold_trace_v02.csv", "window_metrics": "window_metrics.csv", "drift_events": "drift_events.csv", "metrics_by_year": "yearly_metrics.csv", "warmup_buckets": "warmup_bucket_stats.csv"}


def save(result: FlowResult, folder: str) -> None:
    """Write the tables as CSV with headers, each as a folder of one part."""
    for name, file in TABLES.items():
        write_csv(getattr(result, name), f"{folder.rstrip('/')}/{file}")


def learnt(rows: DataFrame, config: FlowConfig, warmup: list[int]) -> tuple[DataFrame, NeighbourTable]:
    """(rows with buckets by period and g, the neighbours' posterior learnt from the warm-up years; the table that learns more)."""
    bucketed = written(assign_buckets(rows, config.buckets, ["period_idx"]), "rows")
    return learn_more(bucketed, bucketed.where(F.col("year").isin(warmup)), _table(bucketed, config), config)


def enrich(rows: DataFrame, config: FlowConfig, warmup: list[int]) -> DataFrame:
    return learnt(rows, config, warmup)[0]


def _with_vector(df: DataFrame, config: FlowConfig) -> DataFrame:
    return df.withColumn("vec", F.array(*[F.col(c).cast("double") for c in config.numeric]))


def _table(data: DataFrame, config: FlowConfig) -> NeighbourTable:
    return NeighbourTable(_with_vector(data, config), config.k, "row_id", "row_id", "label", categories=tuple(config.categories))


def with_posterior(data: DataFrame, train: DataFrame, config: FlowConfig) -> DataFrame:
    """``data`` with g, learnt from all rows of ``train`` at once."""
    return learn_more(data, train, _table(data, config), config)[0]


def learn_more(data: DataFrame, new: DataFrame, table: NeighbourTable, config: FlowConfig) -> tuple[DataFrame, NeighbourTable]:
    """(``data`` with g, ``table`` after the rows of ``new``): g is the kernel posterior of the k nearest of all rows learnt so far, categories that
    differ penalised; 0.5 where nothing can be learnt. Only the new rows are searched."""
    table = table.add(_with_vector(new, config))
    g = kernel_posterior(table.neighbours(), config.kernel).select(F.col("query").alias("row_id"), F.when(~F.isnan("p"), F.col("p")).alias("g"))
    return written(data.drop("g").join(g, "row_id", "left").withColumn("g", F.coalesce("g", F.lit(0.5))), "rows"), table


def run_flow(rows: DataFrame, config: FlowConfig) -> FlowResult:
    """rows: row_id, label, period_idx, year and the config's columns. Deferred rows count as rejected in the metrics."""
    plan = plan_years(rows, "year")
    data, table = learnt(rows, config, list(plan.warmup))
    known = F.col("year").isin(list(plan.warmup))
    periods = sorted(r[0] for r in data.select("period_idx").distinct().collect())
    stream = sorted(r[0] for r in data.where(F.col("year").isin(list(plan.stream))).select("period_idx").distinct().collect())
    spark = rows.sparkSession
    probs: dict[int, DataFrame] = {}
    cuts: dict[int, tuple[float, float]] = {}
    state, multiplier, grid = DriftState(sigma=config.sigma, step_cap=config.step_cap), 1.0, config.grid
    alpha = beta = base_rate = base_f1 = None
    baseline: DataFrame | None = None
    quiet = 0
    trace, metrics, events = [], [], []

    def pool(now: int) -> DataFrame | None:
        past = [t for t in periods if t < now]
        same = [t for t in past if t % config.seasons == now % config.seasons][-config.history_cap :]
        chosen = same + [t for t in past if t % config.seasons != now % config.seasons][-config.recent :]
        if not chosen:
            return None
        old = data.where(F.col("period_idx").isin(chosen))
        seen = [t for t in chosen if t in probs]
        if seen:
            past_p = None
            for t in seen:
                a, b = cuts[t]
                part = probs[t].select("row_id", F.col("p_pos").alias("p"), F.when(F.col("p_pos") >= a, 1).when(F.col("p_pos") <= b, -1).otherwise(0).alias("region"))
                past_p = part if past_p is None else past_p.union(part)
            old = old.join(past_p, "row_id", "left").withColumns({"p": F.coalesce("p", F.lit(0.5)), "region": F.coalesce("region", F.lit(0))})
        else:
            old = old.withColumns({"p": F.lit(0.5), "region": F.lit(0)})
        w = record_weight("period_idx", now, max(same) if same else None, "p", "region", "label", multiplier, replace(config.weights, keep_ratio=state.keep_ratio), config.seasons)
        return old.withColumn("weight", w)

    for index, now in enumerate(stream):
        past = pool(now)
        if past is None:
            continue
        numeric = list(config.numeric)
        refs = reference_set(z_scores(past, numeric, []), "label", "row_id", p="g", config=config.references)
        block = z_scores(data.where(F.col("period_idx") == now), numeric, ["bucket_id"])
        e = similarity_to_references(block, refs, "row_id", numeric, config.categories, state.sigma)
        p, n, b = three_way("e_pos", "e_neg")
        scored = block.select("row_id", "label", "year").join(e, "row_id").withColumns({"p_pos": p, "p_neg": n, "p_bnd": b})
        probs[now] = current = written(scored, "probs")
        use = replace(grid, gap=state.keep_gap, max_bnd=min(grid.max_bnd, state.bnd_cap) if grid.max_bnd < 1 else grid.max_bnd)
        found = select_alpha_beta(current, use).first()
        note = "ok" if found["feasible_count"] else "first window: raw solution"
        if not found["feasible_count"] and alpha is not None:
            near = replace(use, alphas=tuple(limit_range(list(use.alphas), alpha, config.search_radius)), betas=tuple(limit_range(list(use.betas), beta, config.search_radius)), max_bnd=1.0)
            again = select_alpha_beta(current, near).first()
            relaxed = f"within {config.search_radius} of the last thresholds" + (f", deferred share over {use.max_bnd:g} allowed" if use.max_bnd < 1 else "")
            note = f"limited grid: {relaxed}" if again["feasible_count"] else "previous thresholds: no pair is feasible"
            found = again if again["feasible_count"] else Row(**(found.asDict() | {"alpha": alpha, "beta": beta}))
        star = found["alpha"], found["beta"]
        alpha, beta = enforce_gap(ema_clip(star[0], alpha, config.ema, state.step_cap), ema_clip(star[1], beta, config.ema, state.step_cap), use.gap)
        cuts[now] = alpha, beta
        decided = current.withColumn("predicted", (F.col("p_pos") >= alpha).cast("int"))
        m = classification_metrics(decided, [], "label", "predicted", "p_pos").first()
        extra = decided.agg(F.avg((F.col("p_pos") >= alpha).cast("double")).alias("cov"), F.avg(((F.col("p_pos") < alpha) & (F.col("p_pos") > beta)).cast("double")).alias("bnd"), F.avg("label").alias("rate"), F.max("year").alias("year"), *[F.avg(c).alias(f"mean_{c}") for c in MEANS]).first()
        if baseline is None:
            baseline, base_rate, base_f1 = current, extra["rate"], m["F1"]
        shift = psi_tv(baseline, current, "p_pos").first()
        gap, drop = abs(extra["rate"] - base_rate), max(0.0, base_f1 - m["F1"])
        values = ((shift["psi"], config.drift.psi), (shift["tv"], config.drift.tv), (gap, config.drift.posrate), (drop, config.drift.perf_drop))
        level, state = next_level(state, max(2 if v >= hi else 1 if v >= lo else 0 for v, (lo, hi) in values), config.debounce)
        level = refined(level, (shift["psi"], shift["tv"], gap, drop), config.dead, config.strong)
        quiet = 0 if level == "S3" else quiet + 1
        if quiet >= config.reset_after:
            level, quiet = "S3", 0
        state = react(state, level, config.factors)
        multiplier = drift_multiplier(multiplier, level)
        if level == "S3":
            baseline, base_rate, base_f1 = current, extra["rate"], m["F1"]
            if config.refit:  # labels of all periods up to the last one are known by now
                data, table = learn_more(data, data.where((F.col("period_idx") < now) & ~known), table, config)
                known = known | (F.col("period_idx") < now)
        year, season = int(extra["year"]), now % config.seasons + 1
        trace.append((now, index, year, season, *map(float, star), alpha, beta, _float(found["best"]), float(extra["bnd"]), float(extra["cov"]), note, _float(found["best"]), _float(found["second"]), _float(found["delta"]), int(found["feasible_count"] or 0)))
        metrics.append((year, season, now, int(m["n_samples"]), *[_float(m[x]) for x in METRICS], float(shift["psi"]), float(shift["tv"]), gap, float(extra["rate"]), drop, float(extra["bnd"]), float(extra["cov"]), alpha, beta, note, *[_float(extra[f"mean_{c}"]) for c in MEANS]))
        if level != "NONE":
            events.append((now, level, float(shift["psi"]), float(shift["tv"]), gap, drop, f"sigma={state.sigma:.4f} keep={state.keep_ratio:.3f} cooldown={state.cooldown}"))
    num = lambda names: ", ".join(f"{x} double" for x in names)
    t = spark.createDataFrame(trace, f"window int, window_index int, year int, month int, {num(['alpha_star', 'beta_star', 'alpha_smoothed', 'beta_smoothed', 'objective_score', 'bnd_ratio', 'pos_coverage'])}, constraint_note string, {num(['grid_best_score', 'grid_second_score', 'grid_delta'])}, grid_feasible int")
    w = spark.createDataFrame(metrics, f"year int, month int, window int, n_samples int, {num([*METRICS, 'psi', 'tv', 'posrate_gap', 'posrate', 'perf_drop', 'BND_ratio', 'POS_coverage', 'alpha', 'beta'])}, constraint_resolution string, {num([f'mean_{c}' for c in MEANS])}")
    d = spark.createDataFrame(events, f"window int, level string, {num(['psi', 'tv', 'posrate_gap', 'perf_drop'])}, actions string")
    warm = bucket_stats(data.where(F.col("year").isin(list(plan.warmup))), "label")
    return FlowResult(t, w, d, yearly(w), warm, stream)


def _float(x) -> float | None:
    return None if x is None else float(x)
