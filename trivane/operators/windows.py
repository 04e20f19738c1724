"""Periods, warm-up, seasonal history with delayed labels, weights, and runs of equal labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.functions.expressions import month_gap
from trivane.operators.ordered import previous, running_sums


def synthesize_year(df: DataFrame, order: list[str], month: str = "Month", base: int = 0, name: str = "Year_synth") -> DataFrame:
    """Add a year that rises by one whenever the month falls from one row to the next. Missing months take the last one before, or the first after, or 1."""
    filled = df.withColumn("__m", F.when(F.col(month).isNotNull(), F.least(F.greatest(F.col(month).cast("int"), F.lit(1)), F.lit(12))))
    known = filled.where("__m is not null").select(*order, "__m")
    if filled.where("__m is null").limit(1).count():
        # The number of known months so far names the month to take.
        counted = running_sums(filled, order, {"__k": F.col("__m").isNotNull().cast("long")})
        table = running_sums(known, order, {"__k": F.lit(1).cast("long")}).select("__k", F.col("__m").alias("__known"))
        counted = counted.withColumn("__k", F.greatest("__k", F.lit(1))).join(table, "__k", "left")
        filled = counted.withColumn("__m", F.coalesce("__m", "__known", F.lit(1))).drop("__k", "__known")
    back = previous(filled, order, "__m", "__before")
    out = running_sums(back, order, {"__falls": F.coalesce(F.col("__m") < F.col("__before"), F.lit(False)).cast("long")})
    return out.withColumn(name, (F.col("__falls") + base).cast("int")).drop("__m", "__before", "__falls")


@dataclass(frozen=True)
class WindowPlan:
    warmup: tuple[int, ...]
    stream: tuple[int, ...]


def plan_years(df: DataFrame, year: str) -> WindowPlan:
    """The first half of the years (at least one) warms up, the rest is streamed."""
    years = sorted(r[0] for r in df.select(year).where(F.col(year).isNotNull()).distinct().collect())
    if len(years) < 2:
        raise ValueError("two years at least are needed")
    n = max(1, len(years) // 2)
    return WindowPlan(tuple(years[:n]), tuple(years[n:]))


def month_windows(df: DataFrame, period: str, *aggregates: Column) -> DataFrame:
    return df.groupBy(period).agg(F.count("*").alias("n"), *aggregates)


def unlocked(history: DataFrame, current: int, unlock: str = "unlock_idx") -> DataFrame:
    """Rows whose labels are known by now; a label unlocks in the period after its own."""
    return history.where(F.col(unlock) <= current)


def gather(periods: DataFrame, current: int, history_cap: int = 8, recent: int = 3, seasons: int = 12) -> DataFrame:
    """Of the periods before ``current``: the newest history_cap of its season (calendar month), and the newest ``recent`` of others."""
    past = periods.select("period_idx").where(F.col("period_idx") < current).distinct().withColumn("same_month", F.pmod("period_idx", F.lit(seasons)) == current % seasons)
    rank = F.row_number().over(Window.partitionBy("same_month").orderBy(F.desc("period_idx")))
    return past.withColumn("r", rank).where((F.col("same_month") & (F.col("r") <= history_cap)) | (~F.col("same_month") & (F.col("r") <= recent))).drop("r")


@dataclass(frozen=True)
class SeasonWeights:
    """decay by age in months; season factors of the neighbouring months and of others; keep ratio a month of same-month history."""

    decay: float = 0.05
    neighbour: float = 0.5
    other: float = 0.2
    keep_ratio: float = 0.3
    most: float = 10.0


def record_weight(period, current: int, newest_same: int | None, p, region, label, drift: float = 1.0, w: SeasonWeights = SeasonWeights(), seasons: int = 12) -> Column:
    """Weight of a past row: age, season, confidence of its probability (less if deferred or decided wrongly), and drift; held to [1e-6, most]."""
    t = F.col(period)
    age = F.greatest(current - t, F.lit(1)) - 1
    gap = month_gap(F.pmod(t, F.lit(seasons)), F.lit(current % seasons), seasons)
    season = F.when(gap == 0, 1.0).when(gap == 1, w.neighbour).otherwise(w.other)
    keep = F.when(gap == 0, F.pow(F.lit(w.keep_ratio), (F.lit(newest_same) - t).cast("double"))).otherwise(1.0) if newest_same is not None else F.lit(1.0)
    sure = F.least(F.greatest(2 * F.abs(F.col(p) - 0.5), F.lit(0.2)), F.lit(1.0))
    wrong = ((F.col(region) == 1) & (F.col(label) == 0)) | ((F.col(region) == -1) & (F.col(label) == 1))
    sure = sure * F.when(F.col(region) == 0, 0.7).otherwise(1.0) * F.when(wrong, 0.6).otherwise(1.0)
    return F.least(F.greatest(F.exp(-w.decay * age) * season * keep * drift * sure, F.lit(1e-6)), F.lit(w.most))


def drift_multiplier(previous: float, level: str) -> float:
    """S3 1.5, S2 1.3, S1 1.15, kept if greater; otherwise nine tenths, at least 1."""
    up = {"S3": 1.5, "S2": 1.3, "S1": 1.15}.get(level)
    return max(previous, up) if up else max(1.0, previous * 0.9)


def run_windows(df: DataFrame, order: list[str], label: str, span: int = 1) -> DataFrame:
    """Add run (1-based number of the run of equal labels in the order) and window (``span`` runs each, from 0)."""
    back = previous(df, order, label, "__before")
    out = running_sums(back, order, {"run": (~F.col(label).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).cast("long")}).drop("__before")
    return out.withColumn("window", F.floor((F.col("run") - 1) / span).cast("long"))


def sample_windows(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add window: ``size`` rows each in the order, from 0."""
    out = running_sums(df, order, {"__n": F.lit(1).cast("long")})
    return out.withColumn("window", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")
