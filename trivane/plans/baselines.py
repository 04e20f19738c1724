"""Static yearly baselines: a kernel posterior and gradient-boosted trees, learnt on the first years and judged on each later one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.operators.boosting import BoostParams, boost, with_probability
from trivane.operators.encoding import apply_codes, first_seen_codes
from trivane.operators.metrics import classification_metrics
from trivane.operators.posterior import KernelParams, kernel_posterior, nearest


def baseline_features(train: DataFrame, df: DataFrame, numeric: list[str], categories: list[str], order: str) -> DataFrame:
    """Numbers (missing, NaN and infinite as 0) and category codes by first appearance in ``train`` (unseen -1) as one column ``vec``."""
    for c in categories:
        df = apply_codes(df, c, first_seen_codes(train, c, order), unseen=-1)
    number = lambda c: (lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))(F.col(c).try_cast("double"))
    return df.withColumn("vec", F.array(*[number(c) for c in numeric], *[F.col(f"{c}_enc").cast("double") for c in categories]))


def kernel_baseline(df: DataFrame, warmup: list[int], year: str, label: str, key: str, k: int = 10, params: KernelParams = KernelParams(), cut: float = 0.5) -> DataFrame:
    """year and metrics of every later year; df has ``vec``."""
    train, test = df.where(F.col(year).isin(warmup)), df.where(~F.col(year).isin(warmup))
    # Nine places, so that ties of the AUC do not depend on the order of sums.
    p = nearest(train.withColumn("y", F.col(label)), test, k, key, key, answer=lambda found: kernel_posterior(found, params)).withColumn("p", F.round("p", 9))
    scored = test.select(F.col(key).cast("long").alias("query"), year, label).join(p, "query").withColumn("predicted", (F.col("p") >= cut).cast("int"))
    return classification_metrics(scored, [year], label, "predicted", "p")


def boosted_baseline(df: DataFrame, warmup: list[int], year: str, label: str, key: str, params: BoostParams = BoostParams(), cut: float = 0.5) -> DataFrame:
    """The same with second-order boosted trees."""
    forest = boost(df.where(F.col(year).isin(warmup)), label, key, "vec", params)
    scored = with_probability(df.where(~F.col(year).isin(warmup)).select(year, label, "vec"), forest).withColumn("p", F.round("p", 9))
    return classification_metrics(scored.withColumn("predicted", (F.col("p") >= cut).cast("int")), [year], label, "predicted", "p")
