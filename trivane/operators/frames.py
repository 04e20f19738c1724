"""Tidy frames behind a report's pictures: histograms, threshold trajectories, drift timelines and the grid of scores. Any plotting tool can draw them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def probability_histogram(df: DataFrame, p: str, bins: int = 20, keys: list[str] | None = None) -> DataFrame:
    """keys, bin int, lo, hi double, n long, share double: equal bins of [0, 1], the last one closed, empty ones included; values outside count in none."""
    keys = keys or []
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(p).between(0, 1)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    every = df.select(*keys).distinct().join(F.broadcast(spine), F.lit(True)) if keys else spine
    total = Window.partitionBy(*keys)
    out = every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(total)), F.lit(0.0))
    return out.select(*keys, "bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), "n", share.alias("share"))


def trajectory(trace: DataFrame, order: str, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, step int (from 1 in the order), name, value, change double: one row for each value of each window; change is against the step before (null at first)."""
    keys = keys or []
    own = Window.partitionBy(*keys).orderBy(order)
    changes = {f"__{v}": (F.col(v) - F.lag(v).over(own)).cast("double") for v in values}
    numbered = trace.withColumns({"step": F.row_number().over(own), **changes})
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value"), F.col(f"__{v}").alias("change")) for v in values]))
    return numbered.select(*keys, "step", cells.alias("c")).select(*keys, "step", "c.*")


def drift_timeline(events: DataFrame, index: str, value: str, method: str, total: int | None = None) -> DataFrame:
    """number int, index long, value double, method string, gap long, place double: events in their order, gap since the event before (null at first), place in the stream (of ``total`` values, if given)."""
    own = Window.orderBy(index, method)  # events are few beside the stream
    place = F.lit(None).cast("double") if not total else F.col(index) / total
    return events.select(
        F.row_number().over(own).alias("number"), F.col(index).cast("long").alias("index"), F.col(value).cast("double").alias("value"), F.col(method).cast("string").alias("method"),
        (F.col(index) - F.lag(index).over(own)).cast("long").alias("gap"), place.alias("place"),
    )


def score_grid(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, alpha, beta, score, row int, col int, best boolean: rows by alpha, columns by beta; best marks the first feasible cell of the least score (scores of grid_scores())."""
    keys = keys or []
    own = Window.partitionBy(*keys)
    first = F.row_number().over(own.orderBy((~F.col("feasible")).cast("int"), "score", "alpha", "beta")) == 1
    return scores.select(
        *keys, "alpha", "beta", "score", (F.dense_rank().over(own.orderBy("alpha")) - 1).cast("int").alias("row"), (F.dense_rank().over(own.orderBy("beta")) - 1).cast("int").alias("col"),
        (first & F.col("feasible")).alias("best"),
    )
