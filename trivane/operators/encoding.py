"""Category codes, target encoding, scaling, and column roles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trivane.operators.steps import join_same

MISSING = "__MISSING__"


def alphabetical_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace texts by their place in alphabetical order, null by -1. The order is that of the whole frame."""
    for c in columns:
        codes = df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("__code", (F.dense_rank().over(Window.orderBy(c)) - 1).cast("int"))
        df = df.join(codes, c, "left").withColumn(c, F.coalesce("__code", F.lit(-1))).drop("__code")
    return df


def first_seen_codes(train: DataFrame, column: str, order: str) -> DataFrame:
    """value, code: codes by first appearance in ``order``; a null counts as MISSING."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    first = train.groupBy(value.alias("value")).agg(F.min(order).alias("__first"))
    return first.select("value", (F.row_number().over(Window.orderBy("__first", "value")) - 1).cast("int").alias("code"))


def apply_codes(df: DataFrame, column: str, codes: DataFrame, unseen: int | None = None, suffix: str = "_enc") -> DataFrame:
    """Add column + suffix. An unseen value gets ``unseen``, by default the number of codes."""
    n = codes.agg(F.count("*").alias("__n")) if unseen is None else None
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    out = df.withColumn("__value", value).join(codes.withColumnRenamed("value", "__value"), "__value", "left")
    if n is not None:
        out = out.join(F.broadcast(n), F.lit(True))
    filled = F.coalesce("code", F.col("__n") if n is not None else F.lit(unseen)).cast("int")
    return out.withColumn(column + suffix, filled).drop("__value", "code", "__n")


def target_encoding(train: DataFrame, df: DataFrame, column: str, label: str, middle: float = 20, scale: float = 5) -> DataFrame:
    """Add column_te: the label's mean for the value, shrunk to the overall mean where rows are few; unseen values get that mean."""
    prior = train.agg(F.avg(label).alias("__prior"))
    stats = train.groupBy(F.col(column)).agg(F.count("*").alias("__n"), F.avg(label).alias("__mean"))
    out = df.join(stats, column, "left").join(F.broadcast(prior), F.lit(True))
    s = 1 / (1 + F.exp(-(F.col("__n") - middle) / scale))
    return out.withColumn(f"{column}_te", F.coalesce(F.col("__prior") * (1 - s) + F.col("__mean") * s, F.col("__prior"))).drop("__n", "__mean", "__prior")


def min_max(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale by the training range without clipping; a constant column gives its distance from the constant."""
    r = train.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(r), F.lit(True))
    wide = lambda c: F.when(F.col(f"__hi_{c}") == F.col(f"__lo_{c}"), F.lit(1.0)).otherwise(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))
    return out.withColumns({c: (F.col(c) - F.col(f"__lo_{c}")) / wide(c) for c in columns}).drop(*[x for x in r.columns])


def standardise(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls with the training median, then subtract the mean and divide by the population deviation (1 if 0) of the filled training rows."""
    med = train.agg(*[F.expr(f"percentile(`{c}`, 0.5)").alias(f"__med_{c}") for c in columns])
    filled = lambda d: d.join(F.broadcast(med), F.lit(True)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__med_{c}")) for c in columns}).drop(*med.columns)
    stats = filled(train).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    out = filled(df).join(F.broadcast(stats), F.lit(True))
    return out.withColumns({c: (F.col(c) - F.col(f"__mu_{c}")) / F.when(F.col(f"__sd_{c}") == 0, 1.0).otherwise(F.col(f"__sd_{c}")) for c in columns}).drop(*stats.columns)


def z_scores(df: DataFrame, columns: list[str], scope: list[str]) -> DataFrame:
    """Replace columns by z-scores over the rows of the same scope (population deviation; 1 if 0); null is a scope like any other."""
    stats = df.groupBy(*scope).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    out = join_same(df, stats, scope) if scope else df.join(F.broadcast(stats), F.lit(True))
    return out.withColumns({c: (F.col(c) - F.col(f"__mu_{c}")) / F.when(F.col(f"__sd_{c}") == 0, 1.0).otherwise(F.col(f"__sd_{c}")) for c in columns}).drop(*[x for x in stats.columns if x not in scope])


def column_roles(df: DataFrame, exclude: tuple[str, ...] = (), cyclic_words: tuple[str, ...] = ("month", "day", "hour", "time", "week"), most: int = 12) -> dict[str, str]:
    """'cyclic' by name, 'categorical' for texts and for integers of at most ``most`` values, else 'continuous'."""
    columns = [f for f in df.schema.fields if f.name not in exclude]
    counts = {f.name: df.select(f.name).where(F.col(f.name).isNotNull()).distinct().limit(most + 1).count() for f in columns if isinstance(f.dataType, T.IntegralType)}

    def role(f) -> str:
        if any(w in f.name.lower() for w in cyclic_words):
            return "cyclic"
        if isinstance(f.dataType, T.StringType) or (isinstance(f.dataType, T.IntegralType) and counts[f.name] <= most):
            return "categorical"
        return "continuous"

    return {f.name: role(f) for f in columns}


def binned_information(df: DataFrame, features: list[str], label: str, bins: int = 16) -> DataFrame:
    """feature, score: mutual information (nats) of the label and the feature in ``bins`` equal-width bins. One aggregation for all features."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("e")).select("y", "e.*").where("x is not null")
    edges = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    cells = long.join(F.broadcast(edges), "feature").groupBy("feature", b.alias("b"), "y").agg(F.count("*").alias("n"))
    per = lambda *k: Window.partitionBy("feature", *k)
    n, total = F.col("n"), F.sum("n").over(per())
    term = n / total * F.log(n * total / (F.sum("n").over(per("b")) * F.sum("n").over(per("y"))))
    return cells.withColumn("t", term).groupBy("feature").agg(F.sum("t").alias("score"))


def level_sizes(n: int) -> tuple[int, int, int]:
    """Numbers of features of three nested levels: about 60 %, 80 % and all."""
    first = max(1, round(0.6 * n))
    return first, max(first + 1, round(0.8 * n)), n


def level_size_columns(n: Column) -> tuple[Column, Column, Column]:
    """The same of a column of whole numbers."""
    first = F.greatest(F.lit(1), F.bround(0.6 * n, 0).cast("int"))
    return first, F.greatest(first + 1, F.bround(0.8 * n, 0).cast("int")), n.cast("int")


def log2_or_zero(x: Column) -> Column:
    return F.when(x > 0, F.log(x) / math.log(2)).otherwise(0.0)
