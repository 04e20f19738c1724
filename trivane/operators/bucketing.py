"""Buckets with back-off, reference sets, and similarity of rows to the references of their bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.functions.expressions import category_match, mixed_similarity, rbf
from trivane.operators.steps import join_same


#: Bytes that a broadcast value is taken for; rows of a salt.
COLUMN_BYTES, SALT_ROWS = 32, 1 << 16


@dataclass(frozen=True)
class BucketConfig:
    """keys of the finest bucket, then coarser lists of keys (a lone name is a list of one); least rows of a bucket."""

    keys: tuple[str, ...]
    backoff: tuple[tuple[str, ...] | str, ...] = ()
    least: int = 50

    def levels(self, columns: list[str]) -> list[list[str]]:
        all_ = [self.keys, *[(b,) if isinstance(b, str) else tuple(b) for b in self.backoff]]
        return [use for level in all_ if (use := [c for c in level if c in columns])]


def bucket_id(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("__MISSING__")) for k in keys])


def assign_buckets(df: DataFrame, config: BucketConfig, scope: list[str] | None = None, name: str = "bucket_id") -> DataFrame:
    """Add the finest bucket with enough rows of the scope, else the coarsest; without any key column '__MISSING__'.

    Null is a value of the scope like any other. Counts are aggregated by level and joined back, so that a hot bucket is pre-aggregated rather
    than gathered in one window.
    """
    scope, levels = scope or [], config.levels(df.columns)
    if not levels:
        return df.withColumn(name, F.lit("__MISSING__"))
    out = df.withColumns({f"__b{i}": bucket_id(k) for i, k in enumerate(levels)})
    for i in range(len(levels) - 1):
        counts = out.groupBy(*scope, f"__b{i}").agg(F.count("*").alias(f"__n{i}"))
        out = join_same(out, counts, [*scope, f"__b{i}"])
    chosen = [F.when(F.col(f"__n{i}") >= config.least, F.col(f"__b{i}")) for i in range(len(levels) - 1)]
    return out.withColumn(name, F.coalesce(*chosen, F.col(f"__b{len(levels) - 1}"))).drop(*[c for i in range(len(levels)) for c in (f"__b{i}", f"__n{i}")])


def bucket_stats(df: DataFrame, label: str, bucket: str = "bucket_id") -> DataFrame:
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return df.groupBy(bucket).agg(F.count("*").alias("n_samples"), pos.alias("n_pos"), (F.count("*") - pos).alias("n_neg"), (pos / F.count("*")).alias("pos_rate"))


def fine_buckets(train: DataFrame, airport: str, slot: str, min_fine: int, min_airport: int) -> DataFrame:
    """airport, slot, fine: groups with enough rows (slot null: an airport with enough rows)."""
    fine = train.groupBy(airport, slot).agg(F.count("*").alias("n")).where(F.col("n") >= min_fine)
    coarse = train.groupBy(airport).agg(F.count("*").alias("n")).where(F.col("n") >= min_airport)
    name = F.concat(F.col(airport).cast("string"), F.lit("__slot"), F.col(slot).cast("string"))
    return fine.select(airport, slot, name.alias("bucket")).union(coarse.select(airport, F.lit(None).cast(train.schema[slot].dataType), F.concat(F.col(airport).cast("string"), F.lit("__COARSE"))))


def assign_fine(df: DataFrame, known: DataFrame, airport: str, slot: str) -> DataFrame:
    """Add bucket: the known fine one, else the airport's coarse one, which may be new."""
    fine = known.where(F.col(slot).isNotNull()).select(airport, slot, "bucket")
    return df.join(fine, [airport, slot], "left").withColumn("bucket", F.coalesce("bucket", F.concat(F.col(airport).cast("string"), F.lit("__COARSE"))))


def bucket_mask(df: DataFrame, bucket: str, airport: str, slot: str) -> DataFrame:
    """Rows of an id made by fine_buckets."""
    if bucket.endswith("__COARSE"):
        return df.where(F.col(airport).cast("string") == bucket[: -len("__COARSE")])
    if "__slot" in bucket:
        a, s = bucket.rsplit("__slot", 1)
        return df.where((F.col(airport).cast("string") == a) & (F.col(slot).cast("string") == s))
    raise ValueError(f"no such bucket: {bucket}")


@dataclass(frozen=True)
class ReferenceConfig:
    top: int = 256
    quantile: float = 0.8
    weight_clip: float = 10.0


def reference_set(pool: DataFrame, label: str, order: str, p: str = "p", weight: str = "weight", bucket: str = "bucket_id", config: ReferenceConfig = ReferenceConfig()) -> DataFrame:
    """``pool`` rows that represent their bucket, with side ('pos' or 'neg'), rank and weight.

    A positive scores weight * p, a negative weight * (1 - p). Positives at or above the
    quantile and negatives at or above 1 - quantile stay, at most ``top`` of each by score, ties by ``order``.
    """
    w = F.least(F.greatest(F.coalesce(F.col(weight), F.lit(1.0)), F.lit(1e-6)), F.lit(config.weight_clip))
    prob = F.coalesce(F.col(p), F.lit(0.5))
    score = F.when(F.col(label) == 1, w * F.greatest(prob, F.lit(1e-6))).otherwise(w * F.greatest(1 - prob, F.lit(1e-6)))
    rows = pool.withColumns({"side": F.when(F.col(label) == 1, "pos").otherwise("neg"), "weight": w}).withColumn("__score", score)
    q_pos, q_neg = F.percentile(F.when(F.col("side") == "pos", F.col("__score")), F.lit(config.quantile)), F.percentile(F.when(F.col("side") == "neg", F.col("__score")), F.lit(1 - config.quantile))
    cut = rows.groupBy(bucket).agg(q_pos.alias("__qp"), q_neg.alias("__qn"))
    # Scores are compared to nine places, so that ties do not hang on the last bit.
    kept = rows.join(cut, bucket).where(F.col("__score") >= F.when(F.col("side") == "pos", F.col("__qp")).otherwise(F.col("__qn")) - 1e-9)
    rank = F.row_number().over(Window.partitionBy(bucket, "side").orderBy(F.round("__score", 9).desc(), order))
    return kept.withColumn("rank", rank).where(F.col("rank") <= config.top).drop("__score", "__qp", "__qn")


def combine_history(old: DataFrame, new: DataFrame, ratio: float, bucket: str = "bucket_id") -> DataFrame:
    """New references after the first ceil(ratio * number of new ones) old ones of the same bucket and side."""
    n = new.groupBy(bucket, "side").agg(F.count("*").alias("__n"))
    take = old.join(n, [bucket, "side"]).where(F.col("rank") <= F.ceil(F.col("__n") * ratio)).drop("__n")
    return take.withColumn("from_old", F.lit(True)).unionByName(new.withColumn("from_old", F.lit(False)))


def similarity_to_references(
    rows: DataFrame, references: DataFrame, key: str, numeric: list[str], categories: dict[str, float], sigma: float = 1.0, mode: str = "product", mix: float = 0.5, bucket: str = "bucket_id", small: int = 64 << 20
) -> DataFrame:
    """key, e_pos, e_neg: weighted mean similarity of each row to either side's references of its bucket, 0 where there are none.

    References are at most 2 * top a bucket. They are broadcast when they have at most ``small`` bytes (counted first, COLUMN_BYTES a
    value); otherwise both sides are shuffled by bucket, and a bucket is split in as many salts as it has
    SALT_ROWS rows: its references are copied to every salt, its rows dealt among them.
    """
    cols = [*numeric, *categories]
    refs = references.select(bucket, "side", F.col("weight").alias("__w"), *[F.col(c).alias(f"__r_{c}") for c in cols])
    left = rows.select(key, bucket, *cols)
    most = small // (COLUMN_BYTES * len(refs.columns))
    if refs.limit(most + 1).count() <= most:
        pairs = left.join(F.broadcast(refs), bucket)
    else:
        salts = left.groupBy(bucket).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("__salts"))
        refs = refs.join(salts, bucket).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
        left = left.join(salts, bucket).withColumn("__salt", F.expr(f"cast(pmod(xxhash64(`{key}`), __salts) as int)")).drop("__salts")
        pairs = left.join(refs, [bucket, "__salt"])
    num = rbf([F.col(c) for c in numeric], [F.col(f"__r_{c}") for c in numeric], sigma)
    cat = category_match([F.col(c) for c in categories], [F.col(f"__r_{c}") for c in categories], list(categories.values()))
    sim = mixed_similarity(num, cat, mode, mix)
    side = lambda s: F.try_divide(F.sum(F.when(F.col("side") == s, sim * F.col("__w"))), F.sum(F.when(F.col("side") == s, F.col("__w"))))
    e = pairs.groupBy(key).agg(side("pos").alias("e_pos"), side("neg").alias("e_neg"))
    return rows.select(key).join(e, key, "left").select(key, F.coalesce("e_pos", F.lit(0.0)).alias("e_pos"), F.coalesce("e_neg", F.lit(0.0)).alias("e_neg"))
