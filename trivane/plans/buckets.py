"""Posterior by bucket and one pair of thresholds for all: year split, fine and coarse buckets, neighbours in the bucket, global search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.operators.bucketing import assign_fine, fine_buckets
from trivane.operators.encoding import apply_codes, first_seen_codes
from trivane.operators.labels import year_split
from trivane.operators.posterior import nearest_in_bucket
from trivane.operators.steps import written
from trivane.operators.thresholds import learn_global


@dataclass(frozen=True)
class BucketPlan:
    """airport and slot name the buckets; numeric and categories (as codes) are the features; train and validation are inclusive years."""

    key: str
    label: str
    year: str
    airport: str
    slot: str
    numeric: tuple[str, ...]
    categories: tuple[str, ...] = ()
    train: tuple[int, int] = (0, 0)
    validation: tuple[int, int] = (0, 0)
    min_fine: int = 50
    min_airport: int = 50
    k: int = 10
    most: int = 50_000


@dataclass
class BucketPlanResult:
    """probabilities: query, p, source, bucket, year, label of the validation rows; thresholds: pairs, best first."""

    probabilities: DataFrame
    thresholds: DataFrame


def run_bucket_plan(df: DataFrame, plan: BucketPlan, digits: int = 9) -> BucketPlanResult:
    """A known bucket's rows have a model of its own (a coarse one holds all rows of its airport); others use all training rows.

    A bucket's model is its (at most ``most``) training rows. Probabilities are rounded to ``digits`` places. Rows of neither
    span of years go.
    """
    for c in plan.categories:
        df = apply_codes(df, c, first_seen_codes(df.where(F.col(plan.year).between(*plan.train)), c, plan.key), unseen=-1)
    rows = year_split(df, plan.year, plan.train, plan.validation)
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    known = written(fine_buckets(train, plan.airport, plan.slot, plan.min_fine, plan.min_airport), "buckets")
    fine = known.where(F.col(plan.slot).isNotNull())
    coarse = known.where(F.col(plan.slot).isNull()).select(plan.airport, "bucket")
    models = train.join(fine, [plan.airport, plan.slot]).unionByName(train.join(coarse, plan.airport))
    asked = assign_fine(validation, known, plan.airport, plan.slot)
    columns = [*plan.numeric, *[f"{c}_enc" for c in plan.categories]]
    p = nearest_in_bucket(models, asked, plan.k, plan.key, plan.key, "bucket", columns, plan.label, least=1, most=plan.most, fallback=train)
    found = asked.select(F.col(plan.key).cast("long").alias("query"), "bucket", plan.year, plan.label).join(p.withColumn("p", F.round("p", digits)), "query")
    found = written(found, "probabilities")
    return BucketPlanResult(found, learn_global(found, plan.year, plan.label, "p"))
