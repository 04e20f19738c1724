"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.operators.steps import shared_dir


#: With it, Spark deletes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor; the shuffle files that led to it
    go at once. The written table stays until the owner of the folder deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(written: DataFrame) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    context = written.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(written._written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one edge, to a node that is no u."""
    ends = e.select("u", F.lit(1).alias("own"), F.lit(0).alias("centre")).union(e.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("u").agg(F.sum("own").alias("own"), F.max("centre").alias("centre"))
    return seen.where("own > 1 or (own = 1 and centre = 1)").limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is its least node.

    Alternates large-star and small-star steps, each one grouping by node, until
    all that is left are stars. Every round is written to the shared folder. The minimum of
    a node's neighbours is pre-aggregated and joined back, so that a hub with
    very many neighbours is never one group in memory. Null ends are dropped.
    """
    e = (
        edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    e = materialise(e, "cc")
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = materialise(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        settled, e = e, materialise(small, "cc")
        discard(settled)
        discard(large)
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = e.select("u", "v").union(e.select(F.col("v").alias("u"), "v")).distinct()
    return roots.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
