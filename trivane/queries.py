"""One query for each operator over the test tables, with the SQL that says the same.

``flights`` stands in for the domain's table: an order is a row, its date gives year and
month, keys give clock times, places and scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.config import DataConfig, from_dict
from trivane.functions import expressions as X
from trivane.operators import bucketing as B
from trivane.operators import drift as D
from trivane.operators import encoding as E
from trivane.operators import frames as R
from trivane.operators import information as I
from trivane.operators import labels as L
from trivane.operators import light as G
from trivane.operators import metrics as M
from trivane.operators import ordered as O
from trivane.operators import posterior as P
from trivane.operators import thresholds as H
from trivane.operators import threeway as W
from trivane.operators import windows as T
from trivane.operators.boosting import BoostParams
from trivane.operators.steps import shared_dir
from trivane.plans import baselines, buckets, dynamic, flow
from trivane.sources import tables
from trivane.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLIGHTS = """flights AS (
  SELECT o_orderkey AS row_id, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day,
    CAST(o_orderkey % 24 AS INT) * 100 + CAST(o_custkey % 60 AS INT) AS dep, CAST(o_orderkey * 7 % 24 AS INT) * 100 + CAST(o_custkey * 3 % 60 AS INT) AS arr,
    o_totalprice AS dist, CAST(c_nationkey AS INT) AS origin, c_mktsegment AS carrier, o_orderpriority AS priority,
    CAST((o_orderkey * 37 + o_custkey * 11) % 60 - 15 AS DOUBLE) AS delay, CAST(CASE WHEN (o_orderkey * 37 + o_custkey * 11) % 60 > 30 THEN 1 ELSE 0 END AS INT) AS label,
    CAST((o_orderkey * 37 + o_custkey * 11) % 60 + o_orderkey * 13 % 40 AS DOUBLE) / 100 AS p,
    CAST((o_orderkey * 37 + o_custkey * 11) % 60 + o_orderkey * 17 % 70 AS DOUBLE) / 130 AS p1, CAST((o_orderkey * 37 + o_custkey * 11) % 60 + o_orderkey * 19 % 20 AS DOUBLE) / 80 AS p3,
    CAST(year(o_orderdate) AS INT) * 12 + CAST(month(o_orderdate) AS INT) - 1 AS period_idx
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    a = F.expr("(o_orderkey * 37 + o_custkey * 11) % 60")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"),
        F.expr("cast(o_orderkey % 24 as int) * 100 + cast(o_custkey % 60 as int)").alias("dep"), F.expr("cast(o_orderkey * 7 % 24 as int) * 100 + cast(o_custkey * 3 % 60 as int)").alias("arr"),
        F.col("o_totalprice").alias("dist"), F.col("c_nationkey").cast("int").alias("origin"), F.col("c_mktsegment").alias("carrier"), F.col("o_orderpriority").alias("priority"),
        (a - 15).cast("double").alias("delay"), (a > 30).cast("int").alias("label"),
        ((a + F.expr("o_orderkey * 13 % 40")).cast("double") / 100).alias("p"), ((a + F.expr("o_orderkey * 17 % 70")).cast("double") / 130).alias("p1"), ((a + F.expr("o_orderkey * 19 % 20")).cast("double") / 80).alias("p3"),
        X.period_index(F.year("o_orderdate"), F.month("o_orderdate")).alias("period_idx"),
    )


def query(name: str, sql: str | None = None):
    """Register a query; SQL may use the table ``flights``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = body if "flights" not in body else (f"WITH RECURSIVE {FLIGHTS}, {body[5:]}" if body.startswith("WITH ") else f"WITH {FLIGHTS} {body}")
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


# ---- sources, labels, filters ----------------------------------------------------


@query("s1_load_and_prepare", """
WITH codes AS (SELECT *, CAST(dense_rank() OVER (ORDER BY carrier) - 1 AS INT) AS c, CAST(dense_rank() OVER (ORDER BY priority) - 1 AS INT) AS q FROM flights)
SELECT label, count(*) AS n, CAST(sum(c) AS BIGINT) AS carriers, CAST(sum(q) AS BIGINT) AS priorities, round(avg(dist), 6) AS dist FROM codes GROUP BY label""")
def s1(spark, d):
    df = flights(spark, d).select("row_id", "dist", "carrier", "priority", "delay")
    out = tables.prepare(df, DataConfig(continuous_label="delay", threshold=15.0))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum("carrier").alias("carriers"), F.sum("priority").alias("priorities"), F.round(F.avg("dist"), 6).alias("dist"))


@query("s4_synthetic_source", """
WITH f AS (SELECT o_orderkey AS k, list_transform(range(6), lambda i: ('0x' || substr(md5(o_orderkey || '|' || i), 1, 8))::BIGINT / 2147483648.0 - 1) AS x FROM orders)
SELECT CAST(x[2] + x[4] - x[1] - x[3] + x[6] > 0 AS INT) AS label, count(*) AS n, round(avg(x[1]), 6) AS mean, round(max(x[5]), 6) AS most FROM f GROUP BY 1""")
def s4(spark, d):
    rows = tables.synthetic_by_key(read(spark, d, "orders"), "o_orderkey", 5, 4)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("feat_00"), 6).alias("mean"), F.round(F.max("feat_04"), 6).alias("most"))


@query("s3_csv_round_trip", "SELECT count(*) AS n, round(sum(dist), 4) AS dist, count(DISTINCT carrier) AS carriers FROM flights")
def s3(spark, d):
    """Written as CSV by the sink (s5) and read back by the source, which finds the delimiter."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(flights(spark, d).select("row_id", "dist", "carrier"), path, single=False)
    return tables.read_csv(spark, path).agg(F.count("*").alias("n"), F.round(F.sum("dist"), 4).alias("dist"), F.count_distinct("carrier").alias("carriers"))


@query("s2_arff", "SELECT carrier, count(*) AS n, round(sum(delay), 4) AS delay FROM flights GROUP BY carrier")
def s2(spark, d):
    """An ARFF file of the table in the shared folder, read back by the source."""
    path = f"{shared_dir(spark)}/arff-{uuid.uuid4().hex}"
    rows = flights(spark, d)
    head = spark.createDataFrame([(f"@relation flights\n@attribute row_id numeric\n@attribute carrier {{{', '.join(repr(r[0]) for r in rows.select('carrier').distinct().orderBy('carrier').limit(100).collect())}}}\n@attribute delay numeric\n@data",)], "value string")
    body = rows.select(F.concat_ws(",", "row_id", F.concat(F.lit("'"), "carrier", F.lit("'")), "delay").alias("value"))
    head.coalesce(1).write.text(f"{path}/0")
    body.write.text(f"{path}/1")
    return tables.read_arff(spark, f"{path}/0", f"{path}/1").groupBy("carrier").agg(F.count("*").alias("n"), F.round(F.sum("delay"), 4).alias("delay"))


@query("s8_config", "SELECT CAST(delay > 15 AS INT) AS label, count(*) AS n, CAST(10 AS INT) AS k, round(avg(1 - exp(-2.5 * p)), 6) AS regret FROM flights GROUP BY 1")
def s8(spark, d):
    """A configuration of mixed keys says how the table is labelled and measured."""
    c = from_dict({"GWB": {"k": 10}, "S3_sigma": 2.5, "S3_pentalty_large": 100.0, "PSO_particles": 28, "continuous_label": "delay", "threshold": 15})
    rows = L.binarize_continuous(flights(spark, d).drop("label"), c.DATA.continuous_label, c.DATA.threshold, c.DATA.threshold_op)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.lit(c.GWB.k).alias("k"), F.round(F.avg(1 - F.exp(-c.S3WD.sigma * F.col("p"))), 6).alias("regret"))


def tables_config() -> list[tuple[str, str]]:
    from trivane.config import flatten

    mixed = {"GWB": {"k": 10}, "S3_sigma": 2.5, "S3_pentalty_large": 100.0, "PSO_particles": 28, "continuous_label": "delay", "threshold": 15}
    return [(k, str(v)) for k, v in flatten(from_dict(mixed)).items()]


@query("s7_histogram", """
WITH k AS (SELECT DISTINCT year FROM flights), b AS (SELECT unnest(range(20)) AS bin), c AS (SELECT year, least(floor(p1 * 20), 19) AS bin, count(*) AS n FROM flights WHERE p1 BETWEEN 0 AND 1 GROUP BY ALL)
SELECT year, CAST(b.bin AS INT) AS bin, round(b.bin / 20, 6) AS lo, round((b.bin + 1) / 20, 6) AS hi, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / sum(n) OVER (PARTITION BY year), 0), 6) AS share FROM k, b LEFT JOIN c ON c.year = k.year AND c.bin = b.bin""".replace("FROM k, b LEFT", "FROM k CROSS JOIN b LEFT").replace("SELECT year, CAST(b", "SELECT k.year, CAST(b").replace("PARTITION BY year", "PARTITION BY k.year"))
def s7_histogram(spark, d):
    return R.probability_histogram(flights(spark, d), "p1", 20, ["year"]).select("year", "bin", *r6("lo", "hi"), "n", *r6("share"))


@query("s7_trajectory", """
WITH m AS (SELECT year, month, avg(p) AS p, avg(p1) AS q FROM flights GROUP BY ALL), s AS (SELECT *, row_number() OVER w AS step, p - lag(p) OVER w AS dp, q - lag(q) OVER w AS dq FROM m WINDOW w AS (PARTITION BY year ORDER BY month))
SELECT year, CAST(step AS INT) AS step, 'p' AS name, round(p, 6) AS value, round(dp, 6) AS change FROM s UNION ALL SELECT year, CAST(step AS INT), 'q', round(q, 6), round(dq, 6) FROM s""")
def s7_trajectory(spark, d):
    trace = flights(spark, d).groupBy("year", "month").agg(F.avg("p").alias("p"), F.avg("p1").alias("q"))
    return R.trajectory(trace, "month", ["p", "q"], ["year"]).select("year", "step", "name", *r6("value", "change"))


@query("s7_drift_timeline", """
WITH e AS (SELECT period_idx AS i, avg(p1) AS v FROM flights GROUP BY 1 HAVING avg(p1) > 0.45)
SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS number, CAST(i AS BIGINT) AS index, round(v, 6) AS value, 'mean' AS method, CAST(i - lag(i) OVER (ORDER BY i) AS BIGINT) AS gap, round(i / 30000, 6) AS place FROM e""")
def s7_timeline(spark, d):
    e = flights(spark, d).groupBy(F.col("period_idx").alias("i")).agg(F.avg("p1").alias("v")).where("v > 0.45").withColumn("how", F.lit("mean"))
    return R.drift_timeline(e, "i", "v", "how", 30_000).select("number", "index", *r6("value"), "method", "gap", *r6("place"))


@query("l1_continuous_label", "SELECT row_id, CAST(delay > 15 AS INT) AS label FROM flights")
def l1(spark, d):
    return L.binarize_continuous(flights(spark, d).drop("label"), "delay", 15.0).select("row_id", "label")


@query("l2_existing_label", """
WITH n AS (SELECT priority, count(*) AS n FROM flights GROUP BY priority ORDER BY n, priority LIMIT 1)
SELECT row_id, CAST(flights.priority = n.priority AS INT) AS label FROM flights, n""")
def l2(spark, d):
    return L.binarize_existing(flights(spark, d).drop("label"), "priority").select("row_id", "label")


@query("l3_equal_label", "SELECT carrier, CAST(sum(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM flights GROUP BY carrier")
def l3(spark, d):
    return flights(spark, d).groupBy("carrier").agg(F.sum(L.equals_positive("priority", "1-URGENT")).alias("positives"))


@query("f1_clean", "WITH f AS (SELECT *, CASE WHEN row_id % 7 = 0 THEN NULL WHEN row_id % 11 = 0 THEN CAST('inf' AS DOUBLE) WHEN row_id % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE dist END AS x FROM flights) SELECT row_id, x FROM f WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)")
def f1(spark, d):
    x = F.when(F.col("row_id") % 7 == 0, F.lit(None)).when(F.col("row_id") % 11 == 0, F.lit(float("inf"))).when(F.col("row_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("dist"))
    return L.clean(flights(spark, d).withColumn("x", x), ["x", "dist"]).select("row_id", "x")


@query("f2_period_filter", "SELECT row_id, period_idx FROM flights WHERE period_idx = 1996 * 12 + 4")
def f2(spark, d):
    return flights(spark, d).where(F.col("period_idx") == 1996 * 12 + 4).select("row_id", "period_idx")


@query("f3_members_and_complement", "WITH w AS (SELECT DISTINCT year FROM flights WHERE year <= 1997) SELECT year, count(*) AS n, year IN (SELECT year FROM w) AS warmup FROM flights GROUP BY year")
def f3(spark, d):
    df = flights(spark, d)
    warm = df.where("year <= 1997").select("year").distinct()
    side = lambda inside: L.members(df, "year", warm, inside).groupBy("year").agg(F.count("*").alias("n")).withColumn("warmup", F.lit(inside))
    return side(True).unionByName(side(False))


@query("f4_year_split", "SELECT CASE WHEN year BETWEEN 1995 AND 1997 THEN 'train' ELSE 'validation' END AS split, count(*) AS n FROM flights WHERE year BETWEEN 1995 AND 1999 GROUP BY 1")
def f4(spark, d):
    return L.year_split(flights(spark, d), "year", (1995, 1997), (1998, 1999)).groupBy("split").agg(F.count("*").alias("n"))


@query("f5_region_masks", "SELECT p >= 0.6 AS in_pos, p <= 0.35 AS in_neg, p < 0.6 AND p > 0.35 AS in_bnd, count(*) AS n FROM flights GROUP BY ALL")
def f5(spark, d):
    return W.masks(flights(spark, d), "p", 0.6, 0.35).groupBy("in_pos", "in_neg", "in_bnd").agg(F.count("*").alias("n"))


@query("p1_numeric_columns", "SELECT unnest(['row_id', 'year', 'day', 'dep', 'arr', 'dist', 'delay', 'label', 'p', 'p1', 'p3', 'period_idx']) AS name")
def p1(spark, d):
    names = L.numeric_columns(flights(spark, d), ("month", "origin"))
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("u5_chronological_split", """
WITH r AS (SELECT year, row_number() OVER (ORDER BY year, month, day, row_id) AS i, count(*) OVER () AS n FROM flights)
SELECT year, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY ALL""")
def u5(spark, d):
    df = flights(spark, d).withColumn("t", F.col("year") * 400 + F.col("month") * 31 + F.col("day"))
    return L.chronological_split(df, ["t", "row_id"]).groupBy("year", "split").agg(F.count("*").alias("n"))


@query("u6_stratified_split", """
WITH r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || '|5'), row_id) AS i, count(*) OVER (PARTITION BY label) AS n, row_id FROM flights)
SELECT row_id, CASE WHEN i <= floor(n * 0.3 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def u6(spark, d):
    return L.stratified_split(flights(spark, d), "label", "row_id", 0.3, 5).select("row_id", "split")


# ---- expressions -----------------------------------------------------------------


@query("e1_time_to_minutes", "SELECT row_id, CAST(CASE WHEN row_id % 9 = 0 THEN 0 ELSE least(greatest((dep + 1000 * (row_id % 3)) // 100, 0), 23) * 60 + least((dep + 1000 * (row_id % 3)) % 100, 59) END AS INT) AS minutes FROM flights")
def e1(spark, d):
    df = flights(spark, d).withColumn("t", F.when(F.col("row_id") % 9 == 0, F.lit("bad")).otherwise((F.col("dep") + 1000 * (F.col("row_id") % 3)).cast("string")))
    return df.select("row_id", X.time_to_minutes("t").alias("minutes"))


@query("e2_augment_times", """
WITH m AS (SELECT row_id, (dep // 100) * 60 + dep % 100 AS a, (arr // 100) * 60 + arr % 100 AS b FROM flights)
SELECT row_id, CAST(a // 60 AS INT) AS dep_hour, CAST(b // 60 AS INT) AS arr_hour, CAST((b - a + 1440) % 1440 AS INT) AS block_time_min,
  CASE WHEN a // 60 <= 4 THEN 0 WHEN a // 60 <= 9 THEN 1 WHEN a // 60 <= 15 THEN 2 WHEN a // 60 <= 19 THEN 3 ELSE 4 END AS dep_block FROM m""")
def e2(spark, d):
    return X.augment_times(flights(spark, d), "dep", "arr").select("row_id", "dep_hour", "arr_hour", "block_time_min", "dep_block")


@query("e4_time_slots", """
SELECT CASE WHEN m >= 600 AND m < 1500 THEN 2 WHEN m >= 300 AND m < 700 THEN 1 WHEN m >= 0 AND m < 360 THEN 0 ELSE -1 END AS slot, season, count(*) AS n
FROM (SELECT (dep // 100) * 60 + dep % 100 AS m, printf('%d-%02d', year, month) AS season FROM flights) GROUP BY ALL""")
def e4(spark, d):
    df = flights(spark, d).select(X.time_slot(X.time_to_minutes("dep"), [(0, 360), (300, 700), (600, 1500)]).alias("slot"), X.month_label("year", "month").alias("season"))
    return df.groupBy("slot", "season").agg(F.count("*").alias("n"))


@query("e5_window_label", "SELECT DISTINCT year, month, round(CASE WHEN year < 1998 THEN year - 1998 - month / 100.0 ELSE year - 1998 + month / 100.0 END, 2) AS win FROM flights")
def e5(spark, d):
    return flights(spark, d).select("year", "month", X.window_label("year", "month", 1998).alias("win")).distinct()


@query("e6_parse_month_label", "SELECT DISTINCT year || '/' || month AS txt, year + month / 100.0 AS value FROM flights UNION ALL SELECT '7.5', 7.5 UNION ALL SELECT '1997-13', NULL UNION ALL SELECT 'x', NULL")
def e6(spark, d):
    a = flights(spark, d).select(F.concat_ws("/", F.col("year").cast("string"), F.col("month").cast("string")).alias("txt")).distinct()
    b = spark.createDataFrame([("7.5",), ("1997-13",), ("x",)], "txt string")
    return a.union(b).select("txt", X.parse_month_label("txt").alias("value"))


@query("e7_cyclic", "SELECT DISTINCT month, round(sin(2 * pi() * (month % 12) / 12), 6) AS s, round(cos(2 * pi() * (month % 12) / 12), 6) AS c FROM flights")
def e7(spark, d):
    s, c = X.cyclic("month", 12)
    return flights(spark, d).select("month", (F.round(s, 6) + 0.0).alias("s"), (F.round(c, 6) + 0.0).alias("c")).distinct()


@query("e8_event_date", "SELECT row_id, CAST(try_cast(printf('%04d-%02d-%02d', year, month, day + CASE WHEN row_id % 5 = 0 THEN 3 ELSE 0 END) AS DATE) AS VARCHAR) AS dt FROM (SELECT row_id, year, month, least(day, 28) AS day FROM flights)")
def e8(spark, d):
    day = F.least("day", F.lit(28)) + F.when(F.col("row_id") % 5 == 0, 3).otherwise(0)
    return flights(spark, d).select("row_id", X.event_date("year", "month", day).cast("string").alias("dt"))


@query("e9_season_keys", """
SELECT printf('M%02d', month(o_orderdate)) AS m, printf('W%02d', week(o_orderdate)) AS w, printf('D%03d', dayofyear(o_orderdate)) AS dy, printf('Q%02d', quarter(o_orderdate)) AS q, count(*) AS n FROM orders GROUP BY ALL""")
def e9(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy(*[X.season_key("o_orderdate", k).alias(a) for k, a in (("month", "m"), ("week", "w"), ("day", "dy"), ("quarter", "q"))]).agg(F.count("*").alias("n"))


@query("e10_alphabetical_codes", "SELECT row_id, CASE WHEN row_id % 10 = 0 THEN -1 ELSE CAST(c AS INT) END AS carrier FROM (SELECT row_id, dense_rank() OVER (ORDER BY carrier) - 1 AS c FROM flights)")
def e10(spark, d):
    df = flights(spark, d).select("row_id", F.when(F.col("row_id") % 10 != 0, F.col("carrier")).alias("carrier"))
    return E.alphabetical_codes(df, ["carrier"])


@query("e11_first_seen_codes", """
WITH c AS (SELECT carrier || '/' || priority AS v, min(row_id) AS f FROM flights WHERE year <= 1995 GROUP BY 1),
k AS (SELECT v, row_number() OVER (ORDER BY f) - 1 AS code FROM c)
SELECT row_id, CAST(coalesce(code, (SELECT count(*) FROM k)) AS INT) AS v_enc, CAST(coalesce(code, -1) AS INT) AS v_strict FROM flights LEFT JOIN k ON v = carrier || '/' || priority""")
def e11(spark, d):
    df = flights(spark, d).withColumn("v", F.concat_ws("/", "carrier", "priority"))
    codes = E.first_seen_codes(df.where("year <= 1995"), "v", "row_id")
    out = E.apply_codes(E.apply_codes(df, "v", codes), "v", codes, unseen=-1, suffix="_strict")
    return out.select("row_id", "v_enc", "v_strict")


@query("e13_target_encoding", """
WITH t AS (SELECT * FROM flights WHERE year <= 1997), a AS (SELECT avg(label) AS prior FROM t), s AS (SELECT origin, count(*) AS n, avg(label) AS m FROM t GROUP BY origin)
SELECT DISTINCT f.origin, round(coalesce(prior * (1 - 1 / (1 + exp(-(n - 20) / 5.0))) + m / (1 + exp(-(n - 20) / 5.0)), prior), 6) AS origin_te FROM flights f LEFT JOIN s USING (origin), a""")
def e13(spark, d):
    df = flights(spark, d)
    return E.target_encoding(df.where("year <= 1997"), df, "origin", "label").select("origin", *r6("origin_te")).distinct()


@query("e14_min_max", "WITH r AS (SELECT min(dist) AS lo, max(dist) AS hi FROM flights WHERE year <= 1997) SELECT row_id, round((dist - lo) / (hi - lo), 6) AS dist FROM flights, r")
def e14(spark, d):
    df = flights(spark, d).select("row_id", "year", "dist")
    return E.min_max(df.where("year <= 1997"), df, ["dist"]).select("row_id", *r6("dist"))


@query("e15_standardise", """
WITH x AS (SELECT row_id, year, CASE WHEN row_id % 6 = 0 THEN NULL ELSE dist END AS dist FROM flights), m AS (SELECT quantile_cont(dist, 0.5) AS med FROM x WHERE year <= 1997),
s AS (SELECT avg(coalesce(dist, med)) AS mu, stddev_pop(coalesce(dist, med)) AS sd FROM x, m WHERE year <= 1997)
SELECT row_id, round((coalesce(dist, med) - mu) / sd, 6) AS dist FROM x, m, s""")
def e15(spark, d):
    df = flights(spark, d).select("row_id", "year", F.when(F.col("row_id") % 6 != 0, F.col("dist")).alias("dist"))
    return E.standardise(df.where("year <= 1997"), df, ["dist"]).select("row_id", *r6("dist"))


@query("e16_z_scores", "SELECT row_id, round((dist - avg(dist) OVER w) / CASE WHEN stddev_pop(dist) OVER w = 0 THEN 1 ELSE stddev_pop(dist) OVER w END, 6) AS dist FROM flights WINDOW w AS (PARTITION BY period_idx, origin)")
def e16(spark, d):
    return E.z_scores(flights(spark, d), ["dist"], ["period_idx", "origin"]).select("row_id", *r6("dist"))


@query("e17_kernels", """
SELECT row_id, round(exp(-u * u / 2), 6) AS gaussian, round(CASE WHEN abs(u) <= 1 THEN 0.5 ELSE 0 END, 6) AS uniform, round(CASE WHEN abs(u) <= 1 THEN 0.75 * (1 - u * u) ELSE 0 END, 6) AS epanechnikov,
  round(CASE WHEN abs(u) <= 1 THEN 1 - abs(u) ELSE 0 END, 6) AS triangular, round(exp(-greatest(u, 0)), 6) AS exponential FROM (SELECT row_id, delay / 20 AS u FROM flights)""")
def e17(spark, d):
    u = F.col("delay") / 20
    return flights(spark, d).select("row_id", *[F.round(X.kernel(k, u), 6).alias(k) for k in ("gaussian", "uniform", "epanechnikov", "triangular", "exponential")])


@query("e18_similarities", """
WITH s AS (SELECT row_id, exp(-((p - 0.5) * (p - 0.5) + (p1 - 0.4) * (p1 - 0.4)) / (2 * 0.3 * 0.3)) AS num, (CASE WHEN carrier = 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN origin = 3 THEN 1 ELSE 0 END) / 3.0 AS cat FROM flights)
SELECT row_id, round(num, 6) AS num, round(cat, 6) AS cat, round(num * cat, 6) AS prod, round(0.7 * num + 0.3 * cat, 6) AS mixed FROM s""")
def e18(spark, d):
    num = X.rbf([F.col("p"), F.col("p1")], [F.lit(0.5), F.lit(0.4)], 0.3)
    cat = X.category_match([F.col("carrier"), F.col("origin")], [F.lit("BUILDING"), F.lit(3)], [2.0, 1.0])
    return flights(spark, d).select("row_id", F.round(num, 6).alias("num"), F.round(cat, 6).alias("cat"), F.round(X.mixed_similarity(num, cat), 6).alias("prod"), F.round(X.mixed_similarity(num, cat, "weighted_sum", 0.7), 6).alias("mixed"))


@query("e21_three_way", "SELECT row_id, round(a / greatest(a + b, 1e-8), 6) AS p_pos, round(b / greatest(a + b, 1e-8), 6) AS p_neg, round(least(greatest(1 - a / greatest(a + b, 1e-8) - b / greatest(a + b, 1e-8), 0), 1), 6) AS p_bnd FROM (SELECT row_id, CASE WHEN row_id % 8 = 0 THEN 0 ELSE p END AS a, CASE WHEN row_id % 8 = 0 THEN 0 ELSE p1 END AS b FROM flights)")
def e21(spark, d):
    z = lambda c: F.when(F.col("row_id") % 8 == 0, 0.0).otherwise(F.col(c))
    p, n, b = X.three_way(z("p"), z("p1"))
    return flights(spark, d).select("row_id", F.round(p, 6).alias("p_pos"), F.round(n, 6).alias("p_neg"), F.round(b, 6).alias("p_bnd"))


@query("e22_month_gap", "SELECT DISTINCT month, CAST(least(abs(month - 11), 12 - abs(month - 11)) AS INT) AS gap FROM flights")
def e22(spark, d):
    return flights(spark, d).select("month", X.month_gap("month", F.lit(11)).alias("gap")).distinct()


@query("e23_column_roles", "SELECT * FROM (VALUES ('month', 'cyclic'), ('carrier', 'categorical'), ('label', 'categorical'), ('dist', 'continuous'), ('year', 'categorical'), ('dep', 'continuous')) t(name, role)")
def e23(spark, d):
    df = flights(spark, d).select("month", "carrier", "label", "dist", "year", "dep")
    return spark.createDataFrame(list(E.column_roles(df).items()), "name string, role string")


# ---- aggregation -----------------------------------------------------------------


@query("a1_counts", "SELECT year, origin, count(*) AS n FROM flights GROUP BY ALL")
def a1(spark, d):
    return flights(spark, d).groupBy("year", "origin").agg(F.count("*").alias("n"))


_GAIN = """
WITH h AS (SELECT CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.35 THEN -1 ELSE 0 END AS r, label, CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END AS w FROM flights),
g AS (SELECT r, sum(w) AS t, sum(CASE WHEN label = 1 THEN w ELSE 0 END) / sum(w) AS q FROM h GROUP BY r UNION ALL SELECT 9, sum(w), sum(CASE WHEN label = 1 THEN w ELSE 0 END) / sum(w) FROM h),
e AS (SELECT r, t, -(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END + CASE WHEN q < 1 THEN (1 - q) * log2(1 - q) ELSE 0 END) AS e FROM g)
"""


@query("a4_information_gain", _GAIN + "SELECT round(sum(CASE WHEN r = 9 THEN e ELSE -e * t / (SELECT t FROM e WHERE r = 9) END), 6) AS gain FROM e")
def a4(spark, d):
    return flights(spark, d).agg(F.round(W.information_gain("label", "p", 0.6, 0.35, 2.0, 1.0), 6).alias("gain"))


_UTILITY = """
WITH u AS (SELECT label, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.35 THEN -1 ELSE 0 END AS r, power(1 - exp(-2 * greatest(2 * p - 1, 0)), 2) AS up, 1 - exp(-1 * greatest(1 - 2 * p, 0)) AS un FROM flights)
"""


@query("a5_utility_regret", _UTILITY + "SELECT round(2 * coalesce(avg(CASE WHEN label = 0 AND r = 1 THEN 1 - exp(-3 * greatest(un - up, 0)) END), 0) + coalesce(avg(CASE WHEN label = 1 AND r = -1 THEN 1 - exp(-3 * greatest(up - un, 0)) END), 0), 6) AS regret FROM u")
def a5(spark, d):
    return flights(spark, d).agg(F.round(W.utility_regret("label", "p", 0.6, 0.35), 6).alias("regret"))


@query("a6_rate_regret", "SELECT round(2 * (1 - exp(-3 * sum(CASE WHEN label = 0 AND p >= 0.6 THEN 1.0 ELSE 0 END) / sum(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END))) + 1 - exp(-3 * sum(CASE WHEN label = 1 AND p <= 0.35 THEN 1.0 ELSE 0 END) / sum(CASE WHEN p <= 0.35 THEN 1 ELSE 0 END)), 6) AS regret FROM flights")
def a6(spark, d):
    return flights(spark, d).agg(F.round(W.rate_regret("label", "p", 0.6, 0.35), 6).alias("regret"))


@query("a7_objective", _GAIN.replace("CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END", "1.0") + """,
i AS (SELECT sum(CASE WHEN r = 9 THEN e ELSE -e * t / (SELECT t FROM e WHERE r = 9) END) AS gain FROM e),
q AS (SELECT 2 * (1 - exp(-3 * sum(CASE WHEN label = 0 AND p >= 0.6 THEN 1.0 ELSE 0 END) / sum(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END))) + 1 - exp(-3 * sum(CASE WHEN label = 1 AND p <= 0.35 THEN 1.0 ELSE 0 END) / sum(CASE WHEN p <= 0.35 THEN 1 ELSE 0 END)) AS a,
  2 * (1 - exp(-3 * sum(CASE WHEN label = 0 AND p3 >= 0.5 THEN 1.0 ELSE 0 END) / sum(CASE WHEN p3 >= 0.5 THEN 1 ELSE 0 END))) + 1 - exp(-3 * sum(CASE WHEN label = 1 AND p3 < 0.5 THEN 1.0 ELSE 0 END) / sum(CASE WHEN p3 < 0.5 THEN 1 ELSE 0 END)) AS b FROM flights)
SELECT round(a + b - gain, 6) AS fitness FROM i, q""")
def a7(spark, d):
    return flights(spark, d).agg(F.round(W.objective(["p", "p3"], "label", [0.6], [0.35], 0.5, W.ObjectiveParams(regret="rate")), 6).alias("fitness"))


@query("a8_expected_cost", "SELECT year, round((2 * sum(CASE WHEN p <= 0.35 THEN p ELSE 0 END) + sum(CASE WHEN p >= 0.6 THEN 1 - p ELSE 0 END) + 0.3 * sum(CASE WHEN p > 0.35 AND p < 0.6 THEN 0.1 ELSE 0 END)) / count(*), 6) AS cost FROM flights GROUP BY year")
def a8(spark, d):
    df = flights(spark, d).withColumns({"n": 1 - F.col("p"), "b": F.lit(0.1)})
    return df.groupBy("year").agg(F.round(W.expected_cost("p", "n", "b", 0.6, 0.35, 2.0, 1.0, 0.3), 6).alias("cost"))


@query("a9_expected_fbeta", """
WITH c AS (SELECT year, sum(CASE WHEN p >= 0.6 THEN p ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.6 THEN 1 - p ELSE 0 END) AS fp, sum(CASE WHEN p <= 0.35 THEN p ELSE 0 END) AS fn FROM flights GROUP BY year),
r AS (SELECT year, tp / greatest(tp + fp, 1e-6) AS a, tp / greatest(tp + fn, 1e-6) AS b FROM c) SELECT year, round(5 * a * b / greatest(4 * a + b, 1e-6), 6) AS f2 FROM r""")
def a9(spark, d):
    return flights(spark, d).withColumn("n", 1 - F.col("p")).groupBy("year").agg(F.round(W.expected_fbeta("p", "n", 0.6, 0.35, 2.0), 6).alias("f2"))


@query("a10_coverage", "SELECT round(avg(CASE WHEN p >= 0.6 THEN 1.0 ELSE 0 END), 6) AS cov, round(avg(CASE WHEN p > 0.35 AND p < 0.6 THEN 1.0 ELSE 0 END), 6) AS bnd, round((avg(CASE WHEN p > 0.35 AND p < 0.6 THEN 1.0 ELSE 0 END) + avg(CASE WHEN p1 > 0.3 AND p1 < 0.7 THEN 1.0 ELSE 0 END)) / 2, 6) AS levels FROM flights")
def a10(spark, d):
    c, b = W.coverage("p", 0.6, 0.35)
    return flights(spark, d).agg(F.round(c, 6).alias("cov"), F.round(b, 6).alias("bnd"), F.round(W.boundary_ratio(["p", "p1"], [0.6, 0.7], [0.35, 0.3]), 6).alias("levels"))


@query("a11_psi_tv", """
WITH b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS k, count(*) AS n FROM flights WHERE year <= 1996 GROUP BY 1), bt AS (SELECT sum(n) AS t FROM b),
c AS (SELECT year, CAST(least(floor(p1 * 10), 9) AS INT) AS k, count(*) AS n FROM flights WHERE year > 1996 GROUP BY 1, 2), ct AS (SELECT year, sum(n) AS t FROM c GROUP BY year),
s AS (SELECT ct.year, greatest(coalesce(b.n / bt.t, 0), 1e-6) AS x, greatest(coalesce(c.n / ct.t, 0), 1e-6) AS y FROM ct CROSS JOIN bt CROSS JOIN range(10) g(k) LEFT JOIN b ON b.k = g.k LEFT JOIN c ON c.k = g.k AND c.year = ct.year)
SELECT year, round(sum((y - x) * ln(y / x)), 6) AS psi, round(sum(abs(y - x)) / 2, 6) AS tv FROM s GROUP BY year""")
def a11(spark, d):
    df = flights(spark, d)
    base = df.where("year <= 1996").select("p")
    now = df.where("year > 1996").select("year", F.col("p1").alias("p"))
    return D.psi_tv(base, now, "p", ["year"]).select("year", *r6("psi", "tv"))


@query("a12_psi_quantile", """
WITH q AS (SELECT unnest(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM flights WHERE year <= 1996), u AS (SELECT DISTINCT e FROM q),
k AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e DESC) = 2 AS last FROM u), kk AS (SELECT * FROM k WHERE hi IS NOT NULL),
s AS (SELECT lo, (SELECT count(*) FROM flights WHERE year <= 1996 AND p >= lo AND (p < hi OR last AND p <= hi)) / (SELECT count(*) FROM flights WHERE year <= 1996) AS x,
  (SELECT count(*) FROM flights WHERE year > 1996 AND p1 >= lo AND (p1 < hi OR last AND p1 <= hi)) / (SELECT count(*) FROM flights WHERE year > 1996) AS y FROM kk)
SELECT round(sum((CASE WHEN y = 0 THEN 1e-6 ELSE y END - CASE WHEN x = 0 THEN 1e-6 ELSE x END) * ln(CASE WHEN y = 0 THEN 1e-6 ELSE y END / CASE WHEN x = 0 THEN 1e-6 ELSE x END)), 6) AS psi FROM s""")
def a12(spark, d):
    df = flights(spark, d)
    return D.psi_quantile(df.where("year <= 1996").select("p"), df.where("year > 1996").select(F.col("p1").alias("p")), "p").select(*r6("psi"))


_KS = """
WITH v AS (SELECT {0} AS v, 1 AS a, 0 AS b FROM flights WHERE year <= 1996 UNION ALL SELECT {0}, 0, 1 FROM flights WHERE year > 1996), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY v),
c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS x, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS y FROM g)
SELECT {1} round(max(abs(x - y)), 6) AS ks FROM c"""


@query("a13_ks_distance", _KS.format("dist", ""))
def a13(spark, d):
    df = flights(spark, d)
    return D.ks_distance(df.where("year <= 1996"), df.where("year > 1996"), "dist").select(*r6("ks"))


_PSI_Q = """
WITH q AS (SELECT unnest(quantile_cont({0}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM flights WHERE year <= 1996), u AS (SELECT DISTINCT e FROM q),
k AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e DESC) = 2 AS last FROM u), kk AS (SELECT * FROM k WHERE hi IS NOT NULL),
s AS (SELECT lo, (SELECT count(*) FROM flights WHERE year <= 1996 AND {0} >= lo AND ({0} < hi OR last AND {0} <= hi)) / (SELECT count(*) FROM flights WHERE year <= 1996) AS x,
  (SELECT count(*) FROM flights WHERE year > 1996 AND {0} >= lo AND ({0} < hi OR last AND {0} <= hi)) / (SELECT count(*) FROM flights WHERE year > 1996) AS y FROM kk)
SELECT round(sum((CASE WHEN y = 0 THEN 1e-6 ELSE y END - CASE WHEN x = 0 THEN 1e-6 ELSE x END) * ln(CASE WHEN y = 0 THEN 1e-6 ELSE y END / CASE WHEN x = 0 THEN 1e-6 ELSE x END)), 6) AS psi FROM s"""


@query("a14_monitor", " UNION ALL ".join(f"""SELECT '{c}' AS "column", ({_KS.format(c, "")}) AS ks, ({_PSI_Q.format(c)}) AS psi""" for c in ("dist", "p", "delay")))
def a14(spark, d):
    df = flights(spark, d)
    return D.monitor(df.where("year <= 1996"), df.where("year > 1996"), ["dist", "p", "delay"]).select("column", *r6("ks", "psi"))


_METRICS = """
c AS (SELECT {k}, count(*) AS n_samples, sum(CASE WHEN label = 1 AND pred = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND pred = 1 THEN 1.0 ELSE 0 END) AS fp,
  sum(CASE WHEN label = 1 AND pred = 0 THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN label = 0 AND pred = 0 THEN 1.0 ELSE 0 END) AS tn FROM d GROUP BY {k}),
rk AS (SELECT {k}, label, rank() OVER (PARTITION BY {k} ORDER BY s) + (count(*) OVER (PARTITION BY {k}, s) - 1) / 2.0 AS rk FROM d),
au AS (SELECT {k}, (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM rk GROUP BY {k}),
x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(tn / nullif(tn + fp, 0), 0) AS sp, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n_samples * n_samples) AS ex FROM c),
m AS (SELECT x.{k}, n_samples, pr AS "Precision", re AS "Recall", coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS "F1", CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (re + sp) / 2 ELSE re + sp END AS "BAC",
  coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS "MCC", coalesce(((tp + tn) / n_samples - ex) / nullif(1 - ex, 0), 0) AS "Kappa", auc AS "AUC" FROM x JOIN au USING ({k}))
"""
_ROUNDED = ", ".join(f'round("{x}", 6) AS "{x}"' for x in M.METRICS)


@query("a15_classification_metrics", f"WITH d AS (SELECT year, label, CAST(p1 >= 0.5 AS INT) AS pred, p1 AS s FROM flights), {_METRICS.format(k='year')} SELECT year, n_samples, {_ROUNDED} FROM m")
def a15(spark, d):
    df = flights(spark, d).withColumn("pred", (F.col("p1") >= 0.5).cast("int"))
    return M.classification_metrics(df, ["year"], "label", "pred", "p1").select("year", "n_samples", *r6(*M.METRICS))


@query("a16_run_summary", f"""WITH d AS (SELECT year, label, CAST(p1 >= 0.5 AS INT) AS pred, p1 AS s FROM flights), {_METRICS.format(k='year')}
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (SELECT unnest(['F1', 'MCC', 'AUC']) AS metric, unnest(["F1", "MCC", "AUC"]) AS v FROM m) GROUP BY metric""")
def a16(spark, d):
    df = flights(spark, d).withColumn("pred", (F.col("p1") >= 0.5).cast("int"))
    return M.run_summary(M.classification_metrics(df, ["year"], "label", "pred", "p1"), ["F1", "MCC", "AUC"]).select("metric", *r6("mean", "std"))


def _decided(spark, d):
    return W.sequential_decision(flights(spark, d), ["p1", "p", "p3"], [0.8, 0.7], [0.2, 0.3], 0.5)


_LAYERS = """
WITH a AS (SELECT *, CASE WHEN p1 >= 0.8 THEN 1 WHEN p1 <= 0.2 THEN -1 ELSE 0 END AS layer1 FROM flights),
b AS (SELECT *, CASE WHEN layer1 = 0 THEN CASE WHEN p >= 0.7 THEN 1 WHEN p <= 0.3 THEN -1 ELSE 0 END END AS layer2 FROM a),
c AS (SELECT *, CASE WHEN layer2 = 0 THEN CASE WHEN p3 >= 0.5 THEN 1 ELSE -1 END END AS layer3 FROM b)
"""


@query("h14_sequential_decision", _LAYERS + "SELECT row_id, layer1, coalesce(layer2, 9) AS layer2, coalesce(layer3, 9) AS layer3, CASE WHEN coalesce(nullif(layer1, 0), nullif(layer2, 0), layer3) = 1 THEN 1 ELSE 0 END AS predicted FROM c")
def h14(spark, d):
    return _decided(spark, d).select("row_id", "layer1", F.coalesce("layer2", F.lit(9)).alias("layer2"), F.coalesce("layer3", F.lit(9)).alias("layer3"), "predicted")


@query("a17_layer_flow", _LAYERS + """, l AS (SELECT year, unnest(['L1', 'L2', 'L3']) AS layer, unnest([layer1, layer2, layer3]) AS r FROM c),
f AS (SELECT year AS run, layer, count(*) FILTER (r = 1) AS p, count(*) FILTER (r = 0) AS b, count(*) FILTER (r = -1) AS n, count(*) AS t FROM l WHERE r IS NOT NULL GROUP BY ALL)
SELECT layer, round(avg(p), 4) AS "POS_mean", round(avg(b / t), 4) AS "BND_RATE_mean", round(stddev_samp(n), 4) AS "NEG_std", round(avg(t), 4) AS "TOTAL_mean" FROM f GROUP BY layer""")
def a17(spark, d):
    f = M.layer_flow(_decided(spark, d), "year", {"L1": "layer1", "L2": "layer2", "L3": "layer3"})
    return M.layer_summary(f).select("layer", "POS_mean", "BND_RATE_mean", "NEG_std", "TOTAL_mean")


@query("a18_yearly_weighted", f"""WITH d AS (SELECT period_idx, label, CAST(p1 >= 0.5 AS INT) AS pred, p1 AS s FROM flights), {_METRICS.format(k='period_idx')}
SELECT CAST(period_idx // 12 AS INT) AS year, count(DISTINCT period_idx) AS months, CAST(sum(n_samples) AS BIGINT) AS n_samples, round(sum("F1" * n_samples) / sum(n_samples), 6) AS "F1", round(sum("AUC" * n_samples) / sum(n_samples) FILTER ("AUC" IS NOT NULL), 6) AS "AUC" FROM m GROUP BY 1""")
def a18(spark, d):
    df = flights(spark, d).withColumn("pred", (F.col("p1") >= 0.5).cast("int"))
    m = M.classification_metrics(df, ["period_idx"], "label", "pred", "p1").withColumns({"year": F.floor(F.col("period_idx") / 12).cast("int"), "month": F.pmod("period_idx", F.lit(12))})
    return M.yearly(m, metrics=["F1", "AUC"]).select("year", "months", "n_samples", *r6("F1", "AUC"))


@query("a19_years_summary", f"""WITH d AS (SELECT year, label, CAST(p >= 0.6 AS INT) AS pred, p AS s FROM flights), {_METRICS.format(k='year')}, b AS (SELECT year, avg(CASE WHEN p < 0.6 AND p > 0.35 THEN 1.0 ELSE 0 END) AS bnd FROM flights GROUP BY year)
SELECT round(avg("F1"), 6) AS "mean_F1", round(avg("BAC"), 6) AS "mean_BAC", round(avg(bnd), 6) AS "mean_BND", round(var_pop("F1"), 6) AS "var_F1" FROM m JOIN b USING (year)""")
def a19(spark, d):
    return W.years_summary(W.metrics_by_year(flights(spark, d), "year", "label", "p", 0.6, 0.35)).select(*r6("mean_F1", "mean_BAC", "mean_BND", "var_F1"))


@query("a20_exact_quantiles", "SELECT year, round(quantile_cont(dist, 0.3), 4) AS q3, round(quantile_cont(dist, 0.7), 4) AS q7 FROM flights GROUP BY year")
def a20(spark, d):
    return flights(spark, d).groupBy("year").agg(F.round(F.percentile("dist", F.lit(0.3)), 4).alias("q3"), F.round(F.percentile("dist", F.lit(0.7)), 4).alias("q7"))


@query("a21_histogram_quantile", """
WITH h AS (SELECT year, CAST(least(floor(p * 32), 31) AS INT) AS bin, count(*) AS n FROM flights WHERE label = 1 GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY year ORDER BY bin) AS c, sum(n) OVER (PARTITION BY year) * 0.3 AS t FROM h),
f AS (SELECT * FROM c WHERE c > t QUALIFY row_number() OVER (PARTITION BY year ORDER BY bin) = 1) SELECT year, round((bin + (t - c + n) / n) / 32, 6) AS quantile FROM f""")
def a21(spark, d):
    h = H.label_histograms(flights(spark, d), ["year"], "label", "p", 32)
    return H.histogram_quantiles(h, ["year"], "pos", 0.3, 32).select("year", *r6("quantile"))


@query("a22_information_ranking", """
WITH l AS (SELECT label, unnest(['dist', 'p', 'p1', 'delay']) AS feature, unnest([dist, p, p1, delay]) AS x FROM flights), e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
c AS (SELECT feature, CAST(least(floor((x - lo) / (hi - lo) * 16), 15) AS INT) AS b, label, count(*) AS n FROM l JOIN e USING (feature) GROUP BY ALL)
SELECT feature, round(sum(t), 6) AS score FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, b) * sum(n) OVER (PARTITION BY feature, label))) AS t FROM c) GROUP BY feature""")
def a22(spark, d):
    return E.binned_information(flights(spark, d), ["dist", "p", "p1", "delay"], "label").select("feature", *r6("score"))


def _psi_sql(n: str) -> str:
    """Digamma of a whole number: harmonic recurrence over eight places, then the expansion."""
    x = f"({n} + 8.0)"
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8) - 1 / (132 * {x} ** 10) - ({' + '.join(f'1.0 / ({n} + {j})' for j in range(8))}))"


@query("a22_neighbour_information", f"""
WITH l AS (SELECT label AS y, row_id, unnest(['dist', 'p', 'p1', 'delay']) AS feature, unnest([dist, p, p1, delay]) AS x FROM flights), e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
g AS (SELECT feature, y, row_id, CAST(floor((x - lo) / (hi - lo) * 1099511627776) AS BIGINT) AS q FROM l JOIN e USING (feature)),
w AS (SELECT *, list_concat(list(q) OVER (a ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), list(q) OVER (a ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS near, count(*) OVER (PARTITION BY feature, y) AS ny FROM g WINDOW a AS (PARTITION BY feature, y ORDER BY q, row_id)),
r AS (SELECT feature, y, q, ny, list_sort(list_transform(near, lambda z: abs(z - q)))[3] AS r FROM w),
m AS (SELECT feature, ny, count(*) OVER (PARTITION BY feature ORDER BY q RANGE BETWEEN greatest(r - 1, 0) PRECEDING AND greatest(r - 1, 0) FOLLOWING) AS m, count(*) OVER (PARTITION BY feature) AS n FROM r)
SELECT feature, round(greatest(max({_psi_sql('n')}) + {_psi_sql('3')} - avg({_psi_sql('ny')}) - avg({_psi_sql('m')}), 0), 6) AS score FROM m GROUP BY feature""")
def a22_neighbours(spark, d):
    return I.neighbour_information(flights(spark, d), ["dist", "p", "p1", "delay"], "label").select("feature", *r6("score"))


@query("a22_counted_information", """
WITH l AS (SELECT label AS y, unnest(['carrier', 'priority', 'month']) AS feature, unnest([carrier, priority, CAST(month AS VARCHAR)]) AS x FROM flights), c AS (SELECT feature, x, y, count(*) AS n FROM l GROUP BY ALL)
SELECT feature, round(sum(t), 6) AS score FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, x) * sum(n) OVER (PARTITION BY feature, y))) AS t FROM c) GROUP BY feature""")
def a22_counted(spark, d):
    return I.counted_information(flights(spark, d), ["carrier", "priority", "month"], "label").select("feature", *r6("score"))


@query("a23_level_sizes", """
WITH t AS (SELECT p_brand AS brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1), f AS (SELECT *, greatest(1, CAST(round_even(0.6 * n, 0) AS INT)) AS a FROM t)
SELECT brand, a, greatest(a + 1, CAST(round_even(0.8 * n, 0) AS INT)) AS b, CAST(n AS INT) AS c FROM f""")
def a23(spark, d):
    n = read(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct("p_type").alias("n"))
    return n.select("brand", *[x.alias(c) for x, c in zip(E.level_size_columns(F.col("n")), "abc", strict=True)])


# ---- neighbours and posteriors -----------------------------------------------------


def _vectors(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") < 3).cast("int").alias("y"), F.pmod("label", F.lit(4)).cast("string").alias("cat"))
    return e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")


_KNN = """
WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label < 3 AS INT) AS y, label % 4 AS cat FROM embeddings WHERE vec_id % 5 <> 0), q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label % 4 AS cat FROM embeddings WHERE vec_id % 5 = 0),
n AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, y, CAST(t.cat <> q.cat AS INT) AS mismatches, round(list_distance(q.v, t.v) + {w} * CAST(t.cat <> q.cat AS INT), 12) AS d FROM q, t QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, t.vec_id) <= 10)
"""


@query("j2_nearest", _KNN.format(w=0) + "SELECT query, neighbour, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY query ORDER BY n.d, neighbour) AS INT) AS rank FROM n")
def j2(spark, d):
    t, q = _vectors(spark, d)
    return P.nearest(t, q, 10, "vec_id", "vec_id").select("query", "neighbour", *r6("d"), "rank")


@query("j3_nearest_with_categories", _KNN.format(w=0.2) + "SELECT query, round(avg(y), 6) AS p FROM n GROUP BY query")
def j3(spark, d):
    t, q = _vectors(spark, d)
    return P.mean_posterior(P.nearest(t, q, 10, "vec_id", "vec_id", categories=["cat"], category_weight=0.2)).select("query", *r6("p"))


_P = _KNN.format(w=0) + ", p AS (SELECT query, least(greatest((sum(y) + 1) / (count(*) + 2), 0.01), 0.99) AS p FROM n GROUP BY query) "


@query("m1_counted_posterior", _P + "SELECT query, round(p, 6) AS p, CASE WHEN p >= 0.5 THEN 1 WHEN p <= 0.2 THEN -1 ELSE 0 END AS region FROM p")
def m1(spark, d):
    t, q = _vectors(spark, d)
    p = P.counted_posterior(P.nearest(t, q, 10, "vec_id", "vec_id"))
    return p.select("query", *r6("p"), X.region("p", 0.5, 0.2).alias("region"))


@query("m4_kernel_posterior", _KNN.format(w=0) + """, h AS (SELECT *, greatest(max(d) OVER (PARTITION BY query), 1e-6) AS h FROM n), w AS (SELECT query, y, exp(-(d / h) * (d / h) / 2) * power(0.5, mismatches) AS w FROM h)
SELECT query, round(least(greatest((sum(w * y) + 1) / (sum(w) + 2), 0.01), 0.99), 6) AS p FROM w GROUP BY query""")
def m4(spark, d):
    t, q = _vectors(spark, d)
    n = P.nearest(t, q, 10, "vec_id", "vec_id", categories=["cat"])
    return P.with_default(q, P.kernel_posterior(n, P.KernelParams(penalty=0.5)), "vec_id").select("query", *r6("p"))


@query("m2_compact_kernel_all_zero", _KNN.format(w=0) + ", w AS (SELECT query, y, CASE WHEN d <= 0.05 THEN 0.75 * (1 - d * d / 0.0025) ELSE 0 END AS w FROM n), z AS (SELECT query, y, CASE WHEN sum(w) OVER (PARTITION BY query) <= 0 THEN 1 ELSE w END AS w FROM w) SELECT query, round(least(greatest((sum(w * y) + 1) / (sum(w) + 2), 0.01), 0.99), 6) AS p FROM z GROUP BY query")
def m2(spark, d):
    t, q = _vectors(spark, d)
    return P.kernel_posterior(P.nearest(t, q, 10, "vec_id", "vec_id"), P.KernelParams("epanechnikov", bandwidth=0.05)).select("query", *r6("p"))


@query("m7_cap_buckets", "SELECT row_id, origin FROM flights QUALIFY row_number() OVER (PARTITION BY origin ORDER BY md5(CAST(row_id AS VARCHAR) || '|3'), row_id) <= 20")
def m7(spark, d):
    return P.cap_buckets(flights(spark, d), "origin", "row_id", 20, 3).select("row_id", "origin")


@query("j5_bucket_posterior", """
WITH t AS (SELECT *, count(*) OVER (PARTITION BY origin) AS c FROM flights WHERE year <= 1997 QUALIFY row_number() OVER (PARTITION BY origin ORDER BY md5(CAST(row_id AS VARCHAR) || '|0'), row_id) <= 50000), q AS (SELECT * FROM flights WHERE year > 1997),
n AS (SELECT q.row_id, t.label, round(sqrt((q.p1 - t.p1) * (q.p1 - t.p1) + (q.delay - t.delay) * (q.delay - t.delay)), 9) AS d, t.row_id AS i FROM q JOIN t USING (origin) QUALIFY row_number() OVER (PARTITION BY q.row_id ORDER BY d, t.row_id) <= 5)
SELECT row_id AS query, round(avg(label), 6) AS p, 'bucket' AS source FROM n GROUP BY row_id""")
def j5(spark, d):
    df = flights(spark, d)
    out = P.nearest_in_bucket(df.where("year <= 1997"), df.where("year > 1997"), 5, "row_id", "row_id", "origin", ["p1", "delay"], "label", least=5)
    return out.select("query", *r6("p"), "source")


def _baseline_rows(spark, d, rows="true"):
    df = flights(spark, d).where(rows)
    return baselines.baseline_features(df.where("year <= 1997"), df, ["p1", "p3"], ["carrier"], "row_id")


@query("m9_kernel_baseline", f"""
WITH cc AS (SELECT carrier, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM flights WHERE year <= 1997 GROUP BY carrier), v AS (SELECT f.*, coalesce(code, -1) AS code FROM flights f LEFT JOIN cc USING (carrier)),
b AS (SELECT q.row_id, q.year, q.label AS ql, min({{'d': round(sqrt((q.p1 - t.p1) * (q.p1 - t.p1) + (q.p3 - t.p3) * (q.p3 - t.p3) + (q.code - t.code) * (q.code - t.code)), 12), 'i': t.row_id, 'y': t.label}}, 10) AS near FROM v q JOIN v t ON t.year <= 1997 WHERE q.year > 1997 GROUP BY ALL),
n AS (SELECT row_id, year, ql, unnest(near) AS x FROM b), h AS (SELECT row_id, year, ql, x.d AS d, x.y AS label, greatest(max(x.d) OVER (PARTITION BY row_id), 1e-6) AS h FROM n), w AS (SELECT row_id, year, ql, label, exp(-(d / h) * (d / h) / 2) AS w FROM h),
ss AS (SELECT row_id, year, ql AS label, least(greatest((sum(w * label) + 1) / (sum(w) + 2), 0.01), 0.99) AS s FROM w GROUP BY ALL), d AS (SELECT year, label, round(s, 9) AS s, CAST(round(s, 9) >= 0.5 AS INT) AS pred FROM ss), {_METRICS.format(k='year')} SELECT year, n_samples, {_ROUNDED} FROM m""")
def m9(spark, d):
    rows = _baseline_rows(spark, d)
    return baselines.kernel_baseline(rows, [1992, 1993, 1994, 1995, 1996, 1997], "year", "label", "row_id").select("year", "n_samples", *r6(*M.METRICS))


@query("m8_boosted_baseline")
def m8(spark, d):
    return baselines.boosted_baseline(_baseline_rows(spark, d), [1995, 1996, 1997], "year", "label", "row_id", BoostParams(trees=8))


# ---- buckets and references --------------------------------------------------------


_BUCKETS = B.BucketConfig(("origin", "carrier"), ("origin",), 8)
_ASSIGNED = """
WITH k AS (SELECT *, origin || '|' || carrier AS b0, CAST(origin AS VARCHAR) AS b1, count(*) OVER (PARTITION BY period_idx, origin, carrier) AS n0 FROM flights),
b AS (SELECT *, CASE WHEN n0 >= 8 THEN b0 ELSE b1 END AS bucket_id FROM k)
"""


@query("b1_assign_buckets", _ASSIGNED + "SELECT row_id, bucket_id FROM b")
def b1(spark, d):
    return B.assign_buckets(flights(spark, d), _BUCKETS, ["period_idx"]).select("row_id", "bucket_id")


@query("a2_bucket_stats", _ASSIGNED + "SELECT bucket_id, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, round(avg(label), 6) AS pos_rate FROM b GROUP BY bucket_id")
def a2(spark, d):
    return B.bucket_stats(B.assign_buckets(flights(spark, d), _BUCKETS, ["period_idx"]), "label").select("bucket_id", "n_samples", "n_pos", "n_neg", *r6("pos_rate"))


@query("b4_fine_and_coarse", """
WITH s AS (SELECT row_id, origin, CAST(dep // 600 AS INT) AS slot, year FROM flights), k AS (SELECT origin, slot FROM s WHERE year <= 1997 GROUP BY ALL HAVING count(*) >= 60)
SELECT CASE WHEN k.origin IS NULL THEN s.origin || '__COARSE' ELSE s.origin || '__slot' || s.slot END AS bucket, count(*) AS n FROM s LEFT JOIN k USING (origin, slot) GROUP BY 1""")
def b4(spark, d):
    df = flights(spark, d).withColumn("slot", F.floor(F.col("dep") / 600).cast("int"))
    known = B.fine_buckets(df.where("year <= 1997"), "origin", "slot", 60, 100)
    return B.assign_fine(df, known, "origin", "slot").groupBy("bucket").agg(F.count("*").alias("n"))


@query("f6_bucket_mask", "SELECT row_id, CASE WHEN dep // 600 = 1 THEN 'slot' ELSE 'coarse' END AS kind FROM flights WHERE origin = 3 UNION ALL SELECT row_id, 'slot again' FROM flights WHERE origin = 3 AND dep // 600 = 1")
def f6(spark, d):
    df = flights(spark, d).withColumn("slot", F.floor(F.col("dep") / 600).cast("int"))
    whole = B.bucket_mask(df, "3__COARSE", "origin", "slot").select("row_id", F.when(F.col("slot") == 1, "slot").otherwise("coarse").alias("kind"))
    return whole.union(B.bucket_mask(df, "3__slot1", "origin", "slot").select("row_id", F.lit("slot again")))


_REFS = """
WITH s AS (SELECT row_id, origin AS bucket_id, carrier, p1, p3, label, CASE WHEN label = 1 THEN 'pos' ELSE 'neg' END AS side, least(greatest(1 + (row_id % 5) / 2.0, 1e-6), 10) AS weight, p FROM flights WHERE year <= 1996),
c AS (SELECT *, weight * CASE WHEN label = 1 THEN greatest(p, 1e-6) ELSE greatest(1 - p, 1e-6) END AS score FROM s),
q AS (SELECT bucket_id, quantile_cont(CASE WHEN label = 1 THEN score END, 0.8) AS qp, quantile_cont(CASE WHEN label = 0 THEN score END, 1 - 0.8) AS qn FROM c GROUP BY bucket_id),
r AS (SELECT c.*, row_number() OVER (PARTITION BY bucket_id, side ORDER BY round(score, 9) DESC, row_id) AS rank FROM c JOIN q USING (bucket_id) WHERE score >= CASE WHEN side = 'pos' THEN qp ELSE qn END - 1e-9 QUALIFY rank <= 12)
"""


def _refs(spark, d):
    df = flights(spark, d).where("year <= 1996").withColumns({"weight": 1 + (F.col("row_id") % 5) / 2.0, "bucket_id": F.col("origin")})
    return B.reference_set(df, "label", "row_id", config=B.ReferenceConfig(12, 0.8))


@query("b6_reference_set", _REFS + "SELECT bucket_id, side, count(*) AS n, round(sum(weight), 6) AS weight, CAST(sum(row_id) AS BIGINT) AS ids FROM r GROUP BY ALL")
def b6(spark, d):
    return _refs(spark, d).groupBy("bucket_id", "side").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.sum("row_id").alias("ids"))


@query("b7_combine_history", _REFS + ", n AS (SELECT bucket_id, side, count(*) AS n FROM r WHERE rank <= 7 GROUP BY ALL) SELECT bucket_id, side, count(*) AS n FROM (SELECT bucket_id, side FROM r WHERE rank <= 7 UNION ALL SELECT r.bucket_id, r.side FROM r JOIN n USING (bucket_id, side) WHERE rank <= ceil(n * 0.4)) GROUP BY ALL")
def b7(spark, d):
    r = _refs(spark, d)
    return B.combine_history(r, r.where("rank <= 7"), 0.4).groupBy("bucket_id", "side").agg(F.count("*").alias("n"))


@query("j1_similarity_to_references", _REFS + """, x AS (SELECT row_id, origin AS bucket_id, carrier, p1, p3 FROM flights WHERE year > 1996),
sm AS (SELECT x.row_id, side, weight, exp(-((x.p1 - r.p1) ** 2 + (x.p3 - r.p3) ** 2) / (2 * 0.5 * 0.5)) * CASE WHEN x.carrier = r.carrier THEN 1 ELSE 0 END AS sim FROM x JOIN r USING (bucket_id)),
e AS (SELECT row_id, sum(sim * weight) FILTER (side = 'pos') / sum(weight) FILTER (side = 'pos') AS a, sum(sim * weight) FILTER (side = 'neg') / sum(weight) FILTER (side = 'neg') AS b FROM sm GROUP BY row_id)
SELECT x.row_id, round(coalesce(a, 0), 6) AS e_pos, round(coalesce(b, 0), 6) AS e_neg FROM x LEFT JOIN e USING (row_id)""")
def j1(spark, d):
    rows = flights(spark, d).where("year > 1996").withColumn("bucket_id", F.col("origin"))
    return B.similarity_to_references(rows, _refs(spark, d), "row_id", ["p1", "p3"], {"carrier": 1.0}, 0.5).select("row_id", *r6("e_pos", "e_neg"))


# ---- thresholds --------------------------------------------------------------------


def _probs(spark, d):
    return flights(spark, d).select("year", F.col("p").alias("p_pos"), (1 - F.col("p")).alias("p_neg"), F.lit(0.2).alias("p_bnd"))


_GRID = H.Grid(min_coverage=0.1, max_bnd=0.6, c_fn=2.0)
_PAIRS = f"""
WITH g AS (SELECT a, b FROM unnest({list(_GRID.alphas)}) x(a), unnest({list(_GRID.betas)}) y(b)),
s AS (SELECT year, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, (2 * sum(CASE WHEN p <= b THEN p ELSE 0 END) + sum(CASE WHEN p >= a THEN 1 - p ELSE 0 END) + 0.5 * sum(CASE WHEN p < a AND p > b THEN 0.2 ELSE 0 END)) / count(*) AS score,
  avg(CASE WHEN p >= a THEN 1.0 ELSE 0 END) AS cov, avg(CASE WHEN p < a AND p > b THEN 1.0 ELSE 0 END) AS bnd FROM flights, g GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(score, 9), a, b) AS r FROM s WHERE a >= b + 0.05 - 1e-12 AND cov >= 0.1 AND bnd <= 0.6)
"""


@query("h1_grid", f"""SELECT CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta, round(avg(CAST(p >= a AS INT)), 6) AS coverage, round(avg(CAST(p < a AND p > b AS INT)), 6) AS bnd_ratio
FROM flights, unnest({list(_GRID.alphas)}) x(a), unnest({list(_GRID.betas)}) y(b) GROUP BY ALL""")
def h1(spark, d):
    grid = H.Grid(alphas=tuple(H.grid_range(0.5, 0.92, 0.025)), betas=tuple(H.grid_range(0.4, 0.0, 0.02)))
    rows = flights(spark, d).select(F.col("p").alias("p_pos"), (1 - F.col("p")).alias("p_neg"), F.lit(0.0).alias("p_bnd"))
    return H.grid_scores(rows, grid).select("alpha", "beta", *r6("coverage", "bnd_ratio"))


_NEAR = tuple(x for x in _GRID.alphas if abs(x - 0.7) <= 0.05 + 1e-12)


@query("h4_limited_grid", f"""SELECT year, CAST(a AS DOUBLE) AS alpha, round(avg(CAST(p >= a AS INT)), 6) AS coverage FROM flights, unnest({list(_NEAR)}) x(a) GROUP BY ALL""")
def h4(spark, d):
    """Accepted shares of each year for the alphas near the last threshold."""
    grid = H.Grid(alphas=tuple(H.limit_range(H.grid_range(0.92, 0.5, 0.025), 0.7, 0.05)), betas=(0.2,))
    rows = flights(spark, d).select("year", F.col("p").alias("p_pos"), (1 - F.col("p")).alias("p_neg"), F.lit(0.0).alias("p_bnd"))
    return H.grid_scores(rows, grid, ["year"]).select("year", "alpha", *r6("coverage"))


@query("h2_select_alpha_beta", _PAIRS + "SELECT year, max(a) FILTER (r = 1) AS alpha, max(b) FILTER (r = 1) AS beta, round(max(score) FILTER (r = 1), 6) AS best, round(max(score) FILTER (r = 2), 6) AS second, CAST(count(*) AS INT) AS feasible_count FROM f GROUP BY year")
def h2(spark, d):
    return H.select_alpha_beta(_probs(spark, d), _GRID, ["year"], digits=9).select("year", "alpha", "beta", *r6("best", "second"), "feasible_count")


@query("s7_score_grid", _PAIRS + """, q AS (SELECT year, a, b, round(score, 9) AS score, row_number() OVER (PARTITION BY year ORDER BY (NOT (a >= b + 0.05 - 1e-12 AND cov >= 0.1 AND bnd <= 0.6)), round(score, 9), a, b) AS i, a >= b + 0.05 - 1e-12 AND cov >= 0.1 AND bnd <= 0.6 AS ok FROM s)
SELECT year, a AS alpha, b AS beta, round(score, 6) AS score, CAST(dense_rank() OVER (PARTITION BY year ORDER BY a) - 1 AS INT) AS row, CAST(dense_rank() OVER (PARTITION BY year ORDER BY b) - 1 AS INT) AS col, i = 1 AND ok AS best FROM q""")
def s7_grid(spark, d):
    scores = H.grid_scores(_probs(spark, d), _GRID, ["year"]).withColumn("score", F.round("score", 9))
    return R.score_grid(scores, ["year"]).select("year", "alpha", "beta", *r6("score"), "row", "col", "best")


@query("h3_ema_clip", _PAIRS + """, w AS (SELECT year, a, b, row_number() OVER (ORDER BY year) AS i FROM f WHERE r = 1),
e AS (SELECT i, year, a, b, a AS sa, b AS sb FROM w WHERE i = 1 UNION ALL SELECT w.i, w.year, w.a, w.b, least(greatest(e.sa + least(greatest(0.4 * w.a + 0.6 * e.sa - e.sa, -0.05), 0.05), 0), 1), least(greatest(e.sb + least(greatest(0.4 * w.b + 0.6 * e.sb - e.sb, -0.05), 0.05), 0), 1) FROM e JOIN w ON w.i = e.i + 1)
SELECT year, round(sa, 6) AS alpha_smoothed, round(sb, 6) AS beta_smoothed FROM e""")
def h3(spark, d):
    w = H.select_alpha_beta(_probs(spark, d), _GRID, ["year"], digits=9).select("year", "alpha", "beta")
    return H.ema_clip_trace(w, "year", ["alpha", "beta"], 0.4, 0.05).select("year", *r6("alpha_smoothed", "beta_smoothed"))


@query("h6_learn_global", """
WITH q AS (SELECT DISTINCT unnest(quantile_cont(p, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])) AS c FROM flights),
t AS (SELECT year, x.c AS alpha, y.c AS beta, sum(CASE WHEN label = 1 AND p >= x.c THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND p >= x.c THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN label = 1 AND p < x.c THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN label = 0 AND p < x.c THEN 1.0 ELSE 0 END) AS tn, avg(CASE WHEN p < x.c AND p > y.c THEN 1.0 ELSE 0 END) AS bnd
  FROM flights, q x, q y WHERE x.c > y.c GROUP BY ALL),
m AS (SELECT year, alpha, beta, bnd, 2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS bac FROM t)
SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(avg(f1) + avg(bac) - abs(avg(bnd) - 0.2) - var_pop(f1), 6) AS score, round(avg(f1), 6) AS "mean_F1", round(avg(bac), 6) AS "mean_BAC", round(avg(bnd), 6) AS "mean_BND", round(var_pop(f1), 6) AS "var_F1" FROM m GROUP BY m.alpha, m.beta""")
def h6(spark, d):
    return H.learn_global(flights(spark, d), "year", "label", "p").select(*r6("alpha", "beta", "score", "mean_F1", "mean_BAC", "mean_BND", "var_F1"))


@query("h7_swarm_thresholds")
def h7(spark, d):
    r = H.learn_thresholds(flights(spark, d), ["p1", "p", "p3"], "label", H.SwarmParams(6, 3))
    return spark.createDataFrame([(i, float(a), float(b), r.gamma, r.fitness) for i, (a, b) in enumerate(zip(r.alphas, r.betas, strict=True), 1)], "layer int, alpha double, beta double, gamma double, fitness double")


@query("h8_windowed_swarm")
def h8(spark, d):
    df = flights(spark, d)
    last, out = None, []
    for y in sorted(r[0] for r in df.select("year").distinct().collect()):
        last = H.adapt_windowed(df.where(F.col("year") == y), ["p1", "p", "p3"], "label", "p", last, H.SwarmParams(6, 3))
        out += [(y, i, float(a), float(b)) for i, (a, b) in enumerate(zip(last.alphas, last.betas, strict=True), 1)]
    return spark.createDataFrame(out, "year int, layer int, alpha double, beta double")


@query("h9_rule_thresholds", "SELECT month, count(*) AS n, round(quantile_cont(CASE WHEN label = 1 THEN p END, 0.7), 6) AS alpha, round(quantile_cont(CASE WHEN label = 0 THEN p END, 0.3), 6) AS beta FROM flights GROUP BY month HAVING count(*) >= 50")
def h9(spark, d):
    return H.rule_thresholds(flights(spark, d), ["month"], "label", "p", least=50).select("month", "n", *r6("alpha", "beta"))


@query("h10_histogram_thresholds")
def h10(spark, d):
    hist = H.label_histograms(flights(spark, d), ["period_idx"], "label", "p").orderBy("period_idx", "bin").collect()
    import numpy as np

    state, out = H.HistogramState(), []
    for t in sorted({r["period_idx"] for r in hist}):
        pos, neg = np.zeros(32), np.zeros(32)
        for r in hist:
            if r["period_idx"] == t:
                pos[r["bin"]], neg[r["bin"]] = r["pos"], r["neg"]
        state = H.calibrate_replay(H.adapt_histogram(state, pos, neg))
        out.append((int(t), float(state.tau), float(state.alpha), float(state.beta)))
    return spark.createDataFrame(out, "period_idx int, tau double, alpha double, beta double")


@query("h10_light_thresholds")
def h10_light(spark, d):
    """Decayed histograms of three levels, year by year, calibrated over the replayed years."""
    df, names, params = flights(spark, d), ["p1", "p", "p3"], G.LightParams(target_bnd=0.18, every=2)
    strategy, out, last = dynamic.LightStrategy(params), [], None
    for y in sorted(r[0] for r in df.select("year").distinct().collect()):
        last = strategy.adapt(df.where(F.col("year") == y), names, "label", last, False)
        out += [(y, i, a, b, last.gamma, last.fitness) for i, (a, b) in enumerate(zip(last.alphas, last.betas, strict=True), 1)]
    return spark.createDataFrame(out, "year int, layer int, alpha double, beta double, gamma double, fitness double")


@query("h12_enforce_gap", "SELECT row_id, round(least(greatest(CASE WHEN p - p1 < 0.1 THEN (p + p1) / 2 + 0.05 ELSE p END, 0), 0.999), 6) AS a, round(least(greatest(CASE WHEN p - p1 < 0.1 THEN (p + p1) / 2 - 0.05 ELSE p1 END, 0), 0.999), 6) AS b FROM flights")
def h12(spark, d):
    a, b = H.enforce_gap_columns("p", "p1", 0.1)
    return flights(spark, d).select("row_id", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query("h13_running_median", "SELECT year, round(median(m) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS median FROM (SELECT year, avg(p) AS m FROM flights GROUP BY year)")
def h13(spark, d):
    return H.running_median(flights(spark, d).groupBy("year").agg(F.avg("p").alias("m")), "year", "m", 3).select("year", *r6("median"))


# ---- drift -------------------------------------------------------------------------


@query("d1_kswin")
def d1(spark, d):
    e = read(spark, d, "events")
    return D.detect_by_key(e, "event_type", ["ts", "event_id"], "value", D.DetectorConfig(window=100, stat=30, significance=0.01))


@query("d3_adwin")
def d3(spark, d):
    e = read(spark, d, "events").withColumn("value", F.col("value") + F.when(F.col("event_id") % 400 > 200, 30).otherwise(0))
    return D.detect_by_key(e, "event_type", ["ts", "event_id"], "value", D.DetectorConfig("adwin", window=60, delta=0.01))


@query("d3_adwin_cut", """
WITH o AS (SELECT row_number() OVER (ORDER BY event_id) AS k, sum(x) OVER (ORDER BY event_id) AS s, count(*) OVER () AS n, sum(x) OVER () AS t FROM (SELECT event_id, value / 100 + CASE WHEN event_id * 5 > 3 * (SELECT max(event_id) FROM events) THEN 1 ELSE 0 END AS x FROM events)),
g AS (SELECT k, n, abs(s / k - (t - s) / (n - k)) AS gap FROM o WHERE k >= 5 AND n - k >= 5), m AS (SELECT k, gap, gap - sqrt(0.5 * (1.0 / k + 1.0 / (n - k)) * ln(2 / 0.002)) AS margin FROM g)
SELECT k AS n_left, round(gap, 6) AS gap, round(margin, 6) AS margin FROM m WHERE margin > 0 ORDER BY round(margin, 12) DESC, k LIMIT 1""")
def d3c(spark, d):
    e = read(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.max("event_id").alias("last"))), F.lit(True)).withColumn("x", F.col("value") / 100 + F.when(F.col("event_id") * 5 > F.col("last") * 3, 1).otherwise(0))
    return D.adwin_cut(e, ["event_id"], "x").select("n_left", *r6("gap", "margin"))


_SIGNALS = "WITH s AS (SELECT period_idx, avg(p) * 0.4 AS psi, avg(p1) * 0.3 AS tv, abs(avg(label) - 0.48) AS pr, avg(p3) * 0.1 AS pd FROM flights GROUP BY period_idx)"


def _signals(spark, d):
    return flights(spark, d).groupBy("period_idx").agg((F.avg("p") * 0.4).alias("psi"), (F.avg("p1") * 0.3).alias("tv"), F.abs(F.avg("label") - 0.48).alias("pr"), (F.avg("p3") * 0.1).alias("pd"))


@query("d5_severity", _SIGNALS + " SELECT period_idx, CASE WHEN psi >= 0.2 OR tv >= 0.2 OR pr >= 0.1 OR pd >= 0.1 THEN 2 WHEN psi >= 0.1 OR tv >= 0.1 OR pr >= 0.05 OR pd >= 0.05 THEN 1 ELSE 0 END AS severity FROM s")
def d5(spark, d):
    return _signals(spark, d).select("period_idx", D.severity("psi", "tv", "pr", "pd").alias("severity"))


@query("d6_refine_level", _SIGNALS + ", l AS (SELECT *, CASE period_idx % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END AS lv FROM s) SELECT period_idx, CASE WHEN lv IN ('S1', 'S2') AND psi < 0.05 AND tv < 0.02 AND pr < 0.01 AND pd < 0.005 THEN 'NONE' WHEN lv = 'S2' AND psi < 0.25 AND tv < 0.15 AND pr < 0.05 AND pd < 0.06 THEN 'S1' ELSE lv END AS level FROM l")
def d6(spark, d):
    lv = F.when(F.col("period_idx") % 3 == 0, "S1").when(F.col("period_idx") % 3 == 1, "S2").otherwise("S3")
    return _signals(spark, d).withColumn("lv", lv).select("period_idx", D.refine_level("lv", "psi", "tv", "pr", "pd", strong=(0.25, 0.15, 0.05, 0.06)).alias("level"))


@query("d7_reactions", _SIGNALS + """, v AS (SELECT period_idx, row_number() OVER (ORDER BY period_idx) AS i,
  greatest(CASE WHEN psi >= 0.2 THEN 2 WHEN psi >= 0.1 THEN 1 ELSE 0 END, CASE WHEN tv >= 0.2 THEN 2 WHEN tv >= 0.1 THEN 1 ELSE 0 END, CASE WHEN pr >= 0.1 THEN 2 WHEN pr >= 0.05 THEN 1 ELSE 0 END, CASE WHEN pd >= 0.1 THEN 2 WHEN pd >= 0.05 THEN 1 ELSE 0 END) AS s FROM s),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INT) AS period_idx, 'NONE' AS level, 0 AS warn, 0 AS alert, 0 AS cool, CAST(1 AS DOUBLE) AS sigma, 0 AS turns, CAST(0.3 AS DOUBLE) AS keep_ratio, CAST(0.3 AS DOUBLE) AS bnd_cap, CAST(1 AS DOUBLE) AS multiplier
  UNION ALL SELECT i, period_idx, level, CASE WHEN level = 'S3' THEN 0 ELSE w END, CASE WHEN level = 'S3' THEN 0 ELSE a END, CASE WHEN level = 'S3' THEN 3 ELSE c END, CASE WHEN level = 'S1' THEN sigma * CASE WHEN turns % 2 = 0 THEN 0.9 ELSE 1.1 END ELSE sigma END,
    turns + CASE WHEN level = 'S1' THEN 1 ELSE 0 END, CASE WHEN level = 'S2' THEN least(1.0, keep_ratio * 1.5) ELSE keep_ratio END, CASE WHEN level = 'S3' THEN bnd_cap * 0.9 ELSE bnd_cap END,
    CASE level WHEN 'S3' THEN greatest(multiplier, 1.5) WHEN 'S2' THEN greatest(multiplier, 1.3) WHEN 'S1' THEN greatest(multiplier, 1.15) ELSE greatest(1.0, multiplier * 0.9) END
  FROM (SELECT *, CASE WHEN c > 0 OR s = 0 THEN 'NONE' WHEN s = 1 THEN 'S1' WHEN a >= 3 THEN 'S3' ELSE 'S2' END AS level FROM (SELECT v.i, v.period_idx, v.s, greatest(cool - 1, 0) AS c, sigma, turns, keep_ratio, bnd_cap, multiplier,
    CASE WHEN cool > 1 THEN warn WHEN s = 0 THEN 0 ELSE warn + 1 END AS w, CASE WHEN cool > 1 THEN alert WHEN s = 2 THEN alert + 1 ELSE 0 END AS a FROM f JOIN v ON v.i = f.i + 1)))
SELECT period_idx, level, cool AS cooldown, round(sigma, 6) AS sigma, round(keep_ratio, 6) AS keep_ratio, round(bnd_cap, 6) AS bnd_cap, round(multiplier, 6) AS multiplier FROM f WHERE i > 0""")
def d7(spark, d):
    rows = _signals(spark, d).select("period_idx", D.severity("psi", "tv", "pr", "pd").alias("s"))
    return D.reaction_fold(rows, "period_idx", "s", debounce=3).select("period_idx", "level", "cooldown", *r6("sigma", "keep_ratio", "bnd_cap", "multiplier"))


@query("d9_composite_signal", _SIGNALS + " SELECT period_idx, round(0.6 * psi + 0.3 * tv + 0.1 * pr, 6) AS signal FROM s")
def d9(spark, d):
    return _signals(spark, d).select("period_idx", F.round(D.composite_signal(F.col("psi"), F.col("tv"), F.col("pr")), 6).alias("signal"))


# ---- windows -----------------------------------------------------------------------


@query("t1_synthesize_year", "WITH b AS (SELECT row_id, month, lag(month) OVER (ORDER BY row_id) AS q FROM flights) SELECT row_id, CAST(sum(CASE WHEN month < q THEN 1 ELSE 0 END) OVER (ORDER BY row_id) AS INT) AS y FROM b")
def t1(spark, d):
    return T.synthesize_year(flights(spark, d).select("row_id", "month"), ["row_id"], "month", name="y").select("row_id", "y")


@query("t2_month_windows", "SELECT period_idx, count(*) AS n, round(avg(label), 6) AS rate FROM flights GROUP BY period_idx")
def t2(spark, d):
    return T.month_windows(flights(spark, d), "period_idx", F.round(F.avg("label"), 6).alias("rate"))


@query("t3_window_plan", "WITH y AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM flights)) SELECT year, CASE WHEN i <= greatest(1, n // 2) THEN 'warmup' ELSE 'stream' END AS part FROM y")
def t3(spark, d):
    plan = T.plan_years(flights(spark, d), "year")
    return spark.createDataFrame([(y, "warmup") for y in plan.warmup] + [(y, "stream") for y in plan.stream], "year int, part string")


@query("t4_gather", "WITH p AS (SELECT DISTINCT period_idx, period_idx % 12 = 5 AS same_month FROM flights WHERE period_idx < 1999 * 12 + 5) SELECT period_idx, same_month FROM p QUALIFY row_number() OVER (PARTITION BY same_month ORDER BY period_idx DESC) <= CASE WHEN same_month THEN 3 ELSE 4 END")
def t4(spark, d):
    return T.gather(flights(spark, d).select("period_idx"), 1999 * 12 + 5, 3, 4)


@query("t5_record_weights", """
WITH h AS (SELECT *, 1999 * 12 + 5 AS now, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.35 THEN -1 ELSE 0 END AS region FROM flights WHERE period_idx < 1999 * 12 + 5),
g AS (SELECT *, least(abs(period_idx % 12 - 5), 12 - abs(period_idx % 12 - 5)) AS gap FROM h)
SELECT row_id, round(least(greatest(exp(-0.05 * (greatest(now - period_idx, 1) - 1)) * CASE gap WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.2 END * CASE WHEN gap = 0 THEN power(0.9, 1998 * 12 + 5 - period_idx) ELSE 1 END * 1.15
  * least(greatest(2 * abs(p - 0.5), 0.2), 1) * CASE WHEN region = 0 THEN 0.7 ELSE 1 END * CASE WHEN region = 1 AND label = 0 OR region = -1 AND label = 1 THEN 0.6 ELSE 1 END, 1e-6), 10), 6) AS weight FROM g""")
def t5(spark, d):
    now = 1999 * 12 + 5
    df = flights(spark, d).where(F.col("period_idx") < now).withColumn("region", X.region("p", 0.6, 0.35))
    w = T.record_weight("period_idx", now, 1998 * 12 + 5, "p", "region", "label", 1.15, T.SeasonWeights(keep_ratio=0.9))
    return df.select("row_id", F.round(w, 6).alias("weight"))


@query("t6_delayed_labels", "SELECT period_idx, count(*) AS n FROM flights WHERE period_idx + 1 <= 1998 * 12 GROUP BY period_idx")
def t6(spark, d):
    df = flights(spark, d).withColumn("unlock_idx", F.col("period_idx") + 1)
    return T.unlocked(df, 1998 * 12).groupBy("period_idx").agg(F.count("*").alias("n"))


@query("t8_run_windows", """
WITH c AS (SELECT event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM events), r AS (SELECT event_id, sum(f) OVER (ORDER BY event_id) AS run FROM c)
SELECT event_id, CAST(run AS BIGINT) AS run, CAST((run - 1) // 3 AS BIGINT) AS win FROM r""")
def t8(spark, d):
    return T.run_windows(read(spark, d, "events").select("event_id", "event_type"), ["event_id"], "event_type", 3).select("event_id", "run", F.col("window").alias("win"))


@query("t8_sample_windows", "SELECT (row_number() OVER (ORDER BY event_id) - 1) // 250 AS win, event_id FROM events")
def t8s(spark, d):
    return T.sample_windows(read(spark, d, "events").select("event_id"), ["event_id"], 250).select(F.col("window").alias("win"), "event_id")


@query("t9_sliding_posterior")
def t9(spark, d):
    t, q = _vectors(spark, d)
    buffer = P.PosteriorBuffer(size=200, interval=100)
    for part in range(3):
        buffer = buffer.add(t.where(F.col("vec_id") % 3 == part).withColumn("o", F.lit(part * 1_000_000) + F.col("vec_id")), "o")
    return buffer.predict(q, 10, "vec_id", "vec_id")


@query("t10_reservoir_posterior")
def t10(spark, d):
    t, q = _vectors(spark, d)
    buffer = P.PosteriorBuffer(size=200, interval=100, policy="reservoir")
    for part in range(3):
        buffer = buffer.add(t.where(F.col("vec_id") % 3 == part).withColumn("o", F.lit(part * 1_000_000) + F.col("vec_id")), "o", drift=part == 2)
    return buffer.predict(q, 10, "vec_id", "vec_id")


@query("o_top_per_group", "SELECT origin, row_id, dist FROM flights QUALIFY row_number() OVER (PARTITION BY origin ORDER BY dist DESC, row_id) <= 5")
def o2(spark, d):
    w = Window.partitionBy("origin").orderBy(F.desc("dist"), "row_id")
    return flights(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 5").select("origin", "row_id", "dist")


@query("o_row_ranks", "SELECT row_id, row_number() OVER (ORDER BY dist, row_id) AS rank FROM flights")
def o1(spark, d):
    return O.row_ranks(flights(spark, d).select("row_id", "dist"), ["dist", "row_id"]).select("row_id", "rank")


# ---- streaming -----------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run_stream(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to the shared folder and read back. Complete results are one batch, that of the last epoch."""
    path = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/epoch={epoch}")
    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


@query("d1_kswin_stream")
def d1s(spark, d):
    return _run_stream(live.detect_stream(_event_stream(spark, d), "event_type", "ts", "value", D.DetectorConfig(window=100, stat=30, significance=0.01)), "kswin")


@query("t6_late_labels_stream", """
WITH o AS (SELECT o_orderkey, o_orderdate, (o_orderkey * 37 + o_custkey * 11) % 60 AS a FROM orders), y AS (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem),
j AS (SELECT CASE WHEN a >= 40 THEN 1 WHEN a <= 20 THEN -1 ELSE 0 END AS region, l_shipdate - o_orderdate AS wait FROM o JOIN y ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY)
SELECT region, count(*) AS n, CAST(sum(date_diff('day', TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + wait)) AS BIGINT) AS days FROM j GROUP BY region""")
def t6s(spark, d):
    """Orders are scored as they come; each shipment of up to 60 days later is a label. Both sides are streams; results are written batch by batch."""
    source = lambda t: spark.readStream.schema(read(spark, d, t).schema).option("pathGlobFilter", f"{t}.parquet").parquet(d)
    scored = source("orders").select("o_orderkey", "o_orderdate", F.expr("(o_orderkey * 37 + o_custkey * 11) % 60").alias("a"))
    labels = source("lineitem").select("l_orderkey", "l_shipdate", F.lit(1).alias("label"))
    joined = live.with_late_labels(scored, labels.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "o_orderdate", "l_shipdate", "60 days", "4000 days")
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    decide = lambda df: live.decide_stream(df.withColumn("p", F.col("a").cast("double")), "p", 40.0, 20.0).select("o_orderkey", "region", "waited")
    live.write_batches(joined, f"{path}/rows", f"{path}/checkpoint", decide).awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").distinct()  # a shipment date counts once for an order
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("waited").alias("days"))


@query("t2_day_windows_stream", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def t2s(spark, d):
    out = _run_stream(live.window_summary(_event_stream(spark, d), "ts", "value", ["event_type"], "1 day", "400 days"), "days", "complete")
    return out.select("event_type", F.to_date("start").cast("string").alias("day"), "n", *r6("mean"))


@query("f5_region_stream", "SELECT CASE WHEN value >= 60 THEN 1 WHEN value <= 20 THEN -1 ELSE 0 END AS region, count(*) AS n FROM events GROUP BY 1")
def f5s(spark, d):
    return _run_stream(live.decide_stream(_event_stream(spark, d), "value", 60.0, 20.0).groupBy("region").agg(F.count("*").alias("n")), "regions", "complete")


# ---- flows -------------------------------------------------------------------------


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.floor((F.col("month") - 1) / 3)
    return flights(spark, sf_dir).select("row_id", "label", "year", (F.col("year") * 4 + q).cast("int").alias("period_idx"), "p1", "dist", "origin", "carrier")


FLOW = flow.FlowConfig(("p1", "dist"), {"carrier": 1.0}, B.BucketConfig(("origin",), (), 5), B.ReferenceConfig(64, 0.8), seasons=4, history_cap=3, recent=2, k=5)


@query("g1_bucket_plan", """
WITH s AS (SELECT *, CAST(dep // 600 AS INT) AS slot FROM flights), tr AS (SELECT * FROM s WHERE year <= 1995), va AS (SELECT * FROM s WHERE year BETWEEN 1996 AND 1998),
f AS (SELECT origin, slot FROM tr GROUP BY ALL HAVING count(*) >= 110),
m AS (SELECT tr.*, tr.origin || '__slot' || tr.slot AS bucket FROM tr JOIN f USING (origin, slot) UNION ALL SELECT *, origin || '__COARSE' FROM tr),
v AS (SELECT va.*, CASE WHEN f.slot IS NULL THEN va.origin || '__COARSE' ELSE va.origin || '__slot' || va.slot END AS bucket FROM va LEFT JOIN f USING (origin, slot)),
b AS (SELECT v.row_id, v.year, v.label, min({'d': round(sqrt((v.p1 - m.p1) * (v.p1 - m.p1) + (v.delay - m.delay) * (v.delay - m.delay)), 9), 'i': m.row_id, 'y': m.label}, 7) AS near FROM v JOIN m USING (bucket) GROUP BY ALL),
pr AS (SELECT row_id, year, label, round(avg(x.y), 9) AS p FROM (SELECT row_id, year, label, unnest(near) AS x FROM b) GROUP BY ALL),
q AS (SELECT DISTINCT unnest(quantile_cont(p, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])) AS c FROM pr),
t AS (SELECT year, x.c AS alpha, y.c AS beta, sum(CASE WHEN label = 1 AND p >= x.c THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND p >= x.c THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN label = 1 AND p < x.c THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN label = 0 AND p < x.c THEN 1.0 ELSE 0 END) AS tn, avg(CASE WHEN p < x.c AND p > y.c THEN 1.0 ELSE 0 END) AS bnd
  FROM pr, q x, q y WHERE x.c > y.c GROUP BY ALL),
mm AS (SELECT year, alpha, beta, bnd, 2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS bac FROM t)
SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(avg(f1) + avg(bac) - abs(avg(bnd) - 0.2) - var_pop(f1), 6) AS score FROM mm GROUP BY mm.alpha, mm.beta""")
def g1(spark, d):
    df = flights(spark, d).withColumn("slot", F.floor(F.col("dep") / 600).cast("int"))
    plan = buckets.BucketPlan("row_id", "label", "year", "origin", "slot", ("p1", "delay"), (), (1992, 1995), (1996, 1998), 110, 1, 7)
    return buckets.run_bucket_plan(df, plan).thresholds.select(*r6("alpha", "beta", "score"))


@query("t11_rolling_flow")
def t11(spark, d):
    return flow.run_flow(quarters(spark, d), FLOW).window_metrics


@query("t13_dynamic_loop")
def t13(spark, d):
    df = flights(spark, d).withColumns({"window": F.col("year"), "season": F.concat(F.lit("Q"), F.floor((F.col("month") + 2) / 3).cast("string"))})
    steps = dynamic.run_dynamic(df.where("year <= 1997"), df.where("year > 1997"), ["p1", "p", "p3"], "label", "season", swarm=H.SwarmParams(4, 2))
    return spark.createDataFrame([(s.window, s.alphas[0], s.betas[0], s.signal, s.drift, float(s.metrics["F1"])) for s in steps], "window int, alpha double, beta double, signal double, drift boolean, F1 double")


_SPLIT_FEATURES = ["f1", "f2", "f3", "f4"]


def _split_rows(spark, d):
    df = flights(spark, d)
    return df.select("row_id", "label", F.col("p").alias("f1"), F.col("p1").alias("f2"), F.col("p3").alias("f3"), F.col("dist").alias("f4"))


@query("g0_split_runs", """
WITH s AS (SELECT row_id, label, unnest(range(10)) AS run FROM flights), o AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY md5(CAST(row_id AS VARCHAR) || '|' || run), row_id) <= floor(count(*) OVER (PARTITION BY run, label) * 0.3 + 0.5) AS test FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY test, run, label ORDER BY md5(CAST(row_id AS VARCHAR) || '|' || (run + 1)), row_id) <= floor(count(*) OVER (PARTITION BY test, run, label) * 0.3 + 0.5) AS validation FROM o)
SELECT CAST(run AS INT) AS run, CASE WHEN test THEN 'test' WHEN validation THEN 'validation' ELSE 'fit' END AS part, label, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM i GROUP BY ALL""")
def g0_split_runs(spark, d):
    return dynamic.split_runs(_split_rows(spark, d), "label", "row_id", list(range(10))).groupBy("run", "part", "label").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("g0_static_split")
def g0(spark, d):
    """Ten splits of the static experiment."""
    return dynamic.run_splits(_split_rows(spark, d), _SPLIT_FEATURES, "label", "row_id", list(range(10)), 6, H.SwarmParams(8, 6))


@query("g0_repeated_splits")
def g0_repeated(spark, d):
    return dynamic.repeated_splits(_split_rows(spark, d), _SPLIT_FEATURES, "label", "row_id", swarm=H.SwarmParams(8, 6))


@query("t13_loop_strategies")
def t13_strategies(spark, d):
    """Both strategies of the loop on the same windows of a year, as one configuration says."""
    rows = flights(spark, d).withColumn("day", F.make_date("year", "month", F.lit(1)))
    config = from_dict({
        "DYN": {"strategy": "s_lite", "time_unit": "years", "seasonal_group": "year", "seasonal_prior_weight": 0.2, "seasonal_min_samples": 100, "target_bnd": 0.18, "rlite_interval": 2},
        "DRIFT": {"window_size": 12, "stat_size": 3}, "PSO": {"particles": 6, "iters": 4},
    })
    out = []
    for name in ("s_lite", "windowed_pso"):
        steps = dynamic.run_loop(rows, 3, config, ["p1", "p", "p3"], "label", ["row_id"], "day", name)
        out += [(name, s.window, s.alphas[0], s.betas[0], s.gamma, s.drift, float(s.metrics["F1"])) for s in steps]
    return spark.createDataFrame(out, "strategy string, window int, alpha double, beta double, gamma double, drift boolean, F1 double")
