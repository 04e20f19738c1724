"""The search in few dimensions against brute force, and how often it asks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivane.operators import nearby as N
from trivane.operators import posterior as P


def brute(v, x, tid, k, wrong, digits=9):
    d = np.round(np.sqrt(((v[:, None] - x[None]) ** 2).sum(2)) + wrong, digits)
    best = [np.lexsort((tid, row))[:k] for row in d]
    return np.array(best), np.array([row[b] for row, b in zip(d, best, strict=True)])


@pytest.mark.parametrize("rows,queries,dims,k,weight,places", [(300, 100, 1, 3, 0.0, 9), (500, 200, 2, 5, 0.3, 1), (1000, 200, 4, 6, 0.0, 1), (4, 20, 3, 6, 0.2, 9), (900, 50, 2, 7, 0.0, 0)])
def test_boxes_find_what_brute_force_finds(monkeypatch, rows, queries, dims, k, weight, places):
    monkeypatch.setattr(N, "PAIRS", 500)
    monkeypatch.setattr(N, "CHUNK", 64)
    monkeypatch.setattr(N, "BOX", 8)
    rng = np.random.default_rng(rows)
    x, v, tid = rng.random((rows, dims)).round(places), rng.random((queries, dims)).round(places), rng.permutation(rows)
    a, b = rng.integers(0, 3, queries), rng.integers(0, 3, rows)
    wrong = a[:, None] != b[None]
    at, d, miss = N.nearest_rows(v, x, tid, k, [(a, b)], weight, 9)
    want, far = brute(v, x, tid, k, weight * wrong)
    assert (at == want).all() and (d == far).all() and (miss == np.take_along_axis(wrong, want, 1)).all()


@pytest.mark.parametrize("places", [9, 1])
def test_cells_cut_in_parts_give_the_same(spark, monkeypatch, places):
    for name, value in (("PART", 40), ("BLOCK", 30), ("LEAST_BLOCK", 5), ("SAMPLE", 200), ("BOX", 4)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(3)
    x = rng.random((600, 2)).round(places)
    df = spark.createDataFrame([(i, [float(c) for c in r], i % 2) for i, r in enumerate(x)], "i long, vec array<double>, y int")
    t, q = df.where("i % 3 > 0"), df.where("i % 3 = 0")
    of = np.flatnonzero(np.arange(600) % 3 > 0)
    want, far = brute(x[::3], x[of], of, 4, 0, 12)
    found = {(r["query"], r["rank"]): (r["neighbour"], r["d"]) for r in P.nearest(t, q, 4, "i", "i").collect()}
    assert found == {(3 * n, j + 1): (int(of[want[n, j]]), float(far[n, j])) for n in range(len(want)) for j in range(4)}


def test_equal_queries_are_asked_once(spark):
    """all pairs of rows took the square of the table; of equal rows only the k least ids and one query count."""
    df = spark.range(4000).select(F.col("id").alias("i"), F.array((F.col("id") % 3).cast("double"), F.lit(0.0)).alias("vec"), (F.col("id") % 2).cast("int").alias("y"))
    seen = []

    def answer(found):
        seen.append(found.count())
        return P.mean_posterior(found)

    p = {r["query"]: r["p"] for r in P.nearest(df, df, 4, "i", "i", answer=answer).collect()}
    assert seen == [12] and len(p) == 4000 and set(p.values()) == {0.5}


def test_a_bucket_asks_equal_queries_once(spark, monkeypatch):
    """every query of a bucket met every row of it."""
    asked = []
    monkeypatch.setattr(N, "_meet", lambda t, q, *rest, f=N._meet: (asked.append((t.count(), q.count())), f(t, q, *rest))[1])
    df = spark.range(3000).select(F.col("id").alias("i"), F.expr("cast(id % 2 as int)").alias("b"), F.expr("cast(id % 5 as double)").alias("x"), F.expr("cast(id % 3 = 0 as int)").alias("y"))
    found = P.nearest_in_bucket(df.where("i < 2000"), df.where("i >= 2000"), 3, "i", "i", "b", ["x"], "y")
    got = {r["query"]: (round(r["p"], 9), r["source"]) for r in found.collect()}
    assert asked == [(2 * 5 * 3, 2 * 5)]
    for q in range(2000, 3000, 97):
        best = sorted((i for i in range(2000) if i % 2 == q % 2), key=lambda i: (abs(i % 5 - q % 5), i))[:3]
        assert got[q] == (round(sum(i % 3 == 0 for i in best) / 3, 9), "bucket")
