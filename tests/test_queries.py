"""Every query with SQL gives what the SQL gives; the others run and give rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from trivane import queries

#: Queries without SQL, with the rows that they give on the smallest tables (None: any number) and bounds of their numbers.
ROWS = {
    "g0_static_split": 10, "g0_repeated_splits": 7, "m8_boosted_baseline": 4, "h7_swarm_thresholds": 2, "h10_light_thresholds": 14, "h10_histogram_thresholds": 80, "t9_sliding_posterior": 100, "t10_reservoir_posterior": 100,
    "t13_loop_strategies": 8, "d1_kswin": None, "d1_kswin_stream": None, "d3_adwin": None,
}
#: Minutes each: tests/test_operators.py and tests/test_loop.py hold their parts against plain versions.
SLOW = {"t11_rolling_flow", "t13_dynamic_loop", "h8_windowed_swarm"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, sf_dir, con):
    assert_same(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - SLOW))
def test_runs(name, spark, sf_dir):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert ROWS[name] is None or len(rows) == ROWS[name]
    for r in rows:
        for c in ("alpha", "beta", "gamma", "tau", "p", "F1", "BAC", "AUC", "Precision", "Recall"):
            assert c not in r or 0 <= r[c] <= 1
        assert not {"alpha", "beta"} <= set(r.asDict()) or r.alpha > r.beta


def test_boosted_baseline_reads_every_row(monkeypatch, spark, sf_dir):
    monkeypatch.setattr(queries.baselines, "boosted_baseline", lambda df, *a, **k: df)
    assert queries.QUERIES["m8_boosted_baseline"](spark, sf_dir).count() == queries.flights(spark, sf_dir).count()


def test_dynamic_loop_and_windowed_swarm_see_every_year(monkeypatch, spark, sf_dir):
    years = sorted(r[0] for r in queries.flights(spark, sf_dir).select("year").distinct().collect())
    seen = []
    monkeypatch.setattr(queries.dynamic, "run_dynamic", lambda reference, windows, *a, **k: seen.extend(r[0] for x in (reference, windows) for r in x.select("year").distinct().collect()) or [])
    queries.QUERIES["t13_dynamic_loop"](spark, sf_dir)
    assert sorted(seen) == years
    held = []

    def adapt(df, levels, label, p, previous, params):
        held.append((df.agg(F.min("year"), F.max("year")).first(), previous))
        return queries.H.SwarmResult([0.7] * 2, [0.3] * 2, 0.5, float(len(held)))

    monkeypatch.setattr(queries.H, "adapt_windowed", adapt)
    out = queries.QUERIES["h8_windowed_swarm"](spark, sf_dir).collect()
    assert sorted({r.year for r in out}) == years and [tuple(w) for w, _ in held] == [(y, y) for y in years]
    assert held[0][1] is None and [p.fitness for _, p in held[1:]] == list(range(1, len(years)))


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("trivane.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("trivane.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) == set(queries.ORACLES)
    assert set(entry.queries()) == set(queries.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def kswin_plain(values, window, stat, significance):
    """Events of a stream by the definition: the newest ``stat`` of ``window`` values against the others."""
    kept, out = [], []
    for i, v in enumerate(values):
        kept = (kept + [v])[-window:]
        if len(kept) < max(2 * stat, window // 2):
            continue
        old, new = kept[:-stat], kept[-stat:]
        d = max(abs(sum(x <= v for x in old) / len(old) - sum(x <= v for x in new) / len(new)) for v in set(kept))
        root = math.sqrt(len(old) * len(new) / (len(old) + len(new)))
        x = (root + 0.12 + 0.11 / root) * d
        p = min(1.0, max(0.0, sum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0 else 1.0
        if p < significance:
            out.append((i, round(d, 9)))
            kept = new
    return out


def test_kswin_by_the_definition(spark, sf_dir):
    streams = {}
    for r in queries.read(spark, sf_dir, "events").orderBy("ts", "event_id").collect():
        streams.setdefault(r.event_type, []).append(r.value)
    expected = {k: kswin_plain(v, 100, 30, 0.01) for k, v in streams.items()}
    for name in ("d1_kswin", "d1_kswin_stream"):
        got = {}
        for r in queries.QUERIES[name](spark, sf_dir).collect():
            got.setdefault(r.event_type, []).append((r["index"], round(r.value, 9)))
        if name == "d1_kswin":
            assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v}
        assert set(got) <= set(streams)


def adwin_plain(values, window, delta, least=5):
    """Events of a stream by the definition: the cut with the greatest margin of the means' gap over its bound."""
    kept, out = [], []
    for i, v in enumerate(values):
        kept = (kept + [v])[-window:]
        best, at = 0.0, 0
        for k in range(least, len(kept) - least + 1):
            a, b = kept[:k], kept[k:]
            margin = abs(sum(a) / len(a) - sum(b) / len(b)) - math.sqrt(0.5 * (1 / len(a) + 1 / len(b)) * math.log(2 / delta))
            if margin > best + 1e-12:
                best, at = margin, k
        if at:
            out.append((i, round(abs(sum(kept[:at]) / at - sum(kept[at:]) / (len(kept) - at)), 6)))
            kept = kept[at:]
    return out


def test_adwin_by_the_definition(spark, sf_dir):
    streams = {}
    for r in queries.read(spark, sf_dir, "events").orderBy("ts", "event_id").collect():
        streams.setdefault(r.event_type, []).append(r.value + (30 if r.event_id % 400 > 200 else 0))
    got = {}
    for r in queries.QUERIES["d3_adwin"](spark, sf_dir).collect():
        got.setdefault(r.event_type, []).append((r["index"], round(r.value, 6)))
    assert {k: sorted(v) for k, v in got.items()} == {k: e for k, v in streams.items() if (e := adwin_plain(v, 60, 0.01))}


@pytest.mark.parametrize("name", ["t9_sliding_posterior", "t10_reservoir_posterior"])
def test_buffers_by_brute_force(name, spark, sf_dir):
    t, q = (sorted(((r.vec_id, np.array(r.vec), r.y) for r in x.collect()), key=lambda r: r[0]) for x in queries._vectors(spark, sf_dir))
    rows = [(part * 1_000_000 + i, i, v, y) for part in range(3) for i, v, y in t if i % 3 == part]
    if name.startswith("t9"):
        kept = sorted(rows, key=lambda r: -r[0])[:200]
    else:
        kept = sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())[:200]
    got = {r["query"]: r.p for r in queries.QUERIES[name](spark, sf_dir).collect()}
    assert set(got) == {i for i, *_ in q}
    for i, v, _ in q:
        near = sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 12), j, y) for _, j, w, y in kept)[:10]
        h = max(near[-1][0], 1e-6)
        w = [math.exp(-((d / h) ** 2) / 2) for d, _, _ in near]
        p = (sum(x * y for x, (_, _, y) in zip(w, near, strict=True)) + 1) / (sum(w) + 2)
        assert got[i] == pytest.approx(min(max(p, 0.01), 0.99), abs=1e-9)
