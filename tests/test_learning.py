"""Feature information, boosted trees, neighbours, swarms and split runs against plain definitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivane.operators import boosting, drift, information, ordered, posterior, thresholds, threeway, windows
from trivane.plans import baselines, dynamic

# ---- mutual information by nearest neighbours ---------------------------------------------


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def plain_information(xs, ys, k=3):
    """The estimator by its definition, on whole steps of the range."""
    rows = [(x, y) for x, y in zip(xs, ys, strict=True) if x is not None and y is not None and math.isfinite(x)]
    lo, hi = min(x for x, _ in rows), max(x for x, _ in rows)
    q = [(math.floor((x - lo) / (hi - lo) * information.STEPS) if hi > lo else 0, y) for x, y in rows]
    size = Counter(y for _, y in q)
    used = [r for r in q if size[r[1]] > 1]
    if not used:
        return 0.0
    total = 0.0
    for i, (x, y) in enumerate(used):
        own = min(k, size[y] - 1)
        r = sorted(abs(x - z) for j, (z, w) in enumerate(used) if w == y and j != i)[own - 1]
        m = sum(abs(x - z) < r if r else z == x for z, _ in used)
        total += psi(own) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(used)) + total / len(used))


@pytest.mark.parametrize("k", [1, 3])
def test_neighbour_information_by_the_definition(k, spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 40)  # neighbours lie across the edges of ranges
    rng = random.Random(k)
    rows = []
    for i in range(260):
        y = rng.choice(["a", "a", "b", "c"]) if i else "alone"
        rows.append((i, y, rng.gauss(0 if y == "a" else 2, 1), float(rng.randint(0, 4) + (y == "b")), rng.random() if rng.random() > 0.1 else None, 5.0, i % 2))
    rows.append((999, None, 1.0, 1.0, 1.0, 5.0, 0))
    df = spark.createDataFrame(rows, "id long, y string, far double, tied double, noise double, constant double, g int")
    names = ["far", "tied", "noise", "constant"]
    got = {r.feature: r.score for r in information.neighbour_information(df, names, "y", k).collect()}
    for j, name in enumerate(names, 2):
        assert got[name] == pytest.approx(plain_information([r[j] for r in rows], [r[1] for r in rows], k), abs=1e-9), name
    assert got["far"] > got["noise"]
    by = {(r.g, r.feature): r.score for r in information.neighbour_information(df, names, "y", k, ["g"]).collect()}
    for g in (0, 1):
        own = [r for r in rows if r[6] == g]
        assert by[g, "far"] == pytest.approx(plain_information([r[2] for r in own], [r[1] for r in own], k), abs=1e-9)
    assert information.neighbour_information(df.where("false"), names, "y").count() == 0


def test_digamma(spark):
    ns = [1, 2, 3, 7, 50, 1234]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(information.digamma(F.col("n"))).collect()]
    assert got == pytest.approx([psi(n) for n in ns], abs=1e-10)


# ---- boosted trees --------------------------------------------------------------------------


def plain_boost(x, y, keys, edges, p):
    """One process, one split at a time: margins of all rows."""
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.zeros(len(x))
    for number in range(p.trees):
        features = boosting.columns_of(x.shape[1], number, p)
        use = boosting._mixed(keys, p.seed * 1_000_003 + number) < p.rows
        g, h = (v / boosting.FIXED for v in boosting.gradients(y, margin))
        new = np.zeros(len(x))

        def grow(all_rows, depth, value, g=g, h=h, use=use, new=new, features=features):
            rows = all_rows[use[all_rows]]
            best = (1e-6, None, None)
            if depth < p.depth:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f in features:
                    for cut in range(max(len(e) for e in edges)):
                        left = codes[rows, f] <= cut
                        lg, lh = g[rows][left].sum(), h[rows][left].sum()
                        rg, rh = gs - lg, hs - lh
                        if lh < p.least_weight or rh < p.least_weight:
                            continue
                        gain = round(float((lg**2 / (lh + p.penalty) + rg**2 / (rh + p.penalty) - gs**2 / (hs + p.penalty)) / 2 - p.gamma), 9)
                        if gain > best[0]:
                            best = (gain, f, cut)
            if best[1] is None:
                new[all_rows] = value
                return
            side = codes[all_rows, best[1]] <= best[2]
            for part in (all_rows[side], all_rows[~side]):
                own = part[use[part]]
                grow(part, depth + 1, -p.rate * g[own].sum() / (h[own].sum() + p.penalty))

        rows = np.flatnonzero(use)
        grow(np.arange(len(x)), 0, -p.rate * g[rows].sum() / (h[rows].sum() + p.penalty))
        margin += new
    return margin


def test_trees_equal_a_plain_trainer(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((500, 4)), 2)
    y = ((x[:, 0] + x[:, 1] ** 2 > 0.8) ^ (rng.random(500) < 0.05)).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, vec array<double>, y int").repartition(5)
    p = boosting.BoostParams(trees=5, depth=3, bins=16, rate=0.3, rewrite=2)
    forest = boosting.boost(df, "y", "id", params=p)
    keys = {r.id: r.k for r in df.select("id", F.xxhash64(F.col("id").cast("string")).alias("k")).collect()}
    k = np.array([keys[i] for i in range(500)], np.int64).view(np.uint64)
    expected = plain_boost(x, y, k, forest.edges, p)
    assert forest.margins(forest.codes(x)) == pytest.approx(expected, abs=1e-6)
    scored = {r.id: r.p for r in boosting.with_probability(df, forest).collect()}
    assert [scored[i] for i in range(500)] == pytest.approx((1 / (1 + np.exp(-expected))).tolist(), abs=1e-6)
    again = boosting.boost(df.repartition(2), "y", "id", params=p)
    assert all((a.value == b.value).all() for a, b in zip(forest.trees, again.trees, strict=True))


def test_trees_with_odd_input(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)], 1) for i in range(20)] + [(50, None, 1), (51, [1.0, 2.0], None)], "id long, vec array<double>, y int")
    p = boosting.BoostParams(trees=2, depth=2)
    assert all(r.p > 0.5 for r in boosting.with_probability(df.where("vec is not null"), boosting.boost(df, "y", "id", params=p)).collect())
    none = boosting.boost(df.where("false"), "y", "id", params=p)
    assert none.trees == [] and {r.p for r in boosting.with_probability(df, none).collect()} == {0.5}


def test_boosted_baseline_judges_every_later_year(spark):
    rng = random.Random(2)
    rows = [(i, 1995 + i % 4, [rng.random(), float(i % 3)], 0) for i in range(400)]
    rows = [(i, y, v, int(v[0] > 0.5)) for i, y, v, _ in rows]
    df = spark.createDataFrame(rows, "id long, year int, vec array<double>, y int")
    out = {r.year: r for r in baselines.boosted_baseline(df, [1995, 1996], "year", "y", "id", boosting.BoostParams(trees=4, depth=2, rate=0.5)).collect()}
    assert set(out) == {1997, 1998} and all(r.n_samples == 100 and r.AUC > 0.95 for r in out.values())


# ---- neighbours -------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_blocked_search_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, k, weight = (5000, 7, 0.3) if seed % 2 else (11, 20, 0.0)
    x, v = np.round(rng.random((n, 3)), 1), np.round(rng.random((40, 3)), 1)  # many ties
    tid = rng.permutation(n)
    codes = [(rng.integers(0, 3, 40), rng.integers(0, 3, n))] if seed >= 2 else []
    at, d, miss = posterior._nearest_rows(v, x, tid, k, codes, weight, 9)
    per = min(k, n)
    assert len(at) == 40 * per
    for i in range(40):
        wrong = codes[0][0][i] != codes[0][1] if codes else np.zeros(n, bool)
        far = np.round(np.sqrt(((v[i] - x) ** 2).sum(1)) + weight * wrong, 9)
        want = np.lexsort((tid, far))[:per]
        assert (at[i * per : (i + 1) * per] == want).all() and d[i * per : (i + 1) * per] == pytest.approx(far[want]) and (miss[i * per : (i + 1) * per] == wrong[want]).all()


def vectors(spark, n, first=0, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(first + i, [rng.random(), rng.random()], i % 2, rng.choice("xy")) for i in range(n)], "id long, vec array<double>, y int, c string")


@pytest.mark.parametrize("keep", [None, 2])
def test_neighbour_table_equals_a_full_refit(keep, spark, monkeypatch):
    batches = [vectors(spark, n, 1000 * i, i) for i, n in enumerate((30, 5, 50, 1))]
    asked = vectors(spark, 20, 9000, 9)
    table = posterior.NeighbourTable(asked, 6, "id", "id", categories=("c",), category_weight=0.2, keep=keep)
    searched = []
    real = posterior.nearest
    monkeypatch.setattr(posterior, "nearest", lambda train, *a, **k: searched.append(train.count()) or real(train, *a, **k))
    for b in batches:
        table = table.add(b)
    assert searched == [30, 5, 50, 1]  # only what is new
    live = batches if keep is None else batches[-keep:]
    rows = live[0]
    for b in live[1:]:
        rows = rows.union(b)
    expected = real(rows, asked, 6, "id", "id", categories=["c"], category_weight=0.2)
    order = ["query", "rank"]
    assert table.neighbours().select("query", "neighbour", "d", "rank").orderBy(*order).collect() == expected.select("query", "neighbour", "d", "rank").orderBy(*order).collect()


def test_sliding_buffer_drops_segments_whole(spark):
    buffer, written_rows = posterior.PosteriorBuffer(size=25, interval=1000), []
    for i, n in enumerate((10, 10, 10, 10)):
        buffer = buffer.add(vectors(spark, n, 100 * i, i), "id")
        written_rows.append(len(buffer.segments))
    assert sorted(r.id for r in buffer.rows.collect()) == [*range(105, 110), *range(200, 210), *range(300, 310)]
    assert written_rows == [1, 2, 3, 3] and buffer.rebuilds == 1


# ---- objective and swarms ----------------------------------------------------------------------


@pytest.mark.parametrize("regret", ["utility", "rate"])
def test_objective_of_sums_equals_the_aggregate(regret, spark):
    rng = random.Random(1)
    rows = [(rng.choice("gh"), int(rng.random() < 0.4), round(rng.random(), 2), round(rng.random(), 2), None if rng.random() < 0.05 else round(rng.random(), 1), rng.randint(1, 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y int, p1 double, p2 double, p3 double, n int").repartition(3)
    measure = threeway.ObjectiveParams(regret=regret, xi_min=0.2)
    x = {g: np.array([[0.7, 0.6, 0.2, 0.3, 0.5], [0.9, 0.5, 0.1, 0.5, 0.4], [0.5, 0.55, 0.3, 0.545, 0.6]]) for g in "gh"}
    sums = thresholds.objective_sums(df, "g", ["p1", "p2", "p3"], "y", "n", x, measure)
    for g in "gh":
        got = thresholds.objective_of_sums(sums[g], x[g], measure)
        for r, f in zip(x[g], got, strict=True):
            want = df.where(F.col("g") == g).agg(threeway.objective(["p1", "p2", "p3"], "y", r[:2].tolist(), r[2:4].tolist(), float(r[4]), measure, F.col("n").cast("double")).alias("f")).first()["f"]
            assert f == pytest.approx(want, abs=1e-6)


def test_swarms_in_step_equal_swarms_alone(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i % 3, int(rng.random() < 0.3 + 0.1 * (i % 3)), rng.random(), rng.random()) for i in range(600)], "g int, y int, p1 double, p2 double")
    params = thresholds.SwarmParams(5, 4, stall=2)
    together = thresholds.learn_thresholds_by(df, "g", ["p1", "p2"], "y", params)
    for g in range(3):
        alone = thresholds.learn_thresholds(df.where(F.col("g") == g), ["p1", "p2"], "y", params)
        assert together[g] == alone and alone.history == sorted(alone.history, reverse=True)


# ---- runs ------------------------------------------------------------------------------------


def test_level_posteriors_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(run, rng.choice(["fit", "fit", "test", "validation"]), i, int(rng.random() < 0.5), rng.random(), rng.random(), rng.random()) for run in (0, 1) for i in range(80)]
    df = spark.createDataFrame(rows, "run int, part string, id long, y int, a double, b double, c double")
    levels = {0: [["a"], ["a", "b"], ["a", "b", "c"]], 1: [["c"], ["c", "a"], ["c", "a", "b"]]}
    place = {"a": 4, "b": 5, "c": 6}
    got = {(r.run, r.id): r for r in dynamic.level_posteriors(df, levels, ["a", "b", "c"], "id", "y", 5).collect()}
    assert len(got) == sum(r[1] != "fit" for r in rows)
    for r in rows:
        if r[1] == "fit":
            continue
        for i, own in enumerate(levels[r[0]], 1):
            near = sorted((round(math.sqrt(sum((r[place[f]] - t[place[f]]) ** 2 for f in own)), 12), t[2], t[3]) for t in rows if t[0] == r[0] and t[1] == "fit")[:5]
            want = min(max((sum(y for *_, y in near) + 1) / 7, 0.01), 0.99)
            assert got[r[0], r[2]][f"p{i}"] == pytest.approx(want)


def test_split_runs_share_labels_and_keep_every_row(spark):
    df = spark.createDataFrame([(i, i % 5 == 0) for i in range(500)], "id long, yes boolean").select("id", F.col("yes").cast("int").alias("y"))
    parts = defaultdict(set)
    for r in dynamic.split_runs(df, "y", "id", [0, 1, 2]).collect():
        parts[r.run, r.part].add((r.id, r.y))
    for run in range(3):
        own = [parts[run, p] for p in ("fit", "validation", "test")]
        assert sum(map(len, own)) == len(set.union(*own)) == 500 and [sum(y for _, y in p) for p in own] == [49, 21, 30]
    assert parts[0, "test"] != parts[1, "test"]


def test_repeated_splits_summarise_their_runs(spark):
    rng = random.Random(6)
    rows = [(i, *(lambda a: (a, rng.random(), int(a > 0.5)))(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    runs = dynamic.run_splits(df, ["a", "b"], "y", "id", [0, 1, 2], 5, thresholds.SwarmParams(4, 3)).collect()
    assert sorted(r.run for r in runs) == [0, 1, 2] and [(r.n_samples, r.AUC) for r in runs if abs(r.n_samples - 90) > 1 or r.AUC < 0.9] == []
    found = {r.metric: r for r in dynamic.repeated_splits(df, ["a", "b"], "y", "id", range(3), k=5, swarm=thresholds.SwarmParams(4, 3)).collect()}
    assert found["F1"]["mean"] == pytest.approx(np.mean([r.F1 for r in runs])) and found["F1"]["std"] == pytest.approx(np.std([r.F1 for r in runs], ddof=1))


# ---- reactions ---------------------------------------------------------------------------------


@pytest.mark.parametrize("debounce,decay", [(1, False), (2, False), (3, True)])
def test_reaction_fold_equals_the_steps(debounce, decay, spark):
    rng = random.Random(debounce)
    rows = [(run, i, rng.choice([0, 1, 2, 2, 2])) for run in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "run string, t int, s int")
    got = {(r.run, r.t): r for r in drift.reaction_fold(df, "t", "s", ["run"], debounce=debounce, decay_streaks=decay).collect()}
    for run in "ab":
        state, m = drift.DriftState(), 1.0
        for _, t, s in sorted(r for r in rows if r[0] == run):
            level, state = drift.next_level(state, s, debounce, decay)
            state, m = drift.react(state, level), windows.drift_multiplier(m, level)
            r = got[run, t]
            assert (r.level, r.warn, r.alert, r.cooldown) == (level, state.warn, state.alert, state.cooldown)
            assert [r.sigma, r.keep_ratio, r.keep_gap, r.bnd_cap, r.step_cap, r.multiplier] == pytest.approx([state.sigma, state.keep_ratio, state.keep_gap, state.bnd_cap, state.step_cap, m])
