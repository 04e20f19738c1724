"""Hand-computed values, edge cases and invariants of single operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivane import config
from trivane.functions import expressions as X
from trivane.operators import bucketing as B
from trivane.operators import drift as D
from trivane.operators import encoding as E
from trivane.operators import labels as L
from trivane.operators import metrics as M
from trivane.operators import ordered as O
from trivane.operators import posterior as P
from trivane.operators import thresholds as H
from trivane.operators import threeway as W
from trivane.operators import windows as T
from trivane.plans import flow
from trivane.queries import FLOW, quarters
from trivane.sources import tables


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("text,minutes", [("1345", 825), ("2400", 1380), ("99.9", 59), (None, 0), ("x", 0), ("-5", 59), ("1275", 779)])
def test_time_to_minutes(spark, text, minutes):
    assert one(spark.createDataFrame([(text,)], "t string").select(X.time_to_minutes("t").alias("m")))["m"] == minutes


def test_labels_of_missing_and_text_values(spark):
    df = spark.createDataFrame([("20",), ("x",), (None,), ("nan",), ("15",)], "v string")
    assert [r.label for r in L.binarize_continuous(df, "v", 15.0).collect()] == [1, 0, 0, 0, 0]
    yes = spark.createDataFrame([("Yes",), ("no",), (None,)], "v string")
    assert [r.label for r in L.binarize_existing(yes, "v").collect()] == [1, 0, 0]
    rare = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    assert [r.label for r in L.binarize_existing(rare, "v").collect()] == [0, 0, 1]
    with pytest.raises(ValueError):
        L.binarize_existing(spark.createDataFrame([(1,), (2,), (3,)], "v int"), "v")


def test_backoff_given_as_a_name_is_one_column(spark):
    df = spark.createDataFrame([(i, "A" if i < 9 else "B", i) for i in range(12)], "row_id long, origin string, slot long")
    out = B.assign_buckets(df, B.BucketConfig(("origin", "slot"), ("origin",), 2))
    assert {r.bucket_id for r in out.collect()} == {"A", "B"}
    assert {r.bucket_id for r in B.assign_buckets(df, B.BucketConfig(("none",)), []).collect()} == {"__MISSING__"}


def test_three_way_without_evidence_is_deferred(spark):
    p, n, b = X.three_way(F.lit(0.0), F.lit(0.0))
    assert tuple(spark.range(1).select(p, n, b).first()) == (0.0, 0.0, 1.0)


def test_regions_part_the_rows(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("p"))
    m = W.masks(df, "p", 0.7, 0.3)
    assert m.where("cast(in_pos as int) + cast(in_neg as int) + cast(in_bnd as int) <> 1").count() == 0


def test_metrics_of_one_class_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "label int, predicted int, p double")
    m = one(M.classification_metrics(df, [], score="p"))
    assert m["AUC"] is None and m["Precision"] == 1 and m["Recall"] == 0.5
    tied = spark.createDataFrame([(1, 1, 0.5), (0, 0, 0.5)], "label int, predicted int, p double")
    assert one(M.classification_metrics(tied, [], score="p"))["AUC"] == 0.5


def test_psi_counts_one_in_the_last_bin(spark):
    df = spark.createDataFrame([(1.0,), (0.95,), (0.0,)], "p double")
    assert {(r.bin, r.n) for r in D.fixed_bins(df, "p", []).collect()} == {(9, 2), (0, 1)}
    assert one(D.psi_tv(df, df, "p")) == {"psi": 0.0, "tv": 0.0}


def test_ks_is_between_zero_and_one_and_zero_for_itself(spark):
    a = spark.range(50).select(F.col("id").cast("double").alias("v"))
    b = a.select((F.col("v") + 100).alias("v"))
    assert one(D.ks_distance(a, a, "v"))["ks"] == 0 and one(D.ks_distance(a, b, "v"))["ks"] == 1
    empty = a.where("false")
    assert one(D.ks_distance(empty, empty, "v"))["ks"] == 0


@pytest.mark.parametrize("order", [["v", "i"]])
def test_running_sums_do_not_depend_on_partitions(spark, order):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    a = {r.i: r.s for r in O.running_sums(df.repartition(1), order, {"s": F.col("v")}).collect()}
    b = {r.i: r.s for r in O.running_sums(df.repartition(8), order, {"s": F.col("v")}).collect()}
    total, expected = 0.0, {}
    for r in sorted(df.collect(), key=lambda r: (r.v, r.i)):
        total += r.v
        expected[r.i] = total
    assert a == b == expected


def test_previous_crosses_cuts(spark):
    df = spark.range(300).select(F.col("id").alias("i"), (F.col("id") * 7).alias("x"))
    assert all(r.q == (None if r.i == 0 else r.x - 7) for r in O.previous(df, ["i"], "x", "q").collect())


def test_year_rises_when_the_month_falls_and_gaps_are_filled(spark):
    months = [11, 12, None, 1, 2, 1]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(months)], "i int, Month int")
    assert [r.Year_synth for r in T.synthesize_year(df, ["i"]).orderBy("i").collect()] == [0, 0, 0, 1, 1, 2]


def test_grid_search_equals_the_plain_one(spark):
    rng = np.random.default_rng(1)
    p = rng.random(400)
    df = spark.createDataFrame([(float(x), float(1 - x), 0.1) for x in p], "p_pos double, p_neg double, p_bnd double")
    grid = H.Grid((0.5, 0.6, 0.7), (0.2, 0.3, 0.45), gap=0.1, min_coverage=0.2, max_bnd=0.4)
    best = None
    for a in grid.alphas:
        for b in grid.betas:
            pos, neg = p >= a, p <= b
            bnd = ~pos & ~neg
            cost = (p[neg].sum() + (1 - p[pos]).sum() + 0.5 * 0.1 * bnd.sum()) / len(p)
            if a >= b + 0.1 - 1e-12 and pos.mean() >= 0.2 and bnd.mean() <= 0.4 and (best is None or cost < best[0] - 1e-12):
                best = (cost, a, b)
    r = H.select_alpha_beta(df, grid).first()
    assert (r.alpha, r.beta) == best[1:] and math.isclose(r.best, best[0], abs_tol=1e-9)
    none = H.select_alpha_beta(df, H.Grid((0.5,), (0.45,), gap=0.2)).first()
    assert (none.alpha, none.beta, none.feasible_count) == (0.5, 0.3, 0)


def test_smoothing_steps_are_held():
    assert H.ema_clip(0.9, None, 0.5, 0.1) == 0.9
    assert H.ema_clip(0.9, 0.5, 0.5, 0.1) == pytest.approx(0.6)
    a, b = H.enforce_gap(0.5, 0.5, 0.1)
    assert a - b == pytest.approx(0.1)


def test_swarm_finds_a_bowl():
    r = H.swarm(lambda x: ((x - np.array([0.8, 0.6, 0.1, 0.3, 0.5])) ** 2).sum(1), 2, H.SwarmParams(20, 40))
    assert r.fitness < 0.01 and r.alphas[0] >= r.alphas[1] and r.betas[0] <= r.betas[1]


def test_levels_reach_s3_by_a_streak_and_not_under_decay():
    state, levels = D.DriftState(), []
    for _ in range(3):
        level, state = D.next_level(state, 2, 3)
        levels.append(level)
    assert levels == ["S2", "S2", "S3"]
    state, levels = D.DriftState(), []
    for _ in range(6):
        level, state = D.next_level(state, 2, 3, decay_streaks=True)
        levels.append(level)
    assert "S3" not in levels
    after = D.react(D.DriftState(), "S3", cooldown=3)
    seen = []
    for _ in range(3):
        level, after = D.next_level(after, 2, 1)
        seen.append(level)
    assert seen[:2] == ["NONE", "NONE"] and seen[2] != "NONE"


def test_detectors_see_a_jump_and_no_quiet_stream():
    for method in ("kswin", "adwin"):
        d = D.Detector(D.DetectorConfig(method, window=60, stat=20))
        quiet = [d.update(0.5 + 0.01 * (i % 7), i) for i in range(100)]
        jump = [d.update(2.0 + 0.01 * (i % 7), 100 + i) for i in range(60)]
        assert not any(quiet) and any(jump)
    with pytest.raises(ValueError):
        D.DetectorConfig("other")


def test_stream_and_batch_detectors_agree(spark, sf_dir):
    from trivane.queries import QUERIES

    assert sorted(map(tuple, QUERIES["d1_kswin"](spark, sf_dir).collect())) == sorted(map(tuple, QUERIES["d1_kswin_stream"](spark, sf_dir).collect()))


@pytest.mark.parametrize("part, block", [(1 << 15, 1 << 13), (16, 5), (7, 4)])
def test_nearest_by_brute_force_with_cells(spark, monkeypatch, part, block):
    monkeypatch.setattr(P, "PART", part)
    monkeypatch.setattr(P, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    x, q = rng.random((90, 5)), rng.random((17, 5))
    t = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "i long, vec array<double>, y int")
    u = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "i long, vec array<double>")
    got = {}
    for r in P.nearest(t, u, 4, "i", "i").collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    for i, v in enumerate(q):
        expected = sorted(range(90), key=lambda j: (round(float(np.sqrt(((x[j] - v) ** 2).sum())), 12), j))[:4]
        assert [n for _, n in sorted(got[i])] == expected
    none = P.with_default(u, P.kernel_posterior(P.nearest(t.where("false"), u, 4, "i", "i")), "i")
    assert {r.p for r in none.collect()} == {0.5}


def test_nearest_with_categories_and_missing_vectors(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 10)
    rng = np.random.default_rng(4)
    x, c = rng.random((60, 2)), ["abc"[i % 3] if i % 7 else None for i in range(60)]
    t = spark.createDataFrame([(i, v.tolist(), 1, c[i]) for i, v in enumerate(x)] + [(99, None, 1, "a")], "i long, vec array<double>, y int, c string")
    got = {}
    for r in P.nearest(t, t, 3, "i", "i", categories=["c"], category_weight=0.4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["mismatches"]))
    assert set(got) == set(range(60))
    for i in range(60):
        d = lambda j: round(float(np.sqrt(((x[j] - x[i]) ** 2).sum())) + 0.4 * (c[j] != c[i]), 12)
        assert [n for _, n, _ in sorted(got[i])] == sorted(range(60), key=lambda j: (d(j), j))[:3]


def test_running_values_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 17 == 0 else int(rng.integers(0, 4))) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, x int")
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.i: r["rank"] for r in O.row_ranks(df, ["x", "i"]).collect()} == {i: n for n, (i, _) in enumerate(order, 1)}
    before = {r.i: r.b for r in O.previous(df, ["x", "i"], "i", "b").collect()}
    assert before == {i: (order[n - 1][0] if n else None) for n, (i, _) in enumerate(order)}


def test_rare_positive_label_among_many_values(spark):
    rows = [(f"v{k}",) for k in range(1500)] + [("wanted",)] * 5 + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    assert L.binarize_existing(df, "c", "wanted").where("label = 1 and c = 'wanted'").count() == 5 == L.binarize_existing(df, "c", "wanted").where("label = 1").count()
    assert [r.c for r in L.binarize_existing(df, "c", "absent").where("label = 1").collect()] == ["v0"]


def test_null_scopes_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, None, "x", 3.0), (3, None, "y", 5.0)], "i int, s string, k string, v double")
    assert {r.i: r.bucket_id for r in B.assign_buckets(df, B.BucketConfig(("k",), (("s",),), 1), ["s"]).collect()} == {1: "x", 2: "x", 3: "y"}
    assert {r.i: r.v for r in E.z_scores(df, ["v"], ["s"]).collect()} == {1: 0.0, 2: -1.0, 3: 1.0}


def test_roles_by_exact_counts(spark):
    df = spark.range(1000).select((F.col("id") % 12).cast("int").alias("a"), (F.col("id") % 13).cast("int").alias("b"))
    assert E.column_roles(df) == {"a": "categorical", "b": "continuous"}


def test_buffers_keep_the_newest_or_a_sample_of_all(spark):
    part = lambda a, b: spark.range(a, b).select("id", F.col("id").alias("o"))
    slide, pool = P.PosteriorBuffer(10, 100), P.PosteriorBuffer(10, 4, "reservoir")
    for k in range(5):
        slide, pool = slide.add(part(20 * k, 20 * k + 20), "o"), pool.add(part(20 * k, 20 * k + 20), "o")
    assert {r.id for r in slide.rows.collect()} == set(range(90, 100)) and {r.id for r in slide.frozen.collect()} == set(range(10, 20)) and slide.rebuilds == 1
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    assert {r.id for r in pool.rows.collect()} == set(sorted(range(100), key=digest)[:10]) and pool.rebuilds == 5


def test_weights_stay_in_their_range(spark):
    df = spark.createDataFrame([(10, 0.5, 0, 1), (0, 0.99, 1, 0), (11, 0.01, -1, 0)], "period_idx int, p double, region int, label int")
    w = [r.w for r in df.select(T.record_weight("period_idx", 12, 0, "p", "region", "label").alias("w")).collect()]
    assert all(1e-6 <= x <= 10 for x in w)


def test_config_mixes_grouped_and_flat_keys():
    c = config.from_dict({"GWB": {"k": 9}, "S3_sigma": 2, "threshold": 1, "continuous_label": "x", "DRIFT": {"method": "adwin", "psi_thresholds": [1]}})
    assert c.GWB.k == 9 and c.S3WD.sigma == 2 and c.DRIFT.method == "adwin" and config.from_dict({}).DRIFT is None
    with pytest.raises(ValueError):
        config.from_dict({"label_col": "a", "continuous_label": "b", "threshold": 1})


def test_config_sections_become_components():
    c = config.from_dict({"DRIFT": {"method": "kswin", "window_size": 512, "stat_size": 128, "cooldown": 7}, "DYN": {"strategy": "windowed_pso", "stall_rounds": 16}, "INCR": {"buffer_size": 100, "cache_strategy": "reservoir", "min_rebuild_interval": 9}, "PSO": {"particles": 28, "iters": 5}})
    x = config.components(c)
    assert (x.detector.config.window, x.detector.config.stat, x.detector.config.cooldown) == (512, 128, 7) and x.swarm.particles == 28 and x.swarm.rounds == 5 and x.swarm.stall == 16
    assert (x.updater.size, x.updater.policy, x.updater.least_interval) == (100, "reservoir", 9) and x.loop.strategy == "windowed_pso"
    none = config.components(config.from_dict({}))
    assert none.detector is None and none.updater is None and none.loop is None
    with pytest.raises(ValueError):
        config.from_dict({"DYN": {"strategy": "other"}})


def test_levels_are_refined():
    assert D.refined("S2", (0.01, 0.01, 0.0, 0.0)) == "NONE" and D.refined("S2", (0.1, 0.1, 0.01, 0.01)) == "S1"
    assert D.refined("S2", (0.3, 0.1, 0.01, 0.01)) == "S2" and D.refined("S3", (0.0, 0.0, 0.0, 0.0)) == "S3"


def test_a_users_estimator_takes_the_posteriors_place(spark):
    rows = spark.range(10).select("id", F.col("id").alias("o"))
    own = P.PosteriorBuffer(5, 1, estimator=lambda rows, queries, key: queries.where("id < 2").select(F.col(key).alias("query"), F.lit(0.25).alias("p")))
    assert {r["query"]: r.p for r in own.add(rows, "o").predict(rows.where("id < 4"), 3, "id", "id").collect()} == {0: 0.25, 1: 0.25, 2: 0.5, 3: 0.5}


def test_unknown_buckets_use_all_training_rows(spark):
    from trivane.plans.buckets import BucketPlan, run_bucket_plan

    rows = [(i, 2000 if i < 40 else 2001, "A" if i % 2 else "B", 0, float(i % 7), int(i % 3 == 0)) for i in range(60)] + [(99, 2001, "new", 0, 3.0, 1)]
    df = spark.createDataFrame(rows, "id long, year int, airport string, slot int, x double, label int")
    r = run_bucket_plan(df, BucketPlan("id", "label", "year", "airport", "slot", ("x",), (), (2000, 2000), (2001, 2001), 5, 5, 3))
    got = {x["query"]: x for x in r.probabilities.collect()}
    assert got[99].source == "global" and got[99].bucket == "new__COARSE" and {got[i].source for i in range(40, 60)} == {"bucket"}
    for q, x, airport in ((99, 3.0, None), (41, 41 % 7, "A")):
        near = sorted((abs(v - x), i, y) for i, year, a, _, v, y in rows if year == 2000 and airport in (None, a))[:3]
        assert got[q].p == pytest.approx(sum(y for *_, y in near) / 3, abs=1e-9)
    assert r.thresholds.columns[:3] == ["alpha", "beta", "score"]


def test_csv_and_arff(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y;label\n1;2,5;yes\n3;4,5;no\n")
    assert tables.sniff_delimiter(spark, str(tmp_path / "a.csv")) == ";"
    (tmp_path / "b.arff").write_text("% note\n@relation r\n@attribute x numeric\n@attribute 'k' {'u v',w}\n@attribute class {yes,no}\n@data\n1.5,'u v',yes\n?,w,no\n2,w,no\n")
    df = tables.read_arff(spark, str(tmp_path / "b.arff"))
    assert [tuple(r) for r in df.collect()] == [(1.5, "u v", "yes"), (None, "w", "no"), (2.0, "w", "no")]
    ready = tables.load_table(spark, config.DataConfig(str(tmp_path / "b.arff")))
    assert [(r.x, r.k, r.label) for r in ready.orderBy("x").collect()] == [(1.5, 0, 1), (2.0, 1, 0)]
    tables.write_csv(ready, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 2


def test_flow_gives_a_row_for_each_streamed_period(spark, sf_dir, tmp_path):
    rows = quarters(spark, sf_dir).where("year <= 1997")
    r = flow.run_flow(rows, FLOW)
    n = rows.where("year > 1995").select("period_idx").distinct().count()
    m = r.window_metrics.collect()
    assert len(m) == n and all(x.alpha > x.beta for x in m) and all(x.psi >= 0 for x in m)
    assert {x.year for x in r.metrics_by_year.collect()} == {x.year for x in m}
    assert all(0 <= x.mean_p_pos <= 1 and x.mean_e_pos is not None for x in m) and r.warmup_buckets.agg(F.sum("n_samples")).first()[0] == rows.where("year <= 1995").count()
    flow.save(r, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == set(flow.TABLES.values())
    assert tables.read_csv(spark, f"{tmp_path}/window_metrics.csv").count() == n


def test_flow_learns_its_posterior_from_all_training_rows(spark):
    rng = np.random.default_rng(3)
    x, c, y = rng.random((90, 2)), rng.integers(0, 3, 90), rng.integers(0, 2, 90)
    rows = [(i, *map(float, x[i]), "abc"[c[i]], int(y[i]), "uv"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, f double, h double, kind string, label int, bucket_id string")
    own = flow.FlowConfig(("f", "h"), {"kind": 1.0}, B.BucketConfig(("bucket_id",), (), 5), B.ReferenceConfig(4, 0.8), k=5)
    got = {r.row_id: r.g for r in flow.with_posterior(df, df.where("row_id < 60"), own).collect()}
    for i in range(90):
        d = np.sqrt(((x[:60] - x[i]) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:5]
        w = 0.75 * (1 - (d[near] / d[near].max()) ** 2) * 0.3 ** (c[near] != c[i])
        assert got[i] == pytest.approx(((w * y[near]).sum() + 1) / (w.sum() + 2), abs=1e-6)
    assert {r.g for r in flow.with_posterior(df, df.where("false"), own).collect()} == {0.5}


def test_bucket_masks_and_history_caps(spark):
    df = spark.createDataFrame([(i, "A" if i % 2 else "B", i % 3) for i in range(30)], "row_id long, airport string, slot int")
    assert B.bucket_mask(df, "A__COARSE", "airport", "slot").count() == 15 and B.bucket_mask(df, "B__slot2", "airport", "slot").count() == 5
    with pytest.raises(ValueError):
        B.bucket_mask(df, "A", "airport", "slot")
    assert P.cap_buckets(df, "airport", "row_id", 4).groupBy("airport").count().where("count <> 4").count() == 0
