"""Light thresholds over plain rows, calibration by trying every row anew, windows and strategies of the loop's configuration."""

import datetime
import itertools
import random

import numpy as np
import pytest

from trivane import config as C
from trivane.operators import light, thresholds
from trivane.operators.threeway import ObjectiveParams
from trivane.plans import dynamic

NAMES = ["p1", "p2", "p3"]


def sample(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.45)
        out.append((i, y, *[min(max(round(rng.gauss(0.65 if y else 0.35, 0.2), 2), 0.0), 1.0) for _ in NAMES]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, p1 double, p2 double, p3 double")


def plain_objective(rows, alphas, betas, gamma, measure):
    x = np.array([[*alphas, *betas, gamma]])
    y, n = np.array([r[1] for r in rows]), np.ones(len(rows), np.int64)
    layers = len(alphas)
    parts = [thresholds._layer_sums(np.array([r[2 + i] for r in rows]), y, n, x[:, i] if i < layers else x[:, -1], x[:, layers + i] if i < layers else np.nextafter(x[:, -1], -np.inf), measure) for i in range(layers + 1)]
    return float(thresholds.objective_of_sums(np.stack(parts, 1), x, measure)[0])


class PlainLight:
    """The same steps, one row and one level at a time."""

    def __init__(self, p):
        self.p, self.pos, self.neg, self.raw, self.mean, self.last = p, None, None, [], None, None
        self.ta, self.tb, self.tg = [0.7] * 3, [0.3] * 3, 0.5

    def quantile(self, hist, share):
        run, goal = 0.0, share * sum(hist)
        for i, c in enumerate(hist):
            if run + c > goal:
                return (i + (goal - run) / c) / len(hist)
            run += c
        return 1.0

    def step(self, rows, safe):
        p, m, bins = self.p, self.p.measure, self.p.bins
        lean = -0.05 if safe else (m.theta_pos / (m.theta_pos + m.theta_neg) - 0.5) * 0.1
        hold = lambda v, lo, hi: min(max(v, lo), hi)
        self.ta = [hold(t + lean, *((0.4, 0.95) if safe else (0.45, 0.95))) for t in self.ta]
        self.tb = [hold(t - lean, *((0.05, 0.6) if safe else (0.05, 0.55))) for t in self.tb]
        self.tg = hold(self.tg + (lean if safe else lean / 2), 0.2, 0.9)
        hists = []
        for label, old in ((1, self.pos), (0, self.neg)):
            new = [[0.0] * bins for _ in NAMES]
            for r in rows:
                if r[1] == label:
                    for i in range(3):
                        new[i][min(int(r[2 + i] * bins), bins - 1)] += 1
            hists.append([[(1 - p.decay) * b + p.decay * (old[i][k] if old else 0) for k, b in enumerate(new[i])] for i in range(3)])
        self.pos, self.neg = hists
        pairs = []
        for i in range(3):
            a, b = self.quantile(self.pos[i], self.ta[i]), self.quantile(self.neg[i], self.tb[i])
            if self.last:
                (oa, ob) = self.last[i]
                da, db = hold(a - oa, -p.step, p.step), hold(b - ob, -p.step, p.step)
                a, b = oa if abs(da) < p.hysteresis else oa + da, ob if abs(db) < p.hysteresis else ob + db
            pairs.append(thresholds.enforce_gap(a, b, p.gap))
        self.last = pairs
        gamma = self.quantile([x + y for x, y in zip(self.pos[2], self.neg[2], strict=True)], self.tg)
        share = sum(sum(b < r[2 + i] < a for r in rows) / len(rows) for i, (a, b) in enumerate(pairs[:2])) / 2
        pull = hold(p.target_bnd - share, -0.05, 0.05)
        moved = [thresholds.enforce_gap(hold(a + pull, p.gap, 0.999), hold(b - pull, 0, 0.999), p.gap) for a, b in pairs[:2]] + [thresholds.enforce_gap(*pairs[2], p.gap)]
        now = [a for a, _ in moved] + [b for _, b in moved] + [gamma]
        self.raw = [*self.raw, now][-p.median :]
        self.mean = [p.decay * x + (1 - p.decay) * y for x, y in zip(now, self.mean or now, strict=True)]
        smooth = [(x + float(np.median([r[i] for r in self.raw]))) / 2 for i, x in enumerate(self.mean)]
        ab = [thresholds.enforce_gap(smooth[i], smooth[3 + i], p.gap) for i in range(2)]
        return [a for a, _ in ab], [b for _, b in ab], smooth[-1], plain_objective(rows, [a for a, _ in ab], [b for _, b in ab], smooth[-1], m)


def test_light_steps_by_plain_rows(spark):
    p = light.LightParams(bins=32, target_bnd=0.2, median=2)
    state, plain = light.LightState.start(3, p), PlainLight(p)
    for w in range(4):
        rows = sample(w)
        got, state = light.light_step(state, frame(spark, rows), NAMES, "y", p, safe=w == 2)
        a, b, g, f = plain.step(rows, w == 2)
        assert got.alphas == pytest.approx(a) and got.betas == pytest.approx(b) and got.gamma == pytest.approx(g) and got.fitness == pytest.approx(f, abs=1e-6)


def test_calibration_tries_every_place(spark):
    p = light.LightParams(bins=32, grid_radius=1, grid_step=0.05, measure=ObjectiveParams(gap=0.01))
    state = light.LightState.start(3, p)
    rows = []
    for w in range(3):
        own = sample(10 + w, 60)
        rows += own
        _, state = light.light_step(state, frame(spark, own), NAMES, "y", p)
    better, after = light.calibrate(state, NAMES, "y", p)
    values = lambda level, label=None: [r[2 + level] for r in rows if label is None or r[1] == label]

    def fit(taus):
        pairs = [thresholds.enforce_gap(float(np.quantile(values(i, 1), taus["a", i])), float(np.quantile(values(i, 0), taus["b", i])), p.gap) for i in range(2)]
        return plain_objective(rows, [a for a, _ in pairs], [b for _, b in pairs], float(np.quantile(values(2), taus["g", 2])), p.measure)

    start = {("a", i): state.tau_alpha[i] for i in range(2)} | {("b", i): state.tau_beta[i] for i in range(2)} | {("g", 2): state.tau_gamma}
    best, least = dict(start), fit(start)
    for key in [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("g", 2)]:
        lo, hi = {"a": (0.05, 0.95), "b": (0.02, 0.8), "g": (0.1, 0.95)}[key[0]]
        for s in (-1, 0, 1):
            trial = best | {key: min(max(start[key] + s * p.grid_step, lo), hi)}
            if fit(trial) < least - 1e-9:
                best, least = trial, fit(trial)
    mix = lambda k: p.decay * start[k] + (1 - p.decay) * best[k]
    assert better == (best != start)
    assert after.tau_alpha[:2] == pytest.approx([mix(("a", 0)), mix(("a", 1))]) and after.tau_beta[:2] == pytest.approx([mix(("b", 0)), mix(("b", 1))]) and after.tau_gamma == pytest.approx(mix(("g", 2)))
    assert light.calibrate(light.LightState.start(3, p), NAMES, "y", p)[0] is False


def test_loop_windows_and_seasons(spark):
    base = datetime.date(2023, 12, 30)
    rows = [(i, base + datetime.timedelta(days=5 * i)) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, day date")
    for unit, span, number in (
        ("days", 3, lambda d: d.toordinal()), ("weeks", 1, lambda d: (d.toordinal() - 1) // 7), ("months", 2, lambda d: d.year * 12 + d.month - 1), ("quarters", 1, lambda d: (d.year * 12 + d.month - 1) // 3), ("years", 1, lambda d: d.year),
    ):
        got = {r.id: (r.window, r.season) for r in dynamic.loop_windows(df, C.LoopConfig(time_unit=unit, time_span=span, seasonal_group="quarter"), ["id"], "day").collect()}
        for i, d in rows[:-1]:
            assert got[i] == ((number(d) - number(base)) // span, f"Q{(d.month + 2) // 3}"), unit
        assert got[99] == (None, "none")
    by_rows = {r.id: r.window for r in dynamic.loop_windows(df, C.LoopConfig(step=7), ["id"], "day").collect()}
    assert by_rows == {i: k // 7 for k, (i, _) in enumerate(sorted(rows))}
    with pytest.raises(ValueError):
        dynamic.loop_windows(df, C.LoopConfig(time_unit="moons"), ["id"], "day")


@pytest.mark.parametrize("name,kind", [("s_lite", dynamic.LightStrategy), ("windowed_pso", dynamic.SwarmStrategy)])
def test_loop_follows_its_configuration(name, kind, spark):
    cfg = C.from_dict({"DYN": {"strategy": name, "step": 60, "ema_gamma": 0.3, "rlite_interval": 2, "rlite_grid_radius": 1, "seasonal_min_samples": 20, "stall_rounds": 2}, "PSO": {"particles": 4, "iters": 3}, "DRIFT": {"window_size": 6, "stat_size": 2}})
    made = dynamic.loop_strategy(cfg.DYN)
    assert isinstance(made, kind) and (name != "s_lite" or (made.params.decay_gamma, made.params.every, made.params.grid_radius) == (0.3, 2, 1))
    rows = [(i, *r[1:], datetime.date(2024, 1, 1) + datetime.timedelta(days=i // 4)) for i, r in enumerate(itertools.chain(*[sample(s, 60) for s in range(5)]))]
    df = spark.createDataFrame(rows, "id long, y int, p1 double, p2 double, p3 double, day date")
    steps = dynamic.run_loop(df, 1, cfg, NAMES, "y", ["id"], "day")
    assert [s.window for s in steps] == [1, 2, 3, 4] and all(s.metrics["n_samples"] == 60 and s.alphas[0] > s.betas[0] for s in steps)
