"""Configuration: YAML files in grouped or flat form, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from trivane.operators.drift import Detector, DetectorConfig
from trivane.operators.posterior import PosteriorBuffer
from trivane.operators.thresholds import SwarmParams


@dataclass(frozen=True)
class DataConfig:
    data_path: str = ""
    label_col: str | None = None
    positive_label: str | None = None
    continuous_label: str | None = None
    threshold: float | None = None
    threshold_op: str = ">"

    def __post_init__(self):
        if self.label_col and self.continuous_label:
            raise ValueError("give label_col or continuous_label, not both")
        if self.continuous_label and self.threshold is None:
            raise ValueError("continuous_label needs a threshold")


@dataclass(frozen=True)
class LevelConfig:
    ratios: tuple[float, ...] = (0.6, 0.8, 1.0)


@dataclass(frozen=True)
class KnnConfig:
    k: int = 6
    kernel: str = "gaussian"
    bandwidth: float | None = None
    scale: float = 1.0
    category_penalty: float = 1.0


@dataclass(frozen=True)
class DecisionConfig:
    sigma: float = 3.0
    theta_pos: float = 2.0
    theta_neg: float = 1.0
    xi_min: float = 0.0
    penalty_large: float = 1e6
    gap: float = 0.01


@dataclass(frozen=True)
class PsoConfig:
    particles: int = 20
    rounds: int = 20
    w_max: float = 0.9
    w_min: float = 0.4
    c1: float = 1.4
    c2: float = 1.4
    seed: int = 42


@dataclass(frozen=True)
class LoopConfig:
    """The keys of a file's loop section. strategy windowed_pso or s_lite; seasons blend in by seasonal_prior_weight once they have seasonal_min_samples rows."""

    strategy: str = "windowed_pso"
    step: int = 512
    window_size: int | None = None
    target_bnd: float = 0.18
    ema_alpha: float = 0.6
    median_window: int = 3
    keep_gap: float | None = None
    fallback_rule: bool = True
    gamma_last: float | None = None
    stall_rounds: int = 6
    search_gamma: bool = True
    approx_bins: int = 256
    ema_gamma: float = 0.6
    rlite_interval: int = 10
    rlite_grid_step: float = 0.02
    rlite_grid_radius: int = 2
    step_max: float = 0.05
    hysteresis: float = 0.01
    replay_size: int = 20
    time_unit: str = "samples"
    time_span: int = 1
    window_unit: str | None = None
    window_span: int | None = None
    seasonal_group: str = "month"
    seasonal_prior_weight: float = 0.0
    seasonal_min_samples: int = 512

    def __post_init__(self):
        if self.strategy.lower() not in ("windowed_pso", "s_lite", "slite", "s-lite"):
            raise ValueError(f"no such strategy: {self.strategy}")


@dataclass(frozen=True)
class UpdaterConfig:
    """The posterior's buffer."""

    buffer_size: int = 4096
    cache_strategy: str = "sliding"
    rebuild_interval: int = 512
    min_rebuild_interval: int = 64
    drift_shrink: float = 0.5

    def build(self, estimator=None) -> PosteriorBuffer:
        return PosteriorBuffer(self.buffer_size, self.rebuild_interval, self.cache_strategy, shrink=self.drift_shrink, least_interval=self.min_rebuild_interval, estimator=estimator)


@dataclass(frozen=True)
class Components:
    """What a configuration turns on; None where its section is absent."""

    detector: Detector | None
    updater: PosteriorBuffer | None
    loop: LoopConfig | None
    swarm: SwarmParams


@dataclass(frozen=True)
class Config:
    """Sections; DRIFT, DYN and INCR stay None when the file has none, which turns them off."""

    DATA: DataConfig = field(default_factory=DataConfig)
    LEVEL: LevelConfig = field(default_factory=LevelConfig)
    KWB: KnnConfig = field(default_factory=KnnConfig)
    GWB: KnnConfig = field(default_factory=KnnConfig)
    S3WD: DecisionConfig = field(default_factory=DecisionConfig)
    PSO: PsoConfig = field(default_factory=PsoConfig)
    DRIFT: DetectorConfig | None = None
    DYN: LoopConfig | None = None
    INCR: UpdaterConfig | None = None


#: Flat keys of older files and the section and field they set.
FLAT = {
    "data_path": ("DATA", "data_path"), "label_col": ("DATA", "label_col"), "positive_label": ("DATA", "positive_label"), "continuous_label": ("DATA", "continuous_label"),
    "threshold": ("DATA", "threshold"), "threshold_op": ("DATA", "threshold_op"), "KWB_k": ("KWB", "k"), "GWB_k": ("GWB", "k"), "GWB_kernel": ("GWB", "kernel"), "GWB_mode": ("GWB", "kernel"),
    "GWB_bandwidth": ("GWB", "bandwidth"), "S3_sigma": ("S3WD", "sigma"), "S3_theta_pos": ("S3WD", "theta_pos"), "S3_theta_neg": ("S3WD", "theta_neg"), "S3_xi_min": ("S3WD", "xi_min"),
    "S3_penalty_large": ("S3WD", "penalty_large"), "S3_pentalty_large": ("S3WD", "penalty_large"), "S3_gap": ("S3WD", "gap"), "PSO_particles": ("PSO", "particles"), "PSO_iters": ("PSO", "rounds"),
    "PSO_w_max": ("PSO", "w_max"), "PSO_w_min": ("PSO", "w_min"), "PSO_c1": ("PSO", "c1"), "PSO_c2": ("PSO", "c2"), "PSO_seed": ("PSO", "seed"),
}
_SECTIONS = {"DATA": DataConfig, "LEVEL": LevelConfig, "KWB": KnnConfig, "GWB": KnnConfig, "S3WD": DecisionConfig, "PSO": PsoConfig, "DRIFT": DetectorConfig, "DYN": LoopConfig, "INCR": UpdaterConfig}
#: Fields of a file's section that have other names here.
NAMES = {"DRIFT": {"window_size": "window", "stat_size": "stat", "min_window_length": "least"}, "PSO": {"iters": "rounds"}}


def _build(kind, values: dict[str, Any]):
    names = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names})


def from_dict(raw: dict[str, Any]) -> Config:
    """A config from grouped keys, flat keys, or a mix of both; flat keys fill what the groups leave out. Unknown keys are passed over."""
    grouped = {k: {NAMES.get(k, {}).get(n, n): x for n, x in v.items()} for k, v in raw.items() if k in _SECTIONS and isinstance(v, dict)}
    for key, value in raw.items():
        if key in FLAT:
            section, name = FLAT[key]
            grouped.setdefault(section, {}).setdefault(name, value)
    parts = {k: _build(kind, grouped[k]) for k, kind in _SECTIONS.items() if k in grouped}
    return Config(**parts)


def components(config: Config, estimator=None) -> Components:
    """Objects for the sections of ``config``. ``estimator`` is the user's posterior for the updater, if any."""
    p, loop = config.PSO, config.DYN
    swarm = SwarmParams(p.particles, p.rounds, p.w_max, p.w_min, p.c1, p.c2, p.seed, *((loop.stall_rounds, loop.search_gamma) if loop else ()))
    return Components(config.DRIFT and Detector(config.DRIFT), config.INCR and config.INCR.build(estimator), loop, swarm)


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})


def flatten(config: Config) -> dict[str, Any]:
    """Section.field -> value of everything that is set."""
    out: dict[str, Any] = {}
    for section, values in asdict(config).items():
        if isinstance(values, dict):
            out |= {f"{section}.{k}": v for k, v in values.items()}
    return out


def changed(config: Config, section: str, **values) -> Config:
    return replace(config, **{section: replace(getattr(config, section), **values)})
