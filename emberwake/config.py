"""Parameters of the pipelines; defaults are the fixed values of the analyses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Quality:
    min_confidence: float = 70.0
    instruments: tuple[str, ...] = ("MODIS",)
    satellites: tuple[str, ...] = ("Terra", "Aqua")
    dedup_meters: float = 1000.0
    dedup_hours: float = 1.0


@dataclass(frozen=True)
class Region:
    west: float = -125.0
    south: float = 24.0
    east: float = -66.0
    north: float = 50.0


@dataclass(frozen=True)
class Clustering:
    eps_km: float = 1.5
    eps_days: float = 3.0
    min_samples: int = 2
    drop_below: int = 3
    # the speed-constrained detector
    speed_eps_m: float = 2500.0
    speed_eps_days: float = 11.0
    max_kmh: float = 10.0


@dataclass(frozen=True)
class Episodes:
    dormancy_days: int = 2
    rekindle_days: int = 7
    min_hours: float = 1.0
    max_days: float = 365.0
    min_area_km2: float = 0.01
    max_rate_kmh: float = 50.0
    min_coherence: float = 0.5
    min_completeness: float = 0.3


@dataclass(frozen=True)
class Config:
    quality: Quality = field(default_factory=Quality)
    region: Region = field(default_factory=Region)
    clustering: Clustering = field(default_factory=Clustering)
    episodes: Episodes = field(default_factory=Episodes)


def _build(kind: type, values: dict) -> object:
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings for {kind.__name__}: {sorted(unknown)}")
    parts = {}
    for name, value in values.items():
        default = getattr(kind(), name)
        parts[name] = _build(type(default), value or {}) if is_dataclass(default) else tuple(value) if isinstance(default, tuple) else value
    return kind(**parts)


def load_config(path: str | Path | None = None) -> Config:
    """A YAML tree of the same names; what it leaves out keeps its default."""
    if path is None:
        return Config()
    import yaml

    return _build(Config, yaml.safe_load(Path(path).read_text()) or {})
