"""The settings file: a subset of YAML, read into typed settings. Unknown keys warn, wrong values fail."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, is_dataclass


class ConfigError(ValueError):
    pass


@dataclass
class Strip:
    name: str = ""
    rows: int = 0
    cols: int = 2048
    begin: int = 0
    end: int = 10


@dataclass
class FeatureMatch:
    sigma: float = 150.0
    trials: int = 150_000
    iterations: int = 0
    densify: bool = False
    seed_radius: float = 500.0
    seed_min: int = 3
    near_range: int = 64
    far_range: int = 128


@dataclass
class GridMatch:
    spacing: int = 48
    window: int = 15
    search: int = 80
    min_score: float = 0.5
    weak_range: int = 128
    lambda2: float = 0.01


@dataclass
class Steps:
    preprocess: bool = True
    mosaic: bool = True
    trajectory: bool = True
    downsample: bool = True
    feature_match: bool = True
    grid_match: bool = True
    inter_tile_match: bool = True
    adjustment: bool = True
    export: bool = True


@dataclass
class Config:
    root: str = "."
    left: Strip = field(default_factory=Strip)
    right: Strip = field(default_factory=Strip)
    steps: Steps = field(default_factory=Steps)
    feature_match: FeatureMatch = field(default_factory=FeatureMatch)
    grid_match: GridMatch = field(default_factory=GridMatch)

    def validate(self) -> Config:
        for side in (self.left, self.right):
            if not 0 <= side.begin < side.end:
                raise ConfigError(f"{side.name or 'strip'}: tiles {side.begin}..{side.end} are no range")
            if side.rows < 0 or side.cols <= 0:
                raise ConfigError(f"{side.name or 'strip'}: size {side.rows} x {side.cols}")
        g, m = self.grid_match, self.feature_match
        if g.spacing <= 0 or g.window <= 0 or g.window % 2 == 0 or g.search <= 0:
            raise ConfigError("grid_match: spacing and search must be positive, window odd")
        if not -1 <= g.min_score <= 1:
            raise ConfigError("grid_match: min_score must be a correlation")
        if m.sigma <= 0 or m.trials <= 0 or m.iterations < 0:
            raise ConfigError("feature_match: sigma and trials must be positive")
        return self


def _value(text: str, kind: type, key: str):
    text = text.strip().strip("\"'")
    try:
        if kind is bool:
            return {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}[text.lower()]
        return kind(text)
    except (KeyError, ValueError):
        raise ConfigError(f"{key}: {text!r} is no {kind.__name__}") from None


def parse(text: str) -> Config:
    """Keys of two levels, # for comments."""
    out, section = Config(), None
    kinds = {"str": str, "int": int, "float": float, "bool": bool}
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ConfigError(f"line {number}: no key")
        nested = line[0] in " \t"
        if not nested:
            section = None
        target = section if nested else out
        names = {f.name: f.type for f in fields(target)} if target is not None else {}
        if key not in names:
            if not (nested and target is None):
                warnings.warn(f"line {number}: unknown key {key}", stacklevel=2)
        elif is_dataclass(getattr(target, key)):
            section = getattr(target, key)
        else:
            setattr(target, key, _value(value, kinds[names[key]], key))
    return out.validate()
