"""Parameters of detection, with their defaults, and the errors that bad ones raise."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


class DetectorError(Exception):
    """Base of all errors of this package."""


class ConfigError(DetectorError):
    """A parameter can't be used."""


class FamilyError(DetectorError):
    """A family is unknown, has no codes, or can't be indexed."""


@dataclass(frozen=True)
class QuadParams:
    min_cluster_pixels: int = 24
    max_nmaxima: int = 10
    cos_critical_rad: float = math.cos(math.radians(10))
    max_line_fit_mse: float = 10.0
    min_white_black_diff: int = 5
    deglitch: bool = False
    #: Threshold by all eight neighbours of a tile instead of itself, the left and the upper ones.
    full_blur: bool = False


@dataclass(frozen=True)
class DetectorConfig:
    quad_decimate: float = 1.0
    quad_sigma: float = 0.0
    refine_edges: bool = True
    decode_sharpening: float = 0.25
    backend: str = "arrow"
    source_dimensions: tuple[int, int] | None = None
    qtp: QuadParams = field(default_factory=QuadParams)

    def __post_init__(self):
        if self.backend not in ("arrow", "relational"):
            raise ConfigError(f"no backend {self.backend!r}")
        if self.quad_decimate < 0 or not math.isfinite(self.quad_decimate):
            raise ConfigError("quad_decimate must be a finite number from 0")
        if not 0 <= self.qtp.min_white_black_diff <= 255:
            raise ConfigError("min_white_black_diff must be from 0 to 255")

    def decimation(self) -> float:
        """0: none; 1.5; or an integer from 2."""
        if self.quad_decimate <= 1:
            return 0
        if self.quad_decimate == 1.5:
            return 1.5
        k = math.floor(self.quad_decimate + 0.5)
        return k if k > 1 else 0

    def sigma_kernel(self) -> list[int] | None:
        """Weights of the Gaussian for |quad_sigma|, or None where it is off."""
        return gaussian_kernel(abs(self.quad_sigma)) if self.quad_sigma else None


def gaussian_kernel(sigma: float, size: int | None = None) -> list[int] | None:
    """Weights that add up to about 255; ``size`` is ``int(4 sigma)`` made odd, None where that is 1 or less."""
    if size is None:
        size = int(4 * sigma)
        size += (size & 1) == 0
    if size <= 1:
        return None
    raw = [math.exp(-0.5 * ((i - size // 2) / sigma) ** 2) for i in range(size)]
    return [int(math.floor(255 * e / sum(raw) + 0.5)) for e in raw]


@dataclass(frozen=True)
class Camera:
    tagsize: float
    fx: float
    fy: float
    cx: float
    cy: float


#: Configurations of the standard benchmark sweep: what each changes in the base of four threads.
SWEEP_BASE = {"nthreads": 4, "quad_decimate": 2.0, "quad_sigma": 0.0, "refine_edges": True, "decode_sharpening": 0.25, "min_cluster_pixels": 5, "max_line_fit_mse": 10.0, "hamming": 1, "acceleration": "disabled"}


def load_config(path: str) -> dict:
    """A benchmark configuration in TOML, filled up with :data:`SWEEP_BASE`."""
    import tomllib

    with open(path, "rb") as f:
        given = tomllib.load(f)
    flat = dict(SWEEP_BASE)
    for key, value in given.items():
        flat.update(value if isinstance(value, dict) else {key: value})
    return flat
