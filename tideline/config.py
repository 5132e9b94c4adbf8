"""Settings of an analysis; derived values follow the ones they come from."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

import numpy as np

# Frequency bands in Hz (low, high); None is open.
BANDS = {"Delta": (1.0, 4.0), "Theta": (4.0, 8.0), "Alpha": (8.0, 12.0), "Beta": (12.0, 30.0), "Broad": (1.0, 15.0), "FullBand": (None, None)}


@dataclass(frozen=True)
class Config:
    sample_rate: int = 128
    t_min: float = -0.2
    t_max: float = 0.6
    n_channels: int = 64
    n_folds: int = 5
    default_alpha: float = 1.0
    alpha_low: float = -4.0
    alpha_high: float = 5.0
    n_alphas: int = 48
    tolerance: float = 0.02
    n_mels: int = 21
    bands: tuple[str, ...] = ("Theta",)
    sides: tuple[str, ...] = ("left", "right", "mono")
    attributes: tuple[str, ...] = ("Envelope", "Spectrogram", "Phonemes", "BipOnsets")
    subjects: tuple[str, ...] = field(default_factory=tuple)

    @property
    def delays(self) -> np.ndarray:
        """Sample delays from t_min to t_max, both included."""
        return np.arange(int(np.round(self.t_min * self.sample_rate)), int(np.round(self.t_max * self.sample_rate)) + 1)

    @property
    def alphas(self) -> np.ndarray:
        return np.logspace(self.alpha_low, self.alpha_high, self.n_alphas)

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_args(cls, args: list[str]) -> Config:
        """A configuration from ``--name value`` options; sequences are comma-separated."""
        import argparse

        parser = argparse.ArgumentParser()
        for f in fields(cls):
            default = getattr(cls(), f.name)
            kind = (lambda s: tuple(x for x in s.split(",") if x)) if isinstance(default, tuple) else type(default)
            parser.add_argument(f"--{f.name}", type=kind, default=default)
        return cls(**vars(parser.parse_args(args)))
