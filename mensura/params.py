"""Scoring parameters. One ``Params`` is one variant of the scoring run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


@dataclass(frozen=True)
class Params:
    name: str = "base"
    tol_mm: float = 6.0
    area_tol_pct: float = 12.0
    alpha: float = 2.0
    temperature: float = 1.0
    max_z_accept: float = 3.5
    min_llr_margin: float = 2.0
    top_k: int = 3
    camera_height_mm: float = 300.0
    near_miss_factor: float = 1.5
    round_min: float = 0.80
    mode: str = "mean"
    floors: dict = field(default_factory=lambda: dict(C.SIGMA_FLOORS))
    weights: dict = field(default_factory=lambda: dict(C.FEATURE_WEIGHTS))
    features: tuple = C.ALL_FEATURES

    def floor(self, feature: str) -> float:
        return float(self.floors[C.FLOOR_KEYS.get(feature, feature)])

    def global_weights(self) -> dict:
        """Weights of the active features, normalised to sum 1."""
        total = sum(float(self.weights.get(f, 0.0)) for f in self.features)
        if total <= 0:
            raise ValueError("all feature weights are 0")
        return {f: float(self.weights.get(f, 0.0)) / total for f in self.features}

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    def variant(self, name: str, *, color: float = 1.0, floor: float = 1.0,
                tol: float | None = None, temperature: float | None = None,
                features: tuple | None = None) -> "Params":
        """Scaled copy: colour weights, noise floors, tolerance, temperature, subset."""
        weights = {f: w * (color if f in C.COLOR_FEATURES else 1.0)
                   for f, w in self.weights.items()}
        if sum(weights.values()) <= 0:
            raise ValueError("all feature weights are 0")
        return replace(
            self, name=name, weights=weights,
            floors={k: v * floor for k, v in self.floors.items()},
            tol_mm=self.tol_mm if tol is None else tol,
            temperature=self.temperature if temperature is None else temperature,
            features=self.features if features is None else tuple(features))

    def as_struct(self, feature_order: tuple) -> Column:
        """Literal struct of everything the scoring plan reads for this variant."""
        w = self.global_weights()
        cols = [F.lit(self.name).alias("variant"), F.lit(self.mode).alias("mode"),
                F.lit(float(self.alpha)).alias("alpha"),
                F.lit(float(self.tol_mm)).alias("tol_mm"),
                F.lit(float(self.temperature) or 1.0).alias("temperature"),
                F.lit(float(self.max_z_accept)).alias("max_z_accept"),
                F.lit(float(self.min_llr_margin)).alias("min_llr_margin")]
        for f in feature_order:
            active = f in self.features
            cols.append(F.lit(w.get(f, 0.0) if active else 0.0).alias(f"w_{f}"))
            cols.append(F.lit(self.floor(f) if active else 1.0).alias(f"fl_{f}"))
            cols.append(F.lit(active).alias(f"on_{f}"))
        return F.struct(*cols)
