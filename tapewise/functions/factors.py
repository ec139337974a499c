"""Named ranking factors as Column builders, and a weighted ranking of them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.operators.ranks import By, row_numbers


class FactorRegistry:
    """``name`` to a builder of its Column; a column of the frame by that name wins."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable[[], Column]] = {}

    def register(self, name: str, builder: Callable[[], Column]) -> None:
        self._builders[name] = builder

    def column(self, name: str, df: DataFrame) -> Column:
        if name in df.columns:
            return F.col(name)
        if name not in self._builders:
            raise KeyError(name)
        return self._builders[name]()


@dataclass(frozen=True)
class RankingConfig:
    """Weights that sum to 1, caps of single factors after they are normalised
    (1 where none is given), and how they are normalised."""

    weights: dict[str, float]
    caps: dict[str, float] = field(default_factory=dict)
    normalization: str = "minmax"
    version: str = ""
    decay_half_life_days: float = 30.0

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1.0) > 1e-6:
            raise ValueError("weights must sum to 1")
        if self.normalization not in ("minmax", "zscore", "none"):
            raise ValueError("normalization is minmax, zscore or none")
        if self.decay_half_life_days < 0:
            raise ValueError("decay_half_life_days is 0 or more")

    @classmethod
    def of(cls, raw: dict | str) -> RankingConfig:
        """From a mapping or its JSON text. ``version`` and ``weights`` must be
        there; a key that isn't known is an error, never skipped."""
        given = json.loads(raw) if isinstance(raw, str) else dict(raw)
        names = {"version": "version", "weights": "weights", "factor_caps": "caps", "normalization": "normalization", "decay_half_life_days": "decay_half_life_days"}
        if unknown := sorted(set(given) - set(names)):
            raise ValueError(f"unknown keys: {', '.join(unknown)}")
        if missing := sorted({"version", "weights"} - set(given)):
            raise ValueError(f"missing keys: {', '.join(missing)}")
        return cls(**{names[n]: v for n, v in given.items()})


def rank(df: DataFrame, key: str, registry: FactorRegistry, config: RankingConfig, digits: int | None = None) -> DataFrame:
    """(key, score, place), the best first, then by key.

    A factor that is the same for all counts as 0.5, whatever the normalisation
    but none. ``digits`` rounds scores before they are ranked. A null factor
    leaves its score null and last. Extremes are one aggregate, joined back as a
    single row; z-scores are in linear relation to their factor, so bringing them
    to 0 to 1 gives what bringing the factor there gives."""
    raw = df.select(key, *(registry.column(n, df).cast("double").alias(n) for n in config.weights))
    s = raw.agg(*(f(n).alias(f"_{t}_{n}") for n in config.weights for t, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))))
    wide = raw.crossJoin(F.broadcast(s))
    score = F.lit(0.0)
    for n, w in config.weights.items():
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        alike = hi - lo <= 1e-9 * F.greatest(F.abs(lo), F.abs(hi))
        if config.normalization == "zscore":
            alike = alike | (F.coalesce(f"_sd_{n}", F.lit(0.0)) < 1e-12)
        unit = F.col(n) if config.normalization == "none" else F.when(F.col(n).isNotNull(), F.when(alike, 0.5).otherwise(F.try_divide(F.col(n) - lo, hi - lo)))
        cap = F.lit(float(config.caps.get(n, 1.0)))
        score = score + F.when(unit > cap, cap).otherwise(unit) * w
    score = score if digits is None else F.round(score, digits)
    return row_numbers(wide.select(key, score.alias("score")), [By("score", True, False), By(key)])
