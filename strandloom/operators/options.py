"""Options of the commands, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CountOptions:
    k: int = 31
    min_count: int = 1

    def __post_init__(self):
        if not 1 <= self.k < 64:
            raise ValueError("k must be between 1 and 63")


@dataclass(frozen=True)
class QualityOptions:
    min_len: int = 0
    min_frac: float = 0.5
    fpr: float = 4e-5


@dataclass(frozen=True)
class TrioOptions:
    min_count: int = 2
    mid_count: int = 5
    ratio: float = 0.33
    min_streak: int = 2


@dataclass(frozen=True)
class RegionOptions:
    min_count: int = 3
    min_streak: int = 5


@dataclass(frozen=True)
class PartitionOptions:
    min_sex: float = 0.7
    min_specific: float = 0.3
    min_ratio: float = 0.9
