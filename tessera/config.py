"""Thresholds of the listing operators, in one frozen place; every operator takes its own instance."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """Validation. Money in the listing's currency, areas in square metres."""

    price_least: float = 20_000
    area_least: float = 15
    area_most: float = 500
    price_m2_least: float = 1_000
    price_m2_most: float = 40_000
    price_slack: float = 0.10
    description_head: int = 300


@dataclass(frozen=True)
class Pairing:
    """Cross-source deduplication."""

    price_gap: float = 0.05
    area_gap: float = 0.08
    district_sim: float = 0.80
    score: float = 0.85
    price_bin: int = 10_000
    area_bin: int = 5
    district_prefix: int = 12
    photos: int = 10


@dataclass(frozen=True)
class Grouping:
    """Entity resolution. Distances in metres. component: pairs of one component that one task joins; more are joined in rounds over all tasks."""

    same_street_m: float = 30
    no_street_m: float = 15
    name_m: float = 300
    split_m: float = 150
    apart_m: float = 400
    name_sim: float = 0.90
    price_ratio: float = 1.4
    unit_gap: float = 0.02
    cell: int = 1000
    component: int = 500_000


@dataclass(frozen=True)
class Refining:
    """Outlier cut, imputation and double confirmation."""

    low: float = 0.50
    high: float = 1.80
    group_least: int = 3
    rows_least: int = 10
    train_least: int = 8
    trees: int = 100
    impute_trees: int = 50
    contamination: float = 0.05
    residual_sd: float = 3.5
    penalty: float = 0.05
    penalty_most: float = 0.20
    seed: int = 42


@dataclass(frozen=True)
class History:
    active_days: int = 14
    firm: int = 3
    cache_minutes: int = 60
    change_percent: float = 0.5
    attempts: int = 200
    top_districts: int = 6
