"""Settings of a plan's score."""

from __future__ import annotations

from dataclasses import dataclass, replace

from wardflow.functions.numeric import normal_inverse


@dataclass(frozen=True)
class ScoreConfig:
    """Weights, modes and bounds; a weight of 0 leaves the metric out of the total, and out of the plan where nothing else needs it."""

    n_districts: int = 8
    tolerance: float = 0.05
    weight_cut_edges: float = 1.0
    weight_county_excess: float = 0.0
    weight_county_unified: float = 0.0
    weight_congruence: float = 0.0
    congruence_unclipped: bool = True
    weight_polsby_popper: float = 0.0
    weight_reock: float = 0.0
    weight_compactness: float = 0.0
    compactness_unclipped: bool = True
    weight_pop_deviation: float = 0.0
    pop_harbor: float = 0.0
    weight_alignment: float = 0.0
    alignment_focus: str = "none"
    alignment_wins_only: bool = False
    alignment_win_share: float = 0.535
    weight_mean_median: float = 0.0
    mm_mode: str = "fair"
    mm_bound: float = 0.20
    weight_efficiency_gap: float = 0.0
    eg_mode: str = "fair"
    eg_bound: float = 0.35
    eg_robust: bool = True
    quadratic: bool = False
    weight_bias: float = 0.0
    bias_mode: str = "fair"
    bias_bound: float = 0.25
    weight_gini: float = 0.0
    weight_seats: float = 0.0
    seats_favor_dem: bool = True
    weight_proportionality: float = 0.0
    proportionality_unclipped: bool = True
    weight_competitiveness: float = 0.0
    competitiveness_unclipped: bool = True
    weight_majority_dem: float = 0.0
    weight_majority_rep: float = 0.0
    win_chance_at_55: float = 0.9
    swing: float = 0.03
    #: The robust efficiency gap's swing is fixed, whatever `swing` says.
    eg_swing: float = 0.03
    weight_hinge: float = 0.0
    hinge_seats: int = 1
    hinge_dem: bool = True

    @property
    def sigma_district(self) -> float:
        return 0.05 / normal_inverse(min(max(self.win_chance_at_55, 0.501), 0.9999))

    @property
    def sigma(self) -> float:
        return (self.swing**2 + self.sigma_district**2) ** 0.5

    @property
    def sigma_eg(self) -> float:
        return (self.eg_swing**2 + self.sigma_district**2) ** 0.5

    def needs_votes(self) -> bool:
        return any((self.weight_mean_median, self.weight_efficiency_gap, self.weight_bias, self.weight_gini, self.weight_seats, self.weight_proportionality, self.weight_competitiveness, self.weight_majority_dem, self.weight_majority_rep, self.weight_hinge))


def everything(**other) -> ScoreConfig:
    """A setting in which each metric has a weight."""
    ones = {k: 1.0 for k in ScoreConfig.__dataclass_fields__ if k.startswith("weight_")}
    return replace(ScoreConfig(**ones, hinge_seats=4), **other)


def interactive(**other) -> ScoreConfig:
    """What an interactive run starts with: compactness at 50, and no cut edges."""
    return replace(ScoreConfig(weight_cut_edges=0.0, weight_compactness=50.0), **other)
