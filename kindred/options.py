"""Options of the engine, as immutable records."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Budget:
    """Limits of candidate retrieval for one query record and target source."""

    per_s1: int = 200
    digit_cap: int = 100
    exact_cap: int = 100
    max_token_df: int = 1000
    token_bucket_cap: int = 5000
    min_token_len: int = 3


@dataclass(frozen=True)
class NormOptions:
    """``delete_hyphen`` deletes hyphens instead of splitting at them; ``keep_all_marks`` keeps every combining mark, else only those of listed ranges."""

    delete_hyphen: bool = False
    keep_all_marks: bool = True


@dataclass(frozen=True)
class SampleOptions:
    """Quotas of training pairs, the validation share and the seed of all hash orders."""

    seed: int = 1729
    val_fraction: float = 0.15
    zero_truth_negatives: int = 3
    per_positive: int = 3
    hard_cap: int = 10
    mined_per_s1: int = 5
    mined_floor: float = 0.3
    mined_total: int = 50_000


BUDGET, NORM, SAMPLE = Budget(), NormOptions(), SampleOptions()
