"""Settings of a run: named profiles, validation, and a hash that keys materialised results."""
from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

#: Days in a unit of a gap token (fixed values).
DAYS = {"day": 1, "week": 7, "month": 30}
#: Quarter-days in a year of 365.25 days; every age is a whole number of quarter-days.
YEAR_Q = 1461


@dataclass(frozen=True)
class Config:
    """Settings of all three stages; the defaults are the full run's, in months over whole histories."""

    # Sequences to points
    demo_end_index: int = 3
    age_index: int = 3
    sex_index: int = 1
    max_length: int = 4096
    att_type: str = "month"
    absolute: bool = False
    longitudinal: bool = True
    first_occurrence: bool = True
    min_history: int = 10
    min_points: int = 2
    # Points to cohorts
    offset_days: float = 365.25
    age_start: int = 20
    age_end: int = 100
    age_step: int = 10
    max_points: int = 600
    strict_controls: bool = False
    # Cohorts to areas under the curve
    prompt_suffix: str = " <NY> <INSTRUCT-DX>"
    batch_size: int = 8
    sample_frac: float = 1.0

    def __post_init__(self):
        if self.att_type not in DAYS:
            raise ValueError(f"unknown gap unit {self.att_type!r}: one of {', '.join(DAYS)}")
        if self.offset_days < 0:
            raise ValueError("offset_days must not be negative")
        if self.age_step <= 0 or self.age_end <= self.age_start:
            raise ValueError("age brackets need a positive step and an end after the start")
        if not 0 < self.sample_frac <= 1:
            raise ValueError("sample_frac must be in (0, 1]")

    @property
    def gap_days(self) -> int:
        return DAYS[self.att_type]

    @property
    def brackets(self) -> list[int]:
        return list(range(self.age_start, self.age_end, self.age_step))

    @property
    def bracket_width(self) -> int:
        """A single bracket is five years wide, whatever step was asked for."""
        return self.age_step if len(self.brackets) > 1 else 5

    @property
    def lead_q(self) -> int:
        """History must be at least so many quarter-days before its target: strictly more than the offset."""
        return int(self.offset_days * 4 // 1) + 1

    @property
    def key(self) -> str:
        """Keys materialised stages: any setting that differs gives another key."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


#: `driver` is the full run, `cli` the defaults of single stages, `days` the full run over day gaps.
PROFILES = {
    "driver": Config(),
    "cli": Config(demo_end_index=9, att_type="day", longitudinal=False, age_start=45, age_end=80, age_step=5),
    "days": Config(att_type="day"),
}


def profile(name: str = "driver", **changes) -> Config:
    return replace(PROFILES[name], **changes)


def sample_size(sample_size: int | None, data_size: int | None) -> int | None:
    """One of two names for the same option, positive if given."""
    if sample_size is not None and data_size is not None:
        raise ValueError("give sample_size or data_size, not both")
    n = sample_size if sample_size is not None else data_size
    if n is not None and n <= 0:
        raise ValueError("the sample size must be positive")
    return n
