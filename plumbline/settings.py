"""The tunables that change a number, with their ranges. Everything else is left to the Spark session."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from datetime import datetime

# Setting -> (lowest, highest, whole number). Defaults are on the class below.
RANGES = {
    "sample_rows": (1, math.inf, True),
    "sample_rows_shown": (0, math.inf, True),
    "sample_oversample": (1, math.inf, False),
    "sample_seed": (-math.inf, math.inf, True),
    "pilot_files": (1, math.inf, True),
    "categorical_max_distinct": (0, math.inf, True),
    "categorical_max_value_length": (0, math.inf, True),
    "categorical_min_rows_per_value": (1, math.inf, False),
    "join_confirmed": (0, 1, False),
    "join_broken": (0, 1, False),
    "dense_key_share": (0, 1, False),
    "weak_evidence_max_candidates": (0, math.inf, True),
    "stale_after_days": (0, math.inf, False),
    "duplicate_overlap": (0, 1, False),
    "check_hit_rate_tolerance": (0, 1, False),
}

# The settings a measurement or its verdict depends on: kept in a snapshot and used again when it is re-measured.
MEASURED_WITH = [name for name in RANGES if name not in ("sample_rows_shown", "check_hit_rate_tolerance")]


@dataclass(frozen=True)
class Settings:
    """Whole tables are measured unless ``sampled`` is set; then tables above ``sample_rows`` are read through a sample."""

    sampled: bool = False
    sample_rows: int = 50_000
    sample_rows_shown: int = 15
    sample_oversample: float = 3
    sample_seed: int = 1
    pilot_files: int = 100
    categorical_max_distinct: int = 50
    categorical_max_value_length: int = 30
    categorical_min_rows_per_value: float = 2
    join_confirmed: float = 0.95
    join_broken: float = 0.5
    dense_key_share: float = 0.9
    weak_evidence_max_candidates: int | None = None
    stale_after_days: float = 90
    duplicate_overlap: float = 0.7
    check_hit_rate_tolerance: float = 0.01
    as_of: datetime | None = None

    def __post_init__(self) -> None:
        for name, (low, high, whole) in RANGES.items():
            value = getattr(self, name)
            if value is None and name == "weak_evidence_max_candidates":  # no limit
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                raise ValueError(f"{name}: not a number")
            if value < low:
                raise ValueError(f"{name}: {value} is below the minimum {low}")
            if value > high:
                raise ValueError(f"{name}: {value} is above the maximum {high}")
            if whole and value != int(value):
                raise ValueError(f"{name}: {value} must be a whole number")
        if self.join_broken > self.join_confirmed:
            raise ValueError(f"join_broken ({self.join_broken}) must not exceed join_confirmed ({self.join_confirmed})")
        if self.sample_rows_shown > self.sample_rows:
            raise ValueError(
                f"sample_rows_shown ({self.sample_rows_shown}) must not exceed sample_rows ({self.sample_rows})"
            )

    def measured_with(self) -> list[tuple[str, float]]:
        """The (name, value) rows a snapshot keeps. ``sampled`` is 0 or 1."""
        values = asdict(self)
        return [("sampled", float(self.sampled))] + [(name, float(values[name])) for name in MEASURED_WITH if values[name] is not None]

    def with_measured(self, rows: dict[str, float]) -> Settings:
        """This run's settings with a snapshot's in place of those a measurement depends on."""
        values = asdict(self)
        for name, value in rows.items():
            if name == "sampled":
                values[name] = bool(value)
            elif name in MEASURED_WITH:
                values[name] = int(value) if RANGES[name][2] and value == int(value) else value
        values["sample_rows_shown"] = min(values["sample_rows_shown"], int(values["sample_rows"]))
        return Settings(**values)
