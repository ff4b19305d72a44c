"""Profile options (P1-P8, A7, R1-R4 thresholds) as a typed, frozen record."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class ProfileOptions:
    # Option defaults as the option texts give them; whole tables are profiled unless asked otherwise.
    round: bool = True
    max_in_count: int = 10
    distinct_ratio: float = 0.05
    max_null_ratio: float = 0.01
    remove_outliers: bool = True
    outlier_columns: tuple = ()
    num_sigmas: float = 3.0
    trim_strings: bool = True
    max_empty_ratio: float = 0.01
    sample_fraction: float = 1.0
    sample_seed: int | None = None
    limit: int | None = None
    profile_types: tuple | None = None
    min_length: int | None = None
    max_length: int | None = None
    include_histograms: bool = False
    min_value: float | None = None
    max_value: float | None = None
    # our additions: key columns for a repeatable, partition-independent sample and limit
    sample_key: tuple = ()
    histogram_bins: int = 10
    exact_distinct: bool = False  # exact distinct counts for every column (costly on wide tables)

    @classmethod
    def from_dict(cls, options: dict[str, Any] | None) -> "ProfileOptions":
        known = {f.name for f in fields(cls)}
        clean = {}
        for k, v in (options or {}).items():
            if k not in known:
                continue  # unknown keys are passed through by callers, ignored here
            if isinstance(v, list):
                v = tuple(v)
            clean[k] = v
        return cls(**clean)

    def with_(self, **kw) -> "ProfileOptions":
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in kw.items()})

    def to_dict(self) -> dict[str, Any]:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}


# The sample and limit of the option texts, for a quick look at a part of a table.
QUICK_LOOK = ProfileOptions(sample_fraction=0.3, limit=1000)

# The second preset, the defaults of the configuration form.
FORM_PRESET = ProfileOptions(max_in_count=20, distinct_ratio=0.01, max_null_ratio=0.05,
                             remove_outliers=False, max_empty_ratio=0.02, sample_fraction=0.3, limit=1000)

__all__ = ["ProfileOptions", "FORM_PRESET", "QUICK_LOOK"]
