"""ruleforge: data profiling and data-quality rules on Spark DataFrames."""

from .plans.apply import apply_checks, issue_summary, split_valid_invalid, summarize, validate_rules  # noqa: F401

__version__ = "0.1.0"
