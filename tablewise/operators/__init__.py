"""Comparison operators: DataFrames in, a DataFrame out."""

from .details import column_mismatches, flagged, mismatch_samples, mismatched_keys
from .membership import (
    common_keys,
    duplicate_keys,
    duplicate_surplus,
    membership,
    only_left,
    only_right,
    outside_range,
    row_states,
    rule_states,
    state_counts,
    summary,
)

__all__ = [
    "column_mismatches", "common_keys", "duplicate_keys", "duplicate_surplus", "flagged", "membership", "mismatch_samples",
    "mismatched_keys", "only_left", "only_right", "outside_range", "row_states", "rule_states",
    "state_counts", "summary",
]
