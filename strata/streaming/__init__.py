"""Folds over unbounded input."""

from strata.streaming.fold import announced_fold, windowed_counts
from strata.streaming.tracker import CellTracker

__all__ = ["CellTracker", "announced_fold", "windowed_counts"]
