"""Operators over frames, gaps, segments, folds, metrics and costs."""
