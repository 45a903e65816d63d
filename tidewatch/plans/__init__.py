"""Reusable distributed plan shapes: ordered scans, as-of joins, recurrences, folds, exact quantiles."""
