"""fieldmerge: exact reconciliation of point observations in overlapping fields of view, on Spark."""
