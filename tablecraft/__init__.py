"""Table processing on Spark: transforms, checks, diffs, lineage and run logs."""
