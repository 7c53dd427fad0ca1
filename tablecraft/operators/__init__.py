"""Transforms, aggregates, checks and diffs: DataFrame in, DataFrame out."""
