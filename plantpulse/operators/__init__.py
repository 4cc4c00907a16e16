"""Operators: DataFrame (+ options) -> DataFrame, the same for batch and stream."""
