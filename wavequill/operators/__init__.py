"""Operators: DataFrame in, DataFrame out. Rows are traces (gather, ch, r, x), or their samples (gather, ch, i, x)."""
