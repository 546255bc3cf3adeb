"""Numerical kernels and column expressions over traces."""
