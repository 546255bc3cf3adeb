"""Streams of recordings and correlations."""
