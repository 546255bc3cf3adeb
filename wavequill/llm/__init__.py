"""Operators for preparing training text: one module for each operator, queries.py for the registered queries."""
