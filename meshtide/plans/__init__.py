"""Whole pipelines: initial conditions, evolution, and the registered queries."""
