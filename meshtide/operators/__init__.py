"""Distributed operators over particle, mesh and spectrum DataFrames."""
