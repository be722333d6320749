"""Particle sources, the coded store, exports and spectrum tables."""
