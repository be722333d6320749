"""Column expressions: lattice codec, stencils, dither, and k-space factors."""
