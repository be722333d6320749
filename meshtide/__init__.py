"""meshtide: particle-mesh analytics for periodic boxes, expressed as Spark jobs.

Particles, meshes and spectra are DataFrames.  Lattice codecs, mass deposit, stencil
gathers, spectral solves, drift/kick evolution, binned statistics and halo finding are
DataFrame transformations; NumPy runs only inside tasks, on groups of bounded size.
"""

import sys

from pyspark import cloudpickle

# Ship the package's task functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
