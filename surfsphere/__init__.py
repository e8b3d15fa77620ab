"""Surface-docking analytics on Spark: scans, joins, clustering and grids as DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors with their code, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
