"""driftgauge: reliability-score and shift-evaluation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel inside the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
