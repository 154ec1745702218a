"""tracewell: DataFrame operators for dense multichannel recordings and sparse event tables.

Dense signals travel as *chunk rows* (one row holds a few seconds of all channels)
and are processed by narrow Arrow kernels; everything sparse (spikes, peaks, edges,
codes, windows, curves) is plain DataFrame joins, aggregates and windows.
"""

import sys

from pyspark import cloudpickle

# Executors receive the small kernels by value, so a job does not depend on the
# package being installed on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
