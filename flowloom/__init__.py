"""Traffic-metadata analytics on Spark: flows, windows, features, splits, scores.

Every operator takes and returns DataFrames.  ``flowloom.operators`` holds the
batch operators, ``flowloom.streaming`` the Structured Streaming ones,
``flowloom.sources`` / ``flowloom.sinks`` the table boundaries and
``flowloom.plans`` the composed jobs.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
