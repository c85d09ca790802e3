"""larkspur: document, web, file-catalog and telemetry analytics on Spark DataFrames.

Everything is a ``DataFrame -> DataFrame`` transform or a Column builder. Functions that run in
Python workers are pickled by value, so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
