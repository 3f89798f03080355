"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  Code that runs in Python workers is
pickled by value, so executors do not need the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
