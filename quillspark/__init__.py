"""quillspark: zero-shot text scoring and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run in Python workers travel inside their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
