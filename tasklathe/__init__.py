"""tasklathe: keyed task-log analytics expressed as Spark DataFrame operators.

Sub-packages
------------
operators   batch operators over a task log (DataFrame in, DataFrame out)
functions   column functions and codecs the operators share
sources     readers and writers of log records
streaming   Structured Streaming counterparts
plans       fluent pipeline builder and the query catalogue
llm         optional operators for training data; nothing else imports it
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel by value: the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
