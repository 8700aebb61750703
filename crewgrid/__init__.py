"""Workforce, pay and equity analytics as plain Spark DataFrame operators."""

__version__ = "0.1.0"

import sys as _sys

try:  # ship the few Python helpers inside the tasks themselves: executors need no copy of the package
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except ImportError:
    pass
