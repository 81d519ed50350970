"""wardline: service-queue analytics on Spark (see README.md)."""

import sys as _sys

__version__ = "0.1.0"

# Functions shipped to Python workers (pandas scans, grouped maps, the
# streaming state function) are pickled by value, so executors do not need
# this package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
