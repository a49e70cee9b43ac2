"""cellcast: gridded climate, drought and crop analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from cellcast.session import build_session

# Functions shipped to executors travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
__version__ = "0.1.0"
