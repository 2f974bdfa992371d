"""streamwin: per-key stream windows and the operators around them, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so that workers need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
