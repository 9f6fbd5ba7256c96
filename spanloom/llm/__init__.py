"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so the workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
