"""Media timeline and playout analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Step functions travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
