"""plumbline: outlier scoring and corpus preparation as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# executors need no copy of the package: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
