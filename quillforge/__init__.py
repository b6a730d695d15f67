"""Text correction, typo mining and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers receive our functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
