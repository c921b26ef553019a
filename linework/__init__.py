"""linework: document-recognition analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry their own code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
