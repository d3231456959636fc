"""orderlens: order-event analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame. Times are UTC and
held as TIMESTAMP_NTZ, money is integer cents, ids are opaque keys.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job: executors need no
# copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
