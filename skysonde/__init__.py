"""Upper-air weather analytics from aircraft reports, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the query, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
