"""Article ingest, text index and search over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
