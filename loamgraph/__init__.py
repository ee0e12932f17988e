"""loamgraph: documents to knowledge-graph analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with the job, so executors need no installed copy of this package.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
