"""Training-data operators: search, classifiers, scans, counts, de-duplication, decontamination, mixing."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with the task, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
