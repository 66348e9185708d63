"""Root-cause analytics over operational telemetry, as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors do not need the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
