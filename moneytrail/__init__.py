"""Payment-ledger and staff-access risk analytics as Spark batch jobs."""

import sys

from pyspark import cloudpickle

# Small helpers that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
