"""DataFrame operators and jobs for building and searching a text corpus."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
