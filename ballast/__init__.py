"""Spark jobs for the data work behind moving large model weights between machines."""

import sys

from pyspark import cloudpickle

# Python tasks get this package's code inside their own pickles, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
