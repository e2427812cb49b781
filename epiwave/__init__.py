"""Outbreak-surveillance analytics on PySpark DataFrames."""

from pyspark import cloudpickle

import sys

# The few Python tasks travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
