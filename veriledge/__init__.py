"""Evidence-ledger auditing, evaluation and operations analytics as Spark DataFrames."""
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
