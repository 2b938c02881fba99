"""Operators for training-data pipelines: scoring, filtering, dedup, mixing and packing of documents.

Nothing else in the package imports this folder. Every operator takes and returns DataFrames, reads
its whole input, and keeps intermediate tables in the shared folder of the session.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the job, so that no executor needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
