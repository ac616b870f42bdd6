"""Spark-first analytics over tables extracted from construction drawings.

Functions that run on executors travel with the job, pickled by value. What is broadcast (tables
of decontamination and of token encoding) is pickled by name, so executors need the package as
well: install it there, or ship it once with spark.sparkContext.addPyFile.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
