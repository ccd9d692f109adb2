"""Interval-meter analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from meterlens.settings import Settings

__all__ = ["Settings"]

# Functions of this package that run inside tasks travel with the job: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
