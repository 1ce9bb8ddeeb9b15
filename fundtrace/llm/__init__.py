"""Operators for preparing language-model training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
