"""Operators for corpora that language models are trained on."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
