"""Scriptoria: lazy DataFrame operators over corpora of text, value sets and vectors."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
