"""Operators for preparing training data: text, token, web archive and vector work."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
