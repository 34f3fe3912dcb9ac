"""Operators for preparing training text; nothing outside this folder imports them.

Python workers get the operators' functions with their tasks, so executors need no copy of this folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
