"""Operators for text corpora: deduplication, filtering, tokens, packing, scoring, archives.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the tasks, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
