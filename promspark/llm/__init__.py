"""Training-data operators: dedup, decontamination, language, PII, tokens, WARC audit.

Nothing else in the package imports this subpackage.  The functions that run
inside tasks are pickled by value, so a cluster needs no copy of the package
on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
