"""Operators for training-data pipelines: deduplication, decontamination, scans, mixing, archives.

Nothing else in the package imports this subpackage; ``__spark_entry__.py``
registers its queries only if it can be imported.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job: executors need numpy, pyarrow and
# pyahocorasick, but not this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
