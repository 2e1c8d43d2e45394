"""tidemark: time-aligned, evidence-aware analytics on PySpark.

Every operator is a function from DataFrame to DataFrame; nothing runs until a sink or the caller asks for rows, except where a
docstring names an eager checkpoint or a bounded fit.
"""

import sys

try:  # executors need no copy of the package: its functions travel inside the tasks
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001  (an older pickler: the package must then be importable on the executors)
    pass

__version__ = "0.1.0"
