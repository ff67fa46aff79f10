"""benchlens: benchmark-result analytics as Spark DataFrame functions.

Every public function takes and returns DataFrames (or builds one from files);
nothing pulls a table through the driver. See README.md for the operator map.
"""

import sys

from pyspark import cloudpickle

from benchlens.session import checkpoint_dir, get_session

# The few Python functions that run on executors (pandas UDFs) are shipped by
# value, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
