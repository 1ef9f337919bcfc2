"""diffsieve: change-retrieval datasets as Spark DataFrame jobs.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and is built
from Spark SQL expressions, joins, aggregations and windows. Python runs on executors
only inside the few kernels that Spark cannot express (the edit-script search and the
block similarity product), always over data that Spark has partitioned and shuffled.
"""

from diffsieve.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]

# Executor-side kernels (pandas functions) are pickled by value, so executors need no
# installed copy of this package.
import sys as _sys

try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass
