"""terroir: soil, crop and field-telemetry analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or a small family of
them) built from Spark SQL expressions, joins, windows and aggregations, so the
work is planned by Catalyst and distributed by Spark.  Sub-packages:

* ``sources``   - readers for the input tables and derived (proxy) views, file
                  sources and sinks.
* ``functions`` - column-expression builders (features, rules, geometry, text).
* ``operators`` - table-level operators (profiling, validation, cleaning,
                  splitting, evaluation, rules, spatial, weather, windows, ML).
* ``plans``     - compositions (preprocessing pipeline, batch inference) and the
                  query catalog used by ``__spark_entry__``.
* ``streaming`` - Structured Streaming versions of the stateful operators.
"""

__version__ = "0.1.0"

# Functions that run in Python workers travel by value, so executors need no copy of the package.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
