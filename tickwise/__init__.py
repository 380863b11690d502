"""tickwise: Spark-native market and news analytics.

Every operator is a function ``DataFrame -> DataFrame`` (or a column
expression builder) that runs on executors.  Sub-packages:

* ``sources``   readers / writers with explicit schemas and the test views
* ``functions`` column-expression builders (text, dates, urls, html)
* ``operators`` DataFrame operators grouped by stage of the workflow
* ``plans``     the registered queries and their SQL oracles
* ``streaming`` incremental (file-source / foreachBatch) forms of the sinks
"""

__version__ = "0.1.0"

# Functions that run in Python workers (the LCS pandas UDF, scorer plug-ins) are
# shipped with the task by value, so executors need no installed copy of this
# package (the driver may import it from a checkout that workers cannot see).
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
