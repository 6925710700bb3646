"""quire: corpus analytics on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function whose work runs
in Spark (SQL expressions, joins, windows, aggregates, Spark ML, Structured
Streaming).  Python inside tasks appears only where the semantics need it
(blocked vector products of the search, pluggable text encoders, the
training-data operators).
"""

import sys as _sys

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run in Python workers are pickled by value,
    so executors need no installed copy of the package (nor the driver's working
    directory on their path)."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 — without PySpark nothing is shipped anyway
        pass


_ship_by_value()


def worker_state() -> dict:
    """Per-process registry for objects built once per Python worker (models,
    automata).  Lives in ``sys.modules`` so it needs no import of this package."""
    import sys
    import types
    mod = sys.modules.get("_quire_worker_state")
    if mod is None:
        mod = sys.modules["_quire_worker_state"] = types.ModuleType("_quire_worker_state")
        mod.cache = {}
    return mod.cache
