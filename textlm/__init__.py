"""textlm: language-model analytics over text collections as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package that run inside tasks (mapInPandas bodies, UDFs)
# are shipped by value, so executors need no installed copy of the package.
try:  # pragma: no cover - depends on the bundled cloudpickle
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
