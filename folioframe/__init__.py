"""folioframe: DataFrame operators for question answering on document pages.

The package is split by role: ``sources`` (scans and sinks), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame), ``plans``
(whole queries and their SQL), ``streaming`` (incremental variants),
``models`` (pluggable inference) and ``llm`` (training-text operators; nothing
else in the package imports it).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value: executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

#: The packages users work with, loaded when they are first named.
__all__ = ["functions", "models", "operators", "pipeline", "plans", "sources", "streaming"]


def __getattr__(name: str):
    if name in __all__:
        import importlib

        return importlib.import_module(f"{__name__}.{name}")
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
