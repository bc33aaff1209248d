"""A PySpark-native engine that compares tables by key and explains how they differ.

Names are loaded when they are first used, so that Python workers, which import
this package too, load no more than they need.
"""

from importlib import import_module

_HOMES = {
    "functions.equality": ("BaseComparator", "ListComparator", "NumericComparator", "StringComparator"),
    "plans.compare": ("compare",),
    "results": ("ComparisonResult",),
    "settings": ("CompareSettings", "ReportSettings", "SourceOptions"),
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME_OF)


def __getattr__(name: str):
    if name not in _HOME_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME_OF[name]}", __name__), name)
