"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from quirewise import plans
from quirewise.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    importlib.import_module(f"{plans.__name__}.{_module}")
