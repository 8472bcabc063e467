"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry
from .. import plans as _plans

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{_plans.__name__}.{_m}")

QUERIES = registry.QUERIES
CHECKS = registry.CHECKS
