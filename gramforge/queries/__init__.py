"""Query modules; each has QUERIES (name to callable) and ORACLE (name to SQL)."""

import importlib
import pkgutil
from types import ModuleType


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]
