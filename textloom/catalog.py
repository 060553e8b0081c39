"""All registered queries of the library proper, with their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil

from textloom import plans
from textloom.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    importlib.import_module(f"textloom.plans.{_m}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
