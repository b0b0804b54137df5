"""All queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("panel", "timeline", "records", "models", "streams", "inputs", "scoring", "populations", "macro", "resampling", "prices", "catalogs", "replays", "materialised", "compositions")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tidemark.plans.{_name}")
    for _key, (_query, _sql) in _module.REGISTERED.items():
        if _key in QUERIES:
            raise ValueError(f"query {_key!r} is registered twice")
        QUERIES[_key] = _query
        if _sql is not None:
            ORACLE[_key] = _sql
