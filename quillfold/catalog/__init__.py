"""Registered queries: each operator run over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

import importlib

QUERY_MODULES = ("corpus", "style", "listings", "log")
ORACLE_MODULES = ("corpus", "style", "listings_sql", "log")


def _merged(attr: str, modules: tuple[str, ...]) -> dict:
    out: dict = {}
    for name in modules:
        try:
            module = importlib.import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{name}":
                raise
            continue
        part = getattr(module, attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES", QUERY_MODULES)


def oracle_sql() -> dict:
    return _merged("ORACLES", ORACLE_MODULES)
