"""All registered queries, by name."""

from __future__ import annotations

import importlib
from functools import cache

from ..session import tune
from ..sources.star_schema import StarSchema

_MODULES = (
    "table_queries",
    "feature_queries",
    "rule_queries",
    "graph_queries",
    "quality_queries",
    "model_queries",
    "risk_queries",
)


@cache
def catalog() -> dict:
    found = {}
    for name in _MODULES:
        module = importlib.import_module(f"{__package__}.{name}")
        for key, value in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def callables() -> dict:
    def bind(fn):
        return lambda spark, folder: fn(StarSchema(tune(spark), folder))

    return {name: bind(fn) for name, (fn, _) in catalog().items()}


def check_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in catalog().items() if text}
