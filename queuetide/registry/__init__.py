"""Queries over the given tables with their SQL twins."""

from importlib import import_module

for _area in ("reading", "scalars", "joins", "aggregates", "windows", "modelling", "publishing", "streams"):
    import_module(f".{_area}", __name__)

from .catalog import QUERIES, SQL  # noqa: E402

__all__ = ["QUERIES", "SQL"]
