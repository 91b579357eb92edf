"""Queries by area. Importing an area registers its queries."""

from importlib import import_module

AREAS = ("slices", "recommend", "history", "evaluate", "vibes", "serving", "quality", "ingest")


def load_all():
    from earshot.plans.registry import ORACLES, QUERIES

    for area in AREAS:
        import_module(f"earshot.plans.{area}")
    return QUERIES, ORACLES
