"""The registered queries over the driver tables and their SQL counterparts, by area."""

from importlib import import_module

AREAS = ["describe", "infer", "clean", "features", "models", "charts", "workflow"]


def collect(kind: str) -> dict:
    found = {}
    for area in AREAS:
        found.update(getattr(import_module(f"workload.{area}"), kind))
    return found
