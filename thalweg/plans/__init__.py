"""Registered queries: one module per family, each with QUERIES = {name: (function, SQL or None)}."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("raster", "regions", "series", "sets", "delta", "links", "directions", "skeletons")


def registered() -> dict:
    out = {}
    for family in FAMILIES:
        out |= import_module(f"thalweg.plans.{family}").QUERIES
    return out
