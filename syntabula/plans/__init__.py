"""Queries on the driver tables, grouped by area."""

from importlib import import_module

from .registry import ORACLES, QUERIES

AREAS = ("genome", "homology", "loci", "synteny", "ks", "evidence", "files")


def load():
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return QUERIES, ORACLES
