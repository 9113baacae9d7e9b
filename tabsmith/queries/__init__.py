"""Queries over the test tables, each next to the SQL that must give the same rows.

A module registers its queries in a ``Catalog``; ``catalog()`` joins them all.
"""

from __future__ import annotations

from tabsmith.queries.base import Catalog


def catalog() -> Catalog:
    from tabsmith.queries import cleaning, encoding, evaluation, modelling, profiling, quality, splitting

    every = Catalog()
    for module in (profiling, quality, cleaning, encoding, splitting, evaluation, modelling):
        every.include(module.CATALOG)
    return every
