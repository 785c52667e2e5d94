"""Registered queries and the SQL they are compared with."""

from __future__ import annotations


def registry() -> list:
    """The modules that have QUERIES and ORACLES."""
    from fathomline.plans import general, lookups, search, texts, work

    return [search, lookups, texts, work, general]
