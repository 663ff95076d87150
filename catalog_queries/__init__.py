"""Registered queries: each library operator over the given tables, with its SQL twin."""


def registry():
    """All queries by name, in the order of their modules."""
    from catalog_queries import base, modelling, searching, shaping, tabulating  # noqa: F401

    return base.REGISTRY
