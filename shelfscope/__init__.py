"""Product-catalog analytics on Spark: cleaning, labels, features, search, models, reports."""

from shelfscope.config import CatalogConfig

__all__ = ["CatalogConfig"]
