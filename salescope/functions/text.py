"""Normal forms of the free-text brand and category names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def brand_key(name: Column) -> Column:
    return F.upper(F.trim(name))


def category_prefix(category: Column) -> Column:
    """First four characters of the category once hyphens are gone."""
    return F.substring(F.replace(F.upper(category), F.lit("-"), F.lit("")), 1, 4)
