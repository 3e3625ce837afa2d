"""Short names for layers: temporary views over tables that are loaded under their source's name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def create_views(tables: dict[str, DataFrame], names: dict[str, str]) -> list[str]:
    """Makes a view of each name (view: table) whose table is there, in the place of an older one; the views made."""
    made = [view for view, table in names.items() if table in tables]
    for view in made:
        tables[names[view]].createOrReplaceTempView(view)
    return made
