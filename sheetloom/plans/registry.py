"""What the driver contract asks of the drawing queries."""

from __future__ import annotations

from sheetloom.plans.catalog import QUERIES, SQL


def flagship(spark, sf_dir):
    """Measured rooms found by casting rays from room labels, or wall totals per sheet until that plan is there."""
    return QUERIES.get("detected_rooms", QUERIES.get("walls_per_sheet", QUERIES["room_rows"]))(spark, sf_dir)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
