"""All registered queries over drawing tables, with their oracle SQL."""

from sheetloom.plans import catalog_rooms, catalog_segments, catalog_sheets, catalog_text, catalog_topology

PARTS = (catalog_sheets, catalog_segments, catalog_text, catalog_rooms, catalog_topology)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in PARTS for k, s in p.SQL.items()}
