"""Writing rooms as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_rows(rooms: DataFrame) -> DataFrame:
    """The twelve columns of the CSV report, measures rounded to 2, warnings joined."""
    r = lambda c: F.round(c, 2)
    return rooms.select(
        "room_id", "room_name", F.col("doc_id").alias("document"), F.col("page_no").alias("sheet_number"), r("floor_area").alias("floor_area_sqft"), r("perimeter").alias("perimeter_ft"),
        r("wall_area").alias("wall_area_sqft"), r("ceiling_area").alias("ceiling_area_sqft"), r("height").alias("ceiling_height_ft"), F.col("vertex_count"), F.size("warnings").alias("warning_count"), F.array_join("warnings", "; ").alias("warnings"),
    )


#: The CSV report's columns, as it is read again.
CSV = "room_id string, room_name string, document long, sheet_number long, floor_area_sqft double, perimeter_ft double, wall_area_sqft double, ceiling_area_sqft double, ceiling_height_ft double, vertex_count int, warning_count int, warnings string"


def write_csv(rooms: DataFrame, path: str) -> None:
    csv_rows(rooms).write.option("header", True).csv(path)


def json_documents(rooms: DataFrame, version: str = "1.0") -> DataFrame:
    """doc_id, total_rooms, total_area and one JSON text per document, rooms in id order."""
    room = F.struct("room_id", "room_name", F.round("floor_area", 2).alias("floor_area_sqft"), F.round("perimeter", 2).alias("perimeter_ft"), F.struct(F.lit("polygon").alias("type"), F.col("vertex_count")).alias("geometry"), "warnings")
    by_doc = rooms.groupBy("doc_id").agg(F.array_sort(F.collect_list(room)).alias("rooms"), F.count("*").alias("total_rooms"), F.round(F.sum("floor_area"), 2).alias("total_area"))
    warned = F.flatten(F.transform("rooms", lambda x: x["warnings"]))
    head = F.struct(F.col("doc_id").alias("input_file"), F.lit(version).alias("pipeline_version"), "total_rooms", F.col("total_area").alias("total_floor_area_sqft"), warned.alias("warnings"))
    return by_doc.select("doc_id", "total_rooms", "total_area", F.size(warned).alias("warning_count"), F.to_json(F.struct(head.alias("metadata"), "rooms")).alias("document"))


def write_json(rooms: DataFrame, path: str) -> None:
    json_documents(rooms).select("document").write.text(path)
