"""Room measures, their checks, reports and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.geom import area, box, centroid, perimeter, ratio
from sheetloom.sources.views import K

MIN_AREA, MAX_AREA, MIN_HEIGHT, MAX_HEIGHT = 25.0, 100000.0, 7.0, 60.0
FEET_PER_METER = 3.28084
#: How many of each unit make a foot.
PER_FOOT = {"feet": 1.0, "inches": 12.0, "meters": 1 / FEET_PER_METER, "mm": 1000 / FEET_PER_METER}


def measured(polygons: DataFrame, scale: Column, height: Column) -> DataFrame:
    """+ floor_area, perimeter, wall_area, ceiling_area and height, in feet; 0 where the scale is 0."""
    floor, around = (F.coalesce(ratio(m, s), F.lit(0.0)) for m, s in ((area(F.col("vertices")), scale * scale), (perimeter(F.col("vertices")), scale)))
    return polygons.withColumns({"floor_area": floor, "perimeter": around, "height": height.cast("double")}).withColumns({"wall_area": F.col("perimeter") * F.col("height"), "ceiling_area": F.col("floor_area")})


def real_vertices(ring: Column, scale: Column) -> Column:
    """The ring in feet; unchanged where the scale is 0."""
    by = F.when(scale == 0, 1.0).otherwise(scale)
    return F.transform(ring, lambda p: F.struct((p["x"] / by).alias("x"), (p["y"] / by).alias("y")))


def warnings() -> Column:
    """Messages about rooms that are too small, large, low, high, long or walled."""
    floor, height, around, wall = (F.col(c) for c in ("floor_area", "height", "perimeter", "wall_area"))
    say = lambda c, text, *v: F.when(c, F.format_string(text, *v))
    return F.filter(
        F.array(
            say(floor < MIN_AREA, "Floor area %.1f SF is below minimum (25 SF)", floor),
            say(floor > MAX_AREA, "Floor area %.1f SF exceeds maximum (100000 SF)", floor),
            say(height < MIN_HEIGHT, "Ceiling height %.1f' is below minimum (7')", height),
            say(height > MAX_HEIGHT, "Ceiling height %.1f' exceeds maximum (60')", height),
            say((floor > 0) & (around > 16 * F.sqrt(F.greatest(floor, F.lit(0.0)))), "Perimeter %.1f' is unusually high for floor area %.1f SF (irregular shape)", around, floor),
            say((floor > 0) & (wall > 10 * floor), "Wall area %.1f SF is unusually high relative to floor area", wall),
        ),
        lambda w: w.isNotNull(),
    )


def room_rows(measures: DataFrame) -> DataFrame:
    """Rows as they are written: ids, names, measures rounded to 2, ring, warnings."""
    rid = F.format_string("room_%03d_%03d", F.col("page_no"), F.col("poly_idx"))
    name = F.col("name") if "name" in measures.columns else F.format_string("ROOM %d", F.col("poly_idx") + 1)
    cols = [F.round(c, 2).alias(c) for c in ("floor_area", "perimeter", "wall_area", "ceiling_area", "height")]
    return measures.select(*K, "poly_idx", rid.alias("room_id"), name.alias("room_name"), *cols, F.size("vertices").alias("vertex_count"), warnings().alias("warnings"))


def min_area_rooms(rooms: DataFrame, least: float = MIN_AREA) -> DataFrame:
    return rooms.where(F.col("floor_area") >= least)


def run_summary(rooms: DataFrame) -> DataFrame:
    """Per document and over all (doc_id null): pages, rooms, total area, warnings."""
    return rooms.rollup("doc_id").agg(F.countDistinct("page_no").alias("pages"), F.count("*").alias("rooms"), F.round(F.sum("floor_area"), 2).alias("total_area"), F.sum(F.size("warnings")).alias("warning_count"))


def quality_grade(polygons: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, n, grade: POOR, SUSPECT or GOOD by the number and areas of a sheet's polygons."""
    areas = polygons.groupBy(*K).agg(F.array_sort(F.collect_list(area(F.col("vertices")))).alias("areas"))
    full = sheets.join(areas, K, "left").withColumn("areas", F.coalesce("areas", F.array().cast("array<double>")))
    n, middle = F.size("areas"), F.get("areas", F.floor(F.size("areas") / 2).cast("int"))
    alike = F.forall("areas", lambda a: F.abs(a - middle) <= 0.2 * middle)
    grade = F.when(n < 3, "POOR").when(n > 50, "SUSPECT").when(F.array_max("areas") > 0.8 * F.col("page_width") * F.col("page_height"), "POOR").when(alike, "SUSPECT").otherwise("GOOD")
    return full.select(*K, n.alias("n"), grade.alias("grade"))


def centroids(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("centroid", centroid(F.col("vertices")))


def convert(value: Column, unit: Column, scale: Column, to_points: bool = False) -> Column:
    """Points to a real length of the unit, or back; 0 for points at scale 0. Areas: apply it twice."""
    per = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in PER_FOOT.items() for x in p)), unit), F.lit(1.0))
    return value / per * scale if to_points else F.coalesce(ratio(value, scale) * per, F.lit(0.0))


def imperial(feet: Column) -> Column:
    """10'-6": whole feet and inches, to a tenth where they are not near a whole inch."""
    whole = feet.cast("int")
    inches = (feet - whole) * 12
    near = F.rint(inches)
    return F.when(inches < 0.1, F.format_string("%d'-0\"", whole)).when(F.abs(inches - near) < 0.1, F.format_string("%d'-%d\"", whole, near.cast("int"))).otherwise(F.format_string("%d'-%.1f\"", whole, inches))


def area_text(value: Column, unit: Column) -> Column:
    name = F.when(unit == "sqft", "SF").when(unit == "sqm", "m²").otherwise(unit)
    return F.format_string("%.1f %s", value, name)


def boxes(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("box", box(F.col("vertices")))
