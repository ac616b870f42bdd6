"""Queries over sheets, paths and rooms, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.functions.lineage import new_folder
from sheetloom.operators import classify, measure
from sheetloom.sources import sinks, tables, views
from sheetloom.sources.views import K, sql

QUERIES: dict = {}
SQL: dict = {}


def query(key: str, text: str | None = None, *names: str):
    """Registers a query, and its oracle over the named views."""

    def add(f):
        QUERIES[key] = f
        if text:
            SQL[key] = sql(text, *names) if names else text
        return f

    return add


# --- scans and paths ----------------------------------------------------------------


@query("scan_tables", "select doc_id, page_no, count(*) as blocks, sum(length(text)) as chars from v_text_blocks where trim(text) <> '' group by all", "v_text_blocks")
def scan_tables(spark, d):
    return tables.with_text(views.text_blocks(spark, d)).groupBy(*K).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query("scan_files", """with s as (select doc_id, count(*) as sheets from v_sheets group by all),
p as (select doc_id, count(distinct (page_no, seg_idx // 4)) as paths from v_segments group by all),
b as (select doc_id, count(*) filter (block_idx <> 7 and trim(text) <> '') as blocks, coalesce(sum(length(text)) filter (block_idx <> 7 and trim(text) <> ''), 0) as chars, count(*) filter (block_idx = 7) as bad from v_text_blocks group by all)
select doc_id, sheets, coalesce(paths, 0) as paths, coalesce(blocks, 0) as blocks, coalesce(cast(chars as bigint), 0) as chars, coalesce(bad, 0) as bad from s left join p using (doc_id) left join b using (doc_id)""", "v_sheets", "v_segments", "v_text_blocks")
def scan_files(spark, d):
    """The drawing tables as files of JSON lines, some cut short, and what a scan of the folder finds."""
    root = new_folder(spark)
    own = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    own(views.sheets(spark, d)).write.json(f"{root}/sheets")
    own(views.paths(spark, d)).write.json(f"{root}/paths")
    blocks = own(views.text_blocks(spark, d))
    line = F.to_json(F.struct(*blocks.columns))
    blocks.select(F.when(F.col("block_idx") == 7, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line)).write.text(f"{root}/text_blocks")
    t = tables.scan(spark, root, "json")
    count = lambda df, name: df.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias(name))
    bad = t["bad_rows"].withColumn("doc_id", F.coalesce("doc_id", F.regexp_extract(tables.BAD, '"doc_id":"([0-9]+)"', 1)))
    chars = t["text_blocks"].groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(F.length("text")).alias("chars"))
    out = count(t["sheets"], "sheets")
    for part in (count(t["paths"], "paths"), count(t["text_blocks"], "blocks"), chars, count(bad, "bad")):
        out = out.join(part, "doc_id", "left")
    return out.na.fill(0)


PATH_SQL = """
with i as (select *, seg_idx // 4 as path_idx, seg_idx % 4 as kind from v_segments),
heads as (select doc_id, page_no, path_idx, min_by(x1, seg_idx) as hx, min_by(y1, seg_idx) as hy from i group by all),
items as (
  select doc_id, page_no, path_idx, -1 as pos, 'm' as op, hx as px, hy as py, null as a, null as b, null as c, null as e from heads where path_idx % 2 = 0
  union all select doc_id, page_no, path_idx, seg_idx, case kind when 0 then 'l' when 1 then 're' when 2 then 'qu' else 'c' end,
    case kind when 0 then x2 when 3 then x2 end, case kind when 0 then y2 when 3 then y2 end, x1, y1, x2, y2 from i),
cur as (select *, last_value(px ignore nulls) over w as cx, last_value(py ignore nulls) over w as cy from items
  window w as (partition by doc_id, page_no, path_idx order by pos rows between unbounded preceding and 1 preceding)),
segs as (
  select doc_id, page_no, path_idx, pos, 0 as part, a as x1, b as y1, c as x2, e as y2 from cur where op = 'l'
  union all select doc_id, page_no, path_idx, pos, 0, cx, cy, px, py from cur where op = 'c' and cx is not null
  union all select doc_id, page_no, path_idx, pos, n, case n when 0 then a when 1 then c when 2 then c else a end, case n when 0 then b when 1 then b when 2 then e else e end,
    case n when 0 then c when 1 then c when 2 then a else a end, case n when 0 then b when 1 then e when 2 then e else b end from cur, range(4) t(n) where op in ('re', 'qu'))
select doc_id, page_no, cast(row_number() over (partition by doc_id, page_no order by path_idx, pos, part) - 1 as bigint) as seg_idx, path_idx, x1, y1, x2, y2 from segs
"""


@query("path_segments", PATH_SQL, "v_segments")
def path_segments(spark, d):
    return tables.path_segments(views.paths(spark, d)).select(*K, "seg_idx", "path_idx", "x1", "y1", "x2", "y2")


SPECS = "case doc_id % 4 when 0 then 'all' when 1 then '2-4' when 2 then '1,3, 5' else '1-2,9-40,x' end"


@query("page_range", f"""
with p as (select doc_id, page_no, row_number() over (partition by doc_id order by page_no) - 1 as nth from v_sheets)
select doc_id, page_no, cast(nth as int) as nth from p where case doc_id % 4 when 0 then true when 1 then nth between 1 and 3 when 2 then nth in (0, 2, 4) else nth in (0, 1) or nth between 8 and 39 end
""", "v_sheets")
def page_range(spark, d):
    sheets = views.sheets(spark, d)
    specs = sheets.select("doc_id").distinct().withColumn("spec", F.expr(SPECS))
    return classify.page_range(specs, sheets)


# --- classification -----------------------------------------------------------------


def classified(spark, d):
    sheets = views.sheets(spark, d)
    return sheets.withColumn("path", classify.processing_path()).join(classify.page_type(views.text_blocks(spark, d), sheets), K)


PATH_CASE = "case when drawing_count >= 50 then case when image_count <= 3 and image_coverage_percent < 30 then 'VECTOR' else 'HYBRID' end when image_count > 0 then 'RASTER' else 'SKIP' end"
#: The keywords that a text holds first, tried in order.
WORDS = [(k, w) for k, ws in classify.PAGE_TYPES.items() for w in ws]
RULES = ", ".join(f"({i}, '{k}', '{w}')" for i, (k, w) in enumerate(WORDS))
CLASSIFIED = f"""
rules (place, page_type, keyword) as (values {RULES}),
words as (select b.doc_id, b.page_no, lower(string_agg(text, ' ' order by block_idx)) as whole, coalesce(lower(string_agg(text, ' ' order by block_idx) filter (y0 >= page_height * 0.85 or x0 >= page_width * 0.85)), '') as title
  from v_blocks b join v_sheets s using (doc_id, page_no) group by all),
best as (select doc_id, page_no, min_by(page_type, place) as page_type, min_by(keyword, place) as keyword from (
    select doc_id, page_no, place, page_type, keyword from words join rules on contains(title, keyword)
    union all select doc_id, page_no, place + 1000, page_type, keyword from words join rules on contains(whole, keyword)) group by all),
classified as (select s.*, {PATH_CASE} as path, coalesce(page_type, 'OTHER') as page_type, keyword from v_sheets s left join best using (doc_id, page_no))
"""


@query("processing_path", f"select doc_id, page_no, {PATH_CASE} as path from v_sheets", "v_sheets")
def processing_path(spark, d):
    return views.sheets(spark, d).select(*K, classify.processing_path().alias("path"))


@query("page_type", f"with {CLASSIFIED} select doc_id, page_no, page_type, keyword from classified", "v_sheets", "v_text_blocks")
def page_type(spark, d):
    return classify.page_type(views.text_blocks(spark, d), views.sheets(spark, d)).select(*K, "page_type", "keyword")


@query("document_summary", f"""with {CLASSIFIED} select doc_id, count(*) as total_pages, count(*) filter (page_type = 'FLOOR_PLAN') as floor_plan_count,
 count(*) filter (page_type = 'RCP') as rcp_count, count(*) filter (path = 'VECTOR') as vector_count, count(*) filter (path = 'RASTER') as raster_count from classified group by doc_id""", "v_sheets", "v_text_blocks")
def document_summary(spark, d):
    return classify.document_summary(classified(spark, d))


@query("sheets_to_measure", f"with {CLASSIFIED} select doc_id, page_no, path, page_type from classified where not (page_type <> 'FLOOR_PLAN' and path in ('VECTOR', 'SKIP'))", "v_sheets", "v_text_blocks")
def sheets_to_measure(spark, d):
    return classify.sheets_to_measure(classified(spark, d)).select(*K, "path", "page_type")


@query("image_coverage", """
with r as (select doc_id, page_no, poly_idx % 3 as image_id, w * h as a from v_polygons),
c as (select doc_id, page_no, count(distinct image_id) as images, sum(a) as covered from r group by all)
select doc_id, page_no, coalesce(images, 0) as images, round(coalesce(least(100.0, covered * 100 / (page_width * page_height)), 0.0), 4) as coverage from v_sheets left join c using (doc_id, page_no)
""", "v_sheets", "v_polygons")
def image_coverage(spark, d):
    rects = measure.boxes(views.polygons(spark, d)).select(*K, (F.col("poly_idx") % 3).alias("image_id"), "box.*")
    return classify.image_coverage(rects, views.sheets(spark, d)).withColumn("coverage", F.round("coverage", 4))


NAMES = "case page_no % 6 when 0 then concat('A1.', {n}, ' - LEVEL ', {n}, ' PLAN') when 1 then '2nd floor plan' when 2 then 'Ground  Floor' when 3 then 'BASEMENT' when 4 then concat('FLOOR ', {n}) else 'DETAILS' end"


@query("floor_level", f"""select doc_id, page_no, case page_no % 6 when 0 then concat('LEVEL ', cast(page_no % 9 as varchar)) when 1 then '2ND FLOOR' when 2 then 'GROUND  FLOOR' when 3 then 'BASEMENT'
 when 4 then concat('FLOOR ', cast(page_no % 9 as varchar)) else '' end as floor_level from v_sheets""", "v_sheets")
def floor_level(spark, d):
    named = views.sheets(spark, d).withColumn("sheet_name", F.expr(NAMES.format(n="cast(page_no % 9 as string)")))
    return named.select(*K, classify.floor_level(F.col("sheet_name")).alias("floor_level"))


# --- measures -----------------------------------------------------------------------

SCALE, HEIGHT = "case when poly_idx % 11 = 0 then 0.0 else 9.0 end", "case when poly_idx % 7 = 0 then 5.0 when poly_idx % 7 = 1 then 70.0 else 10.0 end"
ROOMS = f"""
base as (select *, case when notch = 1 then w * h * 0.75 else w * h end as a, 2 * (w + h) as p, {SCALE} as s, {HEIGHT} as ht, case when notch = 1 then 6 else 4 end as vertex_count from v_polygons),
m as (select *, case when s = 0 then 0.0 else a / (s * s) end as floor_area, case when s = 0 then 0.0 else p / s end as perimeter from base),
rooms as (select *, perimeter * ht as wall_area, floor_area as ceiling_area, format('room_{{:03d}}_{{:03d}}', page_no, poly_idx) as room_id from m)
"""
WARN = """list_filter([case when floor_area < 25 then format('Floor area {:.1f} SF is below minimum (25 SF)', floor_area) end,
 case when floor_area > 100000 then 'big' end, case when ht < 7 then format('Ceiling height {:.1f}'' is below minimum (7'')', ht) end, case when ht > 60 then format('Ceiling height {:.1f}'' exceeds maximum (60'')', ht) end,
 case when floor_area > 0 and perimeter > 16 * sqrt(floor_area) then 'long' end,
 case when floor_area > 0 and wall_area > 10 * floor_area then format('Wall area {:.1f} SF is unusually high relative to floor area', wall_area) end], lambda w: w is not null)"""


def rooms(spark, d):
    return measure.measured(views.polygons(spark, d), F.expr(SCALE), F.expr(HEIGHT))


@query("measure_rooms", f"with {ROOMS} select doc_id, page_no, poly_idx, round(floor_area, 4) as floor_area, round(perimeter, 4) as perimeter, round(wall_area, 4) as wall_area, round(ceiling_area, 4) as ceiling_area from rooms", "v_polygons")
def measure_rooms(spark, d):
    return rooms(spark, d).select(*K, "poly_idx", *(F.round(c, 4).alias(c) for c in ("floor_area", "perimeter", "wall_area", "ceiling_area")))


@query("real_vertices", f"with {ROOMS} select doc_id, page_no, poly_idx, round(w / case when s = 0 then 1 else s end, 4) as width, round(h / case when s = 0 then 1 else s end, 4) as height, round(x0 / case when s = 0 then 1 else s end, 4) as x0 from rooms", "v_polygons")
def real_vertices(spark, d):
    r = views.polygons(spark, d).withColumn("vertices", measure.real_vertices(F.col("vertices"), F.expr(SCALE)))
    b = measure.boxes(r)
    return b.select(*K, "poly_idx", F.round(F.col("box.x1") - F.col("box.x0"), 4).alias("width"), F.round(F.col("box.y1") - F.col("box.y0"), 4).alias("height"), F.round("box.x0", 4).alias("x0"))


@query("validate_rooms", f"with {ROOMS} select doc_id, page_no, poly_idx, array_to_string({WARN}, '; ') as warnings from rooms", "v_polygons")
def validate_rooms(spark, d):
    return rooms(spark, d).select(*K, "poly_idx", F.array_join(measure.warnings(), "; ").alias("warnings"))


@query("room_rows", f"""with {ROOMS} select doc_id, page_no, poly_idx, room_id, concat('ROOM ', cast(poly_idx + 1 as varchar)) as room_name, round(floor_area, 2) as floor_area, round(perimeter, 2) as perimeter,
 round(wall_area, 2) as wall_area, round(ceiling_area, 2) as ceiling_area, cast(ht as double) as height, vertex_count, len({WARN}) as warning_count from rooms""", "v_polygons")
def room_rows(spark, d):
    return measure.room_rows(rooms(spark, d)).withColumn("warning_count", F.size("warnings").cast("long")).drop("warnings")


@query("min_area_rooms", f"with {ROOMS} select doc_id, page_no, count(*) filter (floor_area >= 25) as kept, count(*) filter (floor_area < 25) as dropped from rooms group by all", "v_polygons")
def min_area_rooms(spark, d):
    all_rooms = rooms(spark, d)
    kept = measure.min_area_rooms(all_rooms).groupBy(*K).agg(F.count("*").alias("kept"))
    return all_rooms.groupBy(*K).agg(F.count("*").alias("n")).join(kept, K, "left").select(*K, F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


@query("run_summary", f"with {ROOMS} select doc_id, count(distinct page_no) as pages, count(*) as rooms, round(sum(round(floor_area, 2)), 2) as total_area, cast(sum(len({WARN})) as bigint) as warning_count from rooms group by rollup (doc_id)", "v_polygons")
def run_summary(spark, d):
    return measure.run_summary(measure.room_rows(rooms(spark, d)))


@query("rooms_csv", f"""with {ROOMS} select room_id, concat('ROOM ', cast(poly_idx + 1 as varchar)) as room_name, doc_id as document, page_no as sheet_number, round(floor_area, 2) as floor_area_sqft, round(perimeter, 2) as perimeter_ft,
 round(wall_area, 2) as wall_area_sqft, round(ceiling_area, 2) as ceiling_area_sqft, cast(ht as double) as ceiling_height_ft, vertex_count, cast(len({WARN}) as int) as warning_count, array_to_string({WARN}, '; ') as warnings from rooms""", "v_polygons")
def rooms_csv(spark, d):
    return sinks.csv_rows(measure.room_rows(rooms(spark, d)))


@query("rooms_json", f"with {ROOMS} select doc_id, count(*) as total_rooms, round(sum(round(floor_area, 2)), 2) as total_area, cast(sum(len({WARN})) as int) as warning_count, true as closed from rooms group by doc_id", "v_polygons")
def rooms_json(spark, d):
    found = sinks.json_documents(measure.room_rows(rooms(spark, d)))
    return found.select("doc_id", "total_rooms", "total_area", "warning_count", (F.get_json_object("document", "$.metadata.total_rooms").cast("long") == F.col("total_rooms")).alias("closed"))


@query("rooms_csv_files", f"""with {ROOMS} select room_id, concat('ROOM ', cast(poly_idx + 1 as varchar)) as room_name, doc_id as document, page_no as sheet_number,
 round(floor_area, 2) as floor_area_sqft, round(perimeter, 2) as perimeter_ft, round(wall_area, 2) as wall_area_sqft, round(ceiling_area, 2) as ceiling_area_sqft, cast(ht as double) as ceiling_height_ft,
 vertex_count, cast(len({WARN}) as int) as warning_count, array_to_string({WARN}, '; ') as warnings from rooms""", "v_polygons")
def rooms_csv_files(spark, d):
    """The CSV report as it is read again from its files."""
    path = new_folder(spark)
    sinks.write_csv(measure.room_rows(rooms(spark, d)), path)
    return spark.read.schema(sinks.CSV).option("header", True).csv(path).na.fill("", ["warnings"])


@query("rooms_json_files", f"""with {ROOMS},
each as (
  select doc_id, room_id, round(floor_area, 2) as area, {WARN} as warned, concat('{{"room_id":"', room_id, '","room_name":"ROOM ', poly_idx + 1, '","floor_area_sqft":', round(floor_area, 2), ',"perimeter_ft":', round(perimeter, 2),
    ',"geometry":{{"type":"polygon","vertex_count":', vertex_count, '}},"warnings":[', array_to_string(list_transform({WARN}, lambda w: '"' || w || '"'), ','), ']}}') as room from rooms),
docs as (
  select doc_id, count(*) as n, round(sum(area), 2) as total, flatten(list(warned order by room_id)) as warned, string_agg(room, ',' order by room_id) as rooms from each group by doc_id)
select concat('{{"metadata":{{"input_file":', doc_id, ',"pipeline_version":"1.0","total_rooms":', n, ',"total_floor_area_sqft":', total, ',"warnings":[',
  array_to_string(list_transform(warned, lambda w: '"' || w || '"'), ','), ']}},"rooms":[', rooms, ']}}') as document from docs""", "v_polygons")
def rooms_json_files(spark, d):
    """The JSON documents as they are read again from their files."""
    path = new_folder(spark)
    sinks.write_json(measure.room_rows(rooms(spark, d)), path)
    return spark.read.text(path).withColumnRenamed("value", "document")


@query("quality_grade", """
with p as (select doc_id, page_no, case when notch = 1 then w * h * 0.75 else w * h end as a from v_polygons where page_no % 3 <> 0 or poly_idx < 2),
g as (select doc_id, page_no, list_sort(list(a)) as areas from p group by all)
select doc_id, page_no, cast(coalesce(len(areas), 0) as int) as n, case when coalesce(len(areas), 0) < 3 then 'POOR' when len(areas) > 50 then 'SUSPECT' when areas[-1] > 0.8 * page_width * page_height then 'POOR'
  when len(list_filter(areas, lambda a: abs(a - areas[len(areas) // 2 + 1]) > 0.2 * areas[len(areas) // 2 + 1])) = 0 then 'SUSPECT' else 'GOOD' end as grade
from v_sheets left join g using (doc_id, page_no)""", "v_sheets", "v_polygons")
def quality_grade(spark, d):
    return measure.quality_grade(views.polygons(spark, d).where("page_no % 3 <> 0 or poly_idx < 2"), views.sheets(spark, d))


@query("centroids", """select doc_id, page_no, poly_idx, round(case when notch = 1 then (x0 + w / 2) * 4 / 3 - (x0 + w * 0.75) / 3 else x0 + w / 2 end, 4) as cx,
 round(case when notch = 1 then (y0 + h / 2) * 4 / 3 - (y0 + h * 0.75) / 3 else y0 + h / 2 end, 4) as cy from v_polygons""", "v_polygons")
def centroids(spark, d):
    return measure.centroids(views.polygons(spark, d)).select(*K, "poly_idx", F.round("centroid.x", 4).alias("cx"), F.round("centroid.y", 4).alias("cy"))


@query("convert_units", """select doc_id, page_no, poly_idx, unit, round(case when s = 0 then 0 else w / s * per end, 5) as size, round(w / per * s, 5) as points, round(case when s = 0 then 0 else w * h / s / s * per * per end, 4) as area
from (select *, case when poly_idx % 11 = 0 then 0.0 else 9.0 end as s from v_polygons), (values ('feet', 1.0), ('inches', 12.0), ('meters', 1 / 3.28084), ('mm', 1000 / 3.28084)) u(unit, per)""", "v_polygons")
def convert_units(spark, d):
    b = measure.boxes(views.polygons(spark, d)).withColumn("unit", F.explode(F.array(*map(F.lit, measure.PER_FOOT)))).withColumn("s", F.expr(SCALE))
    w, h, u, s = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"), F.col("unit"), F.col("s")
    return b.select(*K, "poly_idx", "unit", F.round(measure.convert(w, u, s), 5).alias("size"), F.round(measure.convert(w, u, s, True), 5).alias("points"), F.round(measure.convert(measure.convert(w * h, u, s), u, s), 4).alias("area"))


@query("format_measures", """
with f as (select *, w / 9.0 as ft, trunc(w / 9.0) as whole, (w / 9.0 - trunc(w / 9.0)) * 12 as inches, w * h / 81.0 as a from v_polygons)
select doc_id, page_no, poly_idx, case when inches < 0.1 then format('{}''-0"', cast(whole as int)) when abs(inches - round_even(inches, 0)) < 0.1 then format('{}''-{}"', cast(whole as int), cast(round_even(inches, 0) as int))
 else format('{}''-{:.1f}"', cast(whole as int), inches) end as length_text, format('{:.1f} SF', a) as area_text from f""", "v_polygons")
def format_measures(spark, d):
    b = measure.boxes(views.polygons(spark, d))
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    return b.select(*K, "poly_idx", measure.imperial(w / 9.0).alias("length_text"), measure.area_text(w * h / 81.0, F.lit("sqft")).alias("area_text"))
