"""Queries over text: dimensions, scales, heights; and construction phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.functions.geom import vertex_mean
from sheetloom.functions.lineage import written
from sheetloom.operators import heights as H
from sheetloom.operators import measure
from sheetloom.operators import phases as P
from sheetloom.operators import scale as C

from sheetloom.sources import views
from sheetloom.sources.views import K, led, sql

QUERIES: dict = {}
SQL: dict = {}



def query(key: str, text: str | None, *names: str):
    def add(f):
        QUERIES[key] = f
        if text:
            SQL[key] = sql(text, *names)
        return f

    return add


BLK = ("v_sheets", "v_text_blocks")

# --- dimensions and scales ------------------------------------------------------------


def _mentions() -> str:
    parts = []
    for name, pattern, per, metric in C.DIMENSIONS:
        p = pattern.replace("m(?!m)", "m([^m]|$)").replace("'", "''")
        value = f"coalesce(try_cast(a as double), 0) * {per!r}"
        extra = "0"
        if name == "feet_inches":
            extra = f"coalesce(try_cast(regexp_extract_all(text, '{p}', 2)[n] as double), 0) + coalesce(try_cast(split_part(regexp_extract_all(text, '{p}', 3)[n], '/', 1) as double) / nullif(try_cast(split_part(regexp_extract_all(text, '{p}', 3)[n], '/', 2) as double), 0), 0)"
        parts.append(f"select doc_id, page_no, block_idx, '{name}' as rule, cast(n - 1 as int) as nth, {value} + extra as inches, {str(metric).lower()} as is_metric from (select *, regexp_extract_all(text, '{p}', 1)[n] as a, {extra} as extra from (select *, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) as n from v_text_blocks))" + (f" where {value} + extra > 0" if name == "feet_inches" else ""))
    return " union all ".join(parts)


@query("dimension_mentions", f"select doc_id, page_no, block_idx, rule, nth, round(inches, 6) as inches, is_metric from ({_mentions()})", "v_text_blocks")
def dimension_mentions(spark, d):
    return C.dimension_mentions(views.text_blocks(spark, d)).select(*K, "block_idx", "rule", "nth", F.round("inches", 6).alias("inches"), "is_metric")


def scale_sql(t: str, share: float = 6.0) -> str:
    f, r = C.FRACTION.replace("'", "''"), r"(?i)1\s*:\s*(\d{2,})"
    n, d = (f"try_cast(regexp_extract({t}, '{f}', {g}) as double)" for g in (1, 2))
    q = f"try_cast(regexp_extract({t}, '{r}', 1) as double)"
    words = " ".join(f"when regexp_matches({t}, '{p}') then {v}" for p, _, v in C.PHRASES)
    notes = " ".join(f"when regexp_matches({t}, '{p}') then '{v}'" for p, v, _ in C.PHRASES)
    return f"case when {d} > 0 then {n} / {d} * {share} when {q} > 0 then 2835.0 / {q} {words} end as factor, case when {d} > 0 then cast(cast({n} as bigint) as varchar) || '/' || cast(cast({d} as bigint) as varchar) || ' inch = 1 foot' when {q} > 0 then '1:' || cast(cast({q} as bigint) as varchar) {notes} end as notation"


#: Texts with more kinds of scales than the blocks hold.
VARIED = "case block_idx % 5 when 0 then concat(text, ' QUARTER  INCH SCALE') when 1 then concat('3/16\"=1'' ', text) when 2 then concat('1 : ', cast(20 + block_idx as string)) else text end"


@query("scale_mentions", f"with t as (select *, {VARIED.replace('as string', 'as varchar')} as tx from v_text_blocks), f as (select *, {scale_sql('tx')} from t) select doc_id, page_no, block_idx, round(cast(factor as double), 6) as factor, notation from f where factor is not null", "v_text_blocks")
def scale_mentions(spark, d):
    got = views.text_blocks(spark, d).withColumn("s", C.scale_of(F.expr(VARIED))).where("s is not null")
    return got.select(*K, "block_idx", F.round("s.factor", 6).alias("factor"), "s.notation")


SCALES = f"""words as (select b.doc_id, b.page_no, string_agg(text, ' ' order by block_idx) as whole, coalesce(string_agg(text, ' ' order by block_idx) filter (y0 >= page_height * 0.85 or x0 >= page_width * 0.85), '') as title
  from v_blocks b join v_sheets s using (doc_id, page_no) group by all),
st as (select doc_id, page_no, {scale_sql('title')} from words), sw as (select doc_id, page_no, {scale_sql('whole')} from words),
scales as (select s.doc_id, s.page_no, cast(coalesce(st.factor, sw.factor, 96.0) as double) as factor, coalesce(st.notation, sw.notation, '1/8 inch = 1 foot') as notation,
  case when st.factor is not null then 'HIGH' when sw.factor is not null then 'MEDIUM' else 'LOW' end as confidence from v_sheets s left join st using (doc_id, page_no) left join sw using (doc_id, page_no))"""


@query("sheet_scale", f"with {SCALES} select doc_id, page_no, round(factor, 6) as factor, notation, confidence, case when contains(notation, ':') then 'metric' else 'imperial' end as units from scales", *BLK)
def sheet_scale(spark, d):
    return C.sheet_scale(views.text_blocks(spark, d), views.sheets(spark, d)).withColumn("factor", F.round("factor", 6))


@query("manual_scale", """select doc_id, page_no, cast(case page_no % 6 when 0 then 9 when 1 then 0.72 when 2 then 2835 / 75.0 when 3 then 12.5 when 4 then null else 36 end as double) as factor,
 case page_no % 6 when 0 then '1/8 inch = 1 foot' when 1 then '1:100' when 2 then '1:75' when 3 then 'Factor: 12.5' when 4 then null else 'HALF INCH SCALE' end as notation from v_sheets""", "v_sheets")
def manual_scale(spark, d):
    text = F.expr("case page_no % 6 when 0 then ' 1/8 INCH = 1 FOOT ' when 1 then 'at 1:100' when 2 then '1:75' when 3 then '12.5' when 4 then 'none' else 'half inch scale' end")
    got = views.sheets(spark, d).withColumn("s", C.manual_scale(text))
    return got.select(*K, "s.factor", "s.notation")


@query("scale_conflicts", f"with {SCALES} select a.doc_id, a.page_no, b.page_no as other, a.factor <> 0 and b.factor <> 0 and abs(a.factor - b.factor) / greatest(a.factor, b.factor) > 0.15 as conflict from scales a join scales b on a.doc_id = b.doc_id and a.page_no < b.page_no", *BLK)
def scale_conflicts(spark, d):
    s = C.sheet_scale(views.text_blocks(spark, d), views.sheets(spark, d)).select(*K, "factor")
    o = s.select("doc_id", F.col("page_no").alias("other"), F.col("factor").alias("o"))
    return s.join(o, "doc_id").where("page_no < other").select(*K, "other", C.conflict(F.col("factor"), F.col("o")).alias("conflict"))


OVERRIDES = "select distinct doc_id, case when doc_id % 5 = 1 then '1/4 inch = 1 foot' end as manual, case when doc_id % 5 in (1, 2) then '100,100:300,100=10 ft' when doc_id % 5 = 3 then 'bad' end as calibration from v_sheets"


@query("document_scale", f"""with {SCALES}, e as (select *, row_number() over (partition by doc_id order by page_no) as nth from scales), g as (select *, first_value(factor) over (partition by doc_id order by page_no) as lead from e where nth <= 5 and confidence <> 'LOW'),
f as (select doc_id, min_by(factor, page_no) as detected, count(*) filter (abs(factor - lead) / greatest(factor, lead) > 0.15) as conflicts from g group by doc_id)
select doc_id, round(cast(case when doc_id % 5 = 1 then 18 when doc_id % 5 = 2 then 20 else coalesce(detected, 96) end as double), 6) as factor, case when doc_id % 5 = 1 then 'manual' when doc_id % 5 = 2 then 'calibration' when detected is not null then 'scale_text' else 'default' end as source,
 coalesce(conflicts, 0) as conflicts from (select distinct doc_id from v_sheets) left join f using (doc_id)""", *BLK)
def document_scale(spark, d):
    sheets = views.sheets(spark, d)
    over = sheets.selectExpr("doc_id", "case when doc_id % 5 = 1 then '1/4 inch = 1 foot' end as manual", "case when doc_id % 5 in (1, 2) then '100,100:300,100=10 ft' when doc_id % 5 = 3 then 'bad' end as calibration").distinct()
    return C.document_scale(C.sheet_scale(views.text_blocks(spark, d), sheets), over).withColumn("factor", F.round("factor", 6))


@query("calibration_scale", "select doc_id, page_no, round(cast(case page_no % 5 when 0 then 20 when 1 then 100 / (5 * 3.28084) when 2 then null when 3 then 0 else 5 * 12 / 30.0 end as double), 6) as scale from v_sheets", "v_sheets")
def calibration_scale(spark, d):
    text = F.expr("case page_no % 5 when 0 then '100,100:300,100=10 FT' when 1 then '0,0:100,0=5m' when 2 then 'nonsense' when 3 then '0,0:3,4=0ft' else '0,0:3,4=30 inches' end")
    return views.sheets(spark, d).select(*K, F.round(C.calibration(text), 6).alias("scale"))


def tick_fixture(spark, d):
    """Dimensions, and segments of which every third is drawn as a short tick."""
    tick = F.col("seg_idx") % 3 == 0
    s = views.segments(spark, d).withColumns({"x1": F.when(tick, F.col("x1") + 45).otherwise(F.col("x1")), "x2": F.when(tick, F.col("x1") + 45 + (F.col("x2") - F.col("x1")) / 10).otherwise(F.col("x2")), "y2": F.when(tick, F.col("y1") + (F.col("y2") - F.col("y1")) / 10).otherwise(F.col("y2"))})
    return C.placed_dimensions(views.text_blocks(spark, d)), s


TICKS = """short as (select * replace (case when seg_idx % 3 = 0 then x1 + 45 else x1 end as x1, case when seg_idx % 3 = 0 then x1 + 45 + (x2 - x1) / 10 else x2 end as x2, case when seg_idx % 3 = 0 then y1 + (y2 - y1) / 10 else y2 end as y2) from v_segments),
sg as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len, (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 as ang, (x1 + x2) / 2 as mx, (y1 + y2) / 2 as my from short),
men as ({m}), dm as (select b.doc_id, b.page_no, b.block_idx, (x0 + x1) / 2 as px, (y0 + y1) / 2 as py, case when y1 - y0 > x1 - x0 then 90.0 else 0.0 end as turn, inches from v_blocks b join (select doc_id, page_no, block_idx, arg_min(inches, [case rule when 'feet_inches' then '0' else '1' end, rule, cast(nth as varchar)]) as inches from men group by all) using (doc_id, page_no, block_idx)),
ticks as (select dm.doc_id, dm.page_no, dm.block_idx, sg.seg_idx, mx as tx, my as ty from dm join sg using (doc_id, page_no) where len <= 20 and (mx - px) * (mx - px) + (my - py) * (my - py) <= 2500 and abs(least(abs(ang - turn), 180 - abs(ang - turn)) - 90) <= 15)""".format(m=_mentions())


@query("tick_marks", f"with {TICKS} select doc_id, page_no, block_idx, seg_idx from ticks", "v_segments", "v_text_blocks")
def tick_marks(spark, d):
    dims, s = tick_fixture(spark, d)
    return C.tick_marks(dims, s).select(*K, "block_idx", "seg_idx")


@query("dimension_segments", f"""with {TICKS}, en as (select * from (select *, count(*) over (partition by doc_id, page_no, block_idx) as n from ticks) where n >= 2),
ea as (select distinct en.doc_id, en.page_no, en.block_idx, sg.seg_idx from en join sg using (doc_id, page_no) where sqrt((sg.x1 - tx) * (sg.x1 - tx) + (sg.y1 - ty) * (sg.y1 - ty)) < 5),
eb as (select distinct en.doc_id, en.page_no, en.block_idx, sg.seg_idx from en join sg using (doc_id, page_no) where sqrt((sg.x2 - tx) * (sg.x2 - tx) + (sg.y2 - ty) * (sg.y2 - ty)) < 5),
hi as (select doc_id, page_no, block_idx, min(seg_idx) as hs from ea join eb using (doc_id, page_no, block_idx, seg_idx) group by all),
sd as (select dm.doc_id, dm.page_no, dm.block_idx, sg.seg_idx, round(case when len = 0 then 0 else abs((y2 - y1) * px - (x2 - x1) * py + x2 * y1 - y2 * x1) / len end, 6) as far from dm join sg using (doc_id, page_no) where least(abs(ang - turn), 180 - abs(ang - turn)) <= 15 and abs((y2 - y1) * px - (x2 - x1) * py + x2 * y1 - y2 * x1) / len < 50),
nr as (select doc_id, page_no, block_idx, count(*) as n, arg_min(seg_idx, [far, seg_idx]) as ns from sd group by all),
al as (select dm.*, coalesce(hs, ns) as sx, case when hs is not null then 'HIGH' when n = 1 then 'MEDIUM' when n > 1 then 'LOW' else 'NONE' end as confidence from dm left join hi using (doc_id, page_no, block_idx) left join nr using (doc_id, page_no, block_idx))
select al.doc_id, al.page_no, al.block_idx, al.sx as seg_idx, confidence, round(len / nullif(inches / 12, 0), 4) as scale from al left join sg on sg.doc_id = al.doc_id and sg.page_no = al.page_no and sg.seg_idx = al.sx""", "v_segments", "v_text_blocks")
def dimension_segments(spark, d):
    dims, s = tick_fixture(spark, d)
    return C.dimension_segments(dims, C.tick_marks(dims, s), s).withColumn("scale", F.round("scale", 4))


# --- heights --------------------------------------------------------------------------


def height_sql(t: str = "upper(trim(text))") -> str:
    q = lambda p: p.replace("(?!M)", "(?:[^M]|$)").replace("'", "''")
    vals = [f"coalesce(try_cast(regexp_extract({t}, '{q(p)}', 1) as double), 0) + coalesce(try_cast(regexp_extract({t}, '{q(p)}', 2) as double), 0) / 12" for p in H.IMPERIAL]
    vals += [f"coalesce(try_cast(regexp_extract({t}, '{q(p)}', 1) as double), 0) * {u * 3.28084!r}" for p, u in H.METRIC]
    return "coalesce(" + ", ".join(f"case when {v} between 7 and 60 then {v} end" for v in vals) + ")"


HEIGHTS = f"""ht as (select doc_id, page_no, block_idx, {height_sql()} as height, (x0 + x1) / 2 as hx, (y0 + y1) / 2 as hy, nullif(regexp_extract(upper(text), '{H.ROOM_TOKEN}', 1), '') as room from v_blocks),
heights as (select * from ht where height is not null)"""


@query("height_mentions", f"with {HEIGHTS} select doc_id, page_no, block_idx, round(height, 6) as height, hx, hy, room from heights", "v_text_blocks")
def height_mentions(spark, d):
    return H.height_mentions(views.text_blocks(spark, d)).withColumn("height", F.round("height", 6))


@query("room_keys", r"select doc_id, page_no, block_idx, regexp_replace(upper(text), '[\s\-_]+', '', 'g') as name_key, nullif(regexp_extract(text, '(\d{2,4})', 1), '') as number_key from v_text_blocks", "v_text_blocks")
def room_keys(spark, d):
    return views.text_blocks(spark, d).select(*K, "block_idx", H.name_key(F.col("text")).alias("name_key"), H.number_key(F.col("text")).alias("number_key"))


#: Sheets of three sizes: letter, the views' own, and D.
WIDTHS = "cast(case page_no % 3 when 0 then 612 when 1 then 1000 else 2592 end as double)"
ROOMH = f"""{HEIGHTS}, notes as (select * from heights where page_no % 4 = 3),
rm as (select doc_id, page_no, poly_idx, case when poly_idx % 2 = 1 then '' else 'OFFICE ' end || (100 + poly_idx) as name, x0 + w / 2 as cx, y0 + h / 2 as cy, {WIDTHS} as page_width,
  case when notch = 1 then w * h * 0.75 else w * h end / 81 as floor_area, 2 * (w + h) / 9 as perimeter from v_polygons),
bk as (select doc_id, regexp_replace(room, '[\\s_-]+', '', 'g') as k, arg_max(height, [page_no, block_idx]) as h1 from notes where room is not null group by all),
bn as (select doc_id, regexp_extract(room, '(\\d{{2,4}})', 1) as k, arg_max(height, [page_no, block_idx]) as h2 from notes where room is not null group by all),
nn as (select rm.doc_id, rm.page_no, rm.poly_idx, arg_min(height, [round(sqrt((hx - cx) * (hx - cx) + (hy - cy) * (hy - cy)), 6), notes.page_no, block_idx]) as h3 from rm join notes using (doc_id) where sqrt((hx - cx) * (hx - cx) + (hy - cy) * (hy - cy)) < 0.1 * page_width group by rm.doc_id, rm.page_no, rm.poly_idx),
mh as (
  select rm.*, coalesce(h1, h2, h3, 10) as height,
    case when h1 is not null then 'HIGH' when h2 is not null then 'MEDIUM' when h3 is not null then 'LOW' else 'NONE' end as height_confidence,
    case when h1 is not null then 'rcp_name_match' when h2 is not null then 'rcp_number_match' when h3 is not null then 'rcp_location' else 'default' end as height_source
  from rm left join bk on bk.doc_id = rm.doc_id and bk.k = upper(replace(name, ' ', '')) left join bn on bn.doc_id = rm.doc_id and bn.k = cast(100 + poly_idx as varchar) left join nn on nn.doc_id = rm.doc_id and nn.page_no = rm.page_no and nn.poly_idx = rm.poly_idx)"""


def matched_rooms(spark, d):
    """Rooms named by their number alone, as notes name them, and others; a room lies at the mean of its vertices."""
    notes = H.height_mentions(views.text_blocks(spark, d)).where("page_no % 4 = 3")
    r = measure.measured(views.polygons(spark, d), F.lit(9.0), F.lit(10.0)).withColumn("at", vertex_mean(F.col("vertices")))
    name = F.concat(F.when(F.col("poly_idx") % 2 == 1, "").otherwise("OFFICE "), (100 + F.col("poly_idx")).cast("string"))
    rooms = r.select(*K, "poly_idx", name.alias("name"), F.col("at.x").alias("cx"), F.col("at.y").alias("cy"), F.expr(WIDTHS).alias("page_width"), "floor_area", "perimeter")
    return H.match_heights(rooms, notes)


@query("match_heights", f"with {ROOMH} select doc_id, page_no, poly_idx, name, round(height, 4) as height, height_confidence, height_source from mh", "v_text_blocks", "v_polygons")
def match_heights(spark, d):
    return matched_rooms(spark, d).select(*K, "poly_idx", "name", F.round("height", 4).alias("height"), "height_confidence", "height_source")


@query("reprice_heights", f"with {ROOMH} select doc_id, page_no, poly_idx, round(perimeter * height, 3) as wall_area, round(floor_area, 3) as ceiling_area, case when not bool_or(height_source <> 'default') over (partition by doc_id) then 'No ceiling heights found, using the default' end as height_warning from mh", "v_text_blocks", "v_polygons")
def reprice_heights(spark, d):
    return H.reprice(matched_rooms(spark, d)).select(*K, "poly_idx", F.round("wall_area", 3).alias("wall_area"), F.round("ceiling_area", 3).alias("ceiling_area"), "height_warning")


# --- phases ---------------------------------------------------------------------------

PHRASE = "case page_no % 9 when 0 then 'new wall' when 1 then 'NEW' when 2 then 'Exist.' when 3 then 'n.i.c.' when 4 then 'remove' when 5 then 'foobar' when 6 then 'demo ' when 7 then null else 'not_in_contract' end"
PHASED = "case page_no % 9 when 0 then 'NEW' when 1 then 'NEW' when 2 then 'EXISTING' when 3 then 'NOT_IN_CONTRACT' when 4 then 'DEMO' when 6 then 'DEMO' when 8 then 'NOT_IN_CONTRACT' else 'UNKNOWN' end"


@query("normalize_phase", f"select doc_id, page_no, {PHASED} as phase from v_sheets", "v_sheets")
def normalize_phase(spark, d):
    return views.sheets(spark, d).select(*K, P.normalized(F.expr(PHRASE)).alias("phase"))


@query("in_scope", f"select doc_id, page_no, {PHASED} in ('NEW', 'EXISTING') as in_scope, {PHASED} = 'NEW' as new_work from v_sheets", "v_sheets")
def in_scope(spark, d):
    p = P.normalized(F.expr(PHRASE))
    return views.sheets(spark, d).select(*K, P.in_scope(p).alias("in_scope"), P.in_scope(p, True).alias("new_work"))


@query("fill_phase", """select doc_id, page_no, seg_idx, case when fill_gray is null or fill_type = 's' then 'NONE' when fill_gray > 0.95 then 'WHITE' when fill_gray < 0.1 then 'SOLID_BLACK' when fill_gray between 0.25 and 0.75 then 'SOLID_GRAY' else 'UNKNOWN' end as pattern,
 case when fill_gray is null or fill_type = 's' then 'NEW' when fill_gray > 0.95 then 'UNKNOWN' when fill_gray < 0.1 then 'EXISTING' when fill_gray between 0.25 and 0.75 then 'EXISTING' else 'UNKNOWN' end as phase, coalesce(fill_gray between 0.25 and 0.75, false) as is_gray from v_segments""", "v_segments")
def fill_phase(spark, d):
    f = views.segments(spark, d).withColumn("f", P.fill_phase(F.col("fill"), F.col("fill_type"))).withColumn("is_gray", P.is_gray(F.col("fill")))
    return f.select(*K, "seg_idx", "f.pattern", "f.phase", "is_gray")


GRAYS = """hd as (
  select doc_id, page_no, seg_idx // 4 as path_idx, min_by(fill_gray, seg_idx) as g, min(least(x1, x2)) as x0, min(least(y1, y2)) as y0, max(greatest(x1, x2)) as xx, max(greatest(y1, y2)) as yy from v_segments group by all),
fg as (select doc_id, page_no, seg_idx // 4 as path_idx, fill_gray as g0 from v_segments where seg_idx % 4 = 0),
grays as (select doc_id, page_no, path_idx as region_idx, x0, y0, xx as x1, yy as y1, 'gray' as kind, 0.85 as confidence from hd join fg using (doc_id, page_no, path_idx) where g0 between 0.25 and 0.75 and (xx - x0) * (yy - y0) >= 100 and (least(xx - x0, yy - y0) = 0 or (greatest(xx - x0, yy - y0) >= 3 * least(xx - x0, yy - y0) and greatest(xx - x0, yy - y0) >= 20))),
hatched as (select doc_id, page_no, poly_idx + 1000 as region_idx, x0, y0, x0 + w as x1, y0 + h as y1, 'hatched' as kind, 0.75 as confidence from v_polygons where poly_idx % 8 = 3),
regions as (select * from grays union all select * from hatched)"""


def regions(spark, d):
    """Gray regions of the paths, and every eighth polygon's box as a hatched one."""
    b = measure.boxes(views.polygons(spark, d)).where("poly_idx % 8 = 3").select(*K, (F.col("poly_idx") + 1000).alias("region_idx"), "box.x0", "box.y0", "box.x1", "box.y1", F.lit("hatched").alias("kind"), F.lit(0.75).alias("confidence"))
    return P.gray_regions(views.paths(spark, d)).unionByName(b)


@query("gray_regions", f"with {GRAYS} select doc_id, page_no, region_idx, x0, y0, x1, y1 from grays", "v_segments", "v_polygons")
def gray_regions(spark, d):
    return P.gray_regions(views.paths(spark, d)).select(*K, "region_idx", "x0", "y0", "x1", "y1")


@query("hatched_regions", f"""with mv as (
  select doc_id, page_no, seg_idx, floor(x1 / 480) * 480 + seg_idx % 7 * 5 as x0, floor(y1 / 480) * 480 as y0 from v_segments where x1 <> x2 and y1 <> y2 and fill_gray is null),
sl as (select * from (select *, count(*) over (partition by doc_id, page_no) as m from mv) where m >= 5),
{led("sl", "seg_idx", "sqrt((x.x0 - y.x0) * (x.x0 - y.x0) + (x.y0 - y.y0) * (x.y0 - y.y0)) < 50")},
bx as (
  select sl.doc_id, sl.page_no, leader as region_idx, count(*) as m, min(x0) as x0, min(y0) as y0, max(x0 + 40) as x1, max(y0 + 40) as y1
  from sl join led on led.doc_id = sl.doc_id and led.page_no = sl.page_no and led.node = sl.seg_idx group by all)
select doc_id, page_no, region_idx, x0, y0, x1, y1 from bx where m >= 5 and (x1 - x0) * (y1 - y0) >= 100""", "v_segments")
def hatched_regions(spark, d):
    """Slanted lines moved together by place, so that hatches form."""
    s = views.segments(spark, d)
    slant = (F.col("x1") != F.col("x2")) & (F.col("y1") != F.col("y2"))
    shift = F.when(slant, F.col("seg_idx") % 7 * 5.0).otherwise(0.0)
    base = lambda c: F.when(slant, F.floor(F.col(c) / 480) * 480).otherwise(F.col(c))
    moved = s.withColumns({"x1": base("x1") + shift, "x2": base("x1") + shift + F.when(slant, 40.0).otherwise(F.col("x2") - F.col("x1")), "y1": base("y1"), "y2": base("y1") + F.when(slant, 40.0).otherwise(F.col("y2") - F.col("y1"))})
    return P.hatched_regions(written(moved)).select(*K, "region_idx", "x0", "y0", "x1", "y1")


AT = """rk as (select s.doc_id, s.page_no, s.seg_idx, min(kind) as kind from v_segments s join regions r on r.doc_id = s.doc_id and r.page_no = s.page_no and (s.x1 + s.x2) / 2 between r.x0 and r.x1 and (s.y1 + s.y2) / 2 between r.y0 and r.y1 group by all),
pt as (select s.*, case kind when 'gray' then 'EXISTING' when 'hatched' then 'NOT_IN_CONTRACT' else 'NEW' end as rp, case kind when 'gray' then 0.85 else 0.75 end as rc from v_segments s left join rk using (doc_id, page_no, seg_idx))"""
CLASSED = f"""{GRAYS}, {AT}, cl as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len, fill_gray is not null and fill_type <> 's' and (fill_gray < 0.1 or fill_gray between 0.25 and 0.75) as bf from pt),
classed as (select doc_id, page_no, seg_idx, len, case when bf then 'EXISTING' when rp <> 'NEW' then rp else 'NEW' end as phase,
  cast(case when bf then case when fill_gray < 0.1 then 0.70 else 0.85 end when rp <> 'NEW' then rc when fill_gray is null or fill_type = 's' then 0.75 else 0.60 end as double) as confidence,
  case when bf then 'fill_color' when rp <> 'NEW' then 'spatial_region' when fill_gray is null or fill_type = 's' then 'stroke_only' else 'default' end as method from cl)"""
SP = ("v_segments", "v_polygons")


@query("phase_at_point", f"with {GRAYS}, {AT} select doc_id, page_no, seg_idx, rp as phase, cast(rc as double) as confidence from pt", *SP)
def phase_at_point(spark, d):
    pts = views.segments(spark, d).select(*K, "seg_idx", ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    return P.phase_at(pts, regions(spark, d), [*K, "seg_idx"])


LEGEND = """lh as (select b.*, page_width, page_height, case when contains(upper(text), 'CONSTRUCTION PLAN LEGEND') then 0 when contains(upper(text), 'LEGEND') then 4 end as place from v_blocks b join v_sheets using (doc_id, page_no)),
lb as (select *, row_number() over (partition by doc_id, page_no order by place, case when x0 < 0.7 * page_width then 1 else 0 end, block_idx) as nth from lh where place is not null),
lr as (select doc_id, page_no, greatest(0, least(x0 - 150, page_width)) as lx0, greatest(0, least(y0 - 75, page_height)) as ly0, greatest(0, least(x1 + 300, page_width)) as lx1, greatest(0, least(y1 + 900, page_height)) as ly1,
  case place when 0 then 'CONSTRUCTION PLAN LEGEND' else 'LEGEND' end as keyword from lb where nth = 1),
li as (select b.* from v_blocks b join lr using (doc_id, page_no) where (x0 + x1) / 2 between lx0 and lx1 and (y0 + y1) / 2 between ly0 and ly1 and not contains(upper(text), 'LEGEND')),
le as (select doc_id, page_no, phase, min_by(text, block_idx) as label, min(block_idx) as block_idx from (
  select *, 'NEW' as phase from li where regexp_matches(upper(text), 'NEW|PROPOSED') union all select *, 'EXISTING' from li where regexp_matches(upper(text), 'EXIST|WALLS?\\s*TO\\s*REMAIN|REMAIN(ING)?\\s*WALLS?')
  union all select *, 'NOT_IN_CONTRACT' from li where regexp_matches(upper(text), 'N\\.?I\\.?C|NOT\\s*IN\\s*CONTRACT|OUTSIDE\\s*SCOPE|BY\\s*OTHERS') union all select *, 'DEMO' from li where regexp_matches(upper(text), 'DEMO|REMOVE')) group by all)"""


def legend(spark, d):
    blocks, sheets = views.text_blocks(spark, d), views.sheets(spark, d)
    return P.legend_entries(blocks, P.legend_region(blocks, sheets)), sheets


@query("legend_region", f"with {LEGEND} select * from lr", *BLK)
def legend_region(spark, d):
    return P.legend_region(views.text_blocks(spark, d), views.sheets(spark, d))


@query("legend_entries", f"with {LEGEND}, n as (select doc_id, page_no, count(*) as n, least(0.95, 0.70 + least(0.25, count(*) * 0.05) + case when bool_or(phase = 'NEW') then 0.05 else 0 end + case when bool_or(phase = 'EXISTING') then 0.05 else 0 end) as doc_confidence from le group by all) select doc_id, page_no, phase, label, block_idx, round(cast(doc_confidence as double), 4) as doc_confidence from le join n using (doc_id, page_no)", *BLK)
def legend_entries(spark, d):
    e, _ = legend(spark, d)
    return e.join(P.legend_confidence(e).select(*K, F.round("confidence", 4).alias("doc_confidence")), K).select(*K, "phase", "label", "block_idx", "doc_confidence")


@query("legend_or_default", f"with {LEGEND} select doc_id, page_no, phase, label, cast(0.85 as double) as confidence, true as has_legend from le union all select doc_id, page_no, phase, label, cast(0.75 as double), false from v_sheets anti join (select distinct doc_id, page_no from le) using (doc_id, page_no), (values ('NEW', 'NEW CONSTRUCTION'), ('EXISTING', 'EXISTING CONSTRUCTION'), ('NOT_IN_CONTRACT', 'NOT IN CONTRACT'), ('DEMO', 'DEMOLITION')) t(phase, label)", *BLK)
def legend_or_default(spark, d):
    return P.legend_or_default(*legend(spark, d))


@query("legend_fill_match", f"""with {LEGEND}, en as (select doc_id, page_no, phase from le union all select doc_id, page_no, phase from v_sheets anti join (select distinct doc_id, page_no from le) using (doc_id, page_no), (values ('NEW'), ('EXISTING'), ('NOT_IN_CONTRACT'), ('DEMO')) t(phase))
select doc_id, page_no, seg_idx, phase from v_segments join en using (doc_id, page_no) where (fill_gray is null and phase in ('NEW', 'DEMO')) or (phase = 'EXISTING' and abs(fill_gray - 0.5) < 0.1)""", *BLK, "v_segments")
def legend_fill_match(spark, d):
    return P.legend_fill_match(views.segments(spark, d), P.legend_or_default(*legend(spark, d)), "seg_idx")


@query("classify_phases", f"with {CLASSED} select doc_id, page_no, seg_idx, phase, confidence, method from classed", *SP)
def classify_phases(spark, d):
    return P.classify(views.segments(spark, d), regions(spark, d)).drop("length")


@query("classify_phases_simple", "select doc_id, page_no, seg_idx, case when fill_gray between 0.25 and 0.75 then 'EXISTING' when fill_gray is null or fill_type = 's' then 'NEW' else 'UNKNOWN' end as phase, cast(case when fill_gray between 0.25 and 0.75 then 0.85 when fill_gray is null or fill_type = 's' then 0.75 else 0.5 end as double) as confidence from v_segments", "v_segments")
def classify_phases_simple(spark, d):
    return P.classify_simple(views.segments(spark, d))


@query("phase_stats", f"""with {CLASSED}, m as (select doc_id, page_no, method, count(*) as n from classed group by all), mm as (select doc_id, page_no, string_agg(method || '=' || n, ',' order by method) as methods from m group by all)
select doc_id, page_no, count(*) as total, count(*) filter (phase = 'NEW') as new, count(*) filter (phase = 'EXISTING') as existing, count(*) filter (phase = 'NOT_IN_CONTRACT') as not_in_contract, round(avg(confidence), 12) as avg_confidence, min(confidence) as min_confidence, any_value(methods) as methods from classed join mm using (doc_id, page_no) group by doc_id, page_no""", *SP)
def phase_stats(spark, d):
    s = P.phase_stats(P.classify(views.segments(spark, d), regions(spark, d)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("methods")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select(*K, "total", "new", "existing", "not_in_contract", F.round("avg_confidence", 12).alias("avg_confidence"), "min_confidence", text.alias("methods"))


@query("segments_by_phase", f"with {CLASSED} select doc_id, page_no, seg_idx from classed where phase = 'EXISTING'", *SP)
def segments_by_phase(spark, d):
    return P.classify(views.segments(spark, d), regions(spark, d)).where("phase = 'EXISTING'").select(*K, "seg_idx")


@query("region_overlaps", f"with {GRAYS} select a.doc_id, a.page_no, a.region_idx as a, b.region_idx as b from regions a join regions b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.region_idx < b.region_idx and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1", *SP)
def region_overlaps(spark, d):
    return P.region_overlaps(regions(spark, d))


@query("phase_quantities", f"with {CLASSED} select doc_id, phase, round(sum(len / 9.0), 3) as wall_length, count(*) as segments from classed where phase in ('NEW', 'EXISTING') group by cube (doc_id, phase)", *SP)
def phase_quantities(spark, d):
    return P.phase_quantities(P.classify(views.segments(spark, d), regions(spark, d)), F.lit(9.0))



