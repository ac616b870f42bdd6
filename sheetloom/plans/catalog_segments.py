"""Queries over segments: geometry, filters, walls-only flow, title blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.functions.geom import line_distance

from sheetloom.operators import segments as S
from sheetloom.operators import topology as T
from sheetloom.sources import views
from sheetloom.sources.views import K, sql

QUERIES: dict = {}
SQL: dict = {}
ID = S.ID

#: Geometry of every segment in SQL; colors and dashes as the fixtures define them.
GEO = """
ga as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len, degrees(atan2(y2 - y1, x2 - x1)) as raw, (x1 + x2) / 2 as mx, (y1 + y2) / 2 as my from v_segments),
gb as (select *, case when raw < 0 then raw + 180 else raw end as up from ga),
geo as (select *, case when up >= 180 then up - 180 else up end as ang, width as w from gb),
gp as (select geo.*, page_width as pw, page_height as ph from geo join v_sheets using (doc_id, page_no))
"""


def query(key: str, text: str, *names: str):
    def add(f):
        QUERIES[key] = f
        SQL[key] = sql(f"with {GEO}, {text[5:]}" if text.startswith("with ") else f"with {GEO} {text}", "v_sheets", "v_segments", *names)
        return f

    return add


def both(spark, d):
    return views.segments(spark, d), views.sheets(spark, d)


def r4(*cols):
    return [F.round(c, 4).alias(c) for c in cols]


@query("segment_geometry", "select doc_id, page_no, seg_idx, round(len, 4) as length, round(ang, 4) as angle, mx as mid_x, my as mid_y, is_dashed, fill_gray is not null as has_fill, fill_type = 's' or fill_gray is null as is_stroke_only from geo")
def segment_geometry(spark, d):
    return S.with_geometry(views.segments(spark, d)).select(*ID, *r4("length", "angle"), "mid_x", "mid_y", "is_dashed", "has_fill", "is_stroke_only")


@query("point_line_distance", "select doc_id, page_no, seg_idx, round(abs((y2 - y1) * 500 - (x2 - x1) * 400 + x2 * y1 - y2 * x1) / len, 4) as distance from geo")
def point_line_distance(spark, d):
    at = line_distance(F.lit(500.0), F.lit(400.0), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return views.segments(spark, d).select(*ID, F.round(at, 4).alias("distance"))


@query("dash_pattern", "select doc_id, page_no, seg_idx, case seg_idx % 4 when 0 then 7e0 when 1 then 0e0 when 2 then 2.5e0 else 0e0 end as total, cast(case seg_idx % 4 when 0 then 2 when 2 then 1 else 0 end as int) as n from geo")
def dash_pattern(spark, d):
    text = F.expr("case seg_idx % 4 when 0 then '[3 4] 0' when 1 then '[] 0' when 2 then '[ 2.5, 0 ] 1' else null end")
    got = views.segments(spark, d).select(*ID, S.dash_pattern(text).alias("p"))
    return got.select(*ID, F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("p").alias("n"))


REASON = "case when len < 5 then 'short' when len > 0.9 * sqrt(pw * pw + ph * ph) then 'long' when w = 0 then null when w < 0.25 then 'thin' when w >= 2.0 then 'border' end"


@query("wall_segments", f"with j as (select *, {REASON} as reason from gp) select doc_id, page_no, count(*) filter (reason is null) as walls, round(coalesce(sum(len) filter (reason is null), 0), 3) as wall_length, count(*) filter (reason = 'thin') as thin, count(*) filter (reason = 'border') as border, count(*) filter (reason in ('short', 'long')) as by_length from j group by all")
def wall_segments(spark, d):
    j = S.judged_walls(*both(spark, d))
    kept = F.col("reason").isNull()
    return j.groupBy(*K).agg(F.count_if(kept).alias("walls"), F.round(F.coalesce(F.sum(F.when(kept, F.col("length"))), F.lit(0.0)), 3).alias("wall_length"), F.count_if(F.col("reason") == "thin").alias("thin"), F.count_if(F.col("reason") == "border").alias("border"), F.count_if(F.col("reason").isin("short", "long")).alias("by_length"))


@query("walls_per_sheet", f"select doc_id, page_no, count(*) as walls, round(sum(len), 3) as wall_length from gp where {REASON} is null group by all")
def walls_per_sheet(spark, d):
    return S.wall_segments(*both(spark, d)).groupBy(*K).agg(F.count("*").alias("walls"), F.round(F.sum("length"), 3).alias("wall_length"))


@query("width_distribution", """with h as (select doc_id, page_no, round(w, 1) as wr, count(*) as n from geo group by all)
select doc_id, page_no, cast(sum(n) as bigint) as total, cast(coalesce(sum(n) filter (wr = 0), 0) as bigint) as hairline, cast(coalesce(sum(n) filter (wr < 0.25), 0) as bigint) as thin,
 cast(coalesce(sum(n) filter (wr >= 0.4 and wr < 1), 0) as bigint) as medium, cast(coalesce(sum(n) filter (wr >= 1 and wr < 2), 0) as bigint) as thick, cast(coalesce(sum(n) filter (wr >= 2), 0) as bigint) as border,
 round(coalesce(sum(n) filter (wr >= 2), 0) * 100.0 / sum(n), 4) as border_percent, string_agg(cast(wr as varchar) || ':' || n, ' ' order by wr) as histogram from h group by all""")
def width_distribution(spark, d):
    found = S.width_distribution(views.segments(spark, d))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")
    return found.select(*K, "total", "hairline", "thin", "medium", "thick", "border", *r4("border_percent"), text.alias("histogram"))


BORDERS = """b as (select doc_id, page_no, min(least(x1, x2)) as bx0, min(least(y1, y2)) as by0, max(greatest(x1, x2)) as bx1, max(greatest(y1, y2)) as by1, count(*) as n, any_value(pw) as pw, any_value(ph) as ph from gp where w >= 2 group by doc_id, page_no),
bounds as (select doc_id, page_no, bx0, by0, bx1, by1 from b where n >= 4 and bx1 - bx0 >= 0.5 * pw and by1 - by0 >= 0.5 * ph and not (bx1 - bx0 > 0.98 * pw and by1 - by0 > 0.98 * ph))"""


@query("border_bounds", f"with {BORDERS} select doc_id, page_no, bx0 as x0, by0 as y0, bx1 as x1, by1 as y1 from bounds")
def border_bounds(spark, d):
    return S.border_bounds(*both(spark, d))


@query("clip_midpoint", f"with {BORDERS} select doc_id, page_no, count(*) as kept from geo left join bounds using (doc_id, page_no) where bx0 is null or (mx between bx0 + 50 and bx1 - 50 and my between by0 + 50 and by1 - 50) group by all")
def clip_midpoint(spark, d):
    s, p = both(spark, d)
    return S.clip_midpoint(s, S.border_bounds(s, p)).groupBy(*K).agg(F.count("*").alias("kept"))


def doc_bounds(sheets):
    """Bounds of every third document; the others have none."""
    return sheets.where("doc_id % 3 = 0").select("doc_id").distinct().selectExpr("doc_id", "0.1 as x_min", "0.7 as x_max", "0.1 as y_min", "0.8 as y_max").withColumns({c: F.col(c).cast("double") for c in ("x_min", "x_max", "y_min", "y_max")})


IN = "{x} between (case when doc_id % 3 = 0 then 0.1 else 0 end) * pw and (case when doc_id % 3 = 0 then 0.7 else 0.85 end) * pw and {y} between (case when doc_id % 3 = 0 then 0.1 else 0 end) * ph and (case when doc_id % 3 = 0 then 0.8 else 1.0 end) * ph"
IN1, IN2 = IN.format(x="x1", y="y1"), IN.format(x="x2", y="y2")


@query("clip_endpoints", f"select doc_id, page_no, count(*) filter ({IN1} and {IN2}) as kept_both, count(*) filter (({IN1}) or ({IN2})) as kept_either from gp group by all having count(*) filter (({IN1}) or ({IN2})) > 0")
def clip_endpoints(spark, d):
    s, p = both(spark, d)
    b = doc_bounds(p)
    count = lambda e, name: S.clip_endpoints(s, p, b, e).groupBy(*K).agg(F.count("*").alias(name))
    return count(True, "kept_either").join(count(False, "kept_both"), K, "left").select(*K, F.coalesce("kept_both", F.lit(0)).alias("kept_both"), "kept_either")


@query("clip_polygons", f"with c as (select *, case when notch = 1 then (x0 + w / 2) * 4 / 3 - (x0 + w * 0.75) / 3 else x0 + w / 2 end as cx, case when notch = 1 then (y0 + h / 2) * 4 / 3 - (y0 + h * 0.75) / 3 else y0 + h / 2 end as cy, page_width as pw, page_height as ph from v_polygons join v_sheets using (doc_id, page_no)) select doc_id, page_no, poly_idx from c where {IN.format(x='cx', y='cy')}", "v_polygons")
def clip_polygons(spark, d):
    p = views.sheets(spark, d)
    return S.clip_polygons(views.polygons(spark, d), p, doc_bounds(p)).select(*K, "poly_idx")


GRID = """w > 0 and w <= 1.5 and ((least(ang, 180 - ang) <= 2 and abs(x2 - x1) >= 0.7 * pw and least(x1, x2) <= 100 and greatest(x1, x2) >= pw - 100) or (abs(ang - 90) <= 2 and abs(y2 - y1) >= 0.7 * ph and least(y1, y2) <= 100 and greatest(y1, y2) >= ph - 100))"""


def stretched(segments):
    """Every 50th segment drawn across the sheet, as grid lines are."""
    far = F.col("seg_idx") % 50 == 0
    level = F.col("y1") == F.col("y2")
    return segments.withColumns({"x1": F.when(far & level, 10.0).otherwise(F.col("x1")), "x2": F.when(far & level, 990.0).otherwise(F.col("x2")), "y1": F.when(far & (F.col("x1") == F.col("x2")), 10.0).otherwise(F.col("y1")), "y2": F.when(far & (F.col("x1") == F.col("x2")), 830.0).otherwise(F.col("y2"))})


@query("grid_lines", f"""with st as (select * replace (case when seg_idx % 50 = 0 and y1 = y2 then 10.0 else x1 end as x1, case when seg_idx % 50 = 0 and y1 = y2 then 990.0 else x2 end as x2,
 case when seg_idx % 50 = 0 and x1 = x2 then 10.0 else y1 end as y1, case when seg_idx % 50 = 0 and x1 = x2 then 830.0 else y2 end as y2) from gp) select doc_id, page_no, seg_idx from st where {GRID}""")
def grid_lines(spark, d):
    s, p = both(spark, d)
    g = S.with_geometry(stretched(s)).join(p.select(*K, "page_width", "page_height"), K)
    return g.where(S.grid_lines()).select(*ID)


HATCH = """h1 as (select *, cast(floor(ang / 2) * 2 as double) as bucket from {src}),
h2 as (select *, count(*) over b as hn, avg(len) over b as mean, stddev_pop(len) over b as sd, radians(avg(ang) over b + 90) as turn from h1 window b as (partition by doc_id, page_no, bucket)),
h3 as (select *, round(mx * cos(turn) + my * sin(turn), 6) as loc from h2),
h4 as (select *, loc - lag(loc) over (partition by doc_id, page_no, bucket order by loc, seg_idx) as step from h3),
h5 as (select doc_id, page_no, bucket, any_value(hn) as hn, any_value(mean) as mean, any_value(sd) as sd, avg(step) as gap, stddev_pop(step) as gap_sd from h4 group by all),
hatching as (select h1.doc_id, h1.page_no, seg_idx, hn >= 5 and coalesce(sd <= 0.3 * mean and gap > 0 and gap_sd <= 0.5 * gap and gap <= 0.5 * mean, false) as is_hatching from h1 join h5 using (doc_id, page_no, bucket))"""


@query("hatching_groups", f"with {HATCH.format(src='geo')} select * from hatching")
def hatching_groups(spark, d):
    return S.hatching_groups(views.segments(spark, d))


DIM = """e as (select doc_id, page_no, seg_idx, side, len, ang, w, cast(trunc(case side when 0 then x1 else x2 end / 5) as bigint) as cx, cast(trunc(case side when 0 then y1 else y2 end / 5) as bigint) as cy from {src}, range(2) t(side)),
near as (select m.doc_id, m.page_no, m.seg_idx, m.side, o.seg_idx as other, o.len as olen from e m join e o on m.doc_id = o.doc_id and m.page_no = o.page_no and abs(m.cx - o.cx) <= 1 and abs(m.cy - o.cy) <= 1 and o.seg_idx <> m.seg_idx
  where m.w <= 0.5 and least(abs(o.ang - m.ang), 180 - abs(o.ang - m.ang)) between 30 and 60 and o.len < 0.3 * m.len),
lines as (select doc_id, page_no, seg_idx, side from near group by all having count(*) >= 2),
dims as (select distinct doc_id, page_no, seg_idx from lines union select distinct n.doc_id, n.page_no, n.other from near n join lines using (doc_id, page_no, seg_idx, side) where olen < 20)"""


def shortened(segments):
    """Slanted segments drawn short, as arrow heads are."""
    slant = (F.col("x1") != F.col("x2")) & (F.col("y1") != F.col("y2"))
    return segments.withColumns({"x2": F.when(slant, F.col("x1") + 10).otherwise(F.col("x2")), "y2": F.when(slant, F.col("y1") + 10).otherwise(F.col("y2"))})


SHORT = "short as (select * replace (case when x1 <> x2 and y1 <> y2 then x1 + 10 else x2 end as x2, case when x1 <> x2 and y1 <> y2 then y1 + 10 else y2 end as y2, case when x1 <> x2 and y1 <> y2 then sqrt(200) else len end as len) from geo)"


@query("dimension_lines", f"with {SHORT}, {DIM.format(src='short')} select * from dims")
def dimension_lines(spark, d):
    return S.dimension_lines(shortened(views.segments(spark, d)))


NOTE = "(w <= 0.3 and fill_gray is not null and fill_gray >= 0.1)"


@query("annotation_lines", f"select doc_id, page_no, seg_idx from geo where {NOTE}")
def annotation_lines(spark, d):
    return views.segments(spark, d).where(S.annotation_lines()).select(*ID)


ANTI = "select g.* from {a} g anti join {b} x using (doc_id, page_no, seg_idx)"
CASCADE = f"""
s1 as (select * from gp where {IN1} and {IN2}), s2 as (select * from s1 where not coalesce({GRID}, false)),
{HATCH.format(src="s2")}, s3 as (select s2.* from s2 anti join (select * from hatching where is_hatching) using (doc_id, page_no, seg_idx)),
{DIM.format(src="s3")}, s4 as (select s3.* from s3 anti join dims using (doc_id, page_no, seg_idx)), s5 as (select * from s4 where not {NOTE})"""
COUNTS = ", ".join(f"(select count(*) from {t} x where x.doc_id = p.doc_id and x.page_no = p.page_no) as {n}" for t, n in (("gp", "n0"), ("s1", "n1"), ("s2", "n2"), ("s3", "n3"), ("s4", "n4"), ("s5", "n5")))


def cascaded(spark, d):
    s, p = both(spark, d)
    return S.filter_cascade(s, p, doc_bounds(p))


@query("filter_cascade", f"with {CASCADE} select doc_id, page_no, seg_idx, width from s5")
def filter_cascade(spark, d):
    return cascaded(spark, d).where("removed_by is null").select(*ID, "width")


@query("filter_stats", f"""with {CASCADE}, c as (select doc_id, page_no, {COUNTS} from (select distinct doc_id, page_no from gp) p)
select doc_id, page_no, stage, a as total_input, b as total_output, a - b as removed, round(case when a = 0 then 0 else (a - b) * 100.0 / a end, 4) as removal_rate
from (select doc_id, page_no, unnest(['area', 'grid', 'hatching', 'dimension', 'annotation', 'total']) as stage, unnest([n0, n1, n2, n3, n4, n0]) as a, unnest([n1, n2, n3, n4, n5, n5]) as b from c)""")
def filter_stats(spark, d):
    return S.cascade_stats(cascaded(spark, d)).withColumn("removal_rate", F.round("removal_rate", 4))


COLOR = "(fill_gray is null or (fill_gray < 0.2 and fill_gray * 0.5 < 0.2))"


@query("wall_color", f"select doc_id, page_no, seg_idx, {COLOR} as is_wall_color from geo")
def wall_color(spark, d):
    return views.segments(spark, d).select(*ID, S.wall_color().alias("is_wall_color"))


POS = """p1 as (select *, case when abs(y2 - y1) < 0.05 * len then 'H' when abs(x2 - x1) < 0.05 * len then 'V' end as axis from gp where len >= {least}),
p2 as (select *, round_even(case axis when 'H' then my else mx end / {cell}, 0) * {cell} as pos from p1 where axis is not null),
p3 as (select *, count(*) over g as pn, sum(len) over g as total, max(case axis when 'H' then greatest(x1, x2) else greatest(y1, y2) end) over g - min(case axis when 'H' then least(x1, x2) else least(y1, y2) end) over g as span,
  case axis when 'H' then pw else ph end as side from p2 window g as (partition by doc_id, page_no, axis, pos))"""


@query("grid_chains", f"with {POS.format(least=10, cell=5)} select distinct doc_id, page_no, seg_idx from p3 where (pn >= 3 and span > 0.6 * side and total > case axis when 'H' then 1500 else 1000 end) or len > 400")
def grid_chains(spark, d):
    return S.grid_chains(*both(spark, d))


GRIDPOS = f"{POS.format(least=20, cell=8)}, gridpos as (select distinct doc_id, page_no, axis, pos from p3 where span > 0.4 * side or (pn >= 2 and total > case axis when 'H' then 500 else 400 end))"


@query("grid_positions", f"with {GRIDPOS} select * from gridpos")
def grid_positions(spark, d):
    return S.grid_positions(*both(spark, d))


@query("cluster_positions", f"""with {GRIDPOS}, c as (select *, case when pos - lag(pos) over w > 10 or lag(pos) over w is null then 1 else 0 end as new from gridpos window w as (partition by doc_id, page_no, axis order by pos)),
g as (select *, sum(new) over (partition by doc_id, page_no, axis order by pos) as cl from c) select doc_id, page_no, axis, cast(trunc(avg(pos)) as bigint) as center, count(*) as n from g group by doc_id, page_no, axis, cl""")
def cluster_positions(spark, d):
    return S.cluster_positions(S.grid_positions(*both(spark, d)))


@query("hatching_simple", """with h as (select *, round_even(ang / 2, 0) * 2 as bucket from geo), g as (select *, count(*) over b as n, avg(len) over b as mean, stddev_pop(len) over b as sd from h window b as (partition by doc_id, page_no, bucket))
select doc_id, page_no, seg_idx, n >= 10 and mean <= 200 and coalesce(sd / nullif(mean, 0) < 0.5, false) as is_hatching from g""")
def hatching_simple(spark, d):
    return S.hatching_simple(views.segments(spark, d))


SLANT = "least(ang, 180 - ang) between 40 and 50 and len >= 10 and len < 150"


@query("diagonal_hatching", f"select doc_id, page_no, seg_idx, ({SLANT}) and count(*) filter ({SLANT}) over (partition by doc_id, page_no) >= 8 as is_hatching from geo")
def diagonal_hatching(spark, d):
    return S.diagonal_hatching(views.segments(spark, d), 8)


@query("zone_filter", """select doc_id, page_no, coalesce(case when w < 0.8 then 'thin' when len < 10 then 'short' when least(x1, x2) > 0.85 * pw then 'right' when greatest(x1, x2) < 0.05 * pw then 'left' when greatest(y1, y2) < 0.05 * ph then 'top' when least(y1, y2) > 0.92 * ph then 'bottom' end, 'kept') as reason, count(*) as n from gp group by all""")
def zone_filter(spark, d):
    return S.zone_filter(*both(spark, d)).groupBy(*K, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


#: Upright segments right of 600 made long, as frames of title blocks are.
TITLE = """tb as (select * replace (case when x1 = x2 and x1 >= 600 then 100.0 else y1 end as y1, case when x1 = x2 and x1 >= 600 then 500.0 else y2 end as y2, case when x1 = x2 and x1 >= 600 then 400.0 else len end as len) from gp),
pg as (select doc_id, page_no, row_number() over (partition by doc_id order by page_no) as nth, count(*) over (partition by doc_id) as pages from v_sheets),
t1 as (select tb.*, mx / pw as loc from tb join pg using (doc_id, page_no) where nth <= case when pages < 5 then 3 else 5 end and abs(ang - 90) <= 5 and mx / pw between 0.6 and 0.98 and len >= 0.3 * ph),
t2 as (select *, case when loc - lag(loc) over w > 0.02 or lag(loc) over w is null then 1 else 0 end as new from t1 window w as (partition by doc_id, page_no order by loc, seg_idx)),
t3 as (select *, sum(new) over (partition by doc_id, page_no order by loc, seg_idx) as cl from t2),
t4 as (select doc_id, page_no, avg(loc) as loc from t3 group by doc_id, page_no, cl, ph having sum(len) > 0.3 * ph),
t5 as (select doc_id, floor(round(loc / 0.02, 6)) as bin, avg(loc) as x1 from t4 group by all having count(*) >= 2),
tline as (select doc_id, min_by(x1, bin) as x1 from t5 group by doc_id)"""


def long_uprights(segments):
    up = (F.col("x1") == F.col("x2")) & (F.col("x1") >= 600)
    return segments.withColumns({"y1": F.when(up, 100.0).otherwise(F.col("y1")), "y2": F.when(up, 500.0).otherwise(F.col("y2"))})


def title_lines(spark, d):
    s, p = both(spark, d)
    return S.title_block_line(long_uprights(s), p), p


@query("title_block_line", f"with {TITLE} select doc_id, round(x1, 6) as x1 from tline")
def title_block_line(spark, d):
    return title_lines(spark, d)[0].select("doc_id", F.round("x1", 6).alias("x1"))


#: The whole walls-only flow: the drawing area's edge, grid lines about their clusters' centers, ten rules, then chains, small boxes and lone groups of what is left.
WALLS_ONLY = f"""{GRIDPOS},
cp as (select *, case when pos - lag(pos) over w > 10 or lag(pos) over w is null then 1 else 0 end as new from gridpos window w as (partition by doc_id, page_no, axis order by pos)),
cq as (select *, sum(new) over (partition by doc_id, page_no, axis order by pos) as cl from cp),
gridc as (select doc_id, page_no, axis, cast(trunc(avg(pos)) as bigint) as center from cq group by doc_id, page_no, axis, cl),
tb as (select * from gp),
{TITLE[TITLE.index("pg as"):]},
ax as (select *, case when abs(y2 - y1) < 0.1 * len then 'H' else 'V' end as axis from gp where len > 150),
ong as (select distinct ax.doc_id, ax.page_no, ax.seg_idx from ax join gridc q on q.doc_id = ax.doc_id and q.page_no = ax.page_no and q.axis = ax.axis and abs(q.center - case ax.axis when 'H' then my else mx end) < 8),
r as (select gp.*, case when least(gp.x1, x2) > (coalesce(tline.x1, 0.78) - 0.02) * pw then 'outside' when is_dashed then 'dashed' when not {COLOR} then 'colored' when w > 0 and w < 0.2 then 'hairline' when len < 15 then 'short' when w > 0 and w < 0.4 then 'thin'
  when not (abs(y2 - y1) < 0.1 * len or abs(x2 - gp.x1) < 0.1 * len) then 'angled'
  when ong.seg_idx is not null then 'grid'
  when len > 500 then 'long' end as reason from gp left join ong using (doc_id, page_no, seg_idx) left join tline using (doc_id)),
k0 as (select * from r where reason is null),
{POS.format(least=10, cell=5).replace("p1 ", "q1 ").replace("p2 ", "q2 ").replace("p3 ", "q3 ").replace("from gp", "from k0")},
chain as (select distinct doc_id, page_no, seg_idx from q3 where (pn >= 3 and span > 0.6 * side and total > case axis when 'H' then 1500 else 1000 end) or len > 400),
k1 as (select k0.* from k0 anti join chain using (doc_id, page_no, seg_idx)),
sz as (select * from k1 where len between 10 and 50),
lv as (select doc_id, page_no, seg_idx, least(x1, x2) as l, greatest(x1, x2) as r, my as y from sz where abs(y2 - y1) < 1),
up as (select doc_id, page_no, seg_idx, mx as x, least(y1, y2) as t, greatest(y1, y2) as u from sz where abs(x2 - x1) < 1),
pr as (
  select a.doc_id, a.page_no, a.seg_idx as a, b.seg_idx as b, a.l, a.r, a.y, b.y as oy from lv a join lv b on a.doc_id = b.doc_id and a.page_no = b.page_no
  where b.y > a.y and b.y - a.y between 5 and 50 and least(a.r, b.r) - greatest(a.l, b.l) >= 0.5 * least(a.r - a.l, b.r - b.l)),
sd as (
  select pr.doc_id, pr.page_no, a, b, up.seg_idx as s, abs(x - l) <= 5 as is_left, abs(x - r) <= 5 as is_right from pr join up using (doc_id, page_no)
  where t <= y + 5 and u >= oy - 5 and (abs(x - l) <= 5 or abs(x - r) <= 5)),
bx as (select doc_id, page_no, a, b, list(s) as ss from sd group by all having bool_or(is_left) and bool_or(is_right)),
boxes as (select distinct doc_id, page_no, unnest(list_concat([a, b], ss)) as seg_idx from bx),
k2 as (select k1.* from k1 anti join boxes using (doc_id, page_no, seg_idx)),
en as (select distinct doc_id, page_no, seg_idx, cast(round_even(case n when 0 then x1 else x2 end / 8, 0) as bigint) as cx, cast(round_even(case n when 0 then y1 else y2 end / 8, 0) as bigint) as cy from k2, range(2) t(n)),
ld as (select doc_id, page_no, cx, cy, min(seg_idx) as seg_idx from en group by all),
lk as (
  select distinct a.doc_id, a.page_no, unnest([a.seg_idx, b.seg_idx]) as u, unnest([b.seg_idx, a.seg_idx]) as v
  from en a join ld b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.seg_idx <> b.seg_idx and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1),
 fold as (
  select doc_id, page_no, seg_idx, seg_idx as root from k2
  union select lk.doc_id, lk.page_no, lk.v, fold.root from fold join lk on lk.doc_id = fold.doc_id and lk.page_no = fold.page_no and lk.u = fold.seg_idx and fold.root < lk.v),
rt as (select doc_id, page_no, seg_idx, min(root) as root from fold group by all),
alone as (select doc_id, page_no, seg_idx from (select *, count(*) over (partition by doc_id, page_no, root) as size, count(*) over (partition by doc_id, page_no) as n from rt) where size < 5 and n >= 5),
late as (
  select *, 'chain' as late from chain union all select *, 'box' from boxes union all select *, 'isolated' from alone)"""


def whole_walls_only(spark, d):
    """K, reason, n: segments by what the whole walls-only flow says of them."""
    s, p = both(spark, d)
    grid = S.cluster_positions(S.grid_positions(s, p)).withColumnRenamed("center", "pos")
    judged = T.wall_network(s, p, grid, S.drawing_edges(s, p))
    return judged.groupBy(*K, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("walls_only", f"with {WALLS_ONLY} select doc_id, page_no, coalesce(reason, late, 'kept') as reason, count(*) as n from r left join late using (doc_id, page_no, seg_idx) group by all")
def walls_only(spark, d):
    return whole_walls_only(spark, d)


@query("consensus_vote", f"""with {TITLE}, est as (select doc_id, x1 from tline where doc_id % 4 <> 0 union all select doc_id, 0.7 + (page_no % 7) * 0.03 from v_sheets where doc_id % 4 = 1 union all select doc_id, 0.72 + (page_no % 3) * 0.005 from v_sheets where doc_id % 4 = 2),
m as (select *, quantile_cont(x1, 0.5) over (partition by doc_id) as middle, count(*) over (partition by doc_id) as n from est), k as (select * from m where n = 1 or abs(x1 - middle) <= 0.10),
v as (select doc_id, quantile_cont(x1, 0.5) as x, case when max(n) = 1 then 0.5 when max(x1) - min(x1) < 0.02 then 0.95 when max(x1) - min(x1) < 0.05 then 0.80 when max(x1) - min(x1) < 0.10 then 0.60 else 0.40 end as confidence from k group by doc_id)
select doc_id, round(coalesce(x, 0.86) - 0.01, 6) as x_max, cast(coalesce(confidence, 0.0) as double) as confidence from (select distinct doc_id from v_sheets) left join v using (doc_id)""")
def consensus_vote(spark, d):
    lines, p = title_lines(spark, d)
    more = lambda k, e: p.where(f"doc_id % 4 = {k}").select("doc_id", F.expr(e).cast("double").alias("x1"))
    estimates = lines.where("doc_id % 4 <> 0").unionByName(more(1, "0.7D + (page_no % 7) * 0.03D")).unionByName(more(2, "0.72D + (page_no % 3) * 0.005D"))
    found = S.consensus_vote(estimates, p)
    return found.select("doc_id", F.round("x_max", 6).alias("x_max"), F.col("confidence").cast("double").alias("confidence"))
