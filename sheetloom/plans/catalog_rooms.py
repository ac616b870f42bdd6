"""Queries over labels and label-driven rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.functions.lineage import written
from sheetloom.operators import detect as D
from sheetloom.operators import labels as L

from sheetloom.operators import segments as S
from sheetloom.sources import views
from sheetloom.sources.views import K, led, matched, sql

QUERIES: dict = {}
SQL: dict = {}


def query(key: str, text: str | None, *names: str):
    def add(f):
        QUERIES[key] = f
        if text:
            SQL[key] = sql(text, *names)
        return f

    return add


def ored(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


# --- labels ---------------------------------------------------------------------------

OCR = """emb as (select * from v_blocks where block_idx % 3 <> 1), ocr as (select * replace (case when block_idx % 5 = 0 then x0 + 60 else x0 + 2 end as x0, case when block_idx % 5 = 0 then x1 + 60 else x1 + 2 end as x1, case when block_idx % 5 = 0 then y0 else y0 + 1 end as y0, case when block_idx % 5 = 0 then y1 else y1 + 1 end as y1, block_idx + 100 as block_idx) from v_blocks where block_idx % 2 = 0 or block_idx % 5 = 0)"""


@query("merge_text", f"""with {OCR} select doc_id, page_no, block_idx, x0, y0 from emb union all select doc_id, page_no, block_idx, x0, y0 from ocr o where not exists (select 1 from emb e where e.doc_id = o.doc_id and e.page_no = o.page_no
 and least(e.x1, o.x1) > greatest(e.x0, o.x0) and least(e.y1, o.y1) > greatest(e.y0, o.y0) and (least(e.x1, o.x1) - greatest(e.x0, o.x0)) * (least(e.y1, o.y1) - greatest(e.y0, o.y0)) > 0.5 * least((e.x1 - e.x0) * (e.y1 - e.y0), (o.x1 - o.x0) * (o.y1 - o.y0)))""", "v_text_blocks")
def merge_text(spark, d):
    b = views.text_blocks(spark, d)
    far = F.col("block_idx") % 5 == 0
    dx, dy = F.when(far, 60.0).otherwise(2.0), F.when(far, 0.0).otherwise(1.0)
    ocr = b.where("block_idx % 2 = 0 or block_idx % 5 = 0").withColumns({"x0": F.col("x0") + dx, "x1": F.col("x1") + dx, "y0": F.col("y0") + dy, "y1": F.col("y1") + dy, "block_idx": F.col("block_idx") + 100})
    return L.merge_text(b.where("block_idx % 3 <> 1"), ocr).select(*K, "block_idx", "x0", "y0")


@query("image_to_page", "select doc_id, page_no, block_idx, round(x0 * page_width / 2000, 4) as x0, round(page_height - y1 * page_height / 1500, 4) as y0, round(x1 * page_width / 2000, 4) as x1, round(page_height - y0 * page_height / 1500, 4) as y1 from v_blocks join v_sheets using (doc_id, page_no)", "v_sheets", "v_text_blocks")
def image_to_page(spark, d):
    b = views.text_blocks(spark, d).join(views.sheets(spark, d).select(*K, "page_width", "page_height"), K)
    p = L.image_to_page(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(2000.0), F.lit(1500.0), F.col("page_width"), F.col("page_height"))
    return b.withColumn("p", p).select(*K, "block_idx", *(F.round(f"p.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


ROOM_LABELS = f"""rl as (
  select doc_id, page_no, block_idx, trim(text) as text, (x0 + x1) / 2 as lx, (y0 + y1) / 2 as ly from v_blocks
  where length(trim(text)) between 2 and 50 and font_size between 5 and 36 and (source <> 'ocr' or confidence >= 0.6) and not regexp_matches(trim(text), '(?i){ored(L.NOT_ROOMS)}')
    and not (upper(trim(text)) = trim(text) and length(trim(text)) > 20 and regexp_matches(trim(text), '^\\pL+$'))
    and (regexp_matches(upper(trim(text)), '{ored(L.ROOM_WORDS)}') or regexp_matches(upper(trim(text)), '{ored(L.ROOM_NUMBERS)}')))"""


@query("room_labels", f"with {ROOM_LABELS} select doc_id, page_no, block_idx, text from rl", "v_text_blocks")
def room_labels(spark, d):
    return L.room_labels(views.text_blocks(spark, d)).select(*K, "block_idx", "text")


def _labels(out: str) -> str:
    kinds = [(p, "ROOM_NUMBER", c) for p, c in L.NUMBER_PATTERNS] + [(p, "AREA_TAG", c) for p, c in L.TAG_PATTERNS] + [(p, "ROOM_NAME", c) for p, c in L.NAME_PATTERNS]
    pick = lambda i: " ".join(f"when regexp_matches(norm, '{k[0]}') then {k[i]!r}" for k in kinds)
    return f"""ln as (select b.*, page_width, page_height, upper(regexp_replace(trim(text), '\\s+', ' ', 'g')) as norm, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from v_blocks b join v_sheets using (doc_id, page_no)
  where length(trim(text)) between 1 and 30 and font_size between 4 and 24 and (source <> 'ocr' or confidence >= 0.5) and not regexp_matches(trim(text), '(?i){out}')),
lk as (select *, case {pick(1)} end as label_type, case {pick(2)} end as sure from ln),
ls as (select *, (case source when 'embedded' then 0.95 else confidence end + sure) / 2 * case when cx < page_width * 0.8 then 1 else 0.5 end as score, cx < page_width * 0.8 as in_area from lk where label_type is not null),
labels as (select doc_id, page_no, block_idx, norm as label, label_type, least(1, greatest(0, score)) as confidence, cx, cy, font_size, in_area, page_width, page_height from ls where score >= 0.5),
dd as (select * from (select *, row_number() over (partition by doc_id, page_no, label, trunc(cx / 50), trunc(cy / 50) order by block_idx) as nth from labels) where nth = 1)"""


STRICT, LOOSE = _labels(ored((*L.EXCLUDED, *L.STRICT))), _labels(ored(L.EXCLUDED))
TB = ("v_sheets", "v_text_blocks")


def labels(spark, d, strict=False):
    return L.classify_labels(views.text_blocks(spark, d), views.sheets(spark, d), strict_exclusions=strict)


@query("classify_labels", f"with {STRICT} select doc_id, page_no, block_idx, label, label_type, round(confidence, 6) as confidence, in_area from labels", *TB)
def classify_labels(spark, d):
    return labels(spark, d, True).select(*K, "block_idx", "label", "label_type", F.round("confidence", 6).alias("confidence"), "in_area")


@query("classify_labels_loose", f"with {LOOSE} select doc_id, page_no, block_idx, label, label_type, round(confidence, 6) as confidence, in_area from labels", *TB)
def classify_labels_loose(spark, d):
    return labels(spark, d).select(*K, "block_idx", "label", "label_type", F.round("confidence", 6).alias("confidence"), "in_area")


@query("dedupe_labels", f"with {LOOSE} select doc_id, page_no, block_idx, label from dd", *TB)
def dedupe_labels(spark, d):
    return L.dedupe_labels(labels(spark, d)).select(*K, "block_idx", "label")


@query("grid_markers", f"""with {LOOSE} select doc_id, page_no, block_idx, label, regexp_matches(label, '^(\\d{{1,2}}|[A-Z])$') and (cx < 300 or cx > page_width - 300 or cy < 300 or cy > page_height - 300) as marker, regexp_matches(label, '^(\\d{{1,2}}|[A-Z]{{1,2}})$') and (cy < 50 or cy > page_height - 50) as edge_marker from labels""", *TB)
def grid_markers(spark, d):
    return labels(spark, d).select(*K, "block_idx", "label", L.grid_marker().alias("marker"), L.edge_marker().alias("edge_marker"))


@query("label_stats", f"with {LOOSE} select doc_id, page_no, label_type, count(*) as n, count(*) filter (confidence >= 0.85) as high, count(*) filter (confidence >= 0.6 and confidence < 0.85) as medium, count(*) filter (confidence < 0.6) as low, round(avg(confidence), 8) as average from labels group by rollup (doc_id, page_no, label_type)", *TB)
def label_stats(spark, d):
    return L.label_stats(labels(spark, d))


#: Labels in the drawing's midst: no grid markers.
LB = f"""{LOOSE},
lb as (select * from dd where not (regexp_matches(label, '^(\\d{{1,2}}|[A-Z])$') and (cx < 300 or cx > page_width - 300 or cy < 300 or cy > page_height - 300)))"""


def clusters(spark, d):
    kept = L.dedupe_labels(labels(spark, d)).where(~L.grid_marker())
    return L.label_clusters(kept)


#: The same labels, clustered: lb has a cluster by its leader's index, with its primary label.
CLUSTERED = f"""{LB.replace("lb as (", "l0 as (")}, {led("l0", "block_idx", "abs(x.cx - y.cx) <= 50 and abs(x.cy - y.cy) <= 50")},
ow as (select l0.*, leader from l0 join led on led.doc_id = l0.doc_id and led.page_no = l0.page_no and led.node = l0.block_idx),
rk as (
  select *, row_number() over (partition by doc_id, page_no, leader order by case label_type when 'ROOM_NUMBER' then 0 when 'AREA_TAG' then 1 else 2 end, -confidence, block_idx) as nth from ow),
lb as (
  select doc_id, page_no, leader as block_idx, max(label) filter (nth = 1) as label, string_agg(label, ' ' order by cy, cx, block_idx) as label_text, max(label_type) filter (nth = 1) as label_type,
    max(confidence) filter (nth = 1) as confidence, avg(cx) as cx, avg(cy) as cy, count(*) as n, max(page_width) as page_width, max(page_height) as page_height from rk group by doc_id, page_no, leader)"""


@query("label_clusters", f"""with {CLUSTERED}
select doc_id, page_no, block_idx as cluster_idx, label as primary_label, label_text, label_type, round(confidence, 4) as confidence, round(cx, 4) as cx, round(cy, 4) as cy, n from lb""", *TB)
def label_clusters(spark, d):
    return clusters(spark, d).withColumns({c: F.round(c, 4) for c in ("cx", "cy", "confidence")})


def matches(spark, d):
    polys = views.polygons(spark, d)
    return L.match_labels(L.room_labels(views.text_blocks(spark, d)), polys), polys


#: Labels of polygons: inside the ring, within the grown box, or near the center of area; each once, in polygon order.
MATCHES = f"""{ROOM_LABELS},
pg as (
  select *, case when notch = 1 then (x0 + w / 2) * 4 / 3 - (x0 + w * 0.75) / 3 else x0 + w / 2 end as gx, case when notch = 1 then (y0 + h / 2) * 4 / 3 - (y0 + h * 0.75) / 3 else y0 + h / 2 end as gy from v_polygons),
fa as (select pg.*, block_idx, text, lx, ly, sqrt((lx - gx) * (lx - gx) + (ly - gy) * (ly - gy)) as far from pg join rl using (doc_id, page_no)),
ti as (
  select *, case when lx >= x0 and lx < x0 + w and ly >= y0 and ly < y0 + h and not (notch = 1 and lx >= x0 + w / 2 and ly >= y0 + h / 2) then 0
    when lx between x0 - 0.15 * w and x0 + w + 0.15 * w and ly between y0 - 0.15 * h and y0 + h + 0.15 * h then 1 when far < sqrt(w * w + h * h) / 2 then 2 end as tier from fa),
ce as (select * from ti where tier is not null),
{matched("ce", "poly_idx", "block_idx", "poly_idx, tier, round(case when tier = 2 then far else 0 end, 6), block_idx", shared=False)},
ml as (
  select p.doc_id, p.page_no, p.poly_idx, block_idx, coalesce(text, 'ROOM_' || row_number() over (partition by p.doc_id, p.page_no, tier is null order by p.poly_idx)) as room_name,
    case tier when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'LOW' else 'NONE' end as name_confidence
  from v_polygons p left join taken using (doc_id, page_no, poly_idx))"""


@query("match_labels", f"with {MATCHES} select doc_id, page_no, poly_idx, block_idx, room_name, name_confidence from ml", "v_text_blocks", "v_polygons")
def match_labels(spark, d):
    return matches(spark, d)[0]


@query("apply_labels", f"""with {MATCHES}
select doc_id, page_no, poly_idx, case when name_confidence = 'NONE' then 'ROOM_UNKNOWN' else room_name end as room_name, name_confidence from ml""", "v_text_blocks", "v_polygons")
def apply_labels(spark, d):
    m, polys = matches(spark, d)
    return L.apply_labels(polys, m.where("name_confidence <> 'NONE'")).select(*K, "poly_idx", "room_name", "name_confidence")


# --- rays and rooms -------------------------------------------------------------------


def singles(spark, d):
    """Each label as a cluster of its own."""
    kept = written(L.dedupe_labels(labels(spark, d)).where(~L.grid_marker()))
    return kept.withColumnsRenamed({"block_idx": "cluster_idx", "label": "label_text"})


def wall_rows(spark, d):
    return S.wall_segments(views.segments(spark, d), views.sheets(spark, d)).select(*K, "x1", "y1", "x2", "y2")


def cast(spark, d, c, walls=None):
    return D.ray_hits(c, wall_rows(spark, d) if walls is None else walls, views.sheets(spark, d))


def boundaries(spark, d, c, walls=None):
    """The boundary of each label; rings are written, the hits that they come from are not."""
    return written(D.label_boundaries(cast(spark, d, c, walls)))


WALLS = """walls as (
  select * from (select v_segments.*, page_width, page_height, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len from v_segments join v_sheets using (doc_id, page_no))
  where len >= 5 and len <= 0.9 * sqrt(page_width * page_width + page_height * page_height) and (width = 0 or (width >= 0.25 and width < 2)))"""
HITS = f"""{LB}, {WALLS},
rays as (select n as ray, cos(n * pi() / 8) as dx, sin(n * pi() / 8) as dy from range(16) t(n)),
lr as (select lb.*, ray, dx, dy from lb, rays),
tu as (select lr.doc_id, lr.page_no, lr.block_idx, ray, ((x1 - cx) * (y2 - y1) - (y1 - cy) * (x2 - x1)) / det as t, ((x1 - cx) * dy - (y1 - cy) * dx) / det as u from (select *, dx * (y2 - y1) - dy * (x2 - x1) as det0, case when abs(dx * (y2 - y1) - dy * (x2 - x1)) > 1e-9 then dx * (y2 - y1) - dy * (x2 - x1) end as det from lr join (select doc_id, page_no, x1, y1, x2, y2 from walls) using (doc_id, page_no)) lr),
wl as (select doc_id, page_no, block_idx, ray, min(t) as wall from tu where u between -1e-9 and 1 + 1e-9 and t > 10 and t <= 2000 group by all),
md as (select a.doc_id, a.page_no, a.block_idx, a.ray, a.cx, a.cy, a.dx, a.dy, a.cx / 2 + b.cx / 2 as mx, a.cy / 2 + b.cy / 2 as my from lr a join lb b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.block_idx <> b.block_idx),
mb as (select doc_id, page_no, block_idx, ray, arg_min({{'far': sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)), 'mx': mx, 'my': my}}, [round(sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)), 6), mx, my]) as m from md
  where sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)) > 10 and (mx - cx) * dx + (my - cy) * dy > 0 and abs((mx - cx) * dy - (my - cy) * dx) <= 50 group by all),
hx as (select lr.*, wall, m, least(greatest(coalesce(least(case when dx > 1e-9 then (page_width * 0.85 - cx) / dx when dx < -1e-9 then cx / -dx end, case when dy > 1e-9 then (page_height - cy) / dy when dy < -1e-9 then cy / -dy end), 2000), 0), 2000) as ending from lr left join wl using (doc_id, page_no, block_idx, ray) left join mb using (doc_id, page_no, block_idx, ray)),
hits as (select *, coalesce(wall, m.far, ending) as distance, case when wall is null and m is not null then m.mx else cx + dx * coalesce(wall, ending) end as hx, case when wall is null and m is not null then m.my else cy + dy * coalesce(wall, ending) end as hy from hx)"""
LW = ("v_sheets", "v_text_blocks", "v_segments")


@query("ray_hits", f"with {HITS} select doc_id, page_no, block_idx as cluster_idx, cast(ray as int) as ray, round(distance, 4) as distance, wall is not null as is_wall from hits", *LW)
def ray_hits(spark, d):
    return written(cast(spark, d, singles(spark, d)).select(*K, "cluster_idx", "ray", "distance", "is_wall")).select(*K, "cluster_idx", "ray", F.round("distance", 4).alias("distance"), "is_wall")


BOUNDS = f"""{HITS},
pts as (select *, round((atan2(hy - cy, hx - cx) + 2 * pi()) % (2 * pi()), 9) as turn from hits),
nx as (
  select *, coalesce(lead(hx) over w, first_value(hx) over w) as nhx, coalesce(lead(hy) over w, first_value(hy) over w) as nhy,
    coalesce(lead(hx) over r, first_value(hx) over r) as rhx, coalesce(lead(hy) over r, first_value(hy) over r) as rhy
  from pts window w as (partition by doc_id, page_no, block_idx order by turn, ray), r as (partition by doc_id, page_no, block_idx order by ray)),
cr as (
  select distinct doc_id, page_no, block_idx from nx a join (select doc_id, page_no, block_idx, hx as px, hy as py, rhx as qx, rhy as qy from nx) b using (doc_id, page_no, block_idx)
  where ((rhx - hx) * (py - hy) - (rhy - hy) * (px - hx)) * ((rhx - hx) * (qy - hy) - (rhy - hy) * (qx - hx)) < -1e-9
    and ((qx - px) * (hy - py) - (qy - py) * (hx - px)) * ((qx - px) * (rhy - py) - (qy - py) * (rhx - px)) < -1e-9),
ar as (
  select doc_id, page_no, block_idx, any_value(label) as label, any_value(confidence) as l, count(*) filter (wall is not null) as wall_hits,
    count(*) filter (wall is not null) / 16 as completeness, abs(sum(hx * nhy - nhx * hy)) / 2 as by_turn, abs(sum(hx * rhy - rhx * hy)) / 2 as by_ray
  from nx group by doc_id, page_no, block_idx),
bd as (
  select ar.*, cr.block_idx is not null as repaired, case when cr.block_idx is not null then by_turn else by_ray end as area
  from ar left join cr using (doc_id, page_no, block_idx)),
bounds as (
  select *, case when area < 100 then 'ESTIMATED' when completeness >= 0.9 then 'CLOSED' when completeness >= 0.5 then 'PARTIAL' else 'RAY_CAST' end as method,
    case when area < 100 then 0.2 when completeness >= 0.9 then 0.95 when completeness >= 0.5 then 0.6 + (completeness - 0.5) * 0.5 else 0.3 + 0.4 * completeness end as b
  from bd)"""


@query("label_boundaries", f"with {BOUNDS} select doc_id, page_no, block_idx as cluster_idx, wall_hits, round(area, 1) as area, repaired, method, round(b, 4) as confidence from bounds", *LW)
def label_boundaries(spark, d):
    return boundaries(spark, d, singles(spark, d)).select(*K, "cluster_idx", "wall_hits", F.round("area", 1).alias("area"), "repaired", "method", F.round("confidence", 4).alias("confidence"))


def keyed(spark, d, c, walls=None):
    b = boundaries(spark, d, c, walls)
    return b, D.boundaries_by_text(b, c)


@query("boundaries_by_text", f"with {BOUNDS} select doc_id, page_no, label as label_text, max(block_idx) as cluster_idx, max_by(method, block_idx) as method, round(max_by(area, block_idx), 1) as area from bounds group by all", *LW)
def boundaries_by_text(spark, d):
    return keyed(spark, d, singles(spark, d))[1].select(*K, "label_text", "cluster_idx", "method", F.round("area", 1).alias("area"))


ROOMS = f"""{BOUNDS}, kb as (select doc_id, page_no, label, max_by(area, block_idx) as area, max_by(method, block_idx) as method, max_by(b, block_idx) as b from bounds group by all),
dr as (select bounds.doc_id, bounds.page_no, bounds.label, block_idx, l, kb.area, kb.method, kb.b, min(block_idx) over g as first, max(block_idx) over g as last from bounds join kb using (doc_id, page_no, label) where kb.method <> 'ESTIMATED' window g as (partition by doc_id, page_no, label)),
rooms as (select doc_id, page_no, case when block_idx = first then label else label || '_ALT' end as name, block_idx, method, case method when 'CLOSED' then least(0.95, l * 1.1) when 'PARTIAL' then least(0.85, l * b) else least(0.7, l * b) end as confidence, area / 81 as area_sqft from dr where block_idx in (first, last))"""


def single_rooms(spark, d):
    c = singles(spark, d)
    return D.detected_rooms(c, keyed(spark, d, c)[1], F.lit(9.0))


@query("detected_singles", f"with {ROOMS} select doc_id, page_no, name, method, round(confidence, 8) as confidence, round(area_sqft, 2) as area_sqft from rooms", *LW)
def detected_singles(spark, d):
    return single_rooms(spark, d).select(*K, "name", "method", F.round("confidence", 8).alias("confidence"), F.round("area_sqft", 2).alias("area_sqft"))


@query("finalize_detected", f"with {ROOMS} select doc_id, page_no, format('room_{{:03d}}_{{:03d}}', page_no, row_number() over (partition by doc_id, page_no order by block_idx, name) - 1) as room_id, name, case when round(confidence, 9) >= 0.85 then 'HIGH' when round(confidence, 9) >= 0.6 then 'MEDIUM' else 'LOW' end as level from rooms", *LW)
def finalize_detected(spark, d):
    return D.finalize_detected(single_rooms(spark, d).withColumn("confidence", F.round("confidence", 9))).select(*K, "room_id", "name", "level")


@query("boundary_methods", f"with {ROOMS} select doc_id, page_no, count(*) filter (method = 'CLOSED') as closed, count(*) filter (method = 'PARTIAL') as partial_, count(*) filter (method = 'RAY_CAST') as ray_cast from rooms group by all", *LW)
def boundary_methods(spark, d):
    return D.boundary_methods(single_rooms(spark, d)).select(*K, F.col("CLOSED").alias("closed"), F.col("PARTIAL").alias("partial_"), F.col("RAY_CAST").alias("ray_cast"))


@query("detected_rooms", f"""with {ROOMS.replace(LB, CLUSTERED)}
select doc_id, page_no, format('room_{{:03d}}_{{:03d}}', page_no, row_number() over (partition by doc_id, page_no order by block_idx, name) - 1) as room_id, name, method,
  case when confidence >= 0.85 then 'HIGH' when confidence >= 0.6 then 'MEDIUM' else 'LOW' end as level, round(area_sqft, 2) as area_sqft from rooms""", *LW)
def detected_rooms(spark, d):
    """The flagship: clustered labels, rays, boundaries and measured rooms."""
    # A room goes by its cluster's primary label.
    c = written(clusters(spark, d).withColumn("label_text", F.col("primary_label")))
    rooms = D.finalize_detected(D.detected_rooms(c, keyed(spark, d, c)[1], F.lit(9.0)))
    return rooms.select(*K, "room_id", "name", "method", "level", F.round("area_sqft", 2).alias("area_sqft"))


@query("detection_totals", f"""with {ROOMS}, n1 as (select doc_id, page_no, count(*) as labels from lb group by all), n2 as (select doc_id, page_no, count(*) as walls from walls group by all), n3 as (select doc_id, page_no, count(*) as boundaries from bounds where method <> 'ESTIMATED' group by all), n4 as (select doc_id, page_no, round(sum(area_sqft), 2) as total_area from rooms group by all)
select doc_id, page_no, labels, labels as clusters, coalesce(walls, 0) as walls, coalesce(boundaries, 0) as boundaries, round(coalesce(total_area, 0), 1) as total_area from n1 left join n2 using (doc_id, page_no) left join n3 using (doc_id, page_no) left join n4 using (doc_id, page_no)""", *LW)
def detection_totals(spark, d):
    c = singles(spark, d)
    walls = written(wall_rows(spark, d))
    b, k = keyed(spark, d, c, walls)
    return D.detection_totals(c, c, walls, b, D.detected_rooms(c, k, F.lit(9.0))).withColumn("total_area", F.round("total_area", 1))


INSIDE = """pg as (select *, case when notch = 1 then w * h * 0.75 else w * h end as area, case when notch = 1 then (x0 + w / 2) * 4 / 3 - (x0 + w * 0.75) / 3 else x0 + w / 2 end as gx, case when notch = 1 then (y0 + h / 2) * 4 / 3 - (y0 + h * 0.75) / 3 else y0 + h / 2 end as gy from v_polygons),
ip as (select lb.doc_id, lb.page_no, lb.block_idx, poly_idx, area from lb join pg using (doc_id, page_no) where area >= 8000 and cx > x0 and cx < x0 + w and cy > y0 and cy < y0 + h and not (notch = 1 and cx >= x0 + w / 2 and cy >= y0 + h / 2)),
cp as (select doc_id, page_no, block_idx, arg_max(poly_idx, [area, -poly_idx]) as poly_idx, max(area) as area from ip group by all)"""


@query("containing_polygon", f"with {HITS}, {INSIDE} select doc_id, page_no, block_idx as cluster_idx, poly_idx, cp.area, case when poly_idx is null then 'ESTIMATED' else 'CLOSED' end as method from lb left join cp using (doc_id, page_no, block_idx)", *LW, "v_polygons")
def containing_polygon(spark, d):
    found = D.containing_polygon(singles(spark, d), views.polygons(spark, d), least=8000.0, near=-1.0)
    return found.select(*K, "cluster_idx", "poly_idx", "area", "method")


@query("boundaries_combined", f"with {BOUNDS}, {INSIDE} select doc_id, page_no, block_idx as cluster_idx, round(case when poly_idx is null then bounds.area else cp.area end, 1) as area, case when poly_idx is null then method else 'CLOSED' end as method from bounds left join cp using (doc_id, page_no, block_idx)", *LW, "v_polygons")
def boundaries_combined(spark, d):
    c = singles(spark, d)
    found = D.boundaries_combined(D.containing_polygon(c, views.polygons(spark, d), least=8000.0, near=-1.0), boundaries(spark, d, c))
    return found.select(*K, "cluster_idx", F.round("area", 1).alias("area"), "method")


@query("boundary_overlaps", None)
def boundary_overlaps(spark, d):
    return D.boundary_overlaps(boundaries(spark, d, singles(spark, d)))


@query("detection_fallback", f"""with {ROOMS}, fb as (select doc_id, page_no, concat('ROOM ', cast(poly_idx + 1 as varchar)) as name, 'GEOMETRY' as method from v_polygons)
select doc_id, page_no, name, method from rooms where page_no % 3 <> 0 union all select doc_id, page_no, name, method from fb anti join (select distinct doc_id, page_no from rooms where page_no % 3 <> 0) using (doc_id, page_no)""", *LW, "v_polygons")
def detection_fallback(spark, d):
    """Sheets divisible by three are taken as failed, so the fallback has work."""
    found = single_rooms(spark, d).where("page_no % 3 <> 0").select(*K, "name", "method")
    polys = views.polygons(spark, d).select(*K, F.format_string("ROOM %d", F.col("poly_idx") + 1).alias("name"), F.lit("GEOMETRY").alias("method"))
    return D.with_fallback(found, polys)



