"""Queries over wall topology. Greedy ones and components have recursive SQL; faces have none, and tests hold them against known cases and Euler's formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetloom.functions.geom import area
from sheetloom.functions.lineage import written
from sheetloom.operators import detect as D
from sheetloom.operators import segments as S
from sheetloom.operators import topology as T
from sheetloom.plans.catalog_segments import GEO, REASON, whole_walls_only
from sheetloom.sources import views
from sheetloom.sources.views import K, matched, sql

QUERIES: dict = {}
SQL: dict = {}


def query(key: str, text: str | None = None, *names: str):
    def add(f):
        QUERIES[key] = f
        if text:
            SQL[key] = sql(f"with {GEO}, {text[5:]}" if text.startswith("with ") else f"with {GEO} {text}", "v_sheets", "v_segments", *names)
        return f

    return add


def walls(spark, d):
    return S.wall_segments(views.segments(spark, d), views.sheets(spark, d)).select(*K, "seg_idx", "x1", "y1", "x2", "y2", "width", "dashes", "fill", "fill_type", "color")


WALLS = f"walls as (select * from gp where {REASON} is null)"


ALONG = "(b.x{n} - a.x1) * (a.x2 - a.x1) + (b.y{n} - a.y1) * (a.y2 - a.y1)"
PAIRS = f"""{WALLS}, pairs as (
  select a.doc_id, a.page_no, a.seg_idx as i, b.seg_idx as j from walls a join walls b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.seg_idx < b.seg_idx
  where least(abs(a.ang - b.ang), 180 - abs(a.ang - b.ang)) < 3 and abs((a.y2 - a.y1) * b.mx - (a.x2 - a.x1) * b.my + a.x2 * a.y1 - a.y2 * a.x1) / a.len <= 10
    and greatest(a.len, b.len) <= 1.2 * least(a.len, b.len) and least({ALONG.format(n=1)}, {ALONG.format(n=2)}) / a.len < a.len and greatest({ALONG.format(n=1)}, {ALONG.format(n=2)}) / a.len > 0)"""


@query("parallel_pairs", f"with {PAIRS} select doc_id, page_no, i, j from pairs")
def parallel_pairs(spark, d):
    return T.parallel_pairs(walls(spark, d))


LOOSE_ENDS = f"""{WALLS},
e as (select doc_id, page_no, seg_idx, cast(n as int) as side, case n when 0 then x1 else x2 end as x, case n when 0 then y1 else y2 end as y from walls, range(2) t(n)),
c as (select *, count(*) over (partition by doc_id, page_no, round_even(x / 2, 0), round_even(y / 2, 0)) as k from e),
ends as (select doc_id, page_no, seg_idx, side, x, y from c where k = 1)"""


@query("dangling_endpoints", f"with {LOOSE_ENDS} select doc_id, page_no, seg_idx, side, x, y from ends")
def dangling_endpoints(spark, d):
    return T.dangling_endpoints(walls(spark, d))


@query("merge_double_walls", f"""with {PAIRS}, {matched("pairs", "i", "j", "i, j")},
two as (
  select a.doc_id, a.page_no, a.seg_idx, (a.mx + b.mx) / 2 as cx, (a.my + b.my) / 2 as cy, radians((a.ang + b.ang) / 2) as turn, greatest(a.len, b.len) / 2 as half, (coalesce(a.w, 1) + coalesce(b.w, 1)) / 2 as w
  from taken t join walls a on a.doc_id = t.doc_id and a.page_no = t.page_no and a.seg_idx = t.i join walls b on b.doc_id = t.doc_id and b.page_no = t.page_no and b.seg_idx = t.j),
one as (select * from walls where (doc_id, page_no, seg_idx) not in (select (doc_id, page_no, unnest([i, j])) from taken))
select doc_id, page_no, seg_idx, round(cx - cos(turn) * half, 4) as x1, round(cy - sin(turn) * half, 4) as y1, round(cx + cos(turn) * half, 4) as x2, round(cy + sin(turn) * half, 4) as y2, round(w, 4) as width, true as merged from two
union all select doc_id, page_no, seg_idx, round(x1, 4), round(y1, 4), round(x2, 4), round(y2, 4), round(w, 4), false from one""")
def merge_double_walls(spark, d):
    return T.merge_double_walls(walls(spark, d)).select(*K, "seg_idx", *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2", "width")), "merged")


#: Which side of the line through two points a third lies on.
SIDE = "(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
CUTS = " and ".join(f"{SIDE.format(p=p, q=q, r=r)} * {SIDE.format(p=p, q=q, r=t)} < -1e-9" for p, q, r, t in (("p", "q", "s", "t"), ("s", "t", "p", "q")))


@query("bridge_gaps", f"""with {LOOSE_ENDS},
dn as (select *, row_number() over (partition by doc_id, page_no order by seg_idx, side) as nth, format('{{:.1f}}/{{:.1f}}', x, y) as node from ends),
pr as (
  select p.doc_id, p.page_no, p.nth, q.nth as o_nth, p.node, q.node as o_node, p.x as px, p.y as py, q.x as qx, q.y as qy, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) as far
  from dn p join dn q on p.doc_id = q.doc_id and p.page_no = q.page_no and p.nth <> q.nth and p.seg_idx <> q.seg_idx
  where sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) between 18 and 130),
ps as (
  select pr.doc_id, pr.page_no, nth, o_nth, px, py, qx, qy, x1 as sx, y1 as sy, x2 as tx, y2 as ty, (px + qx) / 2 as mx, (py + qy) / 2 as my
  from pr join walls using (doc_id, page_no)),
pt as (
  select *, greatest(0, least(1, coalesce(((mx - sx) * (tx - sx) + (my - sy) * (ty - sy)) / nullif((tx - sx) * (tx - sx) + (ty - sy) * (ty - sy), 0), 0))) as u from ps),
bl as (
  select distinct doc_id, page_no, nth, o_nth from pt
  where ({CUTS}) or sqrt((mx - sx - u * (tx - sx)) * (mx - sx - u * (tx - sx)) + (my - sy - u * (ty - sy)) * (my - sy - u * (ty - sy))) < 2),
fr as (select * from pr anti join bl using (doc_id, page_no, nth, o_nth)),
{matched("fr", "node", "o_node", "nth, round(far, 6), o_nth")}
select doc_id, page_no, px as x1, py as y1, qx as x2, qy as y2 from taken""")
def bridge_gaps(spark, d):
    return T.bridge_gaps(walls(spark, d), 130.0)


@query("node_segments", f"""with {WALLS},
sg as (select doc_id, page_no, seg_idx, x1, y1, x2, y2, x2 - x1 as dx, y2 - y1 as dy from walls where x1 <> x2 or y1 <> y2),
pr as (
  select a.doc_id, a.page_no, a.seg_idx, a.dx * b.dy - a.dy * b.dx as det, b.x1 - a.x1 as qx, b.y1 - a.y1 as qy, b.x2 - a.x1 as rx, b.y2 - a.y1 as ry, a.dx, a.dy, b.dx as ex, b.dy as ey
  from sg a join sg b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.seg_idx <> b.seg_idx
  where least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 1e-5 and least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 1e-5 and least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 1e-5 and least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 1e-5),
ct as (
  select doc_id, page_no, seg_idx, unnest(case
    when abs(det) > 1e-9 then case when (qx * ey - qy * ex) / det between -1e-9 and 1 + 1e-9 and (qx * dy - qy * dx) / det between -1e-9 and 1 + 1e-9 then [(qx * ey - qy * ex) / det] else cast([] as double[]) end
    when abs(qx * dy - qy * dx) <= 1e-6 * sqrt(dx * dx + dy * dy) then [(qx * dx + qy * dy) / (dx * dx + dy * dy), (rx * dx + ry * dy) / (dx * dx + dy * dy)] else cast([] as double[]) end) as t from pr),
cs as (select doc_id, page_no, seg_idx, list(distinct round(t, 9)) as ts from ct where t > 1e-9 and t < 1 - 1e-9 group by all),
al as (select sg.*, list_sort(list_concat([0.0, 1.0], coalesce(ts, cast([] as double[])))) as ts from sg left join cs using (doc_id, page_no, seg_idx)),
pa as (select doc_id, page_no, x1, y1, x2 - x1 as dx, y2 - y1 as dy, ts[i] as p, ts[i + 1] as q from (select *, unnest(range(1, len(ts))) as i from al)),
ed as (select doc_id, page_no, list_sort([{{'x': round(x1 + p * dx, 4), 'y': round(y1 + p * dy, 4)}}, {{'x': round(x1 + q * dx, 4), 'y': round(y1 + q * dy, 4)}}]) as e from pa)
select distinct doc_id, page_no, e[1].x as x1, e[1].y as y1, e[2].x as x2, e[2].y as y2 from ed where e[1].x <> e[2].x or e[1].y <> e[2].y""")
def node_segments(spark, d):
    return T.node_segments(walls(spark, d)).select(*K, *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("polygonize")
def polygonize(spark, d):
    return T.faces(T.node_segments(walls(spark, d))).select(*K, "poly_idx", F.round("area", 4).alias("area"), F.round("hole_area", 4).alias("hole_area"), F.size("vertices").alias("corners"), "dangles", "cuts")


@query("filter_polygons", "select doc_id, page_no, poly_idx from v_polygons join v_sheets using (doc_id, page_no) where case when notch = 1 then w * h * 0.75 else w * h end between 10000 and 0.85 * page_width * page_height", "v_polygons")
def filter_polygons(spark, d):
    return T.filter_polygons(views.polygons(spark, d), views.sheets(spark, d)).select(*K, "poly_idx")


#: A polygon as one rectangle, or a notched one as two; what two polygons share is what their rectangles share.
SHARED = """rc as (
  select doc_id, page_no, poly_idx, x0 as rx0, y0 as ry0, x0 + w as rx1, case when notch = 1 then y0 + h / 2 else y0 + h end as ry1 from v_polygons
  union all select doc_id, page_no, poly_idx, x0, y0 + h / 2, x0 + w / 2, y0 + h from v_polygons where notch = 1),
ar as (select doc_id, page_no, poly_idx, sum((rx1 - rx0) * (ry1 - ry0)) as area from rc group by all),
sh as (
  select a.doc_id, a.page_no, a.poly_idx as a, b.poly_idx as b, sum(greatest(0, least(a.rx1, b.rx1) - greatest(a.rx0, b.rx0)) * greatest(0, least(a.ry1, b.ry1) - greatest(a.ry0, b.ry0))) as shared
  from rc a join rc b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.poly_idx < b.poly_idx group by all),
ov as (
  select sh.*, p.area as area_a, q.area as area_b from sh
  join ar p on p.doc_id = sh.doc_id and p.page_no = sh.page_no and p.poly_idx = a join ar q on q.doc_id = sh.doc_id and q.page_no = sh.page_no and q.poly_idx = b)"""


@query("suppress_overlaps", f"""with {SHARED},
lost as (select distinct doc_id, page_no, case when area_a > area_b then a else b end as poly_idx from ov where shared > 0.9 * area_a and shared > 0.9 * area_b)
select doc_id, page_no, poly_idx, round(area, 2) as area from ar anti join lost using (doc_id, page_no, poly_idx)""", "v_polygons")
def suppress_overlaps(spark, d):
    return T.suppress_overlaps(views.polygons(spark, d)).select(*K, "poly_idx", F.round(area(F.col("vertices")), 2).alias("area"))


@query("polygon_overlaps", f"""with {SHARED}
select doc_id, page_no, a as cluster_idx, list(format('Overlaps boundary {{}}', b) order by format('Overlaps boundary {{}}', b)) as warnings from ov
where shared > 0.3 * least(area_a, area_b) group by all""", "v_polygons")
def polygon_overlaps(spark, d):
    """Overlap warnings where polygons of the drawing are the boundaries."""
    return D.boundary_overlaps(views.polygons(spark, d).select(*K, F.col("poly_idx").alias("cluster_idx"), "vertices", F.lit("CLOSED").alias("method")))


@query("room_polygons")
def room_polygons(spark, d):
    return T.room_polygons(walls(spark, d), views.sheets(spark, d)).select(*K, "room", F.round("area", 2).alias("area"), "confidence", "required_bridging")


@query("isolated_components", f"""with {WALLS},
en as (select distinct doc_id, page_no, seg_idx, cast(round_even(case n when 0 then x1 else x2 end / 5, 0) as bigint) as cx, cast(round_even(case n when 0 then y1 else y2 end / 5, 0) as bigint) as cy from walls, range(2) t(n)),
ld as (select doc_id, page_no, cx, cy, min(seg_idx) as seg_idx from en group by all),
lk as (
  select distinct a.doc_id, a.page_no, unnest([a.seg_idx, b.seg_idx]) as u, unnest([b.seg_idx, a.seg_idx]) as v
  from en a join ld b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.seg_idx <> b.seg_idx and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1),
 fold as (
  select doc_id, page_no, seg_idx, seg_idx as root from walls
  union select lk.doc_id, lk.page_no, lk.v, fold.root from fold join lk on lk.doc_id = fold.doc_id and lk.page_no = fold.page_no and lk.u = fold.seg_idx and fold.root < lk.v),
rt as (select doc_id, page_no, seg_idx, min(root) as root from fold group by all),
sz as (select *, count(*) over (partition by doc_id, page_no, root) as size, count(*) over (partition by doc_id, page_no) as n from rt)
select doc_id, page_no, seg_idx, root, size, size >= 3 or n < 3 as kept from sz""")
def isolated_components(spark, d):
    return T.isolated_components(walls(spark, d))


@query("wall_network")
def wall_network(spark, d):
    return whole_walls_only(spark, d)


@query("door_swings", """with sh as (
  select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len, (x1 + x2) / 2 as mx, (y1 + y2) / 2 as my from v_segments
  where sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) <= 100),
en as (select distinct doc_id, page_no, seg_idx, round_even(case n when 0 then x1 else x2 end / 15, 0) as cx, round_even(case n when 0 then y1 else y2 end / 15, 0) as cy from sh, range(2) t(n)),
ld as (select doc_id, page_no, cx, cy, min(seg_idx) as lead from en group by all),
lk as (select distinct doc_id, page_no, unnest([seg_idx, lead]) as u, unnest([lead, seg_idx]) as v from en join ld using (doc_id, page_no, cx, cy) where seg_idx <> lead),
 fold as (
  select doc_id, page_no, seg_idx, seg_idx as root from sh
  union select lk.doc_id, lk.page_no, lk.v, fold.root from fold join lk on lk.doc_id = fold.doc_id and lk.page_no = fold.page_no and lk.u = fold.seg_idx and fold.root < lk.v),
rt as (select doc_id, page_no, seg_idx, min(root) as root from fold group by all),
chained as (select doc_id, page_no, seg_idx from (select *, count(*) over (partition by doc_id, page_no, root) as size from rt) where size >= 3),
full_ as (
  select * from (select *, count(*) over (partition by doc_id, page_no, gx, gy) as m from (select *, cast(trunc(mx / 50) as bigint) as gx, cast(trunc(my / 50) as bigint) as gy from sh where len >= 5)) where m > 3),
pv as (select doc_id, page_no, seg_idx, gx, gy, n as side, case n when 0 then x1 else x2 end as px, case n when 0 then y1 else y2 end as py from full_, range(2) t(n)),
fa as (
  select pv.doc_id, pv.page_no, pv.seg_idx, side, o.seg_idx as o, sqrt((o.mx - px) * (o.mx - px) + (o.my - py) * (o.my - py)) as far
  from pv join full_ o on o.doc_id = pv.doc_id and o.page_no = pv.page_no and o.gx = pv.gx and o.gy = pv.gy and o.seg_idx <> pv.seg_idx),
nr as (select * from fa where far > 20 and far < 120),
ev as (select doc_id, page_no, seg_idx, side from nr group by all having count(*) >= 3 and var_pop(far) < 100),
hit as (select distinct doc_id, page_no, unnest([seg_idx, o]) as seg_idx from nr join ev using (doc_id, page_no, seg_idx, side))
select * from chained union select * from hit""")
def door_swings(spark, d):
    return T.door_swings(views.segments(spark, d))


@query("curved_segments", """with sh as (
  select doc_id, page_no, seg_idx, x1, y1, x2, case when x1 <> x2 and y1 <> y2 then y1 + 24 + seg_idx % 4 * 6 else y2 end as y2 from v_segments),
en as (
  select doc_id, page_no, seg_idx, round_even(case n when 0 then x1 else x2 end / 5, 0) as cx, round_even(case n when 0 then y1 else y2 end / 5, 0) as cy,
    round(case n when 0 then atan2(y2 - y1, x2 - x1) else atan2(y1 - y2, x1 - x2) end, 9) as turn from sh, range(2) t(n) where sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) <= 60),
ld as (select *, unnest([1, 2, 3]) as k, [lead(seg_idx, 1) over w, lead(seg_idx, 2) over w, lead(seg_idx, 3) over w] as o, [lead(turn, 1) over w, lead(turn, 2) over w, lead(turn, 3) over w] as ot from en window w as (partition by doc_id, page_no, cx, cy order by turn, seg_idx)),
hit as (select doc_id, page_no, seg_idx, o[k] as other from ld where least(ot[k] - turn, 2 * pi() - (ot[k] - turn)) > 0.05 and least(ot[k] - turn, 2 * pi() - (ot[k] - turn)) < 0.6)
select distinct doc_id, page_no, unnest([seg_idx, other]) as seg_idx from hit""")
def curved_segments(spark, d):
    """Slanted segments drawn under several angles, as chords of arcs are."""
    slant = (F.col("x1") != F.col("x2")) & (F.col("y1") != F.col("y2"))
    s = views.segments(spark, d).withColumn("y2", F.when(slant, F.col("y1") + 24 + F.col("seg_idx") % 4 * 6).otherwise(F.col("y2")))
    return T.curved_segments(written(s))


@query("label_boxes", """with mv as (
  select doc_id, page_no, seg_idx, x1 + dx as x1, y1 + dy as y1, x1 + (x2 - x1) / 2 + dx as x2, y1 + (y2 - y1) / 2 + dy as y2
  from (select *, case when x1 = x2 and seg_idx % 3 = 0 then 60.0 else 0.0 end as dx, case when y1 = y2 and seg_idx % 4 = 0 then 50.0 else 0.0 end as dy from v_segments)),
sz as (select * from mv where sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) between 15 and 80),
lv as (select doc_id, page_no, seg_idx, least(x1, x2) as l, greatest(x1, x2) as r, (y1 + y2) / 2 as y from sz where abs(y2 - y1) < 1),
up as (select doc_id, page_no, seg_idx, (x1 + x2) / 2 as x, least(y1, y2) as t, greatest(y1, y2) as u from sz where abs(x2 - x1) < 1),
pr as (
  select a.doc_id, a.page_no, a.seg_idx as a, b.seg_idx as b, a.l, a.r, a.y, b.y as oy from lv a join lv b on a.doc_id = b.doc_id and a.page_no = b.page_no
  where b.y > a.y and b.y - a.y between 5 and 80 and least(a.r, b.r) - greatest(a.l, b.l) >= 0.5 * least(a.r - a.l, b.r - b.l)),
sd as (
  select pr.doc_id, pr.page_no, a, b, up.seg_idx as s, abs(x - l) <= 5 as is_left, abs(x - r) <= 5 as is_right from pr join up using (doc_id, page_no)
  where t <= y + 5 and u >= oy - 5 and (abs(x - l) <= 5 or abs(x - r) <= 5)),
bx as (select doc_id, page_no, a, b, list(s) as ss from sd group by all having bool_or(is_left) and bool_or(is_right))
select distinct doc_id, page_no, unnest(list_concat([a, b], ss)) as seg_idx from bx""")
def label_boxes(spark, d):
    """Segments drawn at half size, every fourth level one repeated below itself and every third upright moved to its side."""
    s = views.segments(spark, d)
    level, up = F.col("y1") == F.col("y2"), F.col("x1") == F.col("x2")
    x2, y2 = F.col("x1") + (F.col("x2") - F.col("x1")) / 2, F.col("y1") + (F.col("y2") - F.col("y1")) / 2
    low, aside = level & (F.col("seg_idx") % 4 == 0), up & (F.col("seg_idx") % 3 == 0)
    dx, dy = F.when(aside, 60.0).otherwise(0.0), F.when(low, 50.0).otherwise(0.0)
    return T.label_boxes(s.select(*K, "seg_idx", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (x2 + dx).alias("x2"), (y2 + dy).alias("y2"), "dashes", "fill", "fill_type"))
