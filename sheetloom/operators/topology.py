"""Wall topology: double walls, gaps, noding, faces, and graph filters of segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.geom import angle, angle_between, area, common_corner, covered, length, line_distance, ratio
from sheetloom.functions.greedy import components, priority_matching
from sheetloom.functions.lineage import written
from sheetloom.operators.detect import overlaps
from sheetloom.operators.planar import faces
from sheetloom.operators.segments import around, ends, grid_chains, walls_only, with_geometry
from sheetloom.sources.views import K

ID = [*K, "seg_idx"]
EPS = 1e-9


def boxed(df: DataFrame, cell: float, grow: Column | float = 0.0) -> DataFrame:
    g = grow if isinstance(grow, Column) else F.lit(grow)
    return covered(df, cell, F.least("x1", "x2") - g, F.least("y1", "y2") - g, F.greatest("x1", "x2") + g, F.greatest("y1", "y2") + g)


def measured(segments: DataFrame, *more: str) -> DataFrame:
    """ID, x1, y1, x2, y2, length, angle, mid_x, mid_y and more columns."""
    middle = {"mid_x": (F.col("x1") + F.col("x2")) / 2, "mid_y": (F.col("y1") + F.col("y2")) / 2}
    return segments.select(*ID, "x1", "y1", "x2", "y2", length().alias("length"), angle().alias("angle"), *(v.alias(k) for k, v in middle.items()), *more)


def lines_of(segments: DataFrame, *more: str) -> DataFrame:
    """ID, x1, y1, x2, y2 and more columns, worked out once and dealt out by sheet: joins by sheet and cell that end in `written` move nothing more."""
    return written(segments.select(*ID, "x1", "y1", "x2", "y2", *more)).repartition(*K)


def parallel_pairs(segments: DataFrame, gap: float = 10.0, turn: float = 3.0, longer: float = 1.2, cell: float = 128.0) -> DataFrame:
    """K, i, j (i < j): nearly parallel segments of like length side by side, by a join on grid cells."""
    g = measured(segments)
    left = boxed(g, cell, F.lit(gap) + 0.06 * F.col("length")).withColumnRenamed("seg_idx", "i")
    right = boxed(g, cell).select(*K, "gx", "gy", F.col("seg_idx").alias("j"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2", "length", "angle", "mid_x", "mid_y")))
    ux, uy = ratio(F.col("x2") - F.col("x1"), F.col("length")), ratio(F.col("y2") - F.col("y1"), F.col("length"))
    on = lambda x, y: (F.col(x) - F.col("x1")) * ux + (F.col(y) - F.col("y1")) * uy
    a, b = on("o_x1", "o_y1"), on("o_x2", "o_y2")
    near = line_distance(F.col("o_mid_x"), F.col("o_mid_y"), *(F.col(c) for c in ("x1", "y1", "x2", "y2"))) <= gap
    alike = F.greatest("length", "o_length") <= longer * F.least("length", "o_length")
    pair = left.join(right, [*K, "gx", "gy"]).where((F.col("i") < F.col("j")) & (angle_between(F.col("angle"), F.col("o_angle")) < turn) & near & alike & (F.least(a, b) < F.col("length")) & (F.greatest(a, b) > 0))
    return pair.select(*K, "i", "j").distinct()


def merge_double_walls(segments: DataFrame) -> DataFrame:
    """Segments with pairs replaced by their centreline (merged true), first pairs first; ids of the first of a pair stay."""
    own = lines_of(segments, "width")
    edges = parallel_pairs(own).withColumn("rank", F.format_string("%08d-%08d", "i", "j"))
    taken = priority_matching(edges, "i", "j").select(*K, "i", "j").repartition(*K)
    g = measured(own.withColumn("width", F.coalesce("width", F.lit(1.0))), "width")
    one = taken.join(g.withColumnRenamed("seg_idx", "i"), [*K, "i"])
    two = one.join(g.select(*K, F.col("seg_idx").alias("j"), *(F.col(c).alias(f"o_{c}") for c in ("length", "angle", "mid_x", "mid_y", "width"))), [*K, "j"])
    mx, my, turn = (F.col("mid_x") + F.col("o_mid_x")) / 2, (F.col("mid_y") + F.col("o_mid_y")) / 2, F.radians((F.col("angle") + F.col("o_angle")) / 2)
    dx, dy = F.cos(turn) * F.greatest("length", "o_length") / 2, F.sin(turn) * F.greatest("length", "o_length") / 2
    centre = two.select(*K, F.col("i").alias("seg_idx"), (mx - dx).alias("x1"), (my - dy).alias("y1"), (mx + dx).alias("x2"), (my + dy).alias("y2"), ((F.col("width") + F.col("o_width")) / 2).alias("width"), F.lit(True).alias("merged"))
    used = taken.select(*K, F.explode(F.array("i", "j")).alias("seg_idx"))
    rest = own.join(used, ID, "left_anti").select(*ID, "x1", "y1", "x2", "y2", "width", F.lit(False).alias("merged"))
    return written(centre.unionByName(rest))


def endpoints(segments: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("side"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    return segments.select(*ID, F.inline(both))


def dangling_endpoints(segments: DataFrame, cell: float = 2.0) -> DataFrame:
    """ID, side, x, y of ends that are alone in their cell (rounded half to even)."""
    by = Window.partitionBy(*K, F.rint(F.col("x") / cell), F.rint(F.col("y") / cell))
    return endpoints(segments).withColumn("n", F.count("*").over(by)).where("n = 1").drop("n")


def bridge_gaps(segments: DataFrame, tolerance: float = 36.0, least: float = 18.0, most: float = 288.0, beside: float = 2.0, cell: float = 128.0) -> DataFrame:
    """Bridges K, x1, y1, x2, y2 between dangling ends: nearest first per end in order, none across a segment or with its midpoint under `beside` from one."""
    reach = min(max(tolerance, least), most)
    key = lambda x, y: F.format_string("%.1f/%.1f", x, y)
    own = lines_of(segments)
    d = dangling_endpoints(own).withColumn("nth", F.row_number().over(Window.partitionBy(*K).orderBy("seg_idx", "side")))
    a = covered(d, reach, F.col("x") - reach, F.col("y") - reach, F.col("x") + reach, F.col("y") + reach)
    b = d.select(*K, F.col("nth").alias("o_nth"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("seg_idx").alias("o_seg"), F.floor(F.col("x") / reach).alias("gx"), F.floor(F.col("y") / reach).alias("gy"))
    far = F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"))
    met = a.join(b, [*K, "gx", "gy"]).where("nth <> o_nth and seg_idx <> o_seg").where(far.between(least, reach)).select(*K, "nth", "o_nth", "x", "y", "ox", "oy")
    pair = written(met).repartition(*K)
    s = own.select(*K, *(F.col(c).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")))
    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    cuts = (side("x", "y", "ox", "oy", "sx1", "sy1") * side("x", "y", "ox", "oy", "sx2", "sy2") < -EPS) & (side("sx1", "sy1", "sx2", "sy2", "x", "y") * side("sx1", "sy1", "sx2", "sy2", "ox", "oy") < -EPS)
    box = (F.least("sx1", "sx2") <= F.greatest("x", "ox")) & (F.greatest("sx1", "sx2") >= F.least("x", "ox")) & (F.least("sy1", "sy2") <= F.greatest("y", "oy")) & (F.greatest("sy1", "sy2") >= F.least("y", "oy"))
    # What is near the midpoint is as near to the bridge.
    mx, my, dx, dy = (F.col("x") + F.col("ox")) / 2, (F.col("y") + F.col("oy")) / 2, F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio((mx - F.col("sx1")) * dx + (my - F.col("sy1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    along = F.hypot(mx - F.col("sx1") - t * dx, my - F.col("sy1") - t * dy) < beside
    left = covered(pair, cell, F.least("x", "ox") - beside, F.least("y", "oy") - beside, F.greatest("x", "ox") + beside, F.greatest("y", "oy") + beside)
    right = covered(s, cell, F.least("sx1", "sx2"), F.least("sy1", "sy2"), F.greatest("sx1", "sx2"), F.greatest("sy1", "sy2"))
    blocked = left.join(right, [*K, "gx", "gy"]).where((box & cuts) | along).select(*K, "nth", "o_nth").distinct()
    named = {"node": key(F.col("x"), F.col("y")), "o_node": key(F.col("ox"), F.col("oy")), "rank": F.format_string("%06d-%012.6f-%06d", F.col("nth"), far, F.col("o_nth"))}
    free = pair.join(blocked, [*K, "nth", "o_nth"], "left_anti").withColumns(named).drop("nth", "o_nth")
    taken = priority_matching(free, "node", "o_node")
    return taken.select(*K, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("ox").alias("x2"), F.col("oy").alias("y2"))


def node_segments(segments: DataFrame, cell: float = 256.0, snap: float = 1e-6) -> DataFrame:
    """K, x1, y1, x2, y2: distinct undirected edges after splitting all segments where they meet, overlaps included."""
    s = lines_of(segments).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    left = boxed(s, cell, 1e-6)
    right = boxed(s, cell, 1e-6).select(*K, "gx", "gy", F.col("seg_idx").alias("o"), *(F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")))
    # Segments whose boxes don't meet can't cut each other; those that share cells meet in one of them.
    apart = lambda a, b, c, d: F.greatest(F.least(a, b), F.least(c, d)) - F.least(F.greatest(a, b), F.greatest(c, d))
    low = lambda a, b: F.least(a, b) - 1e-6
    once = common_corner(cell, low("x1", "x2"), low("y1", "y2"), low("ox1", "ox2"), low("oy1", "oy2"))
    pair = left.join(right, [*K, "gx", "gy"]).where((F.col("seg_idx") != F.col("o")) & (apart("x1", "x2", "ox1", "ox2") <= 1e-6) & (apart("y1", "y2", "oy1", "oy2") <= 1e-6) & once)
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    qx, qy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    det = dx * ey - dy * ex
    safe = F.when(F.abs(det) > EPS, det)
    t, u = (qx * ey - qy * ex) / safe, (qx * dy - qy * dx) / safe
    # On one line: the other's ends cut this one.
    size = dx * dx + dy * dy
    flat = (F.abs(det) <= EPS) & (F.abs(qx * dy - qy * dx) <= 1e-6 * F.sqrt(size))
    at = lambda x, y: ((F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy) / F.nullif(size, F.lit(0.0))
    cut = F.when(F.abs(det) > EPS, F.when(t.between(-EPS, 1 + EPS) & u.between(-EPS, 1 + EPS), F.array(t))).when(flat, F.array(at("ox1", "oy1"), at("ox2", "oy2")))
    cuts = pair.select(*ID, F.explode(cut).alias("t")).where((F.col("t") > EPS) & (F.col("t") < 1 - EPS)).groupBy(*ID).agg(F.sort_array(F.collect_set(F.round("t", 9))).alias("ts"))
    full = s.join(cuts, ID, "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    snapped = lambda v: F.rint(v / snap) * snap
    point = lambda p: F.struct(snapped(F.col("x1") + p * (F.col("x2") - F.col("x1"))).alias("x"), snapped(F.col("y1") + p * (F.col("y2") - F.col("y1"))).alias("y"))
    parts = full.select(*K, F.explode(F.arrays_zip(F.slice("ts", 1, F.size("ts") - 1).alias("a"), F.slice("ts", 2, F.size("ts") - 1).alias("b"))).alias("p"), "x1", "y1", "x2", "y2")
    a, b = point(F.col("p.a")), point(F.col("p.b"))
    both = parts.select(*K, F.least(a, b).alias("e1"), F.greatest(a, b).alias("e2"))
    return both.select(*K, *(F.col(f"e{i}")[c].alias(f"{c}{i}") for i in (1, 2) for c in ("x", "y"))).where("x1 <> x2 or y1 <> y2").distinct()


def filter_polygons(polygons: DataFrame, sheets: DataFrame, least: float = 10000.0, share: float = 0.85, corners: int = 4, holes: float = 0.5) -> DataFrame:
    """Polygons that can be rooms: large enough without their holes, not most of the sheet, with enough corners and holes of half their area at most."""
    hole = F.col("hole_area") if "hole_area" in polygons.columns else F.lit(0.0)
    a = area(F.col("vertices")) - hole
    return polygons.join(sheets.select(*K, "page_width", "page_height"), K).where((a >= least) & (a <= share * F.col("page_width") * F.col("page_height")) & (F.size("vertices") >= corners) & (hole <= holes * a)).select(polygons.columns)


def suppress_overlaps(polygons: DataFrame, most: float = 0.9) -> DataFrame:
    """Polygons without those that overlap a smaller one (or an earlier one of the same area) by more than most of both."""
    bad = overlaps(polygons, "poly_idx", lambda a, b: most * F.greatest(a, b)).where((F.col("shared") > most * F.col("area_a")) & (F.col("shared") > most * F.col("area_b")))
    loser = F.when(F.col("area_a") > F.col("area_b"), F.col("a")).otherwise(F.col("b"))
    return polygons.join(bad.select(*K, loser.alias("poly_idx")).distinct(), [*K, "poly_idx"], "left_anti")


def room_polygons(segments: DataFrame, sheets: DataFrame, tolerance: float = 36.0) -> DataFrame:
    """K, room, vertices, area, confidence, required_bridging: bridges, noding, faces and the room filter in one."""
    segments = written(segments.select(*ID, "x1", "y1", "x2", "y2"))
    bridges = bridge_gaps(segments, tolerance)
    nth = (F.row_number().over(Window.partitionBy(*K).orderBy("x1", "y1", "x2", "y2")) + 1_000_000).cast("long")
    lines = segments.select(*ID, "x1", "y1", "x2", "y2").unionByName(bridges.withColumn("seg_idx", nth))
    rooms = filter_polygons(faces(node_segments(lines)), sheets)
    count = bridges.groupBy(*K).agg(F.count("*").alias("bridges"))
    named = rooms.withColumn("room", F.format_string("R%03d", F.row_number().over(Window.partitionBy(*K).orderBy("poly_idx"))))
    full = named.join(count, K, "left").withColumn("required_bridging", F.coalesce(F.col("bridges") > 0, F.lit(False)))
    return full.select(*K, "room", "vertices", "area", F.when(F.col("required_bridging"), "MEDIUM").otherwise("HIGH").alias("confidence"), "required_bridging")


# --- graph filters --------------------------------------------------------------------


def linked(segments: DataFrame, cell: float, reach: int = 1) -> DataFrame:
    """K, u, v: segments with ends in cells at most reach apart, through the smallest one of each cell pair."""
    e = ends(segments.select(*ID, "x1", "y1", "x2", "y2"), cell, nearest=True).select(*ID, "cx", "cy")
    lead = e.groupBy(*K, "cx", "cy").agg(F.min("seg_idx").alias("v"))
    return around(e, reach).join(lead, [*K, "cx", "cy"]).where(F.col("seg_idx") != F.col("v")).select(*K, F.col("seg_idx").alias("u"), "v").distinct()


def isolated_components(segments: DataFrame, cell: float = 5.0, least: int = 3, reach: int = 1) -> DataFrame:
    """ID, root, size, kept: connected groups of segments; groups under least are isolated, sheets under it pass."""
    c = components(segments, linked(segments, cell, reach), "seg_idx")
    by = Window.partitionBy(*K, "root")
    return c.withColumn("size", F.count("*").over(by)).withColumn("kept", (F.col("size") >= least) | (F.count("*").over(Window.partitionBy(*K)) < least))


def door_swings(segments: DataFrame, longest: float = 100.0, cell: float = 15.0) -> DataFrame:
    """ID of segments on door arcs: short ones chained in threes or more by ends in one cell, or placed about a pivot."""
    short = with_geometry(segments).where(F.col("length") <= longest)
    chained = isolated_components(short.select(*ID, "x1", "y1", "x2", "y2"), cell, 3, reach=0).where("size >= 3").select(*ID)
    return chained.unionByName(about_pivots(short)).distinct()


def about_pivots(short: DataFrame, shortest: float = 5.0, cell: float = 50.0, least: int = 3, spread: float = 100.0) -> DataFrame:
    """ID of segments of one cell whose midpoints lie 20 to 120 points from an end of one of them at an even distance, and of that one.

    Candidates are the segments with their midpoint in the same cell; their distances are summed up per end, not gathered.
    """
    g = short.where(F.col("length") >= shortest).withColumns({"gx": (F.col("mid_x") / cell).cast("long"), "gy": (F.col("mid_y") / cell).cast("long")})
    full = g.withColumn("n", F.count("*").over(Window.partitionBy(*K, "gx", "gy"))).where(F.col("n") > least)
    pivots = full.select(*ID, "gx", "gy", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.lit(1).alias("side"), F.col("x2").alias("px"), F.col("y2").alias("py")))))
    others = full.select(*K, "gx", "gy", F.col("seg_idx").alias("o"), F.col("mid_x").alias("mx"), F.col("mid_y").alias("my"))
    far = F.hypot(F.col("mx") - F.col("px"), F.col("my") - F.col("py"))
    around_ = pivots.join(others, [*K, "gx", "gy"]).where(F.col("seg_idx") != F.col("o")).withColumn("far", far).where((F.col("far") > 20) & (F.col("far") < 120)).select(*ID, "side", "o", "far")
    even = around_.groupBy(*ID, "side").agg(F.count("*").alias("n"), F.var_pop("far").alias("v")).where((F.col("n") >= least) & (F.col("v") < spread)).select(*ID, "side")
    hit = around_.join(even, [*ID, "side"], "left_semi")
    return hit.select(*K, F.explode(F.array("seg_idx", "o")).alias("seg_idx")).distinct()


def curved_segments(segments: DataFrame, longest: float = 60.0, cell: float = 5.0) -> DataFrame:
    """ID of short segments that meet another at a junction under a small turn, as chords of an arc do."""
    e = ends(with_geometry(segments).where(F.col("length") <= longest).select(*ID, "x1", "y1", "x2", "y2"), cell, nearest=True)
    away = F.atan2(F.when(F.col("side") == 0, F.col("y2") - F.col("y1")).otherwise(F.col("y1") - F.col("y2")), F.when(F.col("side") == 0, F.col("x2") - F.col("x1")).otherwise(F.col("x1") - F.col("x2")))
    by = Window.partitionBy(*K, "cx", "cy").orderBy("turn", "seg_idx")
    j = e.withColumn("turn", F.round(away, 9))
    fold = lambda d: F.least(d, 2 * math.pi - d)
    next_ = j.withColumns({f"p{i}": F.struct(F.lead("seg_idx", i).over(by).alias("o"), fold(F.lead("turn", i).over(by) - F.col("turn")).alias("d")) for i in (1, 2, 3)})
    hit = next_.withColumn("p", F.explode(F.array("p1", "p2", "p3"))).where((F.col("p.d") > 0.05) & (F.col("p.d") < 0.6))
    return hit.select(*K, F.explode(F.array(F.col("seg_idx"), F.col("p.o"))).alias("seg_idx")).distinct()


def label_boxes(segments: DataFrame, least: float = 15.0, most: float = 80.0, cell: float = 5.0) -> DataFrame:
    """ID of segments that form small boxes: two level ones above each other, and an upright at each side."""
    g = with_geometry(segments).where(F.col("length").between(least, most))
    h = g.where(F.abs(F.col("y2") - F.col("y1")) < 1).select(*K, F.col("seg_idx").alias("a"), F.least("x1", "x2").alias("l"), F.greatest("x1", "x2").alias("r"), F.col("mid_y").alias("y"))
    o = h.select(*K, F.col("a").alias("b"), F.col("l").alias("ol"), F.col("r").alias("o_r"), F.col("y").alias("oy"))
    # Cells of the largest box: level ones meet by their spans, uprights by the middle of a box's side.
    above = covered(h, most, F.col("l"), F.col("y"), F.col("r"), F.col("y"))
    below = covered(o, most, F.col("ol"), F.col("oy") - most, F.col("o_r"), F.col("oy"))
    lap = F.least("r", "o_r") - F.greatest("l", "ol")
    pair = above.join(below, [*K, "gx", "gy"]).where((F.col("oy") > F.col("y")) & (F.col("oy") - F.col("y")).between(5, most) & (lap >= 0.5 * F.least(F.col("r") - F.col("l"), F.col("o_r") - F.col("ol"))))
    both = F.array(F.struct(F.lit(True).alias("left"), F.col("l").alias("px")), F.struct(F.lit(False).alias("left"), F.col("r").alias("px")))
    sides = pair.select(*K, "a", "b", "l", "r", "y", "oy").distinct().select(*K, "a", "b", "y", "oy", F.inline(both)).withColumns({"gx": F.floor(F.col("px") / most), "gy": F.floor((F.col("y") + F.col("oy")) / 2 / most)})
    v = g.where(F.abs(F.col("x2") - F.col("x1")) < 1).select(*K, F.col("seg_idx").alias("s"), F.col("mid_x").alias("x"), F.least("y1", "y2").alias("t"), F.greatest("y1", "y2").alias("u"))
    uprights = covered(v, most, F.col("x") - cell, F.col("t") - cell, F.col("x") + cell, F.col("u") + cell)
    side = sides.join(uprights, [*K, "gx", "gy"]).where((F.col("t") <= F.col("y") + cell) & (F.col("u") >= F.col("oy") - cell) & (F.abs(F.col("x") - F.col("px")) <= cell))
    found = side.groupBy(*K, "a", "b").agg(F.collect_set(F.when(F.col("left"), F.col("s"))).alias("ls"), F.collect_set(F.when(~F.col("left"), F.col("s"))).alias("rs")).where((F.size("ls") > 0) & (F.size("rs") > 0))
    return found.select(*K, F.explode(F.concat(F.array("a", "b"), "ls", "rs")).alias("seg_idx")).distinct()


def wall_network(segments: DataFrame, sheets: DataFrame, grid: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """segments + reason: the ten rules of walls_only, then `chain`, `box` and `isolated`, each judged on what is left by then (null: kept)."""
    judged = written(walls_only(segments, sheets, grid, edges))
    left = judged.where("reason is null").drop("reason")
    late = None
    for reason, find in (("chain", lambda s: grid_chains(s, sheets)), ("box", lambda s: label_boxes(s, 10.0, 50.0)), ("isolated", lambda s: isolated_components(s, 8.0, 5).where("not kept"))):
        gone = written(find(left).select(*ID, F.lit(reason).alias("late")))
        left = left.join(gone, ID, "left_anti")
        late = gone if late is None else late.unionByName(gone)
    return judged.join(late, ID, "left").withColumn("reason", F.coalesce("reason", "late")).drop("late")
