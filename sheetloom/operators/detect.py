"""Label-driven rooms: rays from labels to walls, boundaries, detected rooms."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.geom import area, box, celled, centroid, common_corner, covered, following, in_ring, ratio, ring_distance, walked
from sheetloom.functions.lineage import bound, unsent, written
from sheetloom.sources.views import K

RAYS, REACH, LEAST_HIT, EPS = 16, 2000.0, 10.0, 1e-9
CLUSTER = [*K, "cluster_idx"]
#: Points in a side of the grid cells that labels and rings meet by.
CELL = 128.0
#: Points in a side of the cells that rays walk through to walls, and to other labels.
WALK, STRIP = 128.0, 256.0
#: Distances at which a walk pauses.
BANDS = (0.0, 256.0, REACH)


def direction(ray: Column, axis: str) -> Column:
    """A ray's unit vector along x or y, from a table of all of them."""
    turn = [2 * math.pi * i / RAYS for i in range(RAYS)]
    table = F.array(*(F.lit(math.cos(t) if axis == "x" else math.sin(t)) for t in turn))
    return F.element_at(table, ray.cast("int") + 1)


def rays_of(labels: DataFrame) -> DataFrame:
    """CLUSTER, cx, cy, ray, dx, dy: all rays of all labels."""
    each = labels.select(*CLUSTER, "cx", "cy", F.explode(F.sequence(F.lit(0), F.lit(RAYS - 1))).alias("ray"))
    return unsent(each.withColumns({"dx": direction(F.col("ray"), "x"), "dy": direction(F.col("ray"), "y")}))


def within(low_x: Column, low_y: Column, high_x: Column, high_y: Column) -> tuple[Column, Column]:
    """Where a ray enters and leaves a box, as distances from its label."""

    def pair(c: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = ratio(low - c, d), ratio(high - c, d)
        beside = (c < low) | (c > high)
        flat = F.abs(d) <= EPS
        return F.when(flat, F.when(beside, REACH).otherwise(0.0)).otherwise(F.least(a, b)), F.when(flat, REACH).otherwise(F.greatest(a, b))

    (ax, bx), (ay, by) = pair(F.col("cx"), F.col("dx"), low_x, high_x), pair(F.col("cy"), F.col("dy"), low_y, high_y)
    return F.greatest(ax, ay, F.lit(0.0)), F.least(bx, by, F.lit(REACH))


def wall_hits(labels: DataFrame, walls: DataFrame) -> DataFrame:
    """CLUSTER, ray, wall: distance to the nearest wall farther than 10 points, for the rays that meet one.

    Rays walk through grid cells and stop at the first hit. All rays walk the cells of one
    band at a time; those that hit a wall within the band are done, the others go on to the
    next, up to where the walls of their sheet end. Bands grow, so there are few of them.
    """
    # Walls and labels are dealt out by sheet; what follows from them meets without being moved again.
    w = written(walls.select(*K, "x1", "y1", "x2", "y2")).repartition(*K)
    slack = 1.0
    bounds = w.groupBy(*K).agg((F.min(F.least("x1", "x2")) - slack).alias("x0"), (F.min(F.least("y1", "y2")) - slack).alias("y0"), (F.max(F.greatest("x1", "x2")) + slack).alias("x9"), (F.max(F.greatest("y1", "y2")) + slack).alias("y9"))
    enter, leave = within(*(F.col(c) for c in ("x0", "y0", "x9", "y9")))
    rays = rays_of(labels).join(bounds, K).withColumns({"enter": enter, "leave": leave}).where("enter <= leave").drop("x0", "y0", "x9", "y9")
    placed = walked(w, WALK, *(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    done = None
    for near, far in zip(BANDS, BANDS[1:], strict=False):
        left = rays if done is None else rays.join(done, [*CLUSTER, "ray"], "left_anti")
        step = left.withColumns({"from": F.greatest(F.col("enter"), F.lit(near)), "to": F.least(F.col("leave"), F.lit(far))}).where("from <= to")
        on = lambda c, t: F.col(f"c{c}") + F.col(f"d{c}") * F.col(t)
        cells = walked(step, WALK, on("x", "from"), on("y", "from"), on("x", "to"), on("y", "to"))
        met = crossings(cells.select(*CLUSTER, "ray", "cx", "cy", "dx", "dy", "gx", "gy").join(placed, [*K, "gx", "gy"]))
        # A wall that is met behind the band can have others before it.
        found = written(met.groupBy(*CLUSTER, "ray").agg(F.min("t").alias("wall")).where(F.col("wall") <= far))
        done = found if done is None else done.unionByName(found)
    return unsent(done)


def crossings(pairs: DataFrame) -> DataFrame:
    """The pairs of a ray and a wall that meet, with the distance t along the ray."""
    e = pairs.withColumns({"qx": F.col("x1") - F.col("cx"), "qy": F.col("y1") - F.col("cy"), "ex": F.col("x2") - F.col("x1"), "ey": F.col("y2") - F.col("y1")})
    det = e.withColumn("det", F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex")).where(F.abs("det") > EPS)
    t = ratio(F.col("qx") * F.col("ey") - F.col("qy") * F.col("ex"), F.col("det"))
    u = ratio(F.col("qx") * F.col("dy") - F.col("qy") * F.col("dx"), F.col("det"))
    return det.withColumns({"t": t, "u": u}).where(F.col("u").between(-EPS, 1 + EPS) & (F.col("t") > LEAST_HIT) & (F.col("t") <= REACH))


def midpoint_hits(rays: DataFrame, labels: DataFrame, beside: float = 50.0) -> DataFrame:
    """CLUSTER, ray, far, mx, my: of each ray the nearest midpoint to another label ahead, farther than 10 points and at most `beside` from the ray.

    A midpoint lies so when its label lies within twice that of the ray; labels meet the strip about a ray by grid cells.
    """
    own = labels.select(*K, F.col("cluster_idx").alias("o"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    wide = 2 * beside
    bounds = own.groupBy(*K).agg((F.min("ox") - wide).alias("x0"), (F.min("oy") - wide).alias("y0"), (F.max("ox") + wide).alias("x9"), (F.max("oy") + wide).alias("y9"))
    enter, leave = within(*(F.col(c) for c in ("x0", "y0", "x9", "y9")))
    # Labels are far apart compared with a strip, and a sheet has few.
    strip = rays.join(bounds, K).withColumns({"enter": enter, "leave": leave}).where("enter <= leave")
    on = lambda c, t: F.col(f"c{c}") + F.col(f"d{c}") * F.col(t)
    cells = walked(strip, STRIP, on("x", "enter"), on("y", "enter"), on("x", "leave"), on("y", "leave"), slack=wide)
    once = cells.select(*CLUSTER, "ray", "cx", "cy", "dx", "dy", "gx", "gy").distinct()
    pair = once.join(celled(own, STRIP, F.col("ox"), F.col("oy")), [*K, "gx", "gy"]).where(F.col("o") != F.col("cluster_idx"))
    at = pair.withColumns({"mx": F.col("cx") / 2 + F.col("ox") / 2, "my": F.col("cy") / 2 + F.col("oy") / 2}).withColumns({"ax": F.col("mx") - F.col("cx"), "ay": F.col("my") - F.col("cy")})
    along, aside = F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy"), F.abs(F.col("ax") * F.col("dy") - F.col("ay") * F.col("dx"))
    near = at.withColumn("far", F.hypot("ax", "ay")).where((F.col("far") > LEAST_HIT) & (along > 0) & (aside <= beside))
    return near.groupBy(*CLUSTER, "ray").agg(F.min_by(F.struct("far", "mx", "my"), F.struct(F.round("far", 6), "mx", "my")).alias("half")).select(*CLUSTER, "ray", "half.*")


def ray_hits(labels: DataFrame, walls: DataFrame, sheets: DataFrame, edge: float = 0.85) -> DataFrame:
    """CLUSTER, cx, cy, ray, distance, hx, hy, is_wall: what each of a label's rays meets first.

    The nearest wall farther than 10 points; else the nearest midpoint to another label
    within 50 points of the ray; else the drawing area's edge.
    """
    own = labels.select(*CLUSTER, "cx", "cy").repartition(*K)
    wall = wall_hits(own, walls)
    rays = rays_of(own)
    half = midpoint_hits(rays.join(wall, [*CLUSTER, "ray"], "left_anti"), own)
    full = rays.join(sheets.select(*K, "page_width", "page_height"), K).join(wall, [*CLUSTER, "ray"], "left").join(half, [*CLUSTER, "ray"], "left")
    _, out = within(F.lit(0.0), F.lit(0.0), F.col("page_width") * edge, F.col("page_height"))
    end = F.greatest(out, F.lit(0.0))
    at = full.withColumn("distance", F.coalesce("wall", "far", end))
    point = lambda c: F.coalesce(F.when(F.col("wall").isNull(), F.col(f"m{c}")), F.col(f"c{c}") + F.col(f"d{c}") * F.col("distance"))
    return at.select(*CLUSTER, "cx", "cy", "ray", "distance", point("x").alias("hx"), point("y").alias("hy"), F.col("wall").isNotNull().alias("is_wall"))


def crossed(sides: Column, some: Column) -> Column:
    """Whether two of a ring's sides cross each other in their middles, one of them of `some`."""

    def turn(s: Column, x: Column, y: Column) -> Column:
        return (s["qx"] - s["px"]) * (y - s["py"]) - (s["qy"] - s["py"]) * (x - s["px"])

    def cross(s: Column, o: Column) -> Column:
        return (turn(s, o["px"], o["py"]) * turn(s, o["qx"], o["qy"]) < -EPS) & (turn(o, s["px"], s["py"]) * turn(o, s["qx"], s["qy"]) < -EPS)

    return F.exists(some, lambda s: F.exists(sides, lambda o: cross(s, o)))


def label_boundaries(hits: DataFrame, least: float = 0.5) -> DataFrame:
    """CLUSTER, vertices, wall_hits, completeness, area, repaired, method, confidence of the ring of a label's hits.

    The ring takes the hits in the order of the rays. A midpoint lies off its ray, and can make the ring
    cross itself: then its points are put in the order of their angles, and repaired says so. Sides between
    points on their own rays lie in sectors of their own and never cross, so only sides with an end off its ray are tested.
    """
    turn = F.round(F.pmod(F.atan2(F.col("hy") - F.col("cy"), F.col("hx") - F.col("cx")), F.lit(2 * math.pi)), 9)
    # A point on its ray that is the label itself has no angle, and counts as off.
    aside = F.abs((F.col("hx") - F.col("cx")) * direction(F.col("ray"), "y") - (F.col("hy") - F.col("cy")) * direction(F.col("ray"), "x"))
    along = (F.col("hx") - F.col("cx")) * direction(F.col("ray"), "x") + (F.col("hy") - F.col("cy")) * direction(F.col("ray"), "y")
    off = ~((along > 1e-3) & (aside <= 1e-6))
    point = F.struct("ray", F.col("hx").alias("x"), F.col("hy").alias("y"), turn.alias("turn"), off.alias("off"))
    got = hits.groupBy(*CLUSTER).agg(F.array_sort(F.collect_list(point)).alias("p"), F.count_if("is_wall").alias("wall_hits"))
    xy = lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))
    side = lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy"), (p["off"] | q["off"] | (F.pmod(q["ray"] - p["ray"], F.lit(RAYS)) >= RAYS // 2)).alias("off"))
    # What later columns and filters are made from is worked out once a row, step by step.
    drawn = bound(got.withColumn("sides", F.zip_with("p", following(F.col("p")), side)), "sides")
    tested = bound(drawn.withColumn("repaired", crossed(F.col("sides"), F.filter("sides", lambda s: s["off"]))), "repaired")
    by_angle = F.transform(F.array_sort(F.transform("p", lambda s: F.struct(s["turn"].alias("turn"), s["ray"].alias("ray"), s["x"].alias("x"), s["y"].alias("y")))), xy)
    shaped = bound(tested.withColumn("vertices", F.when(F.col("repaired"), by_angle).otherwise(F.transform("p", xy))), "vertices")
    ring = bound(shaped.withColumns({"completeness": F.col("wall_hits") / RAYS, "area": area(F.col("vertices"))}), "area")
    c, has = F.col("completeness"), F.col("area") >= 100
    method = F.when(~has, "ESTIMATED").when(c >= 0.9, "CLOSED").when(c >= least, "PARTIAL").otherwise("RAY_CAST")
    sure = F.when(~has, 0.2).when(c >= 0.9, 0.95).when(c >= least, 0.6 + (c - least) * 0.5).otherwise(0.3 + 0.4 * c)
    return ring.select(*CLUSTER, "vertices", "wall_hits", "completeness", "area", "repaired", method.alias("method"), sure.alias("confidence"))


def boundaries_by_text(boundaries: DataFrame, clusters: DataFrame) -> DataFrame:
    """K, label_text and the boundary of the last cluster with that text."""
    keyed = boundaries.join(clusters.select(*CLUSTER, "label_text"), CLUSTER)
    return keyed.groupBy(*K, "label_text").agg(F.max_by(F.struct("cluster_idx", "vertices", "completeness", "area", "method", "confidence"), "cluster_idx").alias("found")).select(*K, "label_text", "found.*")


def containing_polygon(clusters: DataFrame, polygons: DataFrame, least: float = 50000.0, near: float = 5.0) -> DataFrame:
    """CLUSTER, poly_idx, area, method, confidence: the largest polygon that holds the label, else the closest within reach."""
    big = bound(polygons.withColumns({"area": area(F.col("vertices")), "c": centroid(F.col("vertices")), "bx": box(F.col("vertices"))}), "area", "c", "bx").where(F.col("area") >= least)
    reach = max(near, 0.0)
    spread = covered(big, CELL, F.col("bx.x0") - reach, F.col("bx.y0") - reach, F.col("bx.x1") + reach, F.col("bx.y1") + reach)
    pair = celled(clusters.select(*CLUSTER, "cx", "cy"), CELL, F.col("cx"), F.col("cy")).join(spread, [*K, "gx", "gy"]).withColumns({"inside": in_ring(F.col("cx"), F.col("cy"), F.col("vertices")), "off": ring_distance(F.col("cx"), F.col("cy"), F.col("vertices")), "far": F.hypot(F.col("cx") - F.col("c.x"), F.col("cy") - F.col("c.y"))})
    some = pair.where(F.col("inside") | (F.col("off") <= near))
    best = some.groupBy(*CLUSTER).agg(F.min_by(F.struct("poly_idx", "area"), F.struct(~F.col("inside"), F.when(F.col("inside"), -F.col("area")).otherwise(F.round("far", 6)), "poly_idx")).alias("best"))
    full = clusters.select(*CLUSTER).join(best, CLUSTER, "left")
    return full.select(*CLUSTER, "best.poly_idx", "best.area", F.when(F.col("best").isNotNull(), "CLOSED").otherwise("ESTIMATED").alias("method"), F.when(F.col("best").isNotNull(), 0.95).otherwise(0.0).alias("confidence"))


def boundaries_combined(contained: DataFrame, cast: DataFrame) -> DataFrame:
    """CLUSTER, area, method, confidence: the containing polygon's where there is one, else the rays'."""
    c = cast.select(*CLUSTER, F.col("area").alias("r_area"), F.col("method").alias("r_method"), F.col("confidence").alias("r_conf"))
    hit = F.col("poly_idx").isNotNull()
    both = contained.join(c, CLUSTER, "left")
    return both.select(*CLUSTER, F.when(hit, F.col("area")).otherwise(F.col("r_area")).alias("area"), F.when(hit, F.col("method")).otherwise(F.coalesce("r_method", "method")).alias("method"), F.when(hit, F.col("confidence")).otherwise(F.coalesce("r_conf", "confidence")).alias("confidence"))


#: Pairs of rings that are compared at once.
AT_ONCE = 256


def common_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that rings a[i] and b[i] (pairs, points, x and y) share: horizontal slabs between all corners and crossings, exact for straight edges."""
    an, bn = np.roll(a, -1, 1), np.roll(b, -1, 1)
    d, e = (an - a)[:, :, None], (bn - b)[:, None]
    gap = b[:, None] - a[:, :, None]
    det = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    safe = np.where(np.abs(det) > EPS, det, np.nan)
    t, u = ((gap[..., 0] * v[..., 1] - gap[..., 1] * v[..., 0]) / safe for v in (e, d))
    met = (t > 0) & (t < 1) & (u > -EPS) & (u < 1 + EPS)
    ys = np.sort(np.concatenate([a[..., 1], b[..., 1], np.where(met, a[:, :, None, 1] + t * d[..., 1], np.inf).reshape(len(a), -1)], axis=1), axis=1)
    ys = ys[:, : int(np.isfinite(ys).sum(1).max(initial=0))]
    # Pairs with fewer slabs than others have empty ones behind.
    real = np.isfinite(ys[:, 1:])
    low, top = np.where(real, ys[:, :-1], 0.0), np.where(real, ys[:, 1:], 0.0)
    mid, high = ((low + top) / 2)[..., None], top - low

    def spans(r: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a ring begins and ends in each slab, slabs by stretches; those that are missing are infinite."""
        y, x, ny, nx = r[:, None, :, 1], r[:, None, :, 0], n[:, None, :, 1], n[:, None, :, 0]
        cut = (y > mid) != (ny > mid)
        at = np.sort(np.where(cut, x + (mid - y) * (nx - x) / np.where(cut, ny - y, 1.0), np.inf), axis=2)
        at = at[..., : int(cut.sum(2).max(initial=0)) // 2 * 2]
        return at[..., ::2], at[..., 1::2]

    (a0, a1), (b0, b1) = spans(a, an), spans(b, bn)
    with np.errstate(invalid="ignore"):
        wide = np.minimum(a1[..., None], b1[..., None, :]) - np.maximum(a0[..., None], b0[..., None, :])
    return (np.fmax(wide, 0).sum(axis=(2, 3)) * high).sum(axis=1)


def common_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area that two rings (x, y, x, y, ...) share."""
    return float(common_areas(*(np.asarray(r, float).reshape(1, -1, 2) for r in (p, q)))[0])


def shared_areas(p: pd.Series, q: pd.Series) -> pd.Series:
    """Areas that pairs of rings (x, y, x, y, ...) share; pairs with as many points each are compared together."""
    out = np.zeros(len(p))
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(p, q, strict=True)):
        sizes.setdefault((len(x), len(y)), []).append(i)
    for some in sizes.values():
        for at in range(0, len(some), AT_ONCE):
            part = some[at : at + AT_ONCE]
            out[part] = common_areas(*(np.stack([np.asarray(r[i], float).reshape(-1, 2) for i in part]) for r in (p, q)))
    return pd.Series(out, dtype=float)


def overlaps(shapes: DataFrame, idx: str, enough: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """K, a, b, area_a, area_b, shared: pairs of rings (a < b) of a sheet whose boxes overlap.

    enough(area_a, area_b): the least shared area of interest; pairs whose boxes share no more than that are left out before rings are compared.
    """

    shared = F.pandas_udf(shared_areas, "double")
    flat = F.flatten(F.transform("vertices", lambda v: F.array(v["x"], v["y"])))
    s = shapes.select(*K, F.col(idx).alias("id"), box(F.col("vertices")).alias("box"), area(F.col("vertices")).alias("area"), flat.alias("flat"))
    # Boxes meet by grid cells; the rings themselves follow only for the pairs that are left.
    named = lambda n: (F.col("id").alias(n), F.col("box").alias(f"b{n}"), F.col("area").alias(f"area_{n}"))
    sides = ("x0", "y0", "x1", "y1")
    spread = covered(s.select(*K, *named("a")), CELL, *(F.col(f"ba.{c}") for c in sides))
    other = covered(s.select(*K, *named("b")), CELL, *(F.col(f"bb.{c}") for c in sides))
    once = common_corner(CELL, F.col("ba.x0"), F.col("ba.y0"), F.col("bb.x0"), F.col("bb.y0"))
    wide, high = (F.least(f"ba.{c}1", f"bb.{c}1") - F.greatest(f"ba.{c}0", f"bb.{c}0") for c in "xy")
    least = F.lit(0.0) if enough is None else enough(F.col("area_a"), F.col("area_b"))
    pair = spread.join(other, [*K, "gx", "gy"]).where((F.col("a") < F.col("b")) & once & (wide > 0) & (high > 0) & (wide * high * (1 + EPS) > least)).select(*K, "a", "b", "area_a", "area_b")
    rings = lambda n: s.select(*K, F.col("id").alias(n), F.col("flat").alias(f"v{n}"))
    return pair.join(rings("a"), [*K, "a"]).join(rings("b"), [*K, "b"]).select(*K, "a", "b", "area_a", "area_b", shared("va", "vb").alias("shared"))


def boundary_overlaps(boundaries: DataFrame, most: float = 0.3) -> DataFrame:
    """CLUSTER, warnings: what overlaps a boundary by more than a share of the smaller one, noted on the earlier."""
    # Rings are met by their boxes first and follow for the pairs that are left: they are worked out once.
    rings = written(boundaries.where("method <> 'ESTIMATED'").select(*CLUSTER, "vertices"))
    bad = overlaps(rings, "cluster_idx", lambda a, b: most * F.least(a, b)).where(F.col("shared") > most * F.least("area_a", "area_b"))
    return bad.groupBy(*K, F.col("a").alias("cluster_idx")).agg(F.array_sort(F.collect_list(F.format_string("Overlaps boundary %d", F.col("b")))).alias("warnings"))


def detected_rooms(clusters: DataFrame, keyed: DataFrame, scale: Column) -> DataFrame:
    """K, name, cluster_idx, area_sqft, confidence, method: per text the first cluster, and the last other as text_ALT."""
    joined = clusters.select(*CLUSTER, "label_text", F.col("confidence").alias("l")).join(keyed.select(*K, "label_text", "vertices", "area", "completeness", "method", F.col("confidence").alias("b")), [*K, "label_text"])
    ok = joined.where("method <> 'ESTIMATED'")
    sure = F.when(F.col("method") == "CLOSED", F.least(F.lit(0.95), F.col("l") * 1.1)).when(F.col("method") == "PARTIAL", F.least(F.lit(0.85), F.col("l") * F.col("b"))).otherwise(F.least(F.lit(0.7), F.col("l") * F.col("b")))
    by = Window.partitionBy(*K, "label_text")
    ranked = ok.withColumns({"first": F.min("cluster_idx").over(by), "last": F.max("cluster_idx").over(by)}).where((F.col("cluster_idx") == F.col("first")) | (F.col("cluster_idx") == F.col("last")))
    name = F.when(F.col("cluster_idx") == F.col("first"), F.col("label_text")).otherwise(F.concat("label_text", F.lit("_ALT")))
    return ranked.select(*K, name.alias("name"), "cluster_idx", "vertices", "completeness", "method", sure.alias("confidence"), F.coalesce(ratio(F.col("area"), scale * scale), F.lit(0.0)).alias("area_sqft"))


def finalize_detected(rooms: DataFrame) -> DataFrame:
    """+ room_id and level, in name order on each sheet."""
    nth = F.row_number().over(Window.partitionBy(*K).orderBy("cluster_idx", "name")) - 1
    level = F.when(F.col("confidence") >= 0.85, "HIGH").when(F.col("confidence") >= 0.6, "MEDIUM").otherwise("LOW")
    return rooms.withColumns({"room_id": F.format_string("room_%03d_%03d", F.col("page_no"), nth), "level": level})


def boundary_methods(rooms: DataFrame) -> DataFrame:
    return rooms.groupBy(*K).pivot("method", ["CLOSED", "PARTIAL", "RAY_CAST"]).count().na.fill(0)


def detection_totals(labels: DataFrame, clusters: DataFrame, walls: DataFrame, boundaries: DataFrame, rooms: DataFrame) -> DataFrame:
    """Per sheet: labels, clusters, walls, boundaries and total area; sheets without labels are left out."""
    count = lambda df, n: df.groupBy(*K).agg(F.count("*").alias(n))
    out = count(labels, "labels")
    for part in (count(clusters, "clusters"), count(walls, "walls"), count(boundaries.where("method <> 'ESTIMATED'"), "boundaries"), rooms.groupBy(*K).agg(F.round(F.sum("area_sqft"), 2).alias("total_area"))):
        out = out.join(part, K, "left")
    return out.na.fill(0)


def with_fallback(detected: DataFrame, fallback: DataFrame) -> DataFrame:
    """Detected rooms, and the fallback's on sheets that have none."""
    return detected.unionByName(fallback.join(detected.select(*K).distinct(), K, "left_anti"))
