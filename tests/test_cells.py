"""Joins by grid cells against loops over all pairs, and the queries that have no SQL, on small cases."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from sheetloom.functions import geom, greedy, lineage
from sheetloom.operators import detect, labels, phases, scale, topology
from sheetloom.operators.segments import with_geometry
from sheetloom.sources import tables

RING = "doc_id long, page_no long, poly_idx long, vertices array<struct<x:double,y:double>>"


def boxes(count, wide):
    """Boxes of all sizes, some over many cells and some left of the origin."""
    low = [(random.uniform(-300, 900), random.uniform(-300, 900)) for _ in range(count)]
    return [(x, y, x + random.uniform(1, wide), y + random.uniform(1, wide)) for x, y in low]


def ring(b):
    x0, y0, x1, y1 = map(float, b)
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def regions(spark, found, kinds):
    return spark.createDataFrame([(1, 1, i, *b, k, 0.5) for i, (b, k) in enumerate(zip(found, kinds, strict=True))], "doc_id long, page_no long, region_idx long, x0 double, y0 double, x1 double, y1 double, kind string, confidence double")


def rings(spark, found):
    return spark.createDataFrame([(1, 1, i, ring(b)) for i, b in enumerate(found)], RING)


def test_regions_by_cells_equal_the_loop(spark):
    random.seed(21)
    # Two that touch on a border between cells, and as many that do not.
    found = [*boxes(60, 300), (0.0, 0.0, 128.0, 128.0), (128.0, 128.0, 256.0, 200.0)]
    kinds = [random.choice(("gray", "hatched")) for _ in found]
    r = regions(spark, found, kinds)
    meet = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    want = sorted((i, j) for j in range(len(found)) for i in range(j) if meet(found[i], found[j]))
    assert sorted((p.a, p.b) for p in phases.region_overlaps(r).collect()) == want and (60, 61) in want
    points = [(random.uniform(-300, 1200), random.uniform(-300, 1200)) for _ in range(150)] + [(128.0, 128.0)]
    at = spark.createDataFrame([(1, 1, i, *p) for i, p in enumerate(points)], "doc_id long, page_no long, seg_idx long, px double, py double")
    got = {p.seg_idx: p.phase for p in phases.phase_at(at, r, ["doc_id", "page_no", "seg_idx"]).collect()}
    for i, (x, y) in enumerate(points):
        held = {k for b, k in zip(found, kinds, strict=True) if b[0] <= x <= b[2] and b[1] <= y <= b[3]}
        assert got[i] == ("EXISTING" if "gray" in held else "NOT_IN_CONTRACT" if held else "NEW")


def shared(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def size(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def test_overlaps_of_rings_equal_the_loop(spark):
    random.seed(22)
    found = boxes(50, 250)
    found += [(x0 + 1, y0 + 1, x1, y1) for x0, y0, x1, y1 in found[:10]]
    p = rings(spark, found)
    got = {(r.a, r.b): r.shared for r in detect.overlaps(p, "poly_idx").collect()}
    want = {(i, j): s for j in range(len(found)) for i in range(j) if (s := shared(found[i], found[j])) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    lost = {i if size(found[i]) > size(found[j]) else j for (i, j), s in want.items() if s > 0.9 * max(size(found[i]), size(found[j]))}
    assert {r.poly_idx for r in topology.suppress_overlaps(p).collect()} == set(range(len(found))) - lost and lost
    b = p.withColumnRenamed("poly_idx", "cluster_idx").selectExpr("*", "'CLOSED' as method")
    notes: dict = {}
    for (i, j), s in want.items():
        if s > 0.3 * min(size(found[i]), size(found[j])):
            notes.setdefault(i, []).append(f"Overlaps boundary {j}")
    assert {r.cluster_idx: r.warnings for r in detect.boundary_overlaps(b).collect()} == {k: sorted(v) for k, v in notes.items()}


def test_polygon_of_a_label_equals_the_loop(spark):
    random.seed(23)
    found = boxes(30, 400)
    points = [(random.uniform(-300, 1200), random.uniform(-300, 1200)) for _ in range(100)]
    c = spark.createDataFrame([(1, 1, i, *p) for i, p in enumerate(points)], "doc_id long, page_no long, cluster_idx long, cx double, cy double")
    got = {r.cluster_idx: r.poly_idx for r in detect.containing_polygon(c, rings(spark, found), least=1000.0, near=-1.0).collect()}
    for i, (x, y) in enumerate(points):
        inside = [(-size(b), n) for n, b in enumerate(found) if size(b) >= 1000 and b[0] < x < b[2] and b[1] < y < b[3]]
        assert got[i] == (min(inside)[1] if inside else None)
    # Within reach of an edge, over a border between cells.
    edge = spark.createDataFrame([(1, 1, 0, 132.0, 60.0)], "doc_id long, page_no long, cluster_idx long, cx double, cy double")
    assert detect.containing_polygon(edge, rings(spark, [(0, 0, 127, 127)]), least=1000.0).collect()[0].poly_idx == 0


def test_labels_are_applied(spark):
    p = rings(spark, [(0, 0, 100, 100), (500, 500, 600, 600), (900, 0, 910, 10)])
    said = spark.createDataFrame([(1, 1, 0, "OFFICE", 50.0, 50.0), (1, 1, 1, "HALL", 660.0, 550.0)], "doc_id long, page_no long, block_idx long, text string, cx double, cy double")
    # The second label is out of the grown box, yet within half the diagonal of the center for no ring.
    matched = labels.match_labels(said, p)
    assert {r.poly_idx: (r.room_name, r.name_confidence) for r in matched.collect()} == {0: ("OFFICE", "HIGH"), 1: ("ROOM_1", "NONE"), 2: ("ROOM_2", "NONE")}
    named = labels.apply_labels(p, matched.where("name_confidence <> 'NONE'")).collect()
    assert {r.poly_idx: (r.room_name, r.name_confidence) for r in named} == {0: ("OFFICE", "HIGH"), 1: ("ROOM_UNKNOWN", "NONE"), 2: ("ROOM_UNKNOWN", "NONE")}


def test_rooms_of_two_squares(spark):
    square = lambda x, w: [(x, 0, x + w, 0), (x + w, 0, x + w, w), (x + w, w, x, w), (x, w, x, 0)]
    lines = [(1, page, i, *map(float, s)) for page, w in ((1, 200), (2, 5)) for i, s in enumerate(square(100, w))]
    s = spark.createDataFrame(lines, "doc_id long, page_no long, seg_idx long, x1 double, y1 double, x2 double, y2 double")
    sheets = spark.createDataFrame([(1, 1, 1000.0, 800.0), (1, 2, 1000.0, 800.0)], "doc_id long, page_no long, page_width double, page_height double")
    # The small square of the second sheet is under the least area of a room.
    got = topology.room_polygons(s, sheets).collect()
    assert [(r.page_no, r.room, round(r.area), r.confidence, r.required_bridging) for r in got] == [(1, "R001", 40000, "HIGH", False)]


def test_a_hatch(spark):
    hatch = [(300.0 + 6 * i, 100.0, 330.0 + 6 * i, 130.0) for i in range(6)]
    lone = [(800.0, 800.0, 830.0, 830.0), (10.0, 10.0, 60.0, 10.0)]
    rows = [(1, 1, i, *s, None, "s", None) for i, s in enumerate([*hatch, *lone])]
    s = spark.createDataFrame(rows, "doc_id long, page_no long, seg_idx long, x1 double, y1 double, x2 double, y2 double, fill array<double>, fill_type string, dashes array<double>")
    got = phases.hatched_regions(s).collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.kind) for r in got] == [(300.0, 100.0, 360.0, 130.0, "hatched")]


def test_a_walk_covers_a_segment(spark):
    random.seed(24)
    found = [tuple(random.uniform(-300, 300) for _ in range(4)) for _ in range(80)] + [(0.0, 0.0, 128.0, 128.0), (64.0, -50.0, 64.0, 90.0), (10.0, 64.0, 200.0, 64.0), (5.0, 5.0, 5.0, 5.0), (1.0, 0.0, 1.0000001, 300.0)]
    lines = spark.createDataFrame([(i, *s) for i, s in enumerate(found)], "i long, x1 double, y1 double, x2 double, y2 double")
    cells = {}
    for r in geom.walked(lines, 64.0, *(F.col(c) for c in ("x1", "y1", "x2", "y2"))).collect():
        cells.setdefault(r.i, []).append((r.gx, r.gy))
    for i, (x1, y1, x2, y2) in enumerate(found):
        met = {(math.floor((x1 + t / 500 * (x2 - x1)) / 64), math.floor((y1 + t / 500 * (y2 - y1)) / 64)) for t in range(501)}
        assert met <= set(cells[i]) and len(cells[i]) == len(set(cells[i]))
        # No cell beyond those beside the segment.
        assert all(min(max(abs(gx - x), abs(gy - y)) for x, y in met) <= 1 for gx, gy in cells[i])


def test_rays_in_bands_equal_the_loop(spark):
    random.seed(25)
    walls = [(x := random.uniform(-200, 1800), y := random.uniform(-200, 1800), x + random.uniform(-200, 200), y + random.uniform(-200, 200)) for _ in range(25)]
    at = [(random.uniform(0, 1500), random.uniform(0, 1500)) for _ in range(20)]
    c = spark.createDataFrame([(1, 1, i, *p) for i, p in enumerate(at)], "doc_id long, page_no long, cluster_idx long, cx double, cy double")
    w = spark.createDataFrame([(1, 1, i, *s) for i, s in enumerate(walls)], "doc_id long, page_no long, seg_idx long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.cluster_idx, r.ray): r.wall for r in detect.wall_hits(c, w).collect()}
    want = {}
    for i, (cx, cy) in enumerate(at):
        for ray in range(16):
            dx, dy = math.cos(2 * math.pi * ray / 16), math.sin(2 * math.pi * ray / 16)
            for x1, y1, x2, y2 in walls:
                det = dx * (y2 - y1) - dy * (x2 - x1)
                t, u = ((x1 - cx) * (y2 - y1) - (y1 - cy) * (x2 - x1)) / det, ((x1 - cx) * dy - (y1 - cy) * dx) / det
                if 0 <= u <= 1 and 10 < t <= 2000:
                    want[i, ray] = min(t, want.get((i, ray), t))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert min(want.values()) < 256 < max(want.values())


def test_a_ring_that_crosses_itself(spark):
    ring = [(200 + 100 * math.cos(math.pi * i / 8), 200 + 100 * math.sin(math.pi * i / 8)) for i in range(16)]
    bent = list(ring)
    bent[4], bent[6] = ring[6], ring[4]
    for points, repaired in ((ring, False), (bent, True)):
        hits = spark.createDataFrame([(1, 1, 0, 200.0, 200.0, i, *p, True) for i, p in enumerate(points)], "doc_id long, page_no long, cluster_idx long, cx double, cy double, ray int, hx double, hy double, is_wall boolean")
        (b,) = detect.label_boundaries(hits).collect()
        assert b.repaired is repaired and abs(b.area - 8 * 100 * 100 * math.sin(math.pi / 8)) < 1e-6


def test_lines_beside_points_equal_the_loop(spark):
    random.seed(26)
    found = [(x := random.uniform(0, 2500), y := random.uniform(0, 1700), x + random.choice((0, 60, random.uniform(-9, 9))), y + random.choice((0, 60, random.uniform(-9, 9)))) for _ in range(120)]
    points = [(random.uniform(0, 2500), random.uniform(0, 1700), random.choice((0.0, 90.0))) for _ in range(60)]
    s = spark.createDataFrame([(1, 1, i, *p, "s") for i, p in enumerate(found)], "doc_id long, page_no long, seg_idx long, x1 double, y1 double, x2 double, y2 double, fill_type string")
    g = with_geometry(s.selectExpr("*", "cast(null as array<double>) as dashes", "cast(null as array<double>) as fill")).select("doc_id", "page_no", "seg_idx", "x1", "y1", "x2", "y2", "length", "angle")
    p = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate(points)], "doc_id long, page_no long, block_idx long, px double, py double, turn double")
    got = [(r.block_idx, r.seg_idx) for r in scale.beside_lines(p, g, 50.0, 15.0).collect()]
    want = set()
    for i, (px, py, turn) in enumerate(points):
        for j, (x1, y1, x2, y2) in enumerate(found):
            size = math.hypot(x2 - x1, y2 - y1)
            far = abs((y2 - y1) * px - (x2 - x1) * py + x2 * y1 - y2 * x1) / size if size else math.hypot(px - x1, py - y1)
            off = abs(math.degrees(math.atan2(y2 - y1, x2 - x1)) % 180 - turn)
            if min(off, 180 - off) <= 15 and far < 50:
                want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_leaders_and_components_equal_the_loops(spark):
    random.seed(27)
    n = 150
    pairs = {tuple(sorted(random.sample(range(n), 2))) for _ in range(170)} | {(i, i + 1) for i in range(100, 140)}
    nodes = spark.createDataFrame([(1, 1, i) for i in range(n)], "doc_id long, page_no long, n long")
    edges = spark.createDataFrame([(1, 1, a, b) for p in pairs for a, b in (p, p[::-1])], "doc_id long, page_no long, u long, v long")
    owner, root = {}, list(range(n))
    for x in range(n):
        if x not in owner:
            owner |= {y: x for y in [x, *(b for a, b in [*pairs, *(p[::-1] for p in pairs)] if a == x)] if y not in owner}
    for a, b in pairs:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert {r.n: r.leader for r in greedy.leader_clusters(nodes, edges, "n").collect()} == owner
    assert {r.n: r.root for r in greedy.components(nodes, edges, "n").collect()} == dict(enumerate(root))


def test_lines_that_do_not_parse(spark, tmp_path):
    good = '{"doc_id":"1","page_no":0,"page_width":612.0,"page_height":792.0}'
    for name, lines in (("sheets", [good, good[:-9]]), ("paths", []), ("text_blocks", ['{"doc_id":"1","page_no":0,"block_idx":3,"text":" A "}', '{"doc_id":"1","text":"  "}', "no JSON at all"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("".join(f"{x}\n" for x in lines))
    t = tables.scan(spark, str(tmp_path), "json")
    assert t["sheets"].count() == 1 and t["paths"].count() == 0 and [r.text for r in t["text_blocks"].collect()] == [" A "]
    assert sorted((r["table"], r.bad_row) for r in t["bad_rows"].collect()) == [("sheets", good[:-9]), ("text_blocks", "no JSON at all")]


def test_with_region_keeps_the_rows_and_joins_nothing_back(spark):
    """Each point once, with its own columns: gray before hatched, edges count, points without a place are new; the same as phase_at."""
    points = spark.createDataFrame([(1, 1, 0, 10.0, 10.0, "a"), (1, 1, 1, 200.0, 10.0, "b"), (1, 1, 2, 900.0, 900.0, "c"), (1, 1, 3, None, 5.0, "d"), (1, 2, 0, 10.0, 10.0, "e")], "doc_id long, page_no long, seg_idx long, px double, py double, own string")
    regions = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 20.0, 20.0, "hatched", 0.75), (1, 1, 0.0, 0.0, 300.0, 300.0, "gray", 0.85), (1, 1, 10.0, 10.0, 10.0, 10.0, "gray", 0.85), (1, 1, 890.0, 890.0, 900.0, 900.0, "hatched", 0.75)],
        "doc_id long, page_no long, x0 double, y0 double, x1 double, y1 double, kind string, confidence double",
    )
    found = phases.with_region(points, regions, ["seg_idx"])
    rows = sorted((r.page_no, r.seg_idx, r.own, r.phase, r.confidence) for r in found.collect())
    assert rows == [(1, 0, "a", "EXISTING", 0.85), (1, 1, "b", "EXISTING", 0.85), (1, 2, "c", "NOT_IN_CONTRACT", 0.75), (1, 3, "d", "NEW", 0.75), (2, 0, "e", "NEW", 0.75)]
    at = phases.phase_at(points.select("doc_id", "page_no", "seg_idx", "px", "py"), regions, ["doc_id", "page_no", "seg_idx"])
    assert sorted((r.page_no, r.seg_idx, r.phase, r.confidence) for r in at.collect()) == [(p, i, ph, c) for p, i, _, ph, c in rows]


def test_crossings_of_a_ring_are_worked_out_once(spark):
    """Filters on what follows from a ring don't copy the test of its sides; sides off their rays are tested, whatever the others."""
    hits = spark.createDataFrame([(1, 1, 0, 200.0, 200.0, i, 300.0, 200.0 + i, True) for i in range(16)], "doc_id long, page_no long, cluster_idx long, cx double, cy double, ray int, hx double, hy double, is_wall boolean")
    plan = detect.label_boundaries(hits).where("method <> 'ESTIMATED'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") == 2


def test_areas_of_many_pairs_equal_those_of_each(spark):
    random.seed(31)

    def star(n):
        turns, x, y = sorted(random.uniform(0, 2 * math.pi) for _ in range(n)), random.uniform(0, 300), random.uniform(0, 300)
        return [c for t in turns for r in (random.uniform(20, 400),) for c in (x + r * math.cos(t), y + r * math.sin(t))]

    box = lambda x, y, w, h: [x, y, x + w, y, x + w, y + h, x, y + h]
    pairs = [(star(random.choice((5, 16))), star(random.choice((3, 16)))) for _ in range(600)] + [(box(0, 0, 10, 10), box(5, 5, 10, 10)), (box(0, 0, 10, 10), box(20, 0, 5, 5)), (box(0, 0, 10, 10), box(0, 0, 10, 10))]
    got = detect.shared_areas(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert list(got[-3:]) == [25, 0, 100] and all(abs(g - detect.common_area(a, b)) < 1e-6 for g, (a, b) in zip(got, pairs, strict=True))


def test_dealt_rows_meet_where_they_are(spark):
    """Rows dealt out by sheet are not moved for a join by sheet and cell while they are written, and the session's setting is kept."""
    left, right = (spark.range(1000).selectExpr("id % 7 as doc_id", "id % 7 as page_no", "id % 50 as gx", f"id as {n}").repartition("doc_id", "page_no").hint("merge") for n in "ab")
    joined = lambda: left.join(right, ["doc_id", "page_no", "gx"])
    moved = lambda: sum("gx" in key.split(")")[0] for key in joined()._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:])
    before = spark.conf.get(lineage.ALL_KEYS)
    with lineage.as_dealt(spark):
        assert moved() == 0
    assert spark.conf.get(lineage.ALL_KEYS) == before and moved() == 2
    assert lineage.written(joined()).count() == joined().count() and spark.conf.get(lineage.ALL_KEYS) == before


def test_edges_are_worked_out_once(spark):
    """Rounds of matching and the join after them read edges that were written, whatever made them."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (seen.add(1), x)[1], "long")
    edges = spark.range(20).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), count("id").alias("u"), (F.col("id") + 1).alias("v"), F.format_string("%03d", "id").alias("rank"))
    assert sorted(r.v for r in greedy.priority_matching(edges).collect()) == list(range(1, 21, 2)) and seen.value == 20
