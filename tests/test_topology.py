"""Greedy and graph operators against sequential loops and counts that must hold."""

import math
import random

from pyspark.sql import functions as F

from sheetloom.functions.greedy import components, leader_clusters, priority_matching
from sheetloom.operators import detect, labels, segments, topology
from sheetloom.plans import registry

SEG = "doc_id long, page_no long, seg_idx long, x1 double, y1 double, x2 double, y2 double, width double, dashes array<double>, fill array<double>, fill_type string"


def segs(spark, lines):
    return spark.createDataFrame([(0, 0, i, *map(float, p), 1.0, None, None, "s") for i, p in enumerate(lines)], SEG)


def test_double_wall(spark):
    got = topology.merge_double_walls(segs(spark, [(0, 0, 100, 0), (0, 6, 100, 6), (50, 50, 50, 150)])).orderBy("seg_idx").collect()
    assert [r.merged for r in got] == [True, False] and got[0].y1 == 3 and abs(got[0].x2 - got[0].x1) == 100


def test_bridges(spark):
    near = topology.bridge_gaps(segs(spark, [(0, 0, 100, 0), (130, 0, 230, 0)])).collect()
    assert len(near) == 1 and {near[0].x1, near[0].x2} == {100.0, 130.0}
    assert topology.bridge_gaps(segs(spark, [(0, 0, 100, 0), (200, 0, 300, 0)])).count() == 0
    assert topology.bridge_gaps(segs(spark, [(0, 0, 100, 0), (130, 0, 230, 0), (115, -50, 115, 50)])).count() == 0


def plain_bridges(lines, tolerance):
    """The reference's loop over dangling ends."""
    points = [p for a, b, c, d in lines for p in ((a, b), (c, d))]
    key = lambda p: (round(p[0] / 2), round(p[1] / 2))
    loose = [(p, n // 2) for n, p in enumerate(points) if sum(key(p) == key(q) for q in points) == 1]

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy or 1)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def bad(p, q, a, b):
        side = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
        cross = side(p, q, a) * side(p, q, b) < -1e-9 and side(a, b, p) * side(a, b, q) < -1e-9
        return cross or off(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), a, b) < 2

    used, out = set(), set()
    for p, s in loose:
        free = [(math.dist(p, q), n, q) for n, (q, t) in enumerate(loose) if s != t and q not in used and 18 <= math.dist(p, q) <= tolerance and not any(bad(p, q, (a, b), (c, d)) for a, b, c, d in lines)]
        if p not in used and free:
            q = min(free)[2]
            used |= {p, q}
            out.add((*p, *q))
    return out


def test_no_bridge_beside_a_wall(spark):
    got = topology.bridge_gaps(segs(spark, [(0, 0, 100, 0), (130, 0, 230, 0), (70, 1, 160, 1)])).collect()
    assert not [r for r in got if {r.x1, r.x2} == {100.0, 130.0}]
    # Over a whole wall from end to end, with a free partner further off.
    lines = [(0, 0, 100, 0), (130, 0, 230, 0), (105, 0, 125, 0), (100, 34, 0, 80)]
    assert {(r.x1, r.y1, r.x2, r.y2) for r in topology.bridge_gaps(segs(spark, lines)).collect()} == plain_bridges(lines, 36) != set()


def test_bridges_equal_the_loop(spark):
    random.seed(11)
    end = lambda v: round(v + random.uniform(-60, 60), 1)
    lines = [(x := round(random.uniform(0, 500), 1), y := round(random.uniform(0, 500), 1), end(x), y if random.random() < 0.5 else end(y)) for _ in range(90)]
    lines += [(a + 1, b + 1, c + 1, d + 1) for a, b, c, d in lines[:15]] + [(0.0, 250.0, 500.0, 251.0)]
    assert {(r.x1, r.y1, r.x2, r.y2) for r in topology.bridge_gaps(segs(spark, lines), 60.0).collect()} == plain_bridges(lines, 60)


def plain_curves(lines):
    """The reference's loop over junctions."""
    at, hit = {}, set()
    for i, (a, b, c, d) in enumerate(lines):
        if math.hypot(c - a, d - b) <= 60:
            at.setdefault((round(a / 5), round(b / 5)), []).append((i, math.atan2(d - b, c - a)))
            at.setdefault((round(c / 5), round(d / 5)), []).append((i, math.atan2(b - d, a - c)))
    for found in at.values():
        found.sort(key=lambda x: x[1])
        for n, (i, p) in enumerate(found):
            for j, q in found[n + 1 : n + 4]:
                if 0.05 < min(q - p, 2 * math.pi - (q - p)) < 0.6:
                    hit |= {i, j}
    return hit


def test_curves(spark):
    # Two chords leave to the left of (100, 100), on either side of 180 degrees; two others meet over a border between truncated cells.
    lines = [(100, 100, 60, 102), (100, 100, 60, 98), (299, 300, 340, 303), (301, 301, 340, 310)]
    assert {r.seg_idx for r in topology.curved_segments(segs(spark, lines)).collect()} == {0, 1, 2, 3} == plain_curves(lines)
    random.seed(13)
    near = lambda v, by: v + random.uniform(-by, by)
    lines = [(near(x := random.choice((-40, 0, 40)), 4), near(y := random.choice((-40, 0, 40)), 4), near(x, 50), near(y, 50)) for _ in range(150)]
    assert {r.seg_idx for r in topology.curved_segments(segs(spark, lines)).collect()} == plain_curves(lines)


def plain_groups(lines, cell, reach=1):
    """Sizes of the groups of segments with ends in cells at most reach apart."""
    at = [{(round(x / cell), round(y / cell)) for x, y in ((a, b), (c, d))} for a, b, c, d in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if any(abs(x - u) <= reach and abs(y - v) <= reach for x, y in at[i] for u, v in at[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return [root.count(r) for r in root]


def plain_pivots(lines):
    """Segments about a pivot, by a loop over the 50-point cells."""
    cells, hit = {}, set()
    for a, b, c, d in lines:
        if 5 <= math.hypot(c - a, d - b) <= 100:
            cells.setdefault((int((a + c) / 2 / 50), int((b + d) / 2 / 50)), []).append((a, b, c, d))
    for cell in cells.values():
        for p in cell if len(cell) >= 4 else ():
            for end in (p[:2], p[2:]):
                far = [(math.dist(end, ((q[0] + q[2]) / 2, (q[1] + q[3]) / 2)), q) for q in cell if q != p]
                far = [f for f in far if 20 < f[0] < 120]
                mean = sum(f[0] for f in far) / max(len(far), 1)
                if len(far) >= 3 and sum((f[0] - mean) ** 2 for f in far) / len(far) < 100:
                    hit |= {p, *(f[1] for f in far)}
    return hit


def test_groups_of_segments(spark):
    random.seed(14)
    lines = [(x := random.uniform(0, 900), y := random.uniform(0, 900), x + random.uniform(-90, 90), y + random.uniform(-90, 90)) for _ in range(150)]
    s = segs(spark, lines)
    assert {r.seg_idx: (r["size"], r.kept) for r in topology.isolated_components(s).collect()} == {i: (n, n >= 3) for i, n in enumerate(plain_groups(lines, 5))}
    lines = [(x := random.uniform(0, 320), y := random.uniform(0, 320), x + random.uniform(-90, 90), y + random.uniform(-90, 90)) for _ in range(110)]
    s, short = segs(spark, lines), [p for p in lines if math.dist(p[:2], p[2:]) <= 100]
    want = {p for p, n in zip(short, plain_groups(short, 15, 0), strict=True) if n >= 3}
    about = plain_pivots(lines)
    assert {lines[r.seg_idx] for r in topology.door_swings(s).collect()} == want | about and about - want and want - about


def test_label_box(spark):
    box = [(0, 0, 40, 0), (0, 20, 40, 20), (0, 0, 0, 20), (40, 0, 40, 20)]
    assert {r.seg_idx for r in topology.label_boxes(segs(spark, [*box, (200, 0, 240, 0), (200, 0, 200, 20)])).collect()} == {0, 1, 2, 3}
    assert topology.label_boxes(segs(spark, box[:3])).count() == 0


def plain_boxes(lines, least, most):
    """Boxes by a loop over pairs of level segments."""
    size = lambda p: math.dist(p[:2], p[2:])
    fit = [(i, p) for i, p in enumerate(lines) if least <= size(p) <= most]
    level = [(i, min(p[0], p[2]), max(p[0], p[2]), (p[1] + p[3]) / 2) for i, p in fit if abs(p[3] - p[1]) < 1]
    up = [(i, (p[0] + p[2]) / 2, min(p[1], p[3]), max(p[1], p[3])) for i, p in fit if abs(p[2] - p[0]) < 1]
    hit = set()
    for i, l, r, y in level:
        for j, ol, o_r, oy in level:
            if oy > y and 5 <= oy - y <= most and min(r, o_r) - max(l, ol) >= 0.5 * min(r - l, o_r - ol):
                at = [(k, x) for k, x, t, u in up if t <= y + 5 and u >= oy - 5]
                left, right = {k for k, x in at if abs(x - l) <= 5}, {k for k, x in at if abs(x - r) <= 5}
                if left and right:
                    hit |= {i, j} | left | right
    return hit


def test_label_boxes_equal_the_loop(spark):
    random.seed(15)
    at = lambda: random.randrange(-30, 300, 6) + random.uniform(-1, 1)
    lines = [(x := at(), y := at(), x + n * h, y + n * (not h)) for n, h in ((random.choice((18, 30, 42, 66)), random.random() < 0.5) for _ in range(240))]
    want = plain_boxes(lines, 15, 80)
    assert {r.seg_idx for r in topology.label_boxes(segs(spark, lines)).collect()} == want and 10 < len(want) < 240


def test_wall_network(spark):
    """A room of five pieces stays; a chain over the sheet, a small box and a loose piece go, each for its reason."""
    room = [(100, 100, 300, 100), (300, 100, 300, 300), (300, 300, 200, 300), (200, 300, 100, 300), (100, 300, 100, 100)]
    box = [(400, 400, 430, 400), (400, 420, 430, 420), (400, 400, 400, 420), (430, 400, 430, 420)]
    lines = [*room, (20, 600, 440, 600), *box, (500, 500, 560, 500), (500, 100, 560, 140)]
    sheets = spark.createDataFrame([(0, 0, 1000.0, 800.0)], "doc_id long, page_no long, page_width double, page_height double")
    grid = spark.createDataFrame([], "doc_id long, page_no long, axis string, pos double")
    s = segs(spark, lines).selectExpr("*", "cast(null as array<double>) as color")
    got = {r.seg_idx: r.reason for r in topology.wall_network(s, sheets, grid).collect()}
    assert got == {**dict.fromkeys(range(5)), 5: "chain", **dict.fromkeys(range(6, 10), "box"), 10: "isolated", 11: "angled"}


def test_walls_only_is_the_whole_flow(spark, sf_dir):
    """The query's reasons have those of the steps after the ten rules, and its rules take both ends, the title block's edge and grid lines under 8 points."""
    got = {r.reason for r in registry.queries()["walls_only"](spark, sf_dir).select("reason").distinct().collect()}
    assert {"outside", "kept", "isolated"} <= got
    lines = [(700, 10, 800, 10), (765, 20, 900, 20), (100, 308, 300, 308), (100, 307, 300, 307), (650, 100, 650, 600)]
    s = segs(spark, lines).selectExpr("*", "cast(null as array<double>) as color")
    sheets = spark.createDataFrame([(0, 0, 1000.0, 800.0)], "doc_id long, page_no long, page_width double, page_height double")
    grid = spark.createDataFrame([(0, 0, "H", 300)], "doc_id long, page_no long, axis string, pos long")
    edges = segments.drawing_edges(s, sheets)
    assert [r.edge for r in edges.collect()] == [0.78 - 0.02]
    reasons = lambda e: [r.reason for r in segments.walls_only(s, sheets, grid, e).orderBy("seg_idx").collect()]
    assert reasons(edges) == [None, "outside", None, "grid", None]
    # Two sheets with one upright are a title block.
    two = segs(spark, lines[4:]).crossJoin(spark.range(2).withColumnRenamed("id", "p")).withColumn("page_no", F.col("p")).drop("p")
    pages = spark.createDataFrame([(0, 0, 1000.0, 800.0), (0, 1, 1000.0, 800.0)], sheets.schema)
    block = segments.drawing_edges(two, pages)
    assert [round(r.edge, 6) for r in block.collect()] == [0.63]
    assert reasons(block) == ["outside", "outside", None, "grid", "outside"]


def ring(x, y, w):
    return [(x, y, x + w, y), (x + w, y, x + w, y + w), (x + w, y + w, x, y + w), (x, y + w, x, y)]


def test_holes(spark):
    """A ring in a ring in a ring, and one that touches its outer ring from within at a corner."""
    nested = [*ring(0, 0, 200), *ring(50, 50, 100), *ring(80, 80, 20)]
    touching = [(400, 0, 600, 0), (600, 0, 600, 200), (600, 200, 400, 200), (400, 200, 400, 0), (400, 0, 500, 50), (500, 50, 450, 100), (450, 100, 400, 0)]
    polygons = topology.faces(topology.node_segments(segs(spark, [*nested, *touching])))
    got = sorted((r.area, r.hole_area, len(r.vertices)) for r in polygons.collect())
    assert got == [(400, 0, 4), (3750, 0, 3), (9600, 400, 4), (30000, 10000, 4), (36250, 3750, 4)]
    sheets = spark.createDataFrame([(0, 0, 1000.0, 800.0)], "doc_id long, page_no long, page_width double, page_height double")
    assert sorted(r.area for r in topology.filter_polygons(polygons, sheets, 500.0).collect()) == [9600, 30000, 36250]
    assert sorted(r.area for r in topology.filter_polygons(polygons, sheets, 500.0, holes=0.2).collect()) == [9600, 36250]


def test_square_and_cross(spark):
    square = [(0, 0, 100, 0), (100, 0, 100, 100), (100, 100, 0, 100), (0, 100, 0, 0)]
    one = topology.faces(topology.node_segments(segs(spark, square))).collect()
    assert [r.area for r in one] == [10000.0]
    four = topology.faces(topology.node_segments(segs(spark, [*square, (50, -20, 50, 100), (0, 50, 130, 50)]))).collect()
    assert sorted(r.area for r in four) == [2500.0] * 4 and four[0].dangles == 2


def test_faces_obey_euler(spark):
    random.seed(7)
    lines = [(x := random.randrange(6) * 40, y := random.randrange(6) * 40, x + 40 * (h := random.random() < 0.5), y + 40 * (not h)) for _ in range(70)]
    edges = topology.node_segments(segs(spark, lines))
    e = [(r.x1, r.y1, r.x2, r.y2) for r in edges.collect()]
    parent = {}

    def find(p):
        parent.setdefault(p, p)
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b, c, d in e:
        parent[find((a, b))] = find((c, d))
    nodes = set(parent)
    assert topology.faces(edges).count() == len(e) - len(nodes) + len({find(p) for p in nodes})


def test_matching_uses_each_node_once(spark):
    random.seed(1)
    rows = list({(0, 0, a, b): (0, 0, a, b, f"{random.random():.9f}") for a, b in ((random.randrange(30), random.randrange(30)) for _ in range(120)) if a < b}.values())
    got = {(r.u, r.v) for r in priority_matching(spark.createDataFrame(rows, "doc_id long, page_no long, u long, v long, rank string"), "u", "v").collect()}
    used, want = set(), set()
    for _, _, a, b, _ in sorted(rows, key=lambda r: r[4]):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want


def test_leaders_and_components(spark):
    nodes = spark.createDataFrame([(0, 0, i) for i in range(6)], "doc_id long, page_no long, n long")
    pairs = [(0, 1), (1, 2), (3, 4)]
    edges = spark.createDataFrame([(0, 0, a, b) for p in pairs for a, b in (p, p[::-1])], "doc_id long, page_no long, u long, v long")
    assert {r.n: r.leader for r in leader_clusters(nodes, edges, "n").collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    assert {r.n: r.root for r in components(nodes, edges, "n").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_common_area():
    ring = lambda x, y, w: [x, y, x + w, y, x + w, y + w, x, y + w]
    # A star and a bar across two of its arms share two pieces.
    fork = [0, 0, 10, 0, 10, 10, 8, 10, 8, 2, 2, 2, 2, 10, 0, 10]
    assert detect.common_area(fork, ring(-5, 4, 30)) == 24 and detect.common_area(fork, [5, -5, 15, 5, 5, 15, -5, 5]) == detect.common_area([5, -5, 15, 5, 5, 15, -5, 5], fork)
    assert detect.common_area(ring(0, 0, 10), ring(5, 5, 10)) == 25 and detect.common_area(ring(0, 0, 10), ring(20, 0, 5)) == 0


def test_rays_in_a_closed_square(spark):
    walls = segs(spark, [(100, 100, 300, 100), (300, 100, 300, 300), (300, 300, 100, 300), (100, 300, 100, 100)])
    lab = spark.createDataFrame([(0, 0, 0, 200.0, 200.0)], "doc_id long, page_no long, cluster_idx long, cx double, cy double")
    sheets = spark.createDataFrame([(0, 0, 612.0, 792.0)], "doc_id long, page_no long, page_width double, page_height double")
    b = detect.label_boundaries(detect.ray_hits(lab, walls, sheets)).first()
    assert b.wall_hits == 16 and b.method == "CLOSED" and abs(b.area - 40000) < 20000
    open_ = detect.label_boundaries(detect.ray_hits(lab, walls.where("seg_idx <> 1"), sheets)).first()
    assert open_.method == "PARTIAL" and open_.wall_hits < 16


def test_label_matches(spark):
    sq = "array(struct({x}D as x, 100D as y), struct({x2}D as x, 100D as y), struct({x2}D as x, 200D as y), struct({x}D as x, 200D as y))"
    polys = spark.sql(" union all ".join(f"select 0L as doc_id, 0L as page_no, {i}L as poly_idx, {sq.format(x=x, x2=x + 100)} as vertices" for i, x in enumerate((100, 300, 500))))
    labs = spark.createDataFrame([(0, 0, 0, "A", 160.0, 150.0), (0, 0, 1, "B", 300.5, 150.0)], "doc_id long, page_no long, block_idx long, text string, cx double, cy double")
    got = labels.match_labels(labs, polys).orderBy("poly_idx").collect()
    assert [(r.room_name, r.name_confidence) for r in got] == [("A", "HIGH"), ("B", "HIGH"), ("ROOM_1", "NONE")]


def test_doublings_of_cycles_move_no_rows(spark):
    """Rows that are dealt out by sheet stay where they are; cycles longer than one writing's doublings are found whole."""
    from sheetloom.operators import planar

    rows = [(0, 1, i, (i + 7) % 100) for i in range(100)] + [(0, 2, 200 + i, 200 + (i + 1) % 3) for i in range(3)] + [(0, 2, 300, 300)]
    follows = spark.createDataFrame(rows, "doc_id long, page_no long, id long, next long")
    want, after = {}, {i: n for *_, i, n in rows}
    for i in after:
        walk = [i]
        while after[walk[-1]] != i:
            walk.append(after[walk[-1]])
        want[i] = (min(walk), walk.index(min(walk)))
    assert {r.id: (r.face, r.away) for r in planar.cycles(follows).collect()} == want
    state = follows.selectExpr("doc_id", "page_no", "id", "id as face", "0L as away", "next as jump").repartition("doc_id", "page_no")
    plan = planar.doubled(planar.doubled(state, 1), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_cycles_as_arrays_equal_those_by_windows(spark):
    """Sheets of any size: many at once as arrays, the largest by windows; twins' faces are told alike."""
    from sheetloom.operators import planar

    random.seed(41)
    rows = []
    for page, n in enumerate((2, 40, 6, 120, 8)):
        after = list(range(n))
        random.shuffle(after)
        rows += [(0, page, i, j, f"{page}.{i}") for i, j in enumerate(after)]
    follows = spark.createDataFrame(rows, "doc_id long, page_no long, id long, next long, name string")
    whole, none, some = (sorted(planar.cycles(follows, at_once=8, large=n).collect()) for n in (1000, 0, 50))
    assert whole == none == some and len(whole) == len(rows) and all(r.name == f"{r.page_no}.{r.id}" for r in whole)
    face = {(r.page_no, r.id): r.face for r in whole}
    assert all(r.other == face[r.page_no, r.id ^ 1] for r in whole)


def test_sheets_come_whole_or_in_pieces():
    """Batches that end within sheets: small sheets are handed on whole, once, and large ones in pieces."""
    import pyarrow as pa

    from sheetloom.operators import planar

    sizes = {0: 3, 1: 30, 2: 1, 3: 9, 4: 25, 5: 2}
    pages = [p for p, n in sizes.items() for _ in range(n)]
    batches = [pa.record_batch({"doc_id": [0] * len(part), "page_no": part, "n": list(range(i, i + len(part)))}) for i in range(0, len(pages), 7) for part in (pages[i : i + 7],)]
    got = [(t.column("page_no").to_pylist(), t.column("n").to_pylist(), whole) for t, whole in planar.whole_sheets(iter(batches), 5, 10)]
    assert [n for _, ns, _ in got for n in ns] == list(range(len(pages)))
    for p, n in sizes.items():
        parts = [(pages.count(p), whole) for pages, _, whole in got if p in pages]
        assert {whole for _, whole in parts} == {n <= 10} and (len(parts) == 1 if n <= 10 else sum(c for c, _ in parts) == n)
