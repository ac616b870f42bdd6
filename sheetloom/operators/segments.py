"""Segment geometry, predicates and the filters that leave walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.geom import angle, length, ratio
from sheetloom.functions.lineage import unsent
from sheetloom.sources.views import K

MIN_LENGTH, MAX_LENGTH_RATIO = 5.0, 0.9
THIN, BORDER, DEFINITE, MEDIUM = 0.25, 2.0, 1.0, 0.4
ID = [*K, "seg_idx"]


def with_geometry(segments: DataFrame) -> DataFrame:
    """+ length, angle, mid_x, mid_y, is_dashed, has_fill, is_stroke_only."""
    return segments.withColumns({
        "length": length(), "angle": angle(), "mid_x": (F.col("x1") + F.col("x2")) / 2, "mid_y": (F.col("y1") + F.col("y2")) / 2,
        "is_dashed": F.coalesce(F.size("dashes") > 0, F.lit(False)), "has_fill": F.col("fill").isNotNull(), "is_stroke_only": F.coalesce(F.col("fill_type") == "s", F.lit(False)) | F.col("fill").isNull(),
    })


def dash_pattern(text: Column) -> Column:
    """The positive numbers of a dash text like "[3 4] 0"; empty for a solid line."""
    inner = F.regexp_extract(text, r"\[([^\]]*)\]", 1)
    numbers = F.transform(F.split(F.trim(inner), r"[\s,]+"), lambda x: x.try_cast("double"))
    return F.coalesce(F.filter(numbers, lambda x: x > 0), F.array().cast("array<double>"))


def wall_reason(strict: bool = False) -> Column:
    """Why a segment is no wall (short, long, thin, border, medium), or null if it is one. Needs length and the page."""
    width = F.coalesce("width", F.lit(0.0))
    diagonal = F.hypot("page_width", "page_height")
    return (
        F.when(F.col("length") < MIN_LENGTH, "short").when(F.col("length") > MAX_LENGTH_RATIO * diagonal, "long").when(width == 0, F.lit(None))
        .when(width < THIN, "thin").when(width >= BORDER, "border").when(width >= DEFINITE, F.lit(None)).when(F.lit(strict), "medium")
    )


def judged_walls(segments: DataFrame, sheets: DataFrame, strict: bool = False) -> DataFrame:
    placed = with_geometry(segments).join(sheets.select(*K, "page_width", "page_height"), K)
    return placed.withColumn("reason", wall_reason(strict))


def wall_segments(segments: DataFrame, sheets: DataFrame, strict: bool = False) -> DataFrame:
    return judged_walls(segments, sheets, strict).where(F.col("reason").isNull()).drop("reason")


def width_distribution(segments: DataFrame) -> DataFrame:
    """Per sheet: segments by weight class of their rounded width, shares in percent, and the histogram as a map."""
    w = F.round(F.coalesce("width", F.lit(0.0)), 1)
    by_width = segments.groupBy(*K, w.alias("w")).agg(F.count("*").alias("n"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    classes = {"hairline": F.col("w") == 0, "thin": F.col("w") < THIN, "medium": (F.col("w") >= MEDIUM) & (F.col("w") < DEFINITE), "thick": (F.col("w") >= DEFINITE) & (F.col("w") < BORDER), "border": F.col("w") >= BORDER}
    found = by_width.groupBy(*K).agg(F.sum("n").alias("total"), *(n(c).alias(k) for k, c in classes.items()), F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("histogram"))
    return found.select("*", *((F.col(k) * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias(f"{k}_percent") for k in classes))


def border_bounds(segments: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, x0, y0, x1, y1 of the heavy frame, where four or more heavy segments span it plausibly."""
    heavy = segments.where(F.col("width") >= BORDER).groupBy(*K).agg(
        F.min(F.least("x1", "x2")).alias("bx0"), F.min(F.least("y1", "y2")).alias("by0"), F.max(F.greatest("x1", "x2")).alias("bx1"), F.max(F.greatest("y1", "y2")).alias("by1"), F.count("*").alias("n"))
    w, h = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    ok = (F.col("n") >= 4) & (w >= 0.5 * F.col("page_width")) & (h >= 0.5 * F.col("page_height")) & ~((w > 0.98 * F.col("page_width")) & (h > 0.98 * F.col("page_height")))
    return heavy.join(sheets, K).where(ok).select(*K, F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))


def clip_midpoint(segments: DataFrame, bounds: DataFrame, margin: float = 50.0) -> DataFrame:
    """Segments whose midpoint lies inside the bounds less a margin; sheets without bounds keep all."""
    b = bounds.select(*K, *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = mx.between(F.col("b_x0") + margin, F.col("b_x1") - margin) & my.between(F.col("b_y0") + margin, F.col("b_y1") - margin)
    return segments.join(b, K, "left").where(F.col("b_x0").isNull() | inside).select(segments.columns)


def with_doc_bounds(df: DataFrame, sheets: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """+ left, top, right, bottom of the drawing area in points; without bounds, all but the right 15 %."""
    cols = ["x_min", "x_max", "y_min", "y_max"]
    placed = df.join(sheets.select(*K, "page_width", "page_height"), K)
    if bounds is not None:
        placed = placed.join(bounds.select("doc_id", *cols), "doc_id", "left")
    else:
        placed = placed.withColumns(dict.fromkeys(cols, F.lit(None).cast("double")))
    default = dict(zip(cols, (0.0, 0.85, 0.0, 1.0), strict=True))
    at = lambda c, side: F.coalesce(c, F.lit(default[c])) * F.col(side)
    return placed.withColumns({"left": at("x_min", "page_width"), "right": at("x_max", "page_width"), "top": at("y_min", "page_height"), "bottom": at("y_max", "page_height")}).drop(*cols)


def within(x: Column, y: Column) -> Column:
    return x.between(F.col("left"), F.col("right")) & y.between(F.col("top"), F.col("bottom"))


def clip_endpoints(segments: DataFrame, sheets: DataFrame, bounds: DataFrame | None = None, either: bool = False) -> DataFrame:
    a, b = within(F.col("x1"), F.col("y1")), within(F.col("x2"), F.col("y2"))
    return with_doc_bounds(segments, sheets, bounds).where(a | b if either else a & b).select(segments.columns)


def clip_polygons(polygons: DataFrame, sheets: DataFrame, bounds: DataFrame | None = None, any_vertex: bool = False) -> DataFrame:
    from sheetloom.functions.geom import centroid

    placed = with_doc_bounds(polygons, sheets, bounds).withColumn("c", centroid(F.col("vertices")))
    inside = F.exists("vertices", lambda p: within(p["x"], p["y"])) if any_vertex else within(F.col("c.x"), F.col("c.y"))
    return placed.where(inside).select(polygons.columns)


# --- flags of the filter cascade ------------------------------------------------------


def level(tolerance: float = 2.0) -> Column:
    """H, V or null, from the angle."""
    return F.when((F.col("angle") <= tolerance) | (F.col("angle") >= 180 - tolerance), "H").when(F.abs(F.col("angle") - 90) <= tolerance, "V")


def grid_lines(edge: float = 100.0, span: float = 0.7, widest: float = 1.5, dashed_only: bool = False) -> Column:
    """Thin level lines across most of the sheet, from edge to edge. Needs geometry and the page."""
    def across(a: str, b: str, side: str) -> Column:
        lo, hi = F.least(a, b), F.greatest(a, b)
        return (hi - lo >= span * F.col(side)) & (lo <= edge) & (hi >= F.col(side) - edge)

    thin = (F.coalesce("width", F.lit(0.0)) > 0) & (F.coalesce("width", F.lit(0.0)) <= widest)
    return thin & (F.lit(not dashed_only) | F.col("is_dashed")) & F.coalesce(F.when(level() == "H", across("x1", "x2", "page_width")).when(level() == "V", across("y1", "y2", "page_height")), F.lit(False))


def hatching(among: Column, least: int = 5, length_cv: float = 0.3, spacing_cv: float = 0.5, spacing_ratio: float = 0.5) -> list[dict[str, Column]]:
    """Columns, layer by layer, that end in is_hatching; only segments in among count. Needs geometry.

    Angle buckets of 2 degrees whose lengths and spacings are even and whose spacings are
    small. All layers share one partitioning, so the data is dealt out once.
    """
    by = Window.partitionBy(*K, "among", "bucket")
    turn = F.radians(F.avg("angle").over(by) + 90)
    even = (F.col("sd") <= length_cv * F.col("mean")) & (F.col("gap") > 0) & (F.col("gap_sd") <= spacing_cv * F.col("gap")) & (F.col("gap") <= spacing_ratio * F.col("mean"))
    return [
        {"among": among, "bucket": F.floor(F.col("angle") / 2) * 2},
        {"n": F.count("*").over(by), "mean": F.avg("length").over(by), "sd": F.stddev_pop("length").over(by), "at": F.round(F.col("mid_x") * F.cos(turn) + F.col("mid_y") * F.sin(turn), 6)},
        {"step": F.col("at") - F.lag("at").over(by.orderBy("at", "seg_idx"))},
        {"gap": F.avg("step").over(by), "gap_sd": F.stddev_pop("step").over(by)},
        {"is_hatching": F.col("among") & (F.col("n") >= least) & F.coalesce(even, F.lit(False))},
    ]


def with_layers(df: DataFrame, layers: list[dict[str, Column]]) -> DataFrame:
    for layer in layers:
        df = df.withColumns(layer)
    return df


def hatching_groups(segments: DataFrame) -> DataFrame:
    """ID, is_hatching."""
    return with_layers(with_geometry(segments), hatching(F.lit(True))).select(*ID, "is_hatching")


def ends(segments: DataFrame, cell: float, nearest: bool = False) -> DataFrame:
    """Two rows per segment: ID, side, x, y and the end's cell (truncated towards zero, or rounded half to even)."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("side"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    at = segments.withColumn("e", F.explode(both)).select("*", "e.*").drop("e")
    whole = F.rint if nearest else lambda v: v
    return unsent(at.withColumns({"cx": whole(F.col("x") / cell).cast("long"), "cy": whole(F.col("y") / cell).cast("long")}))


def around(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row once for every cell within reach."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    return unsent(df.withColumn("o", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o"))


def dimension_lines(segments: DataFrame, widest: float = 0.5, cell: float = 5.0, least: int = 2, part: float = 0.3, arrow: float = 20.0) -> DataFrame:
    """ID of thin lines with two or more short slanted ends at an end of theirs, and of the short segments there.

    Every line is judged on the full set, whatever is marked already.
    """
    g = with_geometry(segments)
    thin = F.coalesce("width", F.lit(1.0)) <= widest
    e = ends(g.select(*ID, "x1", "y1", "x2", "y2", "length", "angle", "width"), cell)
    mine = around(e.where(thin).select(*ID, "side", "cx", "cy", F.col("length").alias("own"), F.col("angle").alias("own_angle")))
    other = e.select(*K, F.col("seg_idx").alias("other"), F.col("side").alias("other_side"), "cx", "cy", "length", "angle")
    turn = F.abs(F.col("angle") - F.col("own_angle"))
    slant = F.least(turn, 180 - turn).between(30, 60) & (F.col("length") < part * F.col("own"))
    near = mine.join(other, [*K, "cx", "cy"]).where((F.col("other") != F.col("seg_idx")) & slant)
    # The slanted ends at one end of a line are counted beside the rows themselves, so that lines and heads come from one join.
    marked = near.withColumn("n", F.count("*").over(Window.partitionBy(*ID, "side"))).where(F.col("n") >= least)
    both = F.array(F.col("seg_idx"), F.when(F.col("length") < arrow, F.col("other")))
    return marked.select(*K, F.explode(both).alias("seg_idx")).where("seg_idx is not null").distinct()


def annotation_lines(widest: float = 0.3) -> Column:
    """Thin lines in a colour that is not near black."""
    colour = F.coalesce(F.exists(F.slice("color", 1, 3), lambda c: c >= 0.1), F.lit(False))
    return (F.coalesce("width", F.lit(1.0)) <= widest) & colour


STAGES = ("area", "grid", "hatching", "dimension", "annotation")


def filter_cascade(segments: DataFrame, sheets: DataFrame, bounds: DataFrame | None = None, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """segments + removed_by: the first stage that removes each, null for what stays. Each stage sees what the earlier ones kept."""
    on = lambda stage, flag: F.coalesce(flag, F.lit(False)) if stage in stages else F.lit(False)
    still = F.col("removed_by").isNull()
    mark = lambda stage, flag: F.coalesce("removed_by", F.when(on(stage, flag), stage))
    g = with_doc_bounds(with_geometry(segments), sheets, bounds)
    outside = ~(within(F.col("x1"), F.col("y1")) & within(F.col("x2"), F.col("y2")))
    g = g.withColumn("removed_by", F.when(on("area", outside), "area")).withColumn("removed_by", mark("grid", grid_lines()))
    g = with_layers(g, hatching(still)).withColumn("removed_by", mark("hatching", F.col("is_hatching"))).select(*segments.columns, "removed_by")
    if "dimension" in stages:
        found = dimension_lines(g.where(still).select(segments.columns)).withColumn("is_dimension", F.lit(True))
        g = g.join(found, ID, "left").withColumn("removed_by", mark("dimension", F.col("is_dimension") & still)).drop("is_dimension")
    return g.withColumn("removed_by", mark("annotation", annotation_lines())).select(*segments.columns, "removed_by")


def cascade_stats(cascaded: DataFrame) -> DataFrame:
    """Per sheet and stage: input, output, removed and its rate in percent."""
    counts = cascaded.groupBy(*K).agg(F.count("*").alias("total"), *(F.count_if(F.col("removed_by") == s).alias(s) for s in STAGES))
    before = F.col("total")
    rows = []
    for s in STAGES:
        rows.append(F.struct(F.lit(s).alias("stage"), before.alias("total_input"), (before - F.col(s)).alias("total_output"), F.col(s).alias("removed")))
        before = before - F.col(s)
    rows.append(F.struct(F.lit("total").alias("stage"), F.col("total").alias("total_input"), before.alias("total_output"), (F.col("total") - before).alias("removed")))
    flat = counts.select(*K, F.inline(F.array(*rows)))
    return flat.withColumn("removal_rate", F.coalesce(F.col("removed") * 100.0 / F.nullif(F.col("total_input"), F.lit(0)), F.lit(0.0)))


# --- the walls-only flow ---------------------------------------------------------------


def wall_color() -> Column:
    """Whether a colour can be a wall's: none, or dark in its gray value or in all of red, green and blue. Two channels are no known format and pass."""
    c = F.col("color")
    return c.isNull() | F.size(c).isin(0, 2) | F.forall(F.slice(c, 1, 3), lambda v: v < 0.2)


def axis(slope: float) -> Column:
    """H or V for segments whose rise (run) is under slope of their length; null otherwise."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    return F.when(dy < slope * F.col("length"), "H").when(dx < slope * F.col("length"), "V")


def by_position(segments: DataFrame, sheets: DataFrame, least: float, cell: float, slope: float = 0.05) -> DataFrame:
    """Level segments (+ axis, pos) with what lies on their line: n, total length, span, and the page."""
    g = with_geometry(segments).where(F.col("length") >= least).withColumn("axis", axis(slope)).where(F.col("axis").isNotNull())
    pos = F.rint(F.when(F.col("axis") == "H", F.col("mid_y")).otherwise(F.col("mid_x")) / cell) * cell
    by = Window.partitionBy(*K, "axis", "pos")
    along = lambda f: f(F.when(F.col("axis") == "H", f_of("x1", "x2", f)).otherwise(f_of("y1", "y2", f))).over(by)
    # A window beside the rows, not a join back to groups: rows that are dealt out by sheet already are not moved.
    on = g.withColumn("pos", pos).select(*ID, "axis", "pos", "length", F.count("*").over(by).alias("n"), F.sum("length").over(by).alias("total"), (along(F.max) - along(F.min)).alias("span"))
    return on.join(sheets.select(*K, "page_width", "page_height"), K)


def f_of(a: str, b: str, f) -> Column:
    return F.greatest(a, b) if f is F.max else F.least(a, b)


def grid_chains(segments: DataFrame, sheets: DataFrame) -> DataFrame:
    """ID of segments on long chains of level pieces, or level and very long themselves."""
    on = by_position(segments, sheets, 10.0, 5.0)
    side, total = F.when(F.col("axis") == "H", F.col("page_width")).otherwise(F.col("page_height")), F.when(F.col("axis") == "H", 1500.0).otherwise(1000.0)
    chain = (F.col("n") >= 3) & (F.col("span") > 0.6 * side) & (F.col("total") > total)
    return on.where(chain | (F.col("length") > 400)).select(*ID).distinct()


def grid_positions(segments: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, axis, pos of lines that span much of the sheet or gather much length."""
    on = by_position(segments, sheets, 20.0, 8.0)
    side, total = F.when(F.col("axis") == "H", F.col("page_width")).otherwise(F.col("page_height")), F.when(F.col("axis") == "H", 500.0).otherwise(400.0)
    return on.where((F.col("span") > 0.4 * side) | ((F.col("n") >= 2) & (F.col("total") > total))).select(*K, "axis", "pos").distinct()


def cluster_positions(positions: DataFrame, gap: float = 10.0) -> DataFrame:
    """K, axis, center, n: positions apart by more than gap begin a new cluster; centers are truncated means."""
    by = Window.partitionBy(*K, "axis").orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(by) > gap).cast("int"), F.lit(1))
    return positions.withColumn("new", new).withColumn("cluster", F.sum("new").over(by)).groupBy(*K, "axis", "cluster").agg(F.avg("pos").cast("long").alias("center"), F.count("*").alias("n")).drop("cluster")


def drawing_edges(segments: DataFrame, sheets: DataFrame, unsure: float = 0.78, margin: float = 0.02) -> DataFrame:
    """doc_id, edge: the share of the width where the drawing area ends, a margin before the title block; where no block is sure, before `unsure`."""
    voted = consensus_vote(title_block_line(segments, sheets), sheets)
    x1 = F.when(F.col("confidence") < 0.5, unsure).otherwise(F.col("title_block_x1"))
    return voted.select("doc_id", (x1 - margin).alias("edge"))


def walls_only(segments: DataFrame, sheets: DataFrame, grid: DataFrame, edges: DataFrame | None = None, edge: float = 0.78) -> DataFrame:
    """segments + reason: the first of ten rules that rejects each (null: kept). grid: K, axis, pos; edges: doc_id, edge of the drawing area.

    These are the rules that judge each segment by itself; `topology.wall_network` has the whole flow.
    """
    pages = sheets.select(*K, "page_width", "page_height", F.lit(edge).alias("edge"))
    if edges is not None:
        # The edge goes to the sheets first: segments are not moved for it.
        pages = pages.drop("edge").join(edges.select("doc_id", "edge"), "doc_id", "left").withColumn("edge", F.coalesce("edge", F.lit(edge)))
    g = with_geometry(segments).join(pages, K)
    places = grid.groupBy(*K).agg(*(F.collect_set(F.when(F.col("axis") == a, F.col("pos").cast("double"))).alias(f"grid_{a}") for a in "HV"))
    g = g.join(places, K, "left").withColumn("axis", axis(0.1))
    area = F.col("edge") * F.col("page_width")
    w = F.coalesce("width", F.lit(0.0))
    near = lambda a, mid: F.exists(F.coalesce(f"grid_{a}", F.array().cast("array<double>")), lambda p: F.abs(p - F.col(mid)) < 8)
    on_grid = (F.col("length") > 150) & F.when(F.col("axis") == "H", near("H", "mid_y")).otherwise(near("V", "mid_x"))
    reason = (
        F.when(F.least("x1", "x2") > area, "outside").when(F.col("is_dashed"), "dashed").when(~wall_color(), "colored").when((w > 0) & (w < 0.2), "hairline")
        .when(F.col("length") < 15, "short").when((w > 0) & (w < 0.4), "thin").when(F.col("axis").isNull(), "angled").when(on_grid, "grid").when(F.col("length") > 500, "long")
    )
    return g.select(*(F.col(c) for c in segments.columns), reason.alias("reason"))


def hatching_simple(segments: DataFrame) -> DataFrame:
    """ID, is_hatching: angle buckets round(angle / 2) * 2 with ten or more short lines of even length."""
    g = with_geometry(segments).withColumn("bucket", F.rint(F.col("angle") / 2) * 2)
    by = Window.partitionBy(*K, "bucket")
    n, mean, sd = F.count("*").over(by), F.avg("length").over(by), F.stddev_pop("length").over(by)
    return g.select(*ID, ((n >= 10) & (mean <= 200) & F.coalesce(ratio(sd, mean) < 0.5, F.lit(False))).alias("is_hatching"))


def diagonal_hatching(segments: DataFrame, least: int = 20) -> DataFrame:
    """ID, is_hatching: lines of 10 to 150 points near 45 degrees, where a sheet has enough of them."""
    g = with_geometry(segments)
    folded = F.least(F.col("angle"), 180 - F.col("angle"))
    slanted = folded.between(40, 50) & (F.col("length") >= 10) & (F.col("length") < 150)
    many = F.count_if(F.col("slanted")).over(Window.partitionBy(*K))
    return g.withColumn("slanted", slanted).select(*ID, (F.col("slanted") & (many >= least)).alias("is_hatching"))


def zone_reason() -> Column:
    """Why a segment of a sheet is left out: too thin, too short, or wholly in a margin zone; null if it stays."""
    w, h = F.col("page_width"), F.col("page_height")
    return (
        F.when(F.coalesce("width", F.lit(1.0)) < 0.8, "thin").when(F.col("length") < 10, "short").when(F.least("x1", "x2") > 0.85 * w, "right").when(F.greatest("x1", "x2") < 0.05 * w, "left")
        .when(F.greatest("y1", "y2") < 0.05 * h, "top").when(F.least("y1", "y2") > 0.92 * h, "bottom")
    )


def zone_filter(segments: DataFrame, sheets: DataFrame) -> DataFrame:
    return with_geometry(segments).join(sheets.select(*K, "page_width", "page_height"), K).withColumn("reason", zone_reason())


def title_block_line(segments: DataFrame, sheets: DataFrame) -> DataFrame:
    """doc_id, x1: the title block's left side as a share of the width.

    On the first five sheets (three where a document has fewer than five), long upright
    lines between 60 and 98 % of the width are clustered by gaps over 0.02; clusters with
    enough total length count in bins of 0.02, and the leftmost bin with two wins.
    """
    pages = sheets.withColumns({"nth": F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")), "pages": F.count("*").over(Window.partitionBy("doc_id"))})
    first = pages.where(F.col("nth") <= F.when(F.col("pages") < 5, 3).otherwise(5))
    g = with_geometry(segments).join(first.select(*K, "page_width", "page_height"), K)
    at = g.withColumn("at", F.col("mid_x") / F.col("page_width")).where((F.abs(F.col("angle") - 90) <= 5) & F.col("at").between(0.6, 0.98) & (F.col("length") >= 0.3 * F.col("page_height")))
    by = Window.partitionBy(*K).orderBy("at", "seg_idx")
    new = F.coalesce((F.col("at") - F.lag("at").over(by) > 0.02).cast("int"), F.lit(1))
    lines = at.withColumn("new", new).withColumn("cluster", F.sum("new").over(by)).groupBy(*K, "cluster", "page_height").agg(F.avg("at").alias("at"), F.sum("length").alias("total")).where(F.col("total") > 0.3 * F.col("page_height"))
    bins = lines.groupBy("doc_id", F.floor(F.round(F.col("at") / 0.02, 6)).alias("bin")).agg(F.count("*").alias("hits"), F.avg("at").alias("x1")).where("hits >= 2")
    return bins.groupBy("doc_id").agg(F.min_by("x1", "bin").alias("x1"))


def consensus_vote(estimates: DataFrame, docs: DataFrame, strategy: str = "median") -> DataFrame:
    """doc_id, x_max, confidence, title_block_x1: estimates (doc_id, x1) without outliers, put together."""
    by = Window.partitionBy("doc_id")
    near = estimates.withColumn("middle", F.percentile("x1", F.lit(0.5)).over(by)).withColumn("n", F.count("*").over(by)).where((F.col("n") == 1) | (F.abs(F.col("x1") - F.col("middle")) <= 0.10))
    pick = {"median": F.percentile("x1", F.lit(0.5)), "max": F.max("x1"), "min": F.min("x1")}[strategy]
    spread = F.max("x1") - F.min("x1")
    level_ = F.when(F.max("n") == 1, 0.5).when(spread < 0.02, 0.95).when(spread < 0.05, 0.80).when(spread < 0.10, 0.60).otherwise(0.40)
    voted = near.groupBy("doc_id").agg(pick.alias("title_block_x1"), level_.alias("confidence"))
    full = docs.select("doc_id").distinct().join(voted, "doc_id", "left")
    return full.select("doc_id", (F.coalesce("title_block_x1", F.lit(0.86)) - 0.01).alias("x_max"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "title_block_x1")
