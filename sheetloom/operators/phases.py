"""Construction phases: of words, fills, regions and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.geom import celled, common_corner, covered
from sheetloom.functions.greedy import leader_clusters
from sheetloom.operators.segments import with_geometry
from sheetloom.functions.lineage import unsent
from sheetloom.sources.views import K

#: Points in a side of the grid cells that points and regions meet by.
CELL = 128.0
NAMES = ("NEW", "EXISTING", "NOT_IN_CONTRACT", "DEMO", "UNKNOWN")
#: Legend headings in order of priority.
LEGEND_WORDS = ("CONSTRUCTION PLAN LEGEND", "LEGEND - CONSTRUCTION", "WALL LEGEND", "SYMBOL LEGEND", "LEGEND")
#: What legend entries of each phase say.
ENTRY_PATTERNS = {
    "NEW": [r"NEW\s*(CONSTRUCTION|WALLS?|WORK)?", r"PROPOSED\s*(CONSTRUCTION|WALLS?)?", r"NEW\s*INTERIOR\s*WALLS?"],
    "EXISTING": [r"EXIST(ING)?\s*(CONSTRUCTION|WALLS?|TO\s*REMAIN)?", r"EXISTING\s*BUILDING", r"WALLS?\s*TO\s*REMAIN", r"REMAIN(ING)?\s*WALLS?"],
    "NOT_IN_CONTRACT": [r"N\.?I\.?C\.?", r"NOT\s*IN\s*CONTRACT", r"AREA\s*NOT\s*IN\s*CONTRACT", r"OUTSIDE\s*SCOPE", r"BY\s*OTHERS"],
    "DEMO": [r"DEMO(LITION)?", r"REMOVE", r"DEMOLISH", r"TO\s*BE\s*REMOVED", r"WALLS?\s*TO\s*REMOVE"],
}
#: The legend where a sheet has none: label, phase, fill, gray, line, confidence.
DEFAULT_LEGEND = (("NEW CONSTRUCTION", "NEW", "NONE", None, "solid", 0.80), ("EXISTING CONSTRUCTION", "EXISTING", "SOLID_GRAY", 0.5, "solid", 0.85), ("NOT IN CONTRACT", "NOT_IN_CONTRACT", "HATCHED", None, "solid", 0.75), ("DEMOLITION", "DEMO", "NONE", None, "dashed", 0.70))
ENTRY = "doc_id long, page_no long, label string, phase string, fill_pattern string, gray double, line_style string, confidence double"


def normalized(text: Column) -> Column:
    """The phase that a text names."""
    t = F.upper(F.trim(text))
    has = lambda *words: _any(t.contains(w) for w in words)
    new = (t.contains("NEW") & has("CONSTRUCTION", "WORK", "WALL")) | (t == "NEW")
    found = F.when(t.isin(*NAMES), t).when(new, "NEW").when(has("EXIST"), "EXISTING").when(has("N.I.C", "NIC", "NOT IN CONTRACT"), "NOT_IN_CONTRACT").when(has("DEMO", "REMOVE", "DEMOLISH"), "DEMO")
    return F.coalesce(found, F.lit("UNKNOWN"))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def in_scope(phase: Column, new_only: bool = False) -> Column:
    return phase == "NEW" if new_only else phase.isin("NEW", "EXISTING")


def gray_of(fill: Column) -> tuple[Column, Column]:
    """(gray level, spread of the channels) of a fill."""
    c = lambda i: F.get(fill, F.lit(i))
    three = F.size(fill) >= 3
    spread = F.greatest(F.abs(c(0) - c(1)), F.abs(c(1) - c(2)), F.abs(c(0) - c(2)))
    return F.when(three, (c(0) + c(1) + c(2)) / 3).otherwise(c(0)), F.when(three, spread).otherwise(F.lit(0.0))


def is_gray(fill: Column) -> Column:
    gray, spread = gray_of(fill)
    return F.coalesce((spread <= 0.05) & gray.between(0.25, 0.75), F.lit(False))


def fill_phase(fill: Column, fill_type: Column) -> Column:
    """(pattern, phase, confidence) of a fill."""
    gray, spread = gray_of(fill)
    made = lambda p, ph, c: F.struct(F.lit(p).alias("pattern"), F.lit(ph).alias("phase"), F.lit(c).alias("confidence"))
    return (
        F.when(fill.isNull() | (F.coalesce(fill_type, F.lit("")) == "s"), made("NONE", "NEW", 0.80)).when(spread > 0.1, made("UNKNOWN", "UNKNOWN", 0.50)).when(gray > 0.95, made("WHITE", "UNKNOWN", 0.60))
        .when(gray < 0.10, made("SOLID_BLACK", "EXISTING", 0.70)).when(gray.between(0.25, 0.75), made("SOLID_GRAY", "EXISTING", 0.85)).otherwise(made("UNKNOWN", "UNKNOWN", 0.50))
    )


def gray_regions(paths: DataFrame, area: float = 100.0, aspect: float = 3.0, long_side: float = 20.0) -> DataFrame:
    """K, region_idx, x0, y0, x1, y1, kind, confidence: boxes of long gray shapes."""
    points = F.flatten(F.transform("items", lambda i: i["pts"]))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    boxed = paths.where(is_gray(F.col("fill"))).withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    short, long_ = F.least(w, h), F.greatest(w, h)
    shaped = (short == 0) | ((long_ >= aspect * short) & (long_ >= long_side))
    return boxed.where((w * h >= area) & shaped).select(*K, F.col("path_idx").alias("region_idx"), "x0", "y0", "x1", "y1", F.lit("gray").alias("kind"), F.lit(0.85).alias("confidence"))


def hatched_regions(segments: DataFrame, reach: float = 50.0, turn: float = 5.0, least: int = 5, area: float = 100.0) -> DataFrame:
    """K, region_idx, x0, y0, x1, y1, kind, confidence: boxes of slanted unfilled lines, clustered around leaders in index order."""
    slant = F.col("angle").between(40, 50) | F.col("angle").between(130, 140)
    g = with_geometry(segments).where(F.col("fill").isNull() & (F.col("length") >= 5) & slant)
    g = g.withColumn("n", F.count("*").over(Window.partitionBy(*K))).where(F.col("n") >= least).drop("n")
    cell = lambda c: F.floor(F.col(c) / reach)
    step = F.sequence(F.lit(-1), F.lit(1))
    mine = g.select(*K, F.col("seg_idx").alias("u"), F.col("mid_x").alias("ux"), F.col("mid_y").alias("uy"), F.col("angle").alias("ua")).withColumns({"gx": cell("ux"), "gy": cell("uy")}).withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumns({"gx": F.col("gx") + F.col("i"), "gy": F.col("gy") + F.col("j")})
    theirs = g.select(*K, F.col("seg_idx").alias("v"), "mid_x", "mid_y", "angle").withColumns({"gx": cell("mid_x"), "gy": cell("mid_y")})
    near = unsent(mine).join(theirs, [*K, "gx", "gy"]).where((F.col("u") != F.col("v")) & (F.abs(F.col("ua") - F.col("angle")) <= turn) & (F.hypot(F.col("ux") - F.col("mid_x"), F.col("uy") - F.col("mid_y")) < reach))
    owned = unsent(g).join(leader_clusters(g, near, "seg_idx"), [*K, "seg_idx"])
    boxes = owned.groupBy(*K, F.col("leader").alias("region_idx")).agg(F.count("*").alias("n"), F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("x1", "x2")).alias("x1"), F.max(F.greatest("y1", "y2")).alias("y1"))
    large = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= area
    return boxes.where((F.col("n") >= least) & large).select(*K, "region_idx", "x0", "y0", "x1", "y1", F.lit("hatched").alias("kind"), F.lit(0.75).alias("confidence"))


def phase_at(points: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """key, phase, confidence: by the gray region that holds a point (px, py), else a hatched one, else NEW."""
    placed = celled(points, CELL, F.col("px"), F.col("py"))
    spread = covered(regions.select(*K, "x0", "y0", "x1", "y1", "kind", F.col("confidence").alias("c")), CELL, *map(F.col, ("x0", "y0", "x1", "y1")))
    held = placed.join(spread, [*K, "gx", "gy"]).where(F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    best = held.groupBy(*key).agg(F.min("kind").alias("kind"), F.min_by("c", "kind").alias("c"))
    full = points.select(*key).join(best, key, "left")
    return full.select(*key, F.when(F.col("kind") == "gray", "EXISTING").when(F.col("kind") == "hatched", "NOT_IN_CONTRACT").otherwise("NEW").alias("phase"), F.coalesce("c", F.lit(0.75)).alias("confidence"))


def legend_region(blocks: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, lx0, ly0, lx1, ly1, keyword: the area around the best legend heading."""
    upper = F.upper("text")
    place = F.coalesce(*(F.when(upper.contains(w), F.lit(i)) for i, w in enumerate(LEGEND_WORDS)))
    heads = blocks.withColumn("place", place).where("place is not null").join(sheets.select(*K, "page_width", "page_height"), K)
    best = heads.withColumn("left", (F.col("x0") < 0.7 * F.col("page_width")).cast("int")).withColumn("nth", F.row_number().over(Window.partitionBy(*K).orderBy("place", "left", "block_idx"))).where("nth = 1")
    word = F.element_at(F.array(*map(F.lit, LEGEND_WORDS)), F.col("place") + 1)
    clamp = lambda v, hi: F.greatest(F.lit(0.0), F.least(v, F.col(hi)))
    return best.select(*K, clamp(F.col("x0") - 150, "page_width").alias("lx0"), clamp(F.col("y0") - 75, "page_height").alias("ly0"), clamp(F.col("x1") + 300, "page_width").alias("lx1"), clamp(F.col("y1") + 900, "page_height").alias("ly1"), word.alias("keyword"))


def legend_entries(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """K, phase, label, block_idx, confidence: the first block of each phase in a sheet's legend."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = blocks.join(regions, K).where(cx.between(F.col("lx0"), F.col("lx1")) & cy.between(F.col("ly0"), F.col("ly1")))
    phases = F.array_compact(F.array(*(F.when(F.upper("text").rlike("|".join(f"(?:{p})" for p in ps)), F.lit(k)) for k, ps in ENTRY_PATTERNS.items())))
    hits = inside.where(~F.upper("text").contains("LEGEND")).withColumn("phase", F.explode(phases))
    return hits.groupBy(*K, "phase").agg(F.min_by("text", "block_idx").alias("label"), F.min("block_idx").alias("block_idx"), F.lit(0.85).alias("confidence"))


def legend_confidence(entries: DataFrame) -> DataFrame:
    """K, n, confidence of each sheet's legend."""
    has = lambda p: F.max(F.when(F.col("phase") == p, 0.05).otherwise(0.0))
    return entries.groupBy(*K).agg(F.count("*").alias("n"), F.least(F.lit(0.95), 0.70 + F.least(F.lit(0.25), F.count("*") * 0.05) + has("NEW") + has("EXISTING")).alias("confidence"))


def legend_or_default(entries: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, phase, label, confidence, has_legend: a sheet's own entries, or the four of the trade."""
    own = entries.select(*K, "phase", "label", "confidence", F.lit(True).alias("has_legend"))
    trade = F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(n).alias("label"), F.lit(0.75).alias("confidence")) for n, p, *_ in DEFAULT_LEGEND))
    rest = sheets.select(*K).join(entries.select(*K).distinct(), K, "left_anti").select(*K, F.inline(trade)).withColumn("has_legend", F.lit(False))
    return own.unionByName(rest)


def legend_fill_match(fills: DataFrame, entries: DataFrame, *key: str, tolerance: float = 0.1) -> DataFrame:
    """K, key, phase of those of a sheet's legend entries (its own, or the trade's) that a fill agrees with.

    An entry's fill follows from its phase. No fill agrees with entries drawn without one;
    a fill agrees with an entry's color if each of its first three channels is near it.
    """
    drawn = F.create_map(*(F.lit(x) for _, phase, pattern, *_ in DEFAULT_LEGEND for x in (phase, pattern)))
    gray = {phase: v for _, phase, _, v, *_ in DEFAULT_LEGEND if v is not None}
    color = F.element_at(F.create_map(*(F.lit(x) for kv in gray.items() for x in kv)), F.col("phase"))
    near = (F.size("fill") >= 3) & F.forall(F.slice("fill", 1, 3), lambda v: F.abs(v - color) < tolerance)
    fits = F.when(F.col("fill").isNull(), F.element_at(drawn, F.col("phase")) == "NONE").otherwise(color.isNotNull() & near)
    return fills.select(*K, *key, "fill").join(entries.select(*K, "phase"), K).where(fits).select(*K, *key, "phase")


def with_region(points: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """points (K, key, px, py, ...) + phase and confidence, as phase_at gives them.

    The rows go to the cells whole, once: a point has one cell, so that what is found for it is sorted out where it is found, and nothing is joined back.
    """
    placed = celled(points, CELL, F.col("px"), F.col("py"))
    at = {c: f"r_{c}" for c in (*K, "gx", "gy")}
    spread = covered(regions.select(*K, "x0", "y0", "x1", "y1", "kind", F.col("confidence").alias("c")), CELL, *map(F.col, ("x0", "y0", "x1", "y1"))).withColumnsRenamed(at)
    on = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    for c, r in at.items():
        on = (F.col(c) == F.col(r)) & on
    first = Window.partitionBy(*K, "gx", "gy", *key).orderBy(F.col("kind").asc_nulls_last(), "c")
    held = placed.join(spread, on, "left").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return held.select(*points.columns, F.when(F.col("kind") == "gray", "EXISTING").when(F.col("kind") == "hatched", "NOT_IN_CONTRACT").otherwise("NEW").alias("phase"), F.coalesce("c", F.lit(0.75)).alias("confidence"))


def classify(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """K, seg_idx, phase, confidence, method: by fill, else by region, else by stroke."""
    f = fill_phase(F.col("fill"), F.col("fill_type"))
    own = with_geometry(segments).select(*K, "seg_idx", "is_stroke_only", "length", F.col("mid_x").alias("px"), F.col("mid_y").alias("py"), f.alias("f"), (F.col("fill").isNotNull() & (F.coalesce("fill_type", F.lit("")) != "s")).alias("filled"))
    both = with_region(own, regions, ["seg_idx"]).withColumnsRenamed({"phase": "r_phase", "confidence": "r_conf"})
    by_fill = F.col("filled") & (F.col("f.confidence") >= 0.70)
    by_region = F.col("r_phase") != "NEW"
    pick = lambda a, b, c, d: F.when(by_fill, a).when(by_region, b).when(F.col("is_stroke_only"), c).otherwise(d)
    return both.select(*K, "seg_idx", "length", pick(F.col("f.phase"), F.col("r_phase"), F.lit("NEW"), F.lit("NEW")).alias("phase"), pick(F.col("f.confidence"), F.col("r_conf"), F.lit(0.75), F.lit(0.60)).alias("confidence"), pick(F.lit("fill_color"), F.lit("spatial_region"), F.lit("stroke_only"), F.lit("default")).alias("method"))


def classify_simple(segments: DataFrame) -> DataFrame:
    gray, stroke = is_gray(F.col("fill")), F.col("fill").isNull() | (F.col("fill_type") == "s")
    return segments.select(*K, "seg_idx", F.when(gray, "EXISTING").when(stroke, "NEW").otherwise("UNKNOWN").alias("phase"), F.when(gray, 0.85).when(stroke, 0.75).otherwise(0.50).alias("confidence"))


def phase_stats(classified: DataFrame) -> DataFrame:
    """Per sheet: total, count of each phase, average and least confidence, counts by method as a map."""
    one = classified.groupBy(*K, "method").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.min("confidence").alias("least"), *(F.count_if(F.col("phase") == p).alias(p) for p in NAMES))
    return one.groupBy(*K).agg(F.sum("n").alias("total"), *(F.sum(p).alias(p.lower()) for p in NAMES), (F.sum("c") / F.sum("n")).alias("avg_confidence"), F.min("least").alias("min_confidence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("methods"))


def region_overlaps(regions: DataFrame) -> DataFrame:
    """K, a, b: pairs of regions whose boxes touch."""
    spread = covered(regions.select(*K, "region_idx", "x0", "y0", "x1", "y1"), CELL, *map(F.col, ("x0", "y0", "x1", "y1")))
    o = spread.select(*K, "gx", "gy", F.col("region_idx").alias("b"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))
    once = common_corner(CELL, F.col("x0"), F.col("y0"), F.col("o_x0"), F.col("o_y0"))
    touch = (F.col("x0") <= F.col("o_x1")) & (F.col("o_x0") <= F.col("x1")) & (F.col("y0") <= F.col("o_y1")) & (F.col("o_y0") <= F.col("y1"))
    return spread.withColumnRenamed("region_idx", "a").join(o, [*K, "gx", "gy"]).where((F.col("a") < F.col("b")) & once & touch).select(*K, "a", "b")


def phase_quantities(classified: DataFrame, scale: Column) -> DataFrame:
    """doc_id, phase, wall_length in feet of what is in scope, with totals over either (null)."""
    return classified.where(in_scope(F.col("phase"))).withColumn("feet", F.col("length") / F.nullif(scale, F.lit(0.0))).cube("doc_id", "phase").agg(F.round(F.sum("feet"), 3).alias("wall_length"), F.count("*").alias("segments"))
