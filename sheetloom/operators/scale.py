"""Dimensions, scales and calibration mined from text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.geom import angle_between, celled, covered, line_distance, ratio
from sheetloom.operators.classify import sheet_text
from sheetloom.operators.segments import with_geometry
from sheetloom.functions.lineage import unsent
from sheetloom.sources.views import K

#: Dimension patterns in order: name, pattern, inches per unit, metric.
DIMENSIONS = (
    ("feet_inches", r"""(?i)(\d+)['][-\s]?(\d+)?(?:[-\s]?(\d+/\d+))?["″]?""", 12.0, False),
    ("feet", r"""(?i)(\d+(?:\.\d+)?)\s*(?:ft|feet|['])""", 12.0, False),
    ("inches", r"""(?i)(\d+(?:\.\d+)?)\s*(?:in|inch|inches|["″])""", 1.0, False),
    ("mm", r"(?i)(\d+(?:\.\d+)?)\s*mm", 1 / 25.4, True),
    ("cm", r"(?i)(\d+(?:\.\d+)?)\s*cm", 1 / 2.54, True),
    ("m", r"(?i)(\d+(?:\.\d+)?)\s*m(?!m)", 39.37, True),
)
FRACTION = r"""(?i)(\d+)/(\d+)["″]?\s*=\s*1['][-\s]?0?["″]?"""
RATIO = r"(?i)1\s*:\s*(\d{2,})(?!\s*[AP]M)"
#: Scale phrases, their notation and points per foot.
PHRASES = ((r"(?i)QUARTER\s*INCH\s*SCALE", "QUARTER INCH SCALE", 18.0), (r"(?i)EIGHTH\s*INCH\s*SCALE", "EIGHTH INCH SCALE", 9.0), (r"(?i)HALF\s*INCH\s*SCALE", "HALF INCH SCALE", 36.0), (r"(?i)FULL\s*SCALE", "FULL SCALE", 72.0))
#: Known scales in points per foot, and metric ones.
KNOWN = (("1/16 inch = 1 foot", 4.5), ("1/8 inch = 1 foot", 9.0), ("3/16 inch = 1 foot", 13.5), ("1/4 inch = 1 foot", 18.0), ("3/8 inch = 1 foot", 27.0), ("1/2 inch = 1 foot", 36.0), ("3/4 inch = 1 foot", 54.0), ("1 inch = 1 foot", 72.0))
KNOWN_METRIC = (("1:200", 0.36), ("1:100", 0.72), ("1:50", 1.44))
DEFAULT_SCALE, DEFAULT_NOTATION = 96.0, "1/8 inch = 1 foot"
POINTS_PER_METER = 2835.0
SCALE = "struct<factor:double,notation:string>"


def number(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")).try_cast("double"), F.lit(0.0))


def rule_matches(name: str, pattern: str, per: float, metric: bool) -> Column:
    """All matches of a rule in `text` as an array of (rule, nth, matched, a, b, c, per, is_metric)."""
    groups = ("matched", "a", "b", "c") if name == "feet_inches" else ("matched", "a")
    zipped = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(g) for i, g in enumerate(groups)))

    def row(m: Column, nth: Column) -> Column:
        found = [(m[g] if g in groups else F.lit(None).cast("string")).alias(g) for g in ("matched", "a", "b", "c")]
        return F.struct(F.lit(name).alias("rule"), nth.alias("nth"), *found, F.lit(per).alias("per"), F.lit(metric).alias("is_metric"))

    return F.transform(zipped, row)


def dimension_mentions(blocks: DataFrame) -> DataFrame:
    """One row per match: K, block_idx, rule, nth, matched, inches, is_metric. Overlapping rules all report, from one reading of the blocks."""
    rows = blocks.select(*K, "block_idx", F.inline(F.concat(*(rule_matches(*rule) for rule in DIMENSIONS))))
    part = F.split("c", "/")
    # Inches and fractions of an inch stand beside feet; other rules have none.
    beside = number(F.col("b")) + F.coalesce(ratio(number(F.get(part, F.lit(0))), number(F.get(part, F.lit(1)))), F.lit(0.0))
    got = rows.select(*K, "block_idx", "rule", "nth", "matched", (number(F.col("a")) * F.col("per") + beside).alias("inches"), "is_metric")
    return got.where((F.col("rule") != "feet_inches") | (F.col("inches") > 0))


def scale_of(text: Column, convention: str = "reference") -> Column:
    """(factor, notation) of the first scale in a text, or null. convention: 'reference' n/d * 72 / 12, or 'paper' n/d * 72."""
    n, d = (F.regexp_extract(text, FRACTION, g) for g in (1, 2))
    share = ratio(number(n), number(d)) * (6.0 if convention == "reference" else 72.0)
    r = F.regexp_extract(text, RATIO, 1)
    made = lambda f, note: F.struct(f.cast("double").alias("factor"), note.alias("notation")).cast(SCALE)
    return F.coalesce(
        F.when((n != "") & (number(d) > 0), made(share, F.concat(n.try_cast("long").cast("string"), F.lit("/"), d.try_cast("long").cast("string"), F.lit(" inch = 1 foot")))),
        F.when(number(r) > 0, made(ratio(F.lit(POINTS_PER_METER), number(r)), F.concat(F.lit("1:"), r.try_cast("long").cast("string")))),
        *(F.when(text.rlike(p), made(F.lit(f), F.lit(note))) for p, note, f in PHRASES),
    )


def sheet_scale(blocks: DataFrame, sheets: DataFrame, convention: str = "reference") -> DataFrame:
    """K, factor, notation, confidence, units: from the title block, else the whole sheet, else the default."""
    text = sheet_text(blocks, sheets)
    got = text.withColumn("title", scale_of(F.col("title_text"), convention)).withColumn("whole", scale_of(F.col("all_text"), convention))
    full = sheets.select(*K).join(got, K, "left")
    best = F.coalesce("title", "whole")
    level = F.when(F.col("title").isNotNull(), "HIGH").when(F.col("whole").isNotNull(), "MEDIUM").otherwise("LOW")
    note = F.coalesce(best["notation"], F.lit(DEFAULT_NOTATION))
    return full.select(*K, F.coalesce(best["factor"], F.lit(DEFAULT_SCALE)).alias("factor"), note.alias("notation"), level.alias("confidence"), F.when(note.contains(":"), "metric").otherwise("imperial").alias("units"))


def manual_scale(text: Column) -> Column:
    """(factor, notation) of a scale that was typed in: a known name, a scale notation, or a number; else null."""
    t = F.trim(text)
    low = F.lower(t)
    known = [F.when(low.contains(n), F.struct(F.lit(f).alias("factor"), F.lit(n).alias("notation")).cast(SCALE)) for n, f in (*KNOWN, *KNOWN_METRIC)]
    plain = t.try_cast("double")
    return F.coalesce(*known, scale_of(t), F.when(plain.isNotNull(), F.struct(plain.alias("factor"), F.concat(F.lit("Factor: "), plain.cast("string")).alias("notation")).cast(SCALE)))


def conflict(a: Column, b: Column, threshold: float = 0.15) -> Column:
    """Whether two scales differ by more than threshold of the larger; zeros never do."""
    return (a != 0) & (b != 0) & (F.coalesce(ratio(F.abs(a - b), F.greatest(a, b)), F.lit(0.0)) > threshold)


def calibration(text: Column) -> Column:
    """Points per foot from "x1,y1:x2,y2=LENGTH unit"; null where the text does not parse, 0 for length 0."""
    n = r"(\d+(?:\.\d+)?)"
    pattern = rf"(?i)^{n},{n}:{n},{n}={n}\s*(ft|feet|m|meters?|in|inches?)?"
    g = lambda i: F.regexp_extract(text, pattern, i)
    unit = F.lower(g(6))
    feet = number(g(5)) * F.when(unit.startswith("m"), 3.28084).when(unit.startswith("in"), 1 / 12.0).otherwise(1.0)
    return F.when(text.rlike(pattern), F.coalesce(ratio(F.hypot(number(g(3)) - number(g(1)), number(g(4)) - number(g(2))), feet), F.lit(0.0)))


def document_scale(scales: DataFrame, overrides: DataFrame, first: int = 5) -> DataFrame:
    """doc_id, factor, source, conflicts: manual, else calibration, else the first one detected on the first sheets, else the default.

    overrides: doc_id, manual, calibration (texts or null). conflicts: first sheets whose scale conflicts with the first detected.
    """
    by = Window.partitionBy("doc_id").orderBy("page_no")
    early = scales.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= first)
    seen = early.where("confidence <> 'LOW'").withColumn("lead", F.first("factor").over(by))
    found = seen.groupBy("doc_id").agg(F.min_by("factor", "page_no").alias("detected"), F.count_if(conflict(F.col("factor"), F.col("lead"))).alias("conflicts"))
    full = scales.select("doc_id").distinct().join(found, "doc_id", "left").join(overrides, "doc_id", "left")
    manual, calibrated = manual_scale(F.col("manual"))["factor"], calibration(F.col("calibration"))
    source = F.when(manual.isNotNull(), "manual").when(calibrated > 0, "calibration").when(F.col("detected").isNotNull(), "scale_text").otherwise("default")
    return full.select("doc_id", F.coalesce(manual, F.when(calibrated > 0, calibrated), "detected", F.lit(DEFAULT_SCALE)).alias("factor"), source.alias("source"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def placed_dimensions(blocks: DataFrame) -> DataFrame:
    """The first dimension of each block with the block's center and whether the text stands upright."""
    first = dimension_mentions(blocks).withColumn("order", F.when(F.col("rule") == "feet_inches", 0).otherwise(1))
    one = first.groupBy(*K, "block_idx").agg(F.min_by("inches", F.struct("order", "rule", "nth")).alias("inches"))
    upright = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))
    return unsent(blocks).join(one, [*K, "block_idx"]).select(*K, "block_idx", "inches", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"), F.when(upright, 90.0).otherwise(0.0).alias("turn"))


def tick_marks(dimensions: DataFrame, segments: DataFrame, longest: float = 20.0, reach: float = 50.0, tolerance: float = 15.0) -> DataFrame:
    """Short segments near a dimension and across its text: K, block_idx, seg_idx, tx, ty."""
    short = with_geometry(segments).where(F.col("length") <= longest).select(*K, "seg_idx", "mid_x", "mid_y", "angle")
    both = cell_pairs(dimensions, short, reach)
    near = F.hypot(F.col("mid_x") - F.col("px"), F.col("mid_y") - F.col("py")) <= reach
    across = F.abs(angle_between(F.col("angle"), F.col("turn")) - 90) <= tolerance
    return both.where(near & across).select(*K, "block_idx", "seg_idx", F.col("mid_x").alias("tx"), F.col("mid_y").alias("ty"))


def cell_pairs(dimensions: DataFrame, midpoints: DataFrame, reach: float) -> DataFrame:
    """Dimensions with segments whose midpoint is in the 3 x 3 cells around them (cells as wide as reach)."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    mine = dimensions.withColumns({"cx": F.floor(F.col("px") / reach), "cy": F.floor(F.col("py") / reach)}).withColumn("i", step).withColumn("j", step).withColumns({"cx": F.col("cx") + F.col("i"), "cy": F.col("cy") + F.col("j")}).drop("i", "j")
    theirs = midpoints.withColumns({"cx": F.floor(F.col("mid_x") / reach), "cy": F.floor(F.col("mid_y") / reach)})
    return unsent(mine).join(theirs, [*K, "cx", "cy"]).drop("cx", "cy")


def beside_lines(points: DataFrame, lines: DataFrame, reach: float, tolerance: float, wide: float = 3.0) -> DataFrame:
    """Points (px, py, turn) with the segments whose line, taken as infinite, passes within reach under about their angle.

    A line is known by its angle and its distance from the origin, so each has one cell of these
    two; a point meets the cells of the angles that it asks for, at the distances where lines of such an angle pass near it.
    """
    way = F.radians(F.col("angle"))
    off = F.col("y1") * F.cos(way) - F.col("x1") * F.sin(way)
    placed = lines.withColumns({"turn_cell": F.floor(F.col("angle") / wide), "off_cell": F.floor(off / reach)})
    asked = points.withColumn("a", F.explode(F.sequence(F.floor((F.col("turn") - tolerance) / wide), F.floor((F.col("turn") + tolerance) / wide))))
    turned = asked.withColumn("turn_cell", F.pmod("a", F.lit(round(180 / wide)))).withColumn("way", F.radians((F.col("turn_cell") + 0.5) * wide))
    # Within a cell of angles, the distance changes by the point's own distance from the origin times half the cell.
    near = turned.withColumns({"off": F.col("py") * F.cos("way") - F.col("px") * F.sin("way"), "half": F.hypot("px", "py") * math.radians(wide) / 2 + reach + 1e-6})
    cells = near.withColumn("off_cell", F.explode(F.sequence(F.floor((F.col("off") - F.col("half")) / reach), F.floor((F.col("off") + F.col("half")) / reach))))
    pair = unsent(cells.drop("a", "way", "off", "half")).join(placed, [*K, "turn_cell", "off_cell"]).drop("turn_cell", "off_cell")
    far = line_distance(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return pair.where(angle_between(F.col("angle"), F.col("turn")) <= tolerance).withColumn("far", far).where(F.col("far") < reach)


def dimension_segments(dimensions: DataFrame, ticks: DataFrame, segments: DataFrame, near_tick: float = 5.0, reach: float = 50.0, tolerance: float = 15.0) -> DataFrame:
    """K, block_idx, seg_idx, confidence, scale: the segment that a dimension measures.

    With two ticks or more, the first segment both of whose ends are near a tick (HIGH);
    else parallel segments within reach of the text's center: the only one (MEDIUM) or
    the nearest (LOW).
    """
    g = with_geometry(segments).select(*K, "seg_idx", "x1", "y1", "x2", "y2", "length", "angle")
    enough = ticks.withColumn("n", F.count("*").over(Window.partitionBy(*K, "block_idx"))).where("n >= 2")
    # Ticks and ends of segments meet by grid cells.
    cell = 64.0
    ends = celled(g.select(*K, "seg_idx", "length", F.inline(F.array(*(F.struct(F.col(f"x{i}").alias("ex"), F.col(f"y{i}").alias("ey"), F.lit(i == 1).alias("a"), F.lit(i == 2).alias("b")) for i in (1, 2))))), cell, F.col("ex"), F.col("ey"))
    around = covered(enough.drop("seg_idx"), cell, F.col("tx") - near_tick, F.col("ty") - near_tick, F.col("tx") + near_tick, F.col("ty") + near_tick)
    span = around.join(ends, [*K, "gx", "gy"]).where(F.hypot(F.col("ex") - F.col("tx"), F.col("ey") - F.col("ty")) < near_tick)
    high = span.groupBy(*K, "block_idx", "seg_idx", "length").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a and b").groupBy(*K, "block_idx").agg(F.min_by(F.struct("seg_idx", "length"), "seg_idx").alias("high"))
    side = beside_lines(dimensions, g, reach, tolerance)
    near = side.groupBy(*K, "block_idx").agg(F.count("*").alias("n"), F.min_by(F.struct("seg_idx", "length"), F.struct(F.round("far", 6), "seg_idx")).alias("near"))
    full = dimensions.join(high, [*K, "block_idx"], "left").join(near, [*K, "block_idx"], "left").withColumn("hit", F.coalesce("high", "near"))
    level = F.when(F.col("high").isNotNull(), "HIGH").when(F.col("n") == 1, "MEDIUM").when(F.col("n") > 1, "LOW").otherwise("NONE")
    return full.select(*K, "block_idx", "hit.seg_idx", level.alias("confidence"), ratio(F.col("hit.length"), F.col("inches") / 12).alias("scale"))
