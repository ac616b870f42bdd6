"""Ceiling heights mined from text and given to rooms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.operators.scale import number
from sheetloom.functions.lineage import unsent
from sheetloom.sources.views import K

DEFAULT_HEIGHT, LOWEST, HIGHEST = 10.0, 7.0, 60.0
#: Height patterns in order, imperial (feet, inches) and then metric with its unit in meters.
FEET = r"(\d+)['][-\s]?(\d+)?[\"″]?"
IMPERIAL = (rf"CLG[:\s@]*{FEET}", rf"CEIL(?:ING)?[:\s@]*{FEET}", rf"A\.?F\.?F\.?[:\s@]*{FEET}", rf"{FEET}\s*(?:CLG|CEIL(?:ING)?)", rf"\+{FEET}", r"(\d+)\s*(?:FT|FEET)\b()")
METRIC = ((r"CLG[:\s@]*(\d+)\s*MM", 0.001), (r"CEIL(?:ING)?[:\s@]*(\d+)\s*MM", 0.001), (r"CLG[:\s@]*(\d+(?:\.\d+)?)\s*M(?!M)", 1.0), (r"CEIL(?:ING)?[:\s@]*(\d+(?:\.\d+)?)\s*M(?!M)", 1.0))
ROOM_TOKEN = r"(?:^|\s)(\d{2,4}[A-Z]?|[A-Z]-?\d{2,4})(?:\s|$)"


def height_of(text: Column) -> Column:
    """Feet, from the first pattern whose value is plausible; else null."""
    t = F.upper(F.trim(text))
    hit = lambda p, feet, inches: F.struct(F.regexp_extract(t, p, 1).alias("a"), inches.alias("b"), F.lit(feet).alias("feet"))
    # Each pattern is tried once: what it found is bound before it is judged. No match leaves a empty.
    found = [hit(p, 1.0, F.regexp_extract(t, p, 2)) for p in IMPERIAL] + [hit(p, unit * 3.28084, F.lit("")) for p, unit in METRIC]
    values = F.transform(F.filter(F.array(*found), lambda h: h["a"] != ""), lambda h: number(h["a"]) * h["feet"] + number(h["b"]) / 12)
    return F.get(F.filter(values, lambda v: v.between(LOWEST, HIGHEST)), F.lit(0))


def height_mentions(blocks: DataFrame) -> DataFrame:
    """K, block_idx, height, hx, hy, room: height notes with their center and the room number in the same text."""
    token = F.nullif(F.regexp_extract(F.upper("text"), ROOM_TOKEN, 1), F.lit(""))
    got = blocks.withColumn("height", height_of(F.col("text"))).where("height is not null")
    return got.select(*K, "block_idx", "height", ((F.col("x0") + F.col("x1")) / 2).alias("hx"), ((F.col("y0") + F.col("y1")) / 2).alias("hy"), token.alias("room"))


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), r"[\s\-_]+", "")


def number_key(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d{2,4})", 1), F.lit(""))


def match_heights(rooms: DataFrame, heights: DataFrame, share: float = 0.1) -> DataFrame:
    """rooms + height, height_confidence, height_source. rooms: doc_id, page_no, poly_idx, name, cx, cy (the mean of its vertices), page_width.

    A document's notes are matched by name (HIGH), by number (MEDIUM; the last note of a
    key counts), or by the nearest one within a share of the sheet's width (LOW). The
    nearest is sought in cells as wide as the farthest reach in the document.
    """
    last = lambda key: heights.where(key.isNotNull()).groupBy("doc_id", key.alias("key")).agg(F.max_by("height", F.struct("page_no", "block_idx")).alias("h"))
    by_name, by_number = last(name_key(F.col("room"))), last(number_key(F.col("room")))
    keyed = rooms.withColumns({"k1": name_key(F.col("name")), "k2": number_key(F.col("name"))})
    one = keyed.join(by_name.select("doc_id", F.col("key").alias("k1"), F.col("h").alias("h1")), ["doc_id", "k1"], "left")
    two = one.join(by_number.select("doc_id", F.col("key").alias("k2"), F.col("h").alias("h2")), ["doc_id", "k2"], "left")
    reach = rooms.groupBy("doc_id").agg((share * F.max("page_width")).alias("cell")).where("cell > 0")
    open_ = two.where("h1 is null and h2 is null").select("doc_id", "page_no", "poly_idx", "cx", "cy", "page_width").join(reach, "doc_id")
    at = heights.join(reach, "doc_id").select("doc_id", "cell", F.col("page_no").alias("note_page"), "block_idx", F.col("height").alias("h3"), "hx", "hy")
    far = F.hypot(F.col("hx") - F.col("cx"), F.col("hy") - F.col("cy"))
    cell = lambda x: F.floor(F.col(x) / F.col("cell"))
    step = F.sequence(F.lit(-1), F.lit(1))
    near = open_.withColumns({"gx": cell("cx"), "gy": cell("cy")}).withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumns({"gx": F.col("gx") + F.col("i"), "gy": F.col("gy") + F.col("j")})
    met = unsent(near.drop("cell")).join(at.withColumns({"gx": cell("hx"), "gy": cell("hy")}), ["doc_id", "gx", "gy"]).withColumn("far", far).where(F.col("far") < share * F.col("page_width"))
    best = met.groupBy("doc_id", "page_no", "poly_idx").agg(F.min_by("h3", F.struct(F.round("far", 6), "note_page", "block_idx")).alias("h3"))
    full = two.join(best, ["doc_id", "page_no", "poly_idx"], "left")
    pick = lambda *v: reduce(lambda c, x: c.when(F.col(x[0]).isNotNull(), x[1]), v[1:-1], F.when(F.col(v[0][0]).isNotNull(), v[0][1])).otherwise(v[-1])
    level = pick(("h1", "HIGH"), ("h2", "MEDIUM"), ("h3", "LOW"), "NONE")
    source = pick(("h1", "rcp_name_match"), ("h2", "rcp_number_match"), ("h3", "rcp_location"), "default")
    return full.select(*rooms.columns, F.coalesce("h1", "h2", "h3", F.lit(DEFAULT_HEIGHT)).alias("height"), level.alias("height_confidence"), source.alias("height_source"))


def reprice(rooms: DataFrame) -> DataFrame:
    """Wall and ceiling areas for the heights that rooms have now, with a warning where the document has no note at all."""
    none = F.max(F.col("height_source") != "default").over(Window.partitionBy("doc_id"))
    warning = F.when(~none, "No ceiling heights found, using the default")
    return rooms.withColumns({"wall_area": F.col("perimeter") * F.col("height"), "ceiling_area": F.col("floor_area"), "height_warning": warning})
