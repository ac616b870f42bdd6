"""Sheet classification: processing paths, page types, summaries, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.sources.views import K

#: Keywords of each page type, in order of priority.
PAGE_TYPES = {
    "FLOOR_PLAN": ["floor plan", "plan view", "level", "first floor", "ground floor", "1st floor", "2nd floor", "3rd floor", "4th floor", "5th floor", "basement", "mezzanine"],
    "RCP": ["reflected ceiling", "rcp", "ceiling plan", "reflected"],
    "ELEVATION": ["elevation", "interior elevation", "elev", "north elevation", "south elevation", "east elevation", "west elevation"],
    "SECTION": ["section", "building section", "wall section"],
    "SCHEDULE": ["schedule", "room schedule", "door schedule", "finish schedule", "window schedule"],
}
#: Floor level patterns over upper-cased sheet names, the first that matches counts.
FLOOR_LEVELS = [r"LEVEL\s*\d+", r"FLOOR\s*\d+", r"\d+(?:ST|ND|RD|TH)\s*FLOOR", r"FIRST\s*FLOOR", r"SECOND\s*FLOOR", r"THIRD\s*FLOOR", r"GROUND\s*FLOOR", r"BASEMENT", r"MEZZANINE"]
MIN_DRAWINGS, MAX_IMAGES, MAX_COVERAGE = 50, 3, 30
#: Title blocks fill this share of the sheet at the bottom and at the right.
TITLE_BLOCK = 0.15


def processing_path(drawings="drawing_count", images="image_count", coverage="image_coverage_percent") -> Column:
    """VECTOR, HYBRID, RASTER or SKIP, from a sheet's counts."""
    vector = (F.col(images) <= MAX_IMAGES) & (F.col(coverage) < MAX_COVERAGE)
    return F.when(F.col(drawings) >= MIN_DRAWINGS, F.when(vector, "VECTOR").otherwise("HYBRID")).when(F.col(images) > 0, "RASTER").otherwise("SKIP")


def in_title_block(x="x0", y="y0") -> Column:
    return (F.col(y) >= F.col("page_height") * (1 - TITLE_BLOCK)) | (F.col(x) >= F.col("page_width") * (1 - TITLE_BLOCK))


def sheet_text(blocks: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, title_text and all_text: block texts joined by spaces in block order."""
    placed = blocks.join(sheets.select(*K, "page_width", "page_height"), K)
    item = F.struct("block_idx", "text")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["text"]), " ")
    return placed.groupBy(*K).agg(joined(F.when(in_title_block(), item)).alias("title_text"), joined(item).alias("all_text"))


def page_type(blocks: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, page_type, keyword: the first keyword by type, looked for in the title block before the whole sheet."""
    text = sheet_text(blocks, sheets).select(*K, F.lower("title_text").alias("title"), F.lower("all_text").alias("whole"))
    rules = [(kind, word) for kind, words in PAGE_TYPES.items() for word in words]
    hit = lambda source: F.coalesce(*(F.when(F.col(source).contains(w), F.struct(F.lit(k).alias("page_type"), F.lit(w).alias("keyword"))) for k, w in rules))
    found = text.withColumn("hit", F.coalesce(hit("title"), hit("whole"))).select(*K, "hit.page_type", "hit.keyword")
    return sheets.select(*K).join(found, K, "left").withColumn("page_type", F.coalesce("page_type", F.lit("OTHER")))


def document_summary(classified: DataFrame) -> DataFrame:
    """Per document: pages, floor plans, ceiling plans, vector and raster sheets."""
    return classified.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), F.count_if(F.col("page_type") == "FLOOR_PLAN").alias("floor_plan_count"), F.count_if(F.col("page_type") == "RCP").alias("rcp_count"),
        F.count_if(F.col("path") == "VECTOR").alias("vector_count"), F.count_if(F.col("path") == "RASTER").alias("raster_count"),
    )


def sheets_to_measure(classified: DataFrame) -> DataFrame:
    """All sheets but those that are no floor plan and are vector or empty."""
    return classified.where((F.col("page_type") == "FLOOR_PLAN") | ~F.col("path").isin("VECTOR", "SKIP"))


def image_coverage(rects: DataFrame, sheets: DataFrame) -> DataFrame:
    """K, images, coverage: the rectangles' share of the sheet in percent, 100 at most."""
    sums = rects.groupBy(*K).agg(F.countDistinct("image_id").alias("images"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("covered"))
    share = F.least(F.lit(100.0), F.col("covered") * 100 / F.nullif(F.col("page_width") * F.col("page_height"), F.lit(0.0)))
    return sheets.join(sums, K, "left").select(*K, F.coalesce("images", F.lit(0)).cast("long").alias("images"), F.coalesce(share, F.lit(0.0)).alias("coverage"))


def floor_level(name: Column) -> Column:
    """LEVEL 2, GROUND FLOOR, ... from a sheet's name; '' if none."""
    upper = F.upper(name)
    return F.coalesce(*(F.nullif(F.regexp_extract(upper, p, 0), F.lit("")) for p in FLOOR_LEVELS), F.lit(""))


def page_range(specs: DataFrame, sheets: DataFrame) -> DataFrame:
    """doc_id, page_no (0-based) that a document's spec ("all", "1-5", "1,3") selects; pages that do not exist drop out."""
    pages = sheets.select("doc_id", "page_no", (F.dense_rank().over(_by_doc()) - 1).alias("nth"))
    part = specs.withColumn("part", F.explode(F.split(F.lower(F.trim("spec")), ","))).withColumn("part", F.trim("part"))
    ends = F.split("part", "-")
    lo = F.trim(ends[0]).try_cast("int")
    hi = F.trim(F.element_at(ends, -1)).try_cast("int")
    want = part.withColumn("lo", F.when(F.col("part") == "all", 1).otherwise(lo)).withColumn("hi", F.when(F.col("part") == "all", F.lit(2**31 - 1)).otherwise(hi))
    picked = pages.join(want.where("lo <= hi").select("doc_id", "lo", "hi"), "doc_id").where((F.col("nth") + 1).between(F.col("lo"), F.col("hi")))
    return picked.select("doc_id", "page_no", "nth").distinct()


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("page_no")
