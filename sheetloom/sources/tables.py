"""Reading drawing tables and flattening paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.sources.views import K

PATHS = "doc_id string, page_no int, path_idx long, width double, color array<double>, fill array<double>, fill_type string, dashes array<double>, items array<struct<op:string,pts:array<struct<x:double,y:double>>>>"
SHEETS = "doc_id string, page_no int, page_width double, page_height double, sheet_name string, drawing_count int, image_count int, image_coverage_percent double"
TEXT_BLOCKS = "doc_id string, page_no int, block_idx long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, font_size double, font_name string, source string"


#: Column of the lines that do not parse.
BAD = "bad_row"


def scan(spark: SparkSession, root: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """sheets, paths and text_blocks of a folder with one sub-folder each, by their declared schemas, and bad_rows.

    Of JSON lines, those that do not parse are no rows of a table; bad_rows has them whole, with the table's name and the document, where that could be read.
    """

    schemas = {"sheets": SHEETS, "paths": PATHS, "text_blocks": TEXT_BLOCKS}
    bad = spark.createDataFrame([], f"table string, doc_id string, {BAD} string")
    if kind != "json":
        found = {name: spark.read.schema(schema).format(kind).load(f"{root}/{name}") for name, schema in schemas.items()}
    else:
        found = {}
        for name, schema in schemas.items():
            # Lines are parsed after they are read: a JSON scan can't be asked for its bad lines alone.
            lines = spark.read.text(f"{root}/{name}").where(F.trim("value") != "")
            parsed = lines.select(F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD}).alias("row"))
            found[name] = parsed.where(F.col(f"row.{BAD}").isNull()).select("row.*").drop(BAD)
            bad = bad.unionByName(parsed.where(F.col(f"row.{BAD}").isNotNull()).select(F.lit(name).alias("table"), "row.doc_id", f"row.{BAD}"))
    return found | {"text_blocks": with_text(found["text_blocks"]), "bad_rows": bad}


def with_text(blocks: DataFrame) -> DataFrame:
    """Blocks whose text is not blank."""
    return blocks.where(F.trim("text") != "")


def path_segments(paths: DataFrame) -> DataFrame:
    """Segments of drawing paths: l gives one, re and qu four, c the chord from the current point if there is one.

    m, l and c move the current point; the path's style goes to each of its segments.
    """
    style = [c for c in ("width", "color", "fill", "fill_type", "dashes") if c in paths.columns]
    item = paths.select(*K, "path_idx", *style, F.posexplode("items").alias("pos", "item")).select("*", "item.op", "item.pts").drop("item")
    moved = F.when(F.col("op").isin("m", "l", "c"), F.element_at("pts", -1))
    before = Window.partitionBy(*K, "path_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = item.withColumn("current", F.last(moved, ignorenulls=True).over(before))
    p = lambda i: F.get("pts", F.lit(i))
    seg = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    corner = lambda x, y: F.struct(p(x)["x"].alias("x"), p(y)["y"].alias("y"))
    ring = lambda a, b, c, d: F.array(seg(a, b), seg(b, c), seg(c, d), seg(d, a))
    made = (
        F.when(F.col("op") == "l", F.array(seg(p(0), p(1))))
        .when(F.col("op") == "re", ring(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))
        .when(F.col("op") == "qu", ring(p(0), p(1), p(3), p(2)))
        .when((F.col("op") == "c") & F.col("current").isNotNull(), F.array(seg(F.col("current"), F.element_at("pts", -1))))
    )
    flat = at.select(*K, "path_idx", "pos", *style, F.posexplode(made).alias("part", "s")).select(*K, "path_idx", "pos", "part", *style, "s.*")
    order = Window.partitionBy(*K).orderBy("path_idx", "pos", "part")
    return flat.withColumn("seg_idx", (F.row_number().over(order) - 1).cast("long")).drop("pos", "part")
