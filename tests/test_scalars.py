"""Literal cases: single inputs with known results."""

from pyspark.sql import functions as F

from sheetloom.operators import classify, heights, labels, measure, phases, scale, segments


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_dimension_values(spark):
    cases = {"10'-6\"": 126.0, "10' 6\"": 126.0, "12'-3 1/2\"": 147.5, "10'": 120.0, "126\"": 126.0}
    rows = spark.createDataFrame([(0, 0, i, t) for i, t in enumerate(cases)], "doc_id long, page_no long, block_idx long, text string")
    got = {}
    for r in scale.dimension_mentions(rows).collect():
        got.setdefault(r.block_idx, set()).add(round(r.inches, 3))
    assert all(v in got[i] for i, v in enumerate(cases.values()))


def test_scales(spark):
    f = lambda t: one(spark, scale.scale_of, t)
    assert f("SCALE: 1/8\" = 1'-0\"").factor == 0.75 and abs(f("1 : 200").factor - 14.175) < 1e-9 and f("QUARTER INCH SCALE").factor == 18 and f("nothing") is None
    assert one(spark, scale.manual_scale, "1/8 inch = 1 foot").factor == 9 and one(spark, scale.manual_scale, "96").factor == 96 and one(spark, scale.manual_scale, "x") is None
    assert one(spark, scale.calibration, "100,100:300,100=10 ft") == 20 and one(spark, scale.calibration, "bad") is None


def test_scale_conflict(spark):
    pairs = [(96.0, 96.0, False), (96.0, 100.0, False), (96.0, 150.0, True), (0.0, 96.0, False)]
    got = spark.createDataFrame(pairs, "a double, b double, want boolean").select(scale.conflict(F.col("a"), F.col("b")).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)


def test_heights_and_keys(spark):
    h = lambda t: one(spark, heights.height_of, t)
    assert h("CLG 9'-6\"") == 9.5 and abs(h("CLG 2700mm") - 2.7 * 3.28084) < 1e-9 and h("CLG 3'") is None and h("10 FT CEILING") == 10
    assert one(spark, heights.name_key, "office-101") == "OFFICE101" and one(spark, heights.number_key, "A-205") == "205" and one(spark, heights.number_key, "CONFERENCE") is None


def test_phases(spark):
    want = {"NEW WALL": "NEW", "EXIST": "EXISTING", "NIC": "NOT_IN_CONTRACT", "REMOVE": "DEMO", "FOOBAR": "UNKNOWN"}
    assert {t: one(spark, phases.normalized, t) for t in want} == want
    assert spark.range(1).select(phases.normalized(F.lit(None).cast("string")).alias("r")).first().r == "UNKNOWN"


def test_paths_and_levels(spark):
    rows = spark.createDataFrame([(100, 1, 5.0), (10, 1, 50.0), (100, 5, 40.0), (5, 0, 0.0)], "drawing_count int, image_count int, image_coverage_percent double")
    assert [r.p for r in rows.select(classify.processing_path().alias("p")).collect()] == ["VECTOR", "RASTER", "HYBRID", "SKIP"]
    assert one(spark, classify.floor_level, "A1.1 - LEVEL 1 FLOOR PLAN") == "LEVEL 1" and one(spark, classify.floor_level, "RANDOM SHEET") == ""


def test_measures(spark):
    ring = "array(struct(0D as x, 0D as y), struct(100D as x, 0D as y), struct(100D as x, 100D as y), struct(0D as x, 100D as y))"
    p = spark.sql(f"select 1L as doc_id, 0L as page_no, 0L as poly_idx, {ring} as vertices")
    r = measure.measured(p, F.lit(10.0), F.lit(9.0)).first()
    assert (r.floor_area, r.perimeter, r.wall_area, r.ceiling_area) == (100, 40, 360, 100)
    assert measure.measured(p, F.lit(0.0), F.lit(9.0)).first().floor_area == 0
    assert spark.range(1).select(measure.imperial(F.lit(10.5)).alias("r")).first().r == "10'-6\""


def test_dash_pattern(spark):
    assert one(spark, segments.dash_pattern, "[3 4] 0") == [3.0, 4.0] and one(spark, segments.dash_pattern, "[] 0") == []


def test_room_labels(spark):
    rows = [(0, 0, i, t, 0.0, 0.0, 10.0, 10.0, s, c, f) for i, (t, s, c, f) in enumerate([("OFFICE 101", "embedded", 1.0, 12.0), ("10'-6\"", "embedded", 1.0, 12.0), ("STORAGE", "ocr", 0.9, None), ("A", "embedded", 1.0, 12.0), ("CONFERENCE", "embedded", 1.0, 50.0)])]
    b = spark.createDataFrame(rows, "doc_id long, page_no long, block_idx long, text string, x0 double, y0 double, x1 double, y1 double, source string, confidence double, font_size double")
    assert [r.text for r in labels.room_labels(b).orderBy("block_idx").collect()] == ["OFFICE 101", "STORAGE"]
