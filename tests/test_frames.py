"""What keeps frames from the driver, and expressions from being copied."""

from pyspark.sql import functions as F

from sheetloom.functions.geom import celled, covered, walked
from sheetloom.functions.lineage import bound, written
from sheetloom.sources import views
from sheetloom.sources.views import K
from sheetloom.operators import segments, topology


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_and_written_rows_are_not_broadcast(spark):
    p = spark.range(4).select(F.lit(0).alias("doc_id"), F.lit(0).alias("page_no"), F.col("id").cast("double").alias("x"))
    at = p.withColumnRenamed("x", "o")
    x, o = F.col("x"), F.col("o")
    spread, line = covered(p, 1.0, x, x, x + 9, x + 9), walked(p, 1.0, x, x, x + 9, x + 9)
    for df in (spread.join(at, K), line.join(at, K), p.join(celled(at, 1.0, o, o), K), p.join(written(at), K), spread.groupBy(*K).count().join(at, K)):
        assert "BroadcastHashJoin" not in plan(df)
    assert spread.join(celled(at, 1.0, o, o), [*K, "gx", "gy"]).count() == 4 + 3 + 2 + 1


def test_bound_columns_are_worked_out_once(spark, sf_dir):
    d = spark.range(3).withColumns({"a": F.hypot(F.col("id") + 1, F.col("id")), "b": F.lit("b")})
    once = bound(d, "a").withColumn("c", F.col("a") * F.col("a") + F.col("a"))
    assert once.columns == ["id", "a", "b", "c"] and once.drop("c").collect() == d.collect()
    assert plan(once).count("HYPOT") == 1
    assert "Generate" in plan(views.segments(spark, sf_dir).select("x1")) and "Generate" in plan(views.polygons(spark, sf_dir).select("vertices"))


def exchanges(df):
    """Shuffles by key in the plan, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_segments_stay_dealt_out_by_sheet(spark, sf_dir):
    """Windows within a sheet move nothing after the numbering; positions need one shuffle of segments and one of sheets at most."""
    lines = views.segments(spark, sf_dir)
    assert exchanges(segments.hatching_groups(lines)) == 1
    assert exchanges(topology.dangling_endpoints(lines)) == 1
    assert exchanges(segments.grid_positions(lines, views.sheets(spark, sf_dir))) <= 3


def test_more_segments_than_tasks_hold(spark, sf_dir, monkeypatch):
    """A large table is dealt to more tasks than shuffles have partitions, with the same rows."""
    before = sorted(map(str, views.segments(spark, sf_dir).collect()))
    monkeypatch.setattr(views, "TASK", 500)
    lines = views.segments(spark, sf_dir)
    assert lines.rdd.getNumPartitions() == -(-len(before) // 500) > 4 and sorted(map(str, lines.collect())) == before
