"""Plane geometry as column expressions: lengths, angles, rings, points in rings, rays, grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.lineage import unsent

POINT = "struct<x:double,y:double>"


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def length(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.hypot(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1))


def angle(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Degrees in [0, 180), whichever way the segment is drawn."""
    return F.pmod(F.degrees(F.atan2(F.col(y2) - F.col(y1), F.col(x2) - F.col(x1))), F.lit(180.0))


def angle_between(a: Column, b: Column) -> Column:
    """Difference of two folded angles, 0 to 90 degrees."""
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the infinite line through two points; to the point where they are one."""
    dx, dy = x2 - x1, y2 - y1
    far = F.abs(dy * px - dx * py + x2 * y1 - y2 * x1)
    return F.coalesce(ratio(far, F.hypot(dx, dy)), F.hypot(px - x1, py - y1))


def following(ring: Column) -> Column:
    """The ring's points, each moved one on."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def signed_area(ring: Column) -> Column:
    return total(F.zip_with(ring, following(ring), cross)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return total(F.zip_with(ring, following(ring), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def centroid(ring: Column) -> Column:
    """The area centroid; (0, 0) for an empty ring, the mean point for one without area."""
    six = signed_area(ring) * 6
    mean = lambda c: ratio(total(F.transform(ring, lambda p: p[c])), F.size(ring).cast("double"))
    part = lambda c: total(F.zip_with(ring, following(ring), lambda p, q: (p[c] + q[c]) * cross(p, q)))
    return F.struct(*(F.coalesce(ratio(part(c), six), mean(c), F.lit(0.0)).alias(c) for c in ("x", "y")))


def vertex_mean(ring: Column) -> Column:
    """The mean of a ring's points."""
    mean = lambda c: ratio(total(F.transform(ring, lambda p: p[c])), F.size(ring).cast("double"))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def box(ring: Column) -> Column:
    """(x0, y0, x1, y1) of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies inside, by the parity of crossings."""
    crosses = F.zip_with(ring, following(ring), lambda p, q: F.when(((p["y"] > py) != (q["y"] > py)) & (px < (q["x"] - p["x"]) * ratio(py - p["y"], q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    """From a point to the nearest edge of a ring."""

    def to_edge(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio((px - p["x"]) * dx + (py - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(px - p["x"] - t * dx, py - p["y"] - t * dy)

    return F.array_min(F.zip_with(ring, following(ring), to_edge))


def covered(df: DataFrame, cell: float, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """One row per grid cell (gx, gy) that a box meets."""
    span = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    return unsent(df.withColumn("gx", span(x0, x1)).withColumn("gy", span(y0, y1)))


def walked(df: DataFrame, cell: float, x1: Column, y1: Column, x2: Column, y2: Column, slack: float = 1e-4) -> DataFrame:
    """One row per grid cell (gx, gy) that a segment meets or comes within slack of: column by column, the rows it crosses there."""
    ahead = x1 <= x2
    ends = {"a": F.when(ahead, F.struct(x1.alias("x"), y1.alias("y"))).otherwise(F.struct(x2.alias("x"), y2.alias("y"))), "b": F.when(ahead, F.struct(x2.alias("x"), y2.alias("y"))).otherwise(F.struct(x1.alias("x"), y1.alias("y")))}
    between = lambda low, high: F.explode(F.sequence(F.floor((low - slack) / cell), F.floor((high + slack) / cell)))
    columns = df.withColumns({f"w{k}": v for k, v in ends.items()}).withColumn("gx", between(F.col("wa.x"), F.col("wb.x")))
    slope = ratio(F.col("wb.y") - F.col("wa.y"), F.col("wb.x") - F.col("wa.x"))
    at = lambda x: F.col("wa.y") + slope * (x - F.col("wa.x"))
    enter = F.coalesce(at(F.greatest(F.col("wa.x"), F.col("gx") * cell - slack)), F.col("wa.y"))
    leave = F.coalesce(at(F.least(F.col("wb.x"), (F.col("gx") + 1) * cell + slack)), F.col("wb.y"))
    rows = columns.withColumns({"we": enter, "wl": leave})
    return unsent(rows.withColumn("gy", between(F.least("we", "wl"), F.greatest("we", "wl"))).drop("wa", "wb", "we", "wl"))


def celled(df: DataFrame, cell: float, x: Column, y: Column) -> DataFrame:
    """The one grid cell (gx, gy) that a point lies in."""
    return unsent(df.withColumns({"gx": F.floor(x / cell), "gy": F.floor(y / cell)}))


def common_corner(cell: float, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether (gx, gy) is the cell of the low corner that two boxes share; true in one of the cells they share."""
    return (F.col("gx") == F.floor(F.greatest(ax, bx) / cell)) & (F.col("gy") == F.floor(F.greatest(ay, by) / cell))
