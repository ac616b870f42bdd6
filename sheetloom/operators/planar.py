"""Faces of noded drawings: half-edges, their successors, and cycles by pointer doubling.

Each edge is two half-edges, numbered 2n and 2n + 1 on its sheet. The successor of a half-edge is the one
that leaves its end next before its twin, by angle. Cycles of successors are the faces; all
half-edges learn the smallest number on their cycle, and how many steps it is away, in about as many
doublings as the longest cycle has binary digits. An edge with both its
sides on one face is a bridge; without the bridges, the cycles are the rings of the faces.
Rows are dealt out by sheet, windows and groups go by half-edge, node or face. Doublings are done for many
sheets at once as arrays; sheets of more than LARGE half-edges double by windows over their rows instead, and are no single group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.geom import celled, covered, in_ring, signed_area
from sheetloom.functions.lineage import written
from sheetloom.sources.views import K

CELL = 128.0
#: Layers of loose ends that are taken off before what is left is written.
PEELED = 5
#: Doublings between two writings: cycles of up to half of 2**DOUBLED edges are settled by the first.
DOUBLED = 4
#: Half-edges of whole sheets that are doubled at once as arrays, and those of one sheet beyond which it goes by windows.
AT_ONCE, LARGE = 1 << 17, 1 << 20
RING = "array<struct<x:double,y:double>>"


def half_edges(edges: DataFrame) -> DataFrame:
    """K, id, ax, ay, bx, by: both directions of each edge, numbered by their sheet; twins differ in the lowest bit of id."""
    n = (F.row_number().over(Window.partitionBy(*K).orderBy("x1", "y1", "x2", "y2")) - 1).cast("long") * 2
    both = F.array(
        F.struct(F.col("n").alias("id"), F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by")),
        F.struct((F.col("n") + 1).alias("id"), F.col("x2").alias("ax"), F.col("y2").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by")),
    )
    return edges.select(*K, n.alias("n"), "x1", "y1", "x2", "y2").select(*K, F.inline(both))


def twin(half: Column) -> Column:
    return half.bitwiseXOR(F.lit(1).cast("long"))


def successors(half: DataFrame, *apart: str) -> DataFrame:
    """half + next: of each half-edge the one that follows it around its face, among those alike in the columns apart."""
    # The half-edges that leave a node are the twins of those that arrive.
    turned = half.withColumns({"turn": F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")), "leaves": twin(F.col("id"))})
    at = Window.partitionBy(*K, "bx", "by", *apart).orderBy("turn", "leaves")
    before = F.coalesce(F.lag("leaves").over(at), F.last("leaves").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return turned.withColumn("next", before).drop("turn", "leaves")


def doubled(state: DataFrame, step: int) -> DataFrame:
    """state (K, id, face, away, jump) after one doubling, and whether a row changed. Each half-edge is asked by one other: both meet in a window."""
    asks = F.struct("id", "face", "away")
    met = F.array(
        F.struct(F.col("id").alias("at"), F.lit(None).cast("struct<id:bigint,face:bigint,away:bigint>").alias("asks"), F.struct("face", "away", "jump").alias("told")),
        F.struct(F.col("jump").alias("at"), asks.alias("asks"), F.lit(None).cast("struct<face:bigint,away:bigint,jump:bigint>").alias("told")),
    )
    both = state.select(*K, F.inline(met)).withColumn("told", F.max("told").over(Window.partitionBy(*K, "at"))).where("asks is not null")
    better = F.col("told.face") < F.col("asks.face")
    away = F.when(better, F.col("told.away") + step).otherwise(F.col("asks.away"))
    return both.select(*K, F.col("asks.id").alias("id"), F.least("asks.face", "told.face").alias("face"), away.alias("away"), F.col("told.jump").alias("jump"), better.alias("changed"))


def cycles_by_windows(follows: DataFrame) -> DataFrame:
    """K, id, face, away: the smallest id on each half-edge's cycle, and the steps to it.

    After r rounds a half-edge knows the smallest of the 2**r that follow; when no one learns more, all know their cycle's.
    DOUBLED rounds are done on rows that are dealt out by sheet once, and then written.
    """
    state = follows.select(*K, "id", F.col("id").alias("face"), F.lit(0).cast("long").alias("away"), F.col("next").alias("jump")).repartition(*K)
    step, changed = 1, True
    while changed:
        state = state if step == 1 else state.repartition(*K)
        for _ in range(DOUBLED):
            state = doubled(state, step)
            step *= 2
        after = written(state)
        changed = not after.where("changed").isEmpty()
        state = after.drop("changed")
    return state.select(*K, "id", "face", "away")


def last_sheet(rows: pa.Table) -> int:
    """Where the last sheet of the rows begins."""
    news = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (rows.column(k).combine_chunks() for k in K)]
    return int(np.flatnonzero(np.logical_or(*news))[-1]) + 1 if len(rows) > 1 and np.logical_or(*news).any() else 0


def whole_sheets(batches: Iterator[pa.RecordBatch], at_once: int, large: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by sheet, by whole sheets, and whether these are: those of a sheet of more than large rows come in pieces."""
    held, big = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows, held = pa.concat_tables([held, rows]), None
        if big is not None and rows.num_rows:
            same = np.logical_and(*(pc.equal(rows.column(k), v).to_numpy() for k, v in zip(K, big, strict=True)))
            n = rows.num_rows if same.all() else int(np.argmin(same))
            yield rows.slice(0, n), False
            rows, big = rows.slice(n), big if n == rows.num_rows else None
        if rows.num_rows < at_once:
            held = rows
            continue
        start = last_sheet(rows)
        if start:
            yield rows.slice(0, start), True
            rows = rows.slice(start)
        if rows.num_rows > large:
            big = [rows.column(k)[0] for k in K]
            yield rows, False
        else:
            held = rows
    if held is not None and held.num_rows:
        yield held, held.num_rows <= large or last_sheet(held) > 0


def settled(rows: pa.Table) -> list[np.ndarray]:
    """face, away, other of the half-edges of whole sheets, by doublings of all their cycles at once; other is the twin's face, or -1 without a twin."""
    news = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (rows.column(k).combine_chunks() for k in K)]
    base, follows = rows.column("id").to_numpy(), rows.column("next").to_numpy()
    sheet = np.concatenate([[0], np.cumsum(np.logical_or(*news))]) * (int(base.max()) + 2)
    key = sheet + base
    face, away, jump, step = np.arange(len(key)), np.zeros(len(key), np.int64), np.searchsorted(key, sheet + follows), 1
    while (better := face[jump] < face).any():
        away = np.where(better, away[jump] + step, away)
        face, jump, step = np.where(better, face[jump], face), jump[jump], step * 2
    across = np.searchsorted(key, sheet + (base ^ 1)) % len(key)
    return [base[face], away, np.where(key[across] == sheet + (base ^ 1), base[face[across]], -1)]


def cycles(follows: DataFrame, dealt: bool = False, at_once: int = AT_ONCE, large: int = LARGE) -> DataFrame:
    """follows (K, id, next, ...) + face, away, other: the smallest id on each half-edge's cycle, the steps to it, and the twin's face (-1: no twin).

    dealt: whether the rows are dealt out by sheet already.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, whole in whole_sheets(batches, at_once, large):
            found = settled(rows) if whole and rows.num_rows else [pa.nulls(rows.num_rows, pa.int64())] * 3
            for name, values in zip(("face", "away", "other"), found, strict=True):
                rows = rows.append_column(name, pa.array(values, pa.int64()) if isinstance(values, np.ndarray) else values)
            yield from rows.to_batches()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in follows.schema) + ", face long, away long, other long"
    rows = (follows if dealt else follows.repartition(*K)).sortWithinPartitions(*K, "id")
    out = written(rows.mapInArrow(label, kind))
    rest = out.where("face is null")
    if rest.isEmpty():
        return out
    found = written(cycles_by_windows(rest.select(*K, "id", "next"))).repartition(*K)
    across = found.select(*K, twin(F.col("id")).alias("id"), F.col("face").alias("other"))
    full = rest.drop("face", "away", "other").repartition(*K).join(found, [*K, "id"]).join(across, [*K, "id"], "left").withColumn("other", F.coalesce("other", F.lit(-1).cast("long")))
    return written(out.where("face is not null").unionByName(full))


def pruned_counts(tree: DataFrame) -> DataFrame:
    """K, dangles, cuts: bridges that hang loose at one end, end after end, and those that link rings. tree: K, id, bx, by of the bridges, and ring: whether the end lies at one.

    Loose ends are taken off until none is left; only bridges are touched, and a node at a ring is never loose.
    """
    node, edge = Window.partitionBy(*K, "bx", "by"), Window.partitionBy(*K, F.least(F.col("id"), twin(F.col("id"))))
    total = tree.groupBy(*K).agg((F.count("*") / 2).cast("long").alias("bridges"))
    left, before, now = tree, None, tree.count()
    while now and now != before:
        after = left.repartition(*K)
        for _ in range(PEELED):
            loose = ~F.col("ring") & (F.count("*").over(node) == 1)
            after = after.withColumn("loose", loose).withColumn("gone", F.max("loose").over(edge)).where(~F.col("gone")).drop("loose", "gone")
        left = written(after)
        before, now = now, left.count()
    cuts = left.groupBy(*K).agg((F.count("*") / 2).cast("long").alias("cuts"))
    both = total.join(cuts, K, "left").withColumn("cuts", F.coalesce("cuts", F.lit(0)))
    return both.select(*K, (F.col("bridges") - F.col("cuts")).alias("dangles"), "cuts")


def simple_rings(ring: list) -> tuple[list, float]:
    """A closed walk that meets nodes again: its largest ring, and the area of those that touch it from within."""
    rings, path, at = [], [], {}
    for p in ring:
        x = (p["x"], p["y"])
        if x in at:
            rings.append(path[at[x] :])
            for y in rings[-1]:
                del at[y]
            path = path[: len(path) - len(rings[-1])]
        at[x] = len(path)
        path.append(x)
    rings.append(path)

    def surface(r: list) -> float:
        a = np.array(r)
        b = np.roll(a, -1, 0)
        return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2)

    sizes = [surface(r) for r in rings]
    return [{"x": x, "y": y} for x, y in rings[int(np.argmax(sizes))]], -sum(v for v in sizes if v < 0)


def split_ring(ring: Column) -> Column:
    """(ring, touching) of a walk that meets nodes again; few do."""

    def split(rings: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([simple_rings(list(r)) for r in rings], columns=["ring", "touching"])

    return F.pandas_udf(split, f"ring {RING}, touching double")(ring)


def from_lowest(ring: Column) -> Column:
    """The ring from its leftmost point on, the lowest of these."""
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, at, F.size(ring) - at + 1), F.slice(ring, F.lit(1), at - 1))


def ring_rows(labelled: DataFrame) -> DataFrame:
    """K, face, ring, signed: the points of each cycle in order, and its signed area."""
    point = F.struct((-F.col("away")).alias("n"), F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p"))
    got = labelled.groupBy(*K, "face").agg(F.sort_array(F.collect_list(point)).alias("s"))
    # The leader is no step away and stands last; the others come from the farthest on.
    ring = F.transform("s", lambda s: s["p"])
    return got.select(*K, "face", ring.alias("ring")).withColumn("signed", signed_area(F.col("ring")))


def holes(shells: DataFrame, contours: DataFrame) -> DataFrame:
    """K, face, inner: the area of the contours (outer walks of whole parts) that lie in each face, each in the smallest that holds it."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = lambda df: df.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x9": F.array_max(xs), "y9": F.array_max(ys)})
    inner = celled(boxed(contours).select(*K, F.col("face").alias("part"), F.col("ring")[0]["x"].alias("px"), F.col("ring")[0]["y"].alias("py"), F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x9").alias("u9"), F.col("y9").alias("v9"), "signed"), CELL, F.col("px"), F.col("py"))
    outer = covered(boxed(shells).select(*K, "face", "x0", "y0", "x9", "y9"), CELL, *(F.col(c) for c in ("x0", "y0", "x9", "y9")))
    near = inner.join(outer, [*K, "gx", "gy"]).where("x0 < u0 and y0 < v0 and x9 > u9 and y9 > v9").select(*K, "part", "px", "py", F.col("signed").alias("inner"), "face")
    held = near.join(shells.select(*K, "face", "ring", F.col("signed").alias("size")), [*K, "face"]).where(in_ring(F.col("px"), F.col("py"), F.col("ring")))
    least = held.groupBy(*K, "part").agg(F.min_by(F.struct("face", "inner"), F.struct("size", "face")).alias("at"))
    return least.groupBy(*K, F.col("at.face").alias("face")).agg(F.sum(-F.col("at.inner")).alias("inner"))


def faces(edges: DataFrame) -> DataFrame:
    """K, poly_idx, vertices, area, hole_area, dangles, cuts: bounded faces of each sheet's noded graph, with what was pruned.

    vertices is the outer ring, hole_area that of the holes (whole parts of the graph that lie in the face, or touch its ring
    from within at one point), and area is without them.
    """
    first = cycles(successors(half_edges(edges.repartition(*K))), dealt=True)
    # With both its sides on one face an edge is a bridge; bridges follow no one in the second walk.
    marked = first.select(*K, "id", "ax", "ay", "bx", "by", (F.col("face") == F.col("other")).alias("bridge")).repartition(*K)
    again = successors(marked, "bridge").withColumn("next", F.when(F.col("bridge"), F.col("id")).otherwise(F.col("next")))
    labelled = cycles(again.withColumn("ring", F.max(~F.col("bridge")).over(Window.partitionBy(*K, "bx", "by"))), dealt=True)
    counts = pruned_counts(labelled.where("bridge").select(*K, "id", "bx", "by", "ring"))
    walks = written(ring_rows(labelled.where("not bridge")))
    bounded = walks.where("signed > 0")
    again = F.size(F.array_distinct("ring")) < F.size("ring")
    plain = bounded.where(~again).withColumn("touching", F.lit(0.0))
    touching = bounded.where(again).withColumn("s", split_ring(F.col("ring"))).select(*K, "face", F.col("s.ring").alias("ring"), F.col("signed"), F.col("s.touching").alias("touching"))
    # A walk's signed area lacks what touches it from within; the ring's has it.
    shells = written(plain.select(*K, "face", "ring", "signed", "touching").unionByName(touching.withColumn("signed", F.col("signed") + F.col("touching")))).repartition(*K)
    within = holes(shells, walks.where("signed <= 0").repartition(*K))
    full = shells.join(within, [*K, "face"], "left").withColumn("hole_area", F.col("touching") + F.coalesce("inner", F.lit(0.0)))
    made = full.select(*K, from_lowest(F.col("ring")).alias("vertices"), (F.col("signed") - F.col("hole_area")).alias("area"), "hole_area")
    first = F.col("vertices")[0]
    nth = F.row_number().over(Window.partitionBy(*K).orderBy(first["x"], first["y"], F.round("area", 4), "vertices")) - 1
    out = made.withColumn("poly_idx", nth.cast("long")).join(counts, K, "left")
    return written(out.select(*K, "poly_idx", "vertices", "area", "hole_area", F.coalesce("dangles", F.lit(0).cast("long")).alias("dangles"), F.coalesce("cuts", F.lit(0).cast("long")).alias("cuts")))
