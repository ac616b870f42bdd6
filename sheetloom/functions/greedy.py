"""Greedy steps over edges of a sheet's graph, and its components, as rounds of distributed joins and windows.

Each round decides all edges or nodes that can be decided at once; what it leaves is written
to the shared folder, so that lineage stays short and lost executors cost one round. A round
shuffles its rows once, by sheet; windows go by (sheet, node) and (sheet, edge), never by the
sheet alone: a large sheet is no single group, and its rows are sorted, which spills. Results depend on ranks and ids only, never on row order, and equal the sequential loops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.lineage import written
from sheetloom.sources.views import K


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """The columns under identities of their own, so that two frames of one origin can be joined."""
    return df.select(*(F.col(c).alias(c) for c in names))


def decided(ends: DataFrame, at_node: Callable[[Window], Column], at_edge: Callable[[Window], Column], node_done: Column) -> DataFrame:
    """ends (K, edge, node, ...; two rows per edge) + edge_says, node_says and dead, after one round.

    What a node says about each of its edges (at_node) makes up what the edge says (at_edge);
    a node is done if one of its edges says so (node_done), and an edge is dead if one of its nodes is done.
    """
    node, edge = Window.partitionBy(*K, "node"), Window.partitionBy(*K, "edge")
    said = ends.withColumn("ok", at_node(node)).withColumn("edge_says", at_edge(edge))
    return said.withColumn("node_says", F.max(node_done).over(node)).withColumn("dead", F.max("node_says").over(edge))


def in_rounds(ends: DataFrame, names: list[str], at_node, at_edge, node_done: Column) -> list[DataFrame]:
    """What each round decided, until no edge is left: names of the rows that are dead by then."""
    live, out = written(ends), []
    while not live.isEmpty():
        # Dealt out by sheet once: the four windows by node and edge then move nothing.
        after = written(decided(live.repartition(*K), at_node, at_edge, node_done))
        out.append(after.where("dead").select(*names, "edge_says", "node_says"))
        live = after.where(~F.col("dead")).select(*live.columns)
    return out


def stacked(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for f in frames:
        out = out.unionByName(f)
    return out


def priority_matching(edges: DataFrame, left: str = "u", right: str = "v", rank: str = "rank", shared: bool = True) -> DataFrame:
    """The edges (K, left, right, rank) taken when edges are tried in the order of rank and each node is used once.

    shared: left and right are nodes of one kind. Ranks are unique per sheet. In each round an edge
    is taken that has the smallest rank at both its ends, and the other edges of these ends are dropped.
    """
    # The rounds and the last join read them: they are worked out once.
    edges = written(edges)
    kind = F.struct(F.lit(0).alias("side"), F.col(left).alias("id"))
    other = F.struct(F.lit(0 if shared else 1).alias("side"), F.col(right).alias("id"))
    ends = edges.select(*K, F.col(rank).alias("edge"), F.explode(F.array(kind, other)).alias("node"))
    rounds = in_rounds(ends, [*K, "edge"], lambda w: F.col("edge") == F.min("edge").over(w), lambda w: F.min("ok").over(w), F.col("edge_says"))
    taken = stacked([r.where("edge_says").select(*K, F.col("edge").alias(rank)) for r in rounds], edges.select(*K, rank).limit(0))
    return written(edges.repartition(*K).join(taken.repartition(*K), [*K, rank], "left_semi").select(edges.columns))


def leader_clusters(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """K, node, leader: in index order a free node leads and takes all its free neighbours. edges: K, u, v, both ways.

    In each round those nodes lead that have no smaller neighbour left, and cover their
    neighbours; covered nodes take their edges with them. A covered node goes to its smallest leader.
    """
    up = fresh(edges, *K, "u", "v").where("u < v").distinct()
    each = F.array(F.struct(F.col("u").alias("node"), F.lit(False).alias("larger")), F.struct(F.col("v").alias("node"), F.lit(True).alias("larger")))
    ends = up.select(*K, F.struct("u", "v").alias("edge"), F.inline(each))
    covers = F.col("edge_says") & F.col("larger")
    rounds = in_rounds(ends, [*K, "node"], lambda w: ~F.col("larger") & ~F.max("larger").over(w), lambda w: F.max("ok").over(w), covers)
    covered = stacked([r.where("node_says").select(*K, F.col("node").alias("v")) for r in rounds], up.select(*K, "v").limit(0)).distinct()
    led = written(up.join(covered, [*K, "v"]))
    owner = led.join(fresh(led, *K, "v").select(*K, F.col("v").alias("u")).distinct(), [*K, "u"], "left_anti").groupBy(*K, F.col("v").alias(node)).agg(F.min("u").alias("leader"))
    return fresh(nodes, *K, node).join(owner, [*K, node], "left").withColumn("leader", F.coalesce("leader", node))


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """K, node, root: the smallest node that can be reached.

    In each round every node hands its larger neighbours, then its smaller ones, on to the
    smallest that it knows, until all point straight to their root.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    links = written(edges.select(*K, high.alias("u"), low.alias("v")).where("u <> v").distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64(*K, "u", "v").cast("decimal(38,0)")))
    before = None
    while (state := links.agg(mark.alias("m")).first()["m"]) != before:
        before = state
        # Dealt out by sheet once: the windows by node and the distinct links then move nothing.
        both = links.repartition(*K).select(*K, F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        m = F.least("u", F.min("v").over(Window.partitionBy(*K, "u")))
        large = both.withColumn("m", m).where("v > u").select(*K, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = F.min("v").over(Window.partitionBy(*K, "u"))
        hand = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        links = written(large.withColumn("m", least).select(*K, hand.alias("u"), F.col("m").alias("v")).distinct())
    root = links.select(*K, F.col("u").alias(node), F.col("v").alias("root"))
    return fresh(nodes, *K, node).join(root, [*K, node], "left").withColumn("root", F.coalesce("root", node))
