"""Drawing tables derived from the test schema, as SELECTs that Spark and DuckDB both run.

Sheets, segments, text blocks and polygons follow from orders and line items alone, so
they grow with them. The same text serves the queries and their oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.lineage import bound

K = ["doc_id", "page_no"]

#: Sheets of three sizes, by page: letter, one in between, and D.
WIDE = "cast(case cast(floor(o_orderkey / 32.0) as bigint) % 3 when 0 then 612 when 1 then 1000 else 2592 end as double)"
HIGH = "cast(case cast(floor(o_orderkey / 32.0) as bigint) % 3 when 0 then 792 when 1 then 840 else 1728 end as double)"
SHEETS = """
select cast(floor(o_orderkey / 32.0) as bigint) as page_no,
 cast(floor(o_orderkey / 320.0) as bigint) as doc_id, {wide} as page_width, {high} as page_height,
 cast(sum(o_custkey) % 120 as bigint) as drawing_count, cast(sum(o_custkey) % 6 as bigint) as image_count,
 cast(sum(o_custkey) % 45 as double) as image_coverage_percent
 from orders group by 1, 2, 3, 4
""".format(wide=WIDE, high=HIGH)

SEGMENTS = """
with base as (
 select cast(floor(l_orderkey / 32.0) as bigint) as page_no, cast(floor(l_orderkey / 320.0) as bigint) as doc_id,
  l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
  cast(row_number() over (partition by cast(floor(l_orderkey / 32.0) as bigint)
   order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as seg_idx from lineitem),
 g as (select *, cast(60 + (l_partkey % 7) * 120 as double) as ox, cast(60 + ((l_suppkey + seg_idx) % 6) * 120 as double) as oy,
  cast(case when l_returnflag = 'R' and l_quantity > 25 then 6 else 0 end as double) as off,
  case when l_quantity > 46 then 'D' when (l_linenumber + seg_idx) % 2 = 0 then 'H' else 'V' end as ori from base)
 select doc_id, page_no, seg_idx,
  case when ori = 'V' then ox + off else ox end as x1, case when ori = 'H' then oy + off else oy end as y1,
  case when ori = 'H' then ox + 120 when ori = 'V' then ox + off else ox + 40 end as x2,
  case when ori = 'V' then oy + 120 when ori = 'H' then oy + off else oy + 40 end as y2,
  case l_linenumber when 1 then cast(0.0 as double) when 2 then cast(0.2 as double) when 3 then cast(0.35 as double) when 4 then cast(0.5 as double)
   when 5 then cast(1.0 as double) when 6 then cast(1.5 as double) else cast(2.5 as double) end as width,
  l_linestatus = 'F' and l_tax > 0.05 as is_dashed,
  cast(case when l_returnflag = 'A' then round(l_discount * 10, 2) else null end as double) as fill_gray,
  case when l_returnflag = 'A' then 'f' else 's' end as fill_type
 from g
"""

TEXT_BLOCKS = """
with b as (select cast(floor(o_orderkey / 32.0) as bigint) as page_no, cast(floor(o_orderkey / 320.0) as bigint) as doc_id,
  cast(o_orderkey % 32 as bigint) as block_idx, o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice from orders)
 select doc_id, page_no, block_idx,
  case block_idx when 0 then case when page_no % 4 = 3 then 'REFLECTED CEILING PLAN' else concat('LEVEL ', cast(page_no % 5 as string), ' FLOOR PLAN') end
   when 1 then case page_no % 3 when 0 then 'SCALE: 1/8" = 1''-0"' when 1 then '1:100' else 'NOTES' end
   when 2 then case when page_no % 2 = 0 then 'CONSTRUCTION PLAN LEGEND' else 'KEYNOTES' end
   when 3 then 'NEW CONSTRUCTION' when 4 then 'EXISTING TO REMAIN' when 5 then 'AREA N.I.C.'
   else case o_custkey % 6 when 0 then cast(100 + o_custkey % 90 as string) when 1 then concat('OFFICE ', cast(100 + o_custkey % 90 as string))
    when 2 then concat(cast(8 + o_custkey % 12 as string), '''-', cast(o_custkey % 12 as string), '"') when 3 then concat('CLG ', cast(8 + o_custkey % 5 as string), '''-6" ', cast(100 + o_custkey % 90 as string))
    when 4 then case when o_custkey % 4 = 0 then cast(o_custkey % 30 as string) else 'STORAGE' end else concat(cast(2000 + o_custkey % 900 as string), 'mm') end end as text,
  case when block_idx in (0, 1) then cast(700 as double) when block_idx between 2 and 5 then cast(860 as double) else cast(100 + (block_idx % 6) * 120 as double) end as x0,
  case when block_idx in (0, 1) then cast(780 + 20 * block_idx as double) when block_idx between 2 and 5 then cast(60 + 20 * block_idx as double)
   else cast(100 + (floor(block_idx / 6)) * 120 + o_custkey % 40 as double) end as y0,
  case when o_orderpriority like '1%' then 'ocr' else 'embedded' end as source,
  case when o_orderpriority like '1%' then cast(round(0.5 + (o_orderkey % 50) / 100.0, 2) as double) else cast(1.0 as double) end as confidence,
  cast(6 + o_custkey % 20 as double) as font_size
 from b
"""

POLYGONS = """
select cast(floor(o_orderkey / 320.0) as bigint) as doc_id, cast(floor(o_orderkey / 32.0) as bigint) as page_no, cast(o_orderkey % 32 as bigint) as poly_idx,
  cast(60 + (o_orderkey % 7) * 120 as double) as x0, cast(60 + (floor((o_orderkey % 32) / 7)) * 120 as double) as y0,
  cast(40 + o_custkey % 160 as double) as w, cast(40 + o_custkey % 120 as double) as h, cast(o_custkey % 3 as bigint) as notch from orders
"""

ALL = {"v_sheets": SHEETS, "v_segments": SEGMENTS, "v_text_blocks": TEXT_BLOCKS, "v_polygons": POLYGONS}
#: SEGMENTS for Spark: numbered by the named columns of the sheet, so that rows stay dealt out by sheet and later windows and groups within sheets move nothing.
SHEET = "cast(floor(l_orderkey / 32.0) as bigint) as page_no, cast(floor(l_orderkey / 320.0) as bigint) as doc_id"
SEGMENTS_BY_SHEET = SEGMENTS.replace(f"select {SHEET}", "select page_no, doc_id").replace("partition by cast(floor(l_orderkey / 32.0) as bigint)", "partition by doc_id, page_no")
#: Segments that one task numbers; larger tables are dealt to more tasks than shuffles have partitions.
TASK = 1 << 19
#: Columns that the fixtures add to the views, in both dialects.
BOXES = "select *, x0 + 5 * length(text) as x1, y0 + 10 as y1 from v_text_blocks"


def sql(body: str, *names: str) -> str:
    """body in DuckDB's dialect, with the named views in front. A part named fold is recursive."""
    views = ",\n".join(f"{n} as ({ALL[n].replace(' as string)', ' as varchar)')})" for n in names)
    views += ",\nv_blocks as (" + BOXES + ")" if "v_text_blocks" in names else ""
    body, start = body.strip(), "with recursive" if " fold " in body else "with"
    return f"{start} {views}, {body[5:]}" if body.lower().startswith("with ") else f"{start} {views}\n{body}"


def matched(edges: str, left: str, right: str, rank: str, shared: bool = True) -> str:
    """SQL: `taken` holds the edges that are taken one after another by rank, each node once."""
    return f"""em as (
  select *, row_number() over (partition by doc_id, page_no order by {rank}) as n, 'a' || {left} as na, '{"a" if shared else "b"}' || {right} as nb from {edges}),
 fold as (
  select distinct doc_id, page_no, cast(0 as bigint) as n, cast([] as varchar[]) as used, false as ok from em
  union all select em.doc_id, em.page_no, em.n, case when list_contains(used, na) or list_contains(used, nb) then used else list_concat(used, [na, nb]) end,
    not (list_contains(used, na) or list_contains(used, nb)) from fold join em on em.doc_id = fold.doc_id and em.page_no = fold.page_no and em.n = fold.n + 1),
taken as (select em.* from em join fold using (doc_id, page_no, n) where ok)"""


def led(nodes: str, node: str, near: str) -> str:
    """SQL: `led` gives each of nodes its leader, where nodes lead in the order of their ids unless a smaller leader is near (a condition on x and y)."""
    return f"""nn as (
  select x.doc_id, x.page_no, x.{node} as node, list(y.{node}) filter (y.{node} is not null) as around, row_number() over (partition by x.doc_id, x.page_no order by x.{node}) as n
  from {nodes} x left join {nodes} y on x.doc_id = y.doc_id and x.page_no = y.page_no and x.{node} < y.{node} and {near} group by x.doc_id, x.page_no, x.{node}),
 fold as (
  select distinct doc_id, page_no, cast(0 as bigint) as n, cast(-1 as bigint) as node, cast([] as bigint[]) as covered, false as leads, cast([] as bigint[]) as around from nn
  union all select nn.doc_id, nn.page_no, nn.n, nn.node, case when list_contains(covered, nn.node) or nn.around is null then covered else list_concat(covered, nn.around) end,
    not list_contains(covered, nn.node), nn.around from fold join nn on nn.doc_id = fold.doc_id and nn.page_no = fold.page_no and nn.n = fold.n + 1),
led as (
  select doc_id, page_no, member as node, min(node) as leader
  from (select doc_id, page_no, node, unnest(list_concat([node], coalesce(around, cast([] as bigint[])))) as member from fold where leads) group by all)"""


def _view(spark: SparkSession, sf_dir: str, select: str, *tables: str) -> DataFrame:
    """The SELECT over the tables; they are read at the moment, so no catalog name is taken."""
    for t in tables:
        select = select.replace(f" from {t}", f" from {{{t}}}")
    return spark.sql(select, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SHEETS, "orders")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with fill, color and dashes as arrays, as they come from drawings."""
    gray = F.col("fill_gray")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keyed = rows.selectExpr(*SHEET.split(", "), "*")
    tasks = -(-rows.count() // TASK)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        keyed = keyed.select(*K, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice").repartition(tasks, *K)
    v = bound(spark.sql(SEGMENTS_BY_SHEET.replace(" from lineitem", " from {lineitem}"), lineitem=keyed), "x1", "y1", "x2", "y2")
    return v.select(
        *K, "seg_idx", "x1", "y1", "x2", "y2", "width", "fill_type",
        F.when(F.col("is_dashed"), F.array(F.lit(3.0), F.lit(4.0))).alias("dashes"),
        F.when(gray.isNotNull(), F.array(gray, gray, gray)).alias("fill"),
        F.when(gray.isNotNull(), F.array(gray, gray * 0.5, F.lit(0.0))).alias("color"),
    )


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text is worked out once a row: a generator keeps it from being copied into every filter on it.
    v = _view(spark, sf_dir, TEXT_BLOCKS, "orders").withColumn("text", F.explode(F.array("text")))
    return v.withColumn("x1", F.col("x0") + 5 * F.length("text")).withColumn("y1", F.col("y0") + 10)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rings: a rectangle, or one that lacks a quarter at a corner."""
    v = _view(spark, sf_dir, POLYGONS, "orders")
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    full = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    cut = F.array(point(x, y), point(x + w, y), point(x + w, y + h / 2), point(x + w / 2, y + h / 2), point(x + w / 2, y + h), point(x, y + h))
    return bound(v.select(*K, "poly_idx", F.when(F.col("notch") == 1, cut).otherwise(full).alias("vertices")), "vertices")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawing paths: four segments each, drawn as a line, a rectangle, a quadrilateral and a curve after a move."""
    s = segments(spark, sf_dir)
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    kind = F.col("seg_idx") % 4
    op = F.when(kind == 0, "l").when(kind == 1, "re").when(kind == 2, "qu").otherwise("c")
    pts = F.when(kind == 2, F.array(point("x1", "y1"), point("x2", "y1"), point("x1", "y2"), point("x2", "y2"))).when(kind == 3, F.array(point("x1", "y1"), point("x1", "y2"), point("x2", "y1"), point("x2", "y2"))).otherwise(F.array(point("x1", "y1"), point("x2", "y2")))
    item = F.struct(F.col("seg_idx").alias("at"), op.alias("op"), pts.alias("pts"))
    style = F.min_by(F.struct("width", "color", "fill", "fill_type", "dashes"), "seg_idx").alias("style")
    grouped = s.groupBy(*K, F.expr("seg_idx div 4").alias("path_idx")).agg(F.array_sort(F.collect_list(item)).alias("drawn"), style)
    move = F.struct(F.lit("m").alias("op"), F.slice(F.col("drawn")[0]["pts"], 1, 1).alias("pts"))
    drawn = F.transform("drawn", lambda i: F.struct(i["op"].alias("op"), i["pts"].alias("pts")))
    return grouped.select(*K, "path_idx", "style.*", F.when(F.col("path_idx") % 2 == 0, F.concat(F.array(move), drawn)).otherwise(drawn).alias("items"))
