"""Room labels: from text blocks to labels, clusters and matches with polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.geom import box, celled, centroid, covered, in_ring
from sheetloom.functions.greedy import leader_clusters, priority_matching
from sheetloom.functions.lineage import bound, unsent
from sheetloom.sources.views import K

#: Words that make a room label, and shapes of room numbers.
ROOM_WORDS = (
    r"\bOFFICE\b",
    r"\bOFF\b",
    r"\bCONF\b",
    r"\bCONFERENCE\b",
    r"\bMEETING\b",
    r"\bKITCHEN\b",
    r"\bBREAK\s*ROOM\b",
    r"\bBREAK\b",
    r"\bKITCHENETTE\b",
    r"\bRESTROOM\b",
    r"\bTOILET\b",
    r"\bMEN\b",
    r"\bWOMEN\b",
    r"\bUNISEX\b",
    r"\bRR\b",
    r"\bSTORAGE\b",
    r"\bSTOR\b",
    r"\bCLOSET\b",
    r"\bJANITOR\b",
    r"\bLOBBY\b",
    r"\bRECEPTION\b",
    r"\bVESTIBULE\b",
    r"\bENTRY\b",
    r"\bCORRIDOR\b",
    r"\bCORR\b",
    r"\bHALL\b",
    r"\bHALLWAY\b",
    r"\bMECHANICAL\b",
    r"\bMECH\b",
    r"\bELECTRICAL\b",
    r"\bELEC\b",
    r"\bTELECOM\b",
    r"\bIDF\b",
    r"\bMDF\b",
    r"\bWAREHOUSE\b",
    r"\bLOADING\b",
    r"\bDOCK\b",
    r"\bSTAIR\b",
    r"\bSTAIRWELL\b",
    r"\bELEVATOR\b",
    r"\bELEV\b",
    r"\bBEDROOM\b",
    r"\bLIVING\b",
    r"\bDINING\b",
    r"\bBATHROOM\b",
    r"\bBATH\b",
)
#: Numbers of rooms.
ROOM_NUMBERS = (
    r"^\d{2,4}$",
    r"^[A-Z]\d{2,4}$",
    r"^\d{2,4}[A-Z]$",
    r"^\d+-\d{2,4}$",
    r"^[A-Z]-\d{2,4}$",
)
#: Texts that name no room.
NOT_ROOMS = (
    r"['\"]",
    r"\d+\s*(ft|feet|inch|in|mm|cm|m)\b",
    r"=",
    r":",
    r"^NOTE\b",
    r"^SEE\b",
    r"^REF\b",
    r"^TYP\b",
    r"^[ASMEP]\d+\.\d+",
    r"^\d+/\d+",
)
#: Kinds of labels with patterns and their confidence, tried in order.
NUMBER_PATTERNS = (
    (r"^(\d{3})$", 0.95),
    (r"^(\d{3}[A-Z])$", 0.95),
    (r"^([A-Z])(\d{3})$", 0.90),
    (r"^(\d{2,3})-(\d{2,3})$", 0.85),
    (r"^([A-Z])-(\d{2,3})$", 0.90),
    (r"^(\d{4})$", 0.85),
    (r"^(\d{2})$", 0.70),
)
TAG_PATTERNS = (
    (r"^P(\d+)$", 0.90),
    (r"^C-?(\d+)$", 0.90),
    (r"^[ABCD]-(\d{2})$", 0.85),
    (r"^(ST|STAIR)-?(\d*)$", 0.90),
    (r"^(EL|ELEV)-?(\d*)$", 0.90),
)
NAME_PATTERNS = (
    (r"^OFFICE$", 0.90),
    (r"^LOBBY$", 0.90),
    (r"^RESTROOM$", 0.90),
    (r"^CORRIDOR$", 0.85),
    (r"^CORR\.?$", 0.80),
    (r"^STORAGE$", 0.90),
    (r"^STOR\.?$", 0.80),
    (r"^MECHANICAL$", 0.90),
    (r"^MECH\.?$", 0.80),
    (r"^ELECTRICAL$", 0.90),
    (r"^ELEC\.?$", 0.80),
    (r"^CONFERENCE$", 0.90),
    (r"^CONF\.?$", 0.80),
    (r"^BREAK\s*ROOM$", 0.90),
    (r"^KITCHEN$", 0.90),
    (r"^(MEN|WOMEN|UNISEX)$", 0.85),
    (r"^ELEVATOR$", 0.90),
    (r"^STAIR(WELL)?$", 0.90),
    (r"^VESTIBULE$", 0.90),
    (r"^RECEPTION$", 0.90),
    (r"^ENTRY$", 0.85),
    (r"^HALL(WAY)?$", 0.85),
    (r"^JANITOR$", 0.85),
    (r"^CLOSET$", 0.85),
    (r"^TELECOM$", 0.85),
    (r"^(IDF|MDF)$", 0.85),
    (r"^WAREHOUSE$", 0.90),
    (r"^LOADING$", 0.85),
    (r"^DOCK$", 0.85),
)
#: Texts that are no labels.
EXCLUDED = (
    r"\d+\s*['\"]",
    r"\d+\s*(ft|feet|in|inch|mm|cm|m)\b",
    r"^[\d\.]+\s*['\"]",
    r"[=:]",
    r"^NOTE[S]?\b",
    r"^SEE\s",
    r"^REF\.?\b",
    r"^TYP\.?\b",
    r"^[ASMEP]\d+\.\d+",
    r"^\d+/\d+",
    r"^@",
    r"^\(.*\)$",
    r"^\d+\s*SF$",
    r"^[+-]?\d+\.\d{2,}$",
    r"^SCALE\b",
    r"^NORTH$",
    r"^N\.T\.S\.$",
    r"^EXIST",
    r"^NEW\b",
    r"^DEMO",
    r"^\d+\s*X\s*\d+",
    r"^[ASMEP]\d{3}$",
    r"^[ASMEP]\d{2}$",
    r"^[ASMEP]-\d+$",
)
#: Two further ones, which reject most names and dashed numbers and can be left out.
STRICT = (
    r"['\"\-]\s*\d+",
    r"^[A-Z]{2,}\d*$",
)


def any_of(text: Column, patterns, flags: str = "(?i)") -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def with_center(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def merge_text(embedded: DataFrame, ocr: DataFrame, overlap: float = 0.5, cell: float = 128.0) -> DataFrame:
    """All embedded blocks, and the OCR blocks that overlap none of them by more than a share of the smaller box."""
    def cells(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        return df.withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))

    e = cells(embedded.select(*K, *(F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")))).select(*K, "gx", "gy", *(F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")))
    w, h = F.least("x1", "e_x1") - F.greatest("x0", "e_x0"), F.least("y1", "e_y1") - F.greatest("y0", "e_y0")
    smaller = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("e_x1") - F.col("e_x0")) * (F.col("e_y1") - F.col("e_y0")))
    hit = unsent(cells(ocr)).join(e, [*K, "gx", "gy"]).where((w > 0) & (h > 0) & (smaller > 0) & (w * h > overlap * smaller)).select(*K, "block_idx").distinct()
    return embedded.unionByName(unsent(ocr).join(hit, [*K, "block_idx"], "left_anti"))


def image_to_page(x0: Column, y0: Column, x1: Column, y1: Column, iw: Column, ih: Column, pw: Column, ph: Column) -> Column:
    """A box in pixels of an image as points of the page, the y axis turned over."""
    sx, sy = pw / F.nullif(iw, F.lit(0.0)), ph / F.nullif(ih, F.lit(0.0))
    return F.struct((x0 * sx).alias("x0"), (ph - y1 * sy).alias("y0"), (x1 * sx).alias("x1"), (ph - y0 * sy).alias("y1"))


def room_labels(blocks: DataFrame) -> DataFrame:
    """Blocks that name a room: by length, font, confidence, exclusions and room words or numbers."""
    t = F.trim("text")
    sized = F.length(t).between(2, 50) & (F.col("font_size").isNull() | F.col("font_size").between(5, 36)) & ((F.col("source") != "ocr") | (F.col("confidence") >= 0.6))
    shout = (F.upper(t) == t) & (F.length(t) > 20) & t.rlike(r"^\p{L}+$")
    named = any_of(F.upper(t), ROOM_WORDS, "") | any_of(F.upper(t), ROOM_NUMBERS, "")
    return with_center(blocks.where(sized & ~any_of(t, NOT_ROOMS) & ~shout & named).withColumn("text", t))


def classify_labels(blocks: DataFrame, sheets: DataFrame, least: float = 0.5, strict_exclusions: bool = True, right: float = 0.80) -> DataFrame:
    """K, block_idx, label, label_type, confidence, cx, cy, font_size, in_area of the blocks that are labels."""
    t = F.trim("text")
    # Bound by a generator, so that not every pattern trims the text anew.
    bound = F.explode(F.array(F.upper(F.regexp_replace(t, r"\s+", " "))))
    norm = F.col("label")
    sized = F.length(t).between(1, 30) & (F.col("font_size").isNull() | F.col("font_size").between(4, 24)) & ((F.col("source") != "ocr") | (F.col("confidence") >= 0.5))
    made = lambda k, c: F.struct(F.lit(k).alias("label_type"), F.lit(c).alias("sure"))
    hit = None
    for kind, patterns in (("ROOM_NUMBER", NUMBER_PATTERNS), ("AREA_TAG", TAG_PATTERNS), ("ROOM_NAME", NAME_PATTERNS)):
        # Patterns of one confidence are tried together; a text that fits two kinds of patterns gets the first.
        for sure in dict.fromkeys(c for _, c in patterns):
            fits, value = any_of(norm, [p for p, c in patterns if c == sure], ""), made(kind, sure)
            hit = F.when(fits, value) if hit is None else hit.when(fits, value)
    out = (*EXCLUDED, *(STRICT if strict_exclusions else ()))
    got = with_center(blocks.where(sized & ~any_of(t, out)).withColumn("label", bound)).withColumn("hit", hit).where("hit is not null").join(sheets.select(*K, "page_width", "page_height"), K)
    inside = F.col("cx") < F.col("page_width") * right
    base = (F.when(F.col("source") == "embedded", 0.95).otherwise(F.col("confidence")) + F.col("hit.sure")) / 2
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(inside, base).otherwise(base * 0.5)))
    return got.select(*K, "block_idx", "label", "hit.label_type", score.alias("confidence"), "cx", "cy", "font_size", inside.alias("in_area"), "page_width", "page_height").where(F.col("confidence") >= least)


def dedupe_labels(labels: DataFrame, cell: float = 50.0) -> DataFrame:
    """The first of equal labels in one cell."""
    by = Window.partitionBy(*K, "label", (F.col("cx") / cell).cast("long"), (F.col("cy") / cell).cast("long")).orderBy("block_idx")
    return labels.withColumn("nth", F.row_number().over(by)).where("nth = 1").drop("nth")


def grid_marker(edge: float = 300.0) -> Column:
    """Whether a label is a grid marker: a digit or two, or one letter, near an edge of the page."""
    mark = F.col("label").rlike(r"^(\d{1,2}|[A-Z])$")
    return mark & ((F.col("cx") < edge) | (F.col("cx") > F.col("page_width") - edge) | (F.col("cy") < edge) | (F.col("cy") > F.col("page_height") - edge))


def edge_marker(edge: float = 50.0) -> Column:
    """The second rule: one or two digits, or one or two letters, at the top or bottom."""
    return F.col("label").rlike(r"^(\d{1,2}|[A-Z]{1,2})$") & ((F.col("cy") < edge) | (F.col("cy") > F.col("page_height") - edge))


def label_clusters(labels: DataFrame, reach: float = 50.0) -> DataFrame:
    """K, cluster_idx, label_text, label_type, confidence, cx, cy, n: labels near a leader, in index order."""
    step = F.sequence(F.lit(-1), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / reach)
    mine = labels.select(*K, F.col("block_idx").alias("u"), F.col("cx").alias("ux"), F.col("cy").alias("uy")).withColumns({"gx": cell("ux"), "gy": cell("uy")}).withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumns({"gx": F.col("gx") + F.col("i"), "gy": F.col("gy") + F.col("j")})
    theirs = labels.select(*K, F.col("block_idx").alias("v"), "cx", "cy").withColumns({"gx": cell("cx"), "gy": cell("cy")})
    near = unsent(mine).join(theirs, [*K, "gx", "gy"]).where((F.col("u") != F.col("v")) & (F.abs(F.col("ux") - F.col("cx")) <= reach) & (F.abs(F.col("uy") - F.col("cy")) <= reach))
    owned = unsent(labels).join(leader_clusters(labels, near, "block_idx"), [*K, "block_idx"])
    order = F.when(F.col("label_type") == "ROOM_NUMBER", 0).when(F.col("label_type") == "AREA_TAG", 1).otherwise(2)
    first = F.min_by(F.struct("label", "label_type", "confidence"), F.struct(order, -F.col("confidence"), "block_idx"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "block_idx", "label"))), lambda s: s["label"]), " ")
    got = owned.groupBy(*K, F.col("leader").alias("cluster_idx")).agg(first.alias("lead"), text.alias("label_text"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.count("*").alias("n"))
    return got.select(*K, "cluster_idx", F.col("lead.label").alias("primary_label"), "label_text", "lead.label_type", "lead.confidence", "cx", "cy", "n")


def match_labels(labels: DataFrame, polygons: DataFrame, grow: float = 0.15) -> DataFrame:
    """K, poly_idx, block_idx, room_name, name_confidence: in polygon order, each label once.

    A label inside the ring is HIGH, one inside the grown box MEDIUM, the nearest within
    half the box's diagonal LOW; the nth polygon without one is named ROOM_n, NONE.
    """
    p = bound(polygons.withColumns({"bx": box(F.col("vertices")), "c": centroid(F.col("vertices"))}), "bx", "c")
    w, h = F.col("bx.x1") - F.col("bx.x0"), F.col("bx.y1") - F.col("bx.y0")
    # Cells that a ring's grown box or the circle about its center meets; a label lies in one.
    cell, half = 128.0, F.hypot(w, h) / 2
    low = lambda c, side: F.least(F.col(f"bx.{c}0") - grow * side, F.col(f"c.{c}") - half)
    high = lambda c, side: F.greatest(F.col(f"bx.{c}1") + grow * side, F.col(f"c.{c}") + half)
    spread = covered(p, cell, low("x", w), low("y", h), high("x", w), high("y", h))
    placed = celled(labels.select(*K, "block_idx", "text", F.col("cx").alias("lx"), F.col("cy").alias("ly")), cell, F.col("lx"), F.col("ly"))
    pair = spread.join(placed, [*K, "gx", "gy"])
    far = F.hypot(F.col("lx") - F.col("c.x"), F.col("ly") - F.col("c.y"))
    inside = in_ring(F.col("lx"), F.col("ly"), F.col("vertices"))
    near = F.col("lx").between(F.col("bx.x0") - grow * w, F.col("bx.x1") + grow * w) & F.col("ly").between(F.col("bx.y0") - grow * h, F.col("bx.y1") + grow * h)
    tier = F.when(inside, 0).when(near, 1).when(far < F.hypot(w, h) / 2, 2)
    # Tiers 0 and 1 take the first label in block order, tier 2 the nearest.
    rank = F.format_string("%06d-%d-%014.6f-%06d", F.col("poly_idx"), F.col("tier"), F.when(F.col("tier") == 2, F.col("far")).otherwise(0.0), F.col("block_idx"))
    edges = pair.withColumns({"tier": tier, "far": far}).where("tier is not null").select(*K, "poly_idx", "block_idx", "text", "tier", rank.alias("rank"))
    taken = priority_matching(edges, "poly_idx", "block_idx", "rank", shared=False)
    full = unsent(polygons.select(*K, "poly_idx")).join(taken, [*K, "poly_idx"], "left")
    nth = F.row_number().over(Window.partitionBy(*K, F.col("tier").isNull()).orderBy("poly_idx"))
    level = F.when(F.col("tier") == 0, "HIGH").when(F.col("tier") == 1, "MEDIUM").when(F.col("tier") == 2, "LOW")
    return full.select(*K, "poly_idx", "block_idx", F.coalesce("text", F.format_string("ROOM_%d", nth)).alias("room_name"), F.coalesce(level, F.lit("NONE")).alias("name_confidence"))


def apply_labels(polygons: DataFrame, matches: DataFrame) -> DataFrame:
    return unsent(polygons).join(matches.select(*K, "poly_idx", "room_name", "name_confidence"), [*K, "poly_idx"], "left").withColumns({"room_name": F.coalesce("room_name", F.lit("ROOM_UNKNOWN")), "name_confidence": F.coalesce("name_confidence", F.lit("NONE"))})


def label_stats(labels: DataFrame) -> DataFrame:
    """Per sheet and type, and per sheet (type null), and over all: counts by band of confidence, and the average."""
    c = F.col("confidence")
    return labels.rollup("doc_id", "page_no", "label_type").agg(F.count("*").alias("n"), F.count_if(c >= 0.85).alias("high"), F.count_if((c >= 0.6) & (c < 0.85)).alias("medium"), F.count_if(c < 0.6).alias("low"), F.round(F.avg("confidence"), 8).alias("average"))
