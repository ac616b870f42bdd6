"""Secret scanning over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the digest of its content. The ledger holds
the (blob, rule, rule version) triples that have been scanned and what they gave; only
blobs with an unseen triple move on, each once however many paths hold it, and only the
unseen rules run. Findings are joined back to all paths by digest.

Defined results: a null text counts as empty; rows with equal content share findings; an
empty table gives no rows; input columns named blob or spans are replaced. Offsets are code
points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.common import named, spare, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to match, how long a match (or its group) must be, and its place among kinds that start together."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1


#: The base kinds come first; those after them are ours.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
SPANS = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"
#: Matches of one text that are gathered at a time.
BLOCK = 128
#: Code points of the pieces that a text is cut into for marks.
PIECE = 4096
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column of its own that is worked out once a row: projections aren't merged across a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def matches(text: Column, rule: Rule) -> Column:
    """Rows (whole, judged, before) of the rule's leftmost non-overlapping matches, and a last one without a match for the text after them."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    return F.when(text.rlike(rule.pattern), F.arrays_zip(whole.alias("whole"), judged.alias("judged"), F.split(text, rule.pattern, -1).alias("before")))


def spans_of(rows: Column, rule: Rule, place: int) -> Column:
    """The spans of a rule's matches that are long enough; the pieces between matches give their offsets. rows: a bound column."""

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        start = at + F.length(row["before"])
        end = start + F.length(row["whole"])
        span = F.struct(start.cast("long").alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        return end.cast("long"), F.when(F.length(row["judged"]) >= rule.least, F.array(span)).otherwise(F.array().cast(SPANS))

    return F.coalesce(folded(rows, F.size(rows) - 1, step, SPANS)[1], F.array().cast(SPANS))


def folded(rows: Column, n: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> tuple[Column, Column]:
    """Runs step from an offset and a row to the next offset and an array, over the first n rows: (last offset, all arrays in one).

    An array that grows is copied with every row, so rows are folded in blocks of BLOCK and
    the blocks' arrays are put together at the end. rows must be a column, not an expression: it is sliced once a block.
    """
    none = F.array().cast(kind)

    def within(acc: Column, row: Column) -> Column:
        at, more = step(acc["at"], row)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        last = F.aggregate(part, F.struct(acc["last"]["at"].alias("at"), none.alias("out")), within)
        return F.struct(last.alias("last"), F.concat(acc["done"], F.array(acc["last"]["out"])).alias("done"))

    count = F.ceil(n / BLOCK).cast("int")
    parts = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(rows, i * BLOCK + 1, F.least(F.lit(BLOCK), n - i * BLOCK)))
    start = F.struct(F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")).alias("last"), F.array().cast(f"array<{kind}>").alias("done"))
    end = F.aggregate(parts, start, block)
    return end["last"]["at"], F.flatten(F.concat(end["done"], F.array(end["last"]["out"])))


def placed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans from a ledger, with the places that their kinds have among today's rules."""
    places = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(places, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(versions: DataFrame, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(versions with their blob's digest, new ledger rows). versions keeps its columns but the text and any named `spans`, and gets `blob`; carry: new rows hold the text as well."""
    body = F.coalesce(named(text), F.lit(""))
    others = [c for c in versions.columns if c not in (text, "blob", "spans")]
    paths = versions.select(*(named(c) for c in others), F.sha2(body, 256).alias("blob"))
    contents = versions.select(F.sha2(body, 256).alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    marks = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    if ledger is None:
        unseen = contents.withColumn("todo", marks)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
        unseen = contents.join(seen, "blob", "left").withColumn("todo", F.array_except(marks, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    asked = [F.array_contains("todo", f"{r.kind}:{r.version}") for r in rules]
    # One pass per blob; rules that were seen give null and drop out.
    matched = bound(unseen, "m", F.struct(*(F.when(ask, matches(F.col("text"), r)).alias(f"r{i}") for i, (r, ask) in enumerate(zip(rules, asked, strict=True)))))
    found = [F.when(ask, F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col(f"m.r{i}"), r, i).alias("spans"))) for i, (r, ask) in enumerate(zip(rules, asked, strict=True))]
    new = matched.select("blob", *["text"] * carry, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("results"))
    return paths, new


def entries(new: DataFrame) -> DataFrame:
    """The new results as ledger rows, one for each blob and rule version."""
    return new.select("blob", F.inline("results"))


def findings(paths: DataFrame, new: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """paths with `spans`: all findings of the current rule versions, ordered by start and then by rule."""
    blobs = new.select("blob", F.flatten(F.transform("results", lambda r: r["spans"])).alias("spans"))
    if ledger is not None:
        current = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
        old = ledger.where(F.array_contains(current, F.concat_ws(":", "rule", "version"))).select("blob", "rule", "version", placed(F.col("spans"), rules).alias("spans")).dropDuplicates(["blob", "rule", "version"])
        fresh = entries(new)
        blobs = old.unionByName(fresh).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # Blobs without findings need not meet their paths.
    some = blobs.where(F.size("spans") > 0).select("blob", F.array_sort("spans").alias("spans"))
    return paths.join(some, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def advance(versions: DataFrame, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans what is new: (paths with all their findings, the ledger to keep for the next run)."""
    paths, new = scan(versions, text, ledger, rules)
    new = written(new)
    full = entries(new) if ledger is None else ledger.unionByName(entries(new))
    return findings(paths, new, ledger, rules), full


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def redacted(pieces: Column, spans: Column, mark: str) -> Column:
    """The text with every run of overlapping spans replaced by mark. pieces: the text in pieces of PIECE code points; spans are ordered by start; both are bound columns.

    A stretch of text is cut from the pieces that hold it: in the whole text, finding its start takes all characters before it.
    """

    def cut(start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        low, high = (start - first * PIECE).cast("int"), (end - last * PIECE).cast("int")
        within = F.substr(piece(first), low + 1, high - low)
        across = F.concat(F.substr(piece(first), low + 1), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substr(piece(last), F.lit(1), high))
        return F.when(first == last, within).otherwise(across)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(cut(at, s["start"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))

    at, out = folded(spans, F.size(spans), step, "array<string>")
    first = F.floor(at / PIECE).cast("int")
    rest = F.concat(F.substr(F.coalesce(F.get(pieces, first), F.lit("")), (at - first * PIECE + 1).cast("int")), F.array_join(F.slice(pieces, first + 2, F.greatest(F.size(pieces) - first - 1, F.lit(0))), ""))
    return F.concat(F.array_join(out, ""), rest)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, with the secrets in their texts replaced by mark; each distinct text is scanned once."""
    blob, safe = spare(docs.columns, "blob"), spare([*docs.columns, "blob"], "safe")
    body = named(text).cast("string")
    _, new = scan(docs.select(body.alias("text")), "text", None, rules, carry=True)
    spans = F.array_sort(F.flatten(F.transform("results", lambda r: r["spans"])))
    some = bound(new, "spans", spans).where(F.size("spans") > 0)
    cut = bound(some, "pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    held = cut.select(F.col("blob").alias(blob), redacted(F.col("pieces"), F.col("spans"), mark).alias(safe))
    both = docs.withColumn(blob, F.sha2(F.coalesce(body, F.lit("")), 256)).join(held, blob, "left")
    return both.select(*(F.coalesce(named(safe), named(c)).alias(c) if c == text else named(c) for c in docs.columns))


def line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, *keep: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one string."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    count = [F.size(F.filter("spans", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(*(named(c) for c in keep), *count, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
