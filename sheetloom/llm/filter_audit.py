"""Audit of how five filters interact, over all orders of applying them.

Each document has a mask: which filters it fails, and whether it is good or toxic. What one
document adds to the report is fixed by its mask alone: for each of the 600 steps (120 orders
of five filters) whether it is kept after the step, removed by it, or fails its filter after
an earlier one removed it, and so on. Offline, every mask is mapped to one big integer whose
fields of 64 bits hold what a document with that mask adds to each of these counters.
Sums of such integers are sums of all fields at once: tasks sum them for each part, partial
sums are added in two rounds, and the sum of a part is unpacked into its 600 rows. A field
overflows at 2**64 documents only.

Defined results: a null text is empty and equals other empty texts; a null part is the
empty string; a null id is never smaller than another and has no labels; rows that repeat an
id and text aren't copies of each other; of repeated labels of an id the highest counts;
an empty table gives no rows; other columns are not read, so that their names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.common import map_texts, named

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of a mask: filters A to E, then good and toxic.
GOOD, TOXIC, MASKS = 1 << 5, 1 << 6, 1 << 7
#: Bytes of a field, and of all fields of one integer.
FIELD = 8
WIDTH = FIELD * STEPS * len(COUNTERS)
#: Parts that a task sums at a time, and partial sums of a part that one task of the first round gets at least.
HELD, FAN = 256, 64
CAPITAL, SIGN = re.compile(rb"[A-Z]"), re.compile(rb"[#$%&*|]")
JUDGED = T.StructType([T.StructField("mask", T.IntegerType())])
SUMS = "part string, salt int, packed binary"
ROWS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))


def packed(mask: int) -> int:
    """What a document with this mask adds to all counters of all steps, as one integer."""
    fields = np.zeros((STEPS, len(COUNTERS)), "<u8")
    fails = [bool(mask >> i & 1) for i in range(len(FILTERS))]
    for n, order in enumerate(ORDERS):
        gone = False
        for k, letter in enumerate(order):
            bad = fails[FILTERS.index(letter)]
            removed = bad and not gone
            redundant = bad and gone
            gone = gone or bad
            lost = [removed and bool(mask & bit) for bit in (GOOD, TOXIC)]
            fields[n * len(FILTERS) + k] = [not gone, removed, redundant, bad and sum(fails) == 1, *lost]
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: bytes) -> np.ndarray:
    """Steps by counters, with the removals of a step's filter over all orders as a last column."""
    fields = np.frombuffer(total, "<u8").reshape(STEPS, len(COUNTERS)).astype(np.int64)
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    removed = np.zeros(len(FILTERS), np.int64)
    np.add.at(removed, letters, fields[:, 1])
    return np.column_stack([fields, removed[letters]])


def judge(texts: list[bytes]) -> list[pa.Array]:
    """Filters A to D: too few words, too few distinct ones, too many capitals, signs."""
    masks = []
    for t in texts:
        words = t.split()
        n, points = len(words), len(t) if t.isascii() else len(t.decode("utf-8", "replace"))
        fails = (n < 200, 100 * len(set(words)) < 50 * n, 100 * len(CAPITAL.findall(t)) > 3 * points, SIGN.search(t) is not None)
        masks.append(sum(1 << i for i, bad in enumerate(fails) if bad))
    return [pa.array(masks, pa.int32())]


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n: how many documents of each part have each mask.

    Copies of a text are never gathered: each group of copies is counted by (part, labels) first,
    with its smallest id, so that all but the rows of the smallest id fail filter E.
    """
    own = docs.select(named(doc_id).cast("long").alias("doc"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    judged = map_texts(own.withColumn("key", F.unhex(F.sha2("text", 256))), "text", JUDGED, lambda: judge, keep=["doc", "part", "key"])
    flag = lambda c: F.max(F.coalesce(named(c) == 1, F.lit(False)).cast("int"))
    marked = labels.select(named(doc_id).cast("long").alias("doc"), named("quality"), named("toxic")).where(F.col("doc").isNotNull()).groupBy("doc").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    bits = F.coalesce("good", F.lit(0)) * GOOD + F.coalesce("toxic", F.lit(0)) * TOXIC
    # Ids that repeat are counted first, so that an id counts as one of its text.
    rows = judged.join(marked, "doc", "left").withColumn("mask", F.col("mask") + bits).groupBy("doc", "key", "part", "mask").agg(F.count("*").alias("n"))
    by_text = rows.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))).alias("first"), F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    # (part, mask) of one text are few and small, whatever the number of its copies.
    both = by_text.withColumn("lead", F.min("first.doc").over(Window.partitionBy("key")))
    unique = F.col("loose") + F.when(F.col("first.doc") == F.col("lead"), F.col("first.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    each = F.array(F.struct(F.col("mask"), unique.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - unique).alias("n")))
    return both.select("part", F.inline(each)).where("n > 0")


def big(counts: DataFrame) -> DataFrame:
    """part, salt, packed: in each task, the sum of the masks' integers for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, int] = {}
        held: dict[str, dict[int, int]] = {}
        salt = TaskContext.get().partitionId() // FAN

        def summed() -> pa.RecordBatch:
            """n documents of a mask add n times its integer."""
            for mask in {m for counts in held.values() for m in counts}.difference(table):
                table[mask] = packed(mask)
            return sums({part: sum(n * table[m] for m, n in counts.items()) for part, counts in held.items()}, salt)

        for batch in batches:
            for part, mask, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in held and len(held) >= HELD:
                    yield summed()
                    held.clear()
                own = held.setdefault(part, {})
                own[mask] = own.get(mask, 0) + n
        if held:
            yield summed()

    return counts.mapInArrow(run, SUMS)


def sums(held: dict[str, int], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([v.to_bytes(WIDTH, "little") for v in held.values()], pa.binary())], names=["part", "salt", "packed"])


def added(partial: DataFrame, keys: list[str], out: Callable[[str, int], pa.RecordBatch], schema: str) -> DataFrame:
    """One big sum for each key, added as the rows come by; a task holds one sum at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, 0
        for batch in batches:
            for part, salt, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (part, salt) if "salt" in keys else (part,)
                if key != at:
                    if at is not None:
                        yield out(at[0], total)
                    at, total = key, 0
                total += int.from_bytes(data, "little")
        if at is not None:
            yield out(at[0], total)

    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def report_rows(part: str, total: int) -> pa.RecordBatch:
    found = unpacked(total.to_bytes(WIDTH, "little"))
    orders = [o for o in ORDERS for _ in FILTERS]
    cols = [pa.array([part] * STEPS, pa.string()), pa.array(orders, pa.string()), pa.array([*range(1, len(FILTERS) + 1)] * len(ORDERS), pa.int32())]
    names = ["part", "filter_order", "step", *COUNTERS, "shapley"]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int64()) for c in found.T)], names=names)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, the counters and shapley: 600 rows for each part."""
    partial = big(masks(docs, labels, doc_id, text, part))
    once = added(partial, ["part", "salt"], lambda p, total: sums({p: total}, 0), SUMS)
    return added(once, ["part"], report_rows, ROWS)
