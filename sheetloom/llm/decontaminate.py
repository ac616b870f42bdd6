"""Benchmark decontamination with Wu-Manber multi-pattern search.

Texts and items become lower-case words parted by single spaces; each window of n item
words is one pattern, " w1 ... wn ". A shift table over blocks of bytes says how far the
search may skip, buckets by the hash of the window's suffix block select the patterns
to test, and the bytes are compared before an occurrence counts. Patterns are searched
in classes of similar length, so that a short item does not shorten every skip.

Defined results: a null text has no words; rows keep their other columns; items without
words have no window; null item ids hit but are not listed; repeated items count once; an
empty table gives no rows; input columns named as the results are replaced by them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.common import MASKS, ODD, map_texts, named, spare, words_of

#: Pattern lengths in bytes from which a class starts, with the block size and bits of its tables.
CLASSES = ((24, 8, 20), (10, 4, 18), (0, 2, 16))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_from", T.ArrayType(T.LongType())), T.StructField("hit_to", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def slots(blocks: np.ndarray, bits: int) -> np.ndarray:
    return ((blocks * np.uint64(ODD)) >> np.uint64(64 - bits)).astype(np.int64)


class WuManber:
    """Search tables for byte patterns; find() gives every occurrence in a buffer."""

    def __init__(self, patterns: list[bytes]):
        self.patterns, self.groups = patterns, []
        sizes = np.array([len(p) for p in patterns], np.int64)
        top = np.iinfo(np.int64).max
        for least, block, bits in CLASSES:
            of = np.flatnonzero((sizes >= least) & (sizes < top))
            top = least
            if len(of):
                self.groups.append(self._tables(of, int(sizes[of].min()), block, bits))

    def _tables(self, of: np.ndarray, m: int, block: int, bits: int) -> tuple:
        heads = np.frombuffer(b"".join(self.patterns[i][:m] + bytes(8) for i in of), np.uint8).reshape(len(of), m + 8)
        load = lambda at: np.ascontiguousarray(heads[:, at : at + 8]).view("<u8")[:, 0] & MASKS[block]
        shift = np.full(1 << bits, m - block + 1, np.int32)
        for end in range(block, m + 1):
            np.minimum.at(shift, slots(load(end - block), bits), m - end)
        suffix = slots(load(m - block), bits)
        order = np.argsort(suffix, kind="stable")
        start = np.searchsorted(suffix[order], np.arange((1 << bits) + 1)).astype(np.int32)
        prefix = np.ascontiguousarray(heads[:, :8]).view("<u8")[:, 0] & MASKS[min(8, m)]
        return m, block, bits, shift, start, of[order], prefix[order]

    def find(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences."""
        padded = buf + bytes(16)
        loads = np.ndarray((len(buf) + 8,), dtype="<u8", buffer=padded, strides=(1,))
        found: list[tuple[int, int]] = []
        for m, block, bits, shift, start, of, prefix in self.groups:
            last = len(buf) - m
            if last < 0:
                continue
            lanes = int(np.clip(len(buf) // 256, 1, 8192))
            bound = np.linspace(0, last + 1, lanes + 1).astype(np.int64)
            at, stop, hits = bound[:-1].copy(), bound[1:].copy(), []
            while len(at):
                slot = slots(loads[at + (m - block)] & MASKS[block], bits)
                skip = shift[slot]
                if (zero := skip == 0).any():
                    hits.append((at[zero], slot[zero]))
                at = at + np.maximum(skip, 1)
                if not (on := at < stop).all():
                    at, stop = at[on], stop[on]
            if not hits:
                continue
            pos, slot = (np.concatenate(x) for x in zip(*hits, strict=True))
            many = start[slot + 1] - start[slot]
            row = np.repeat(start[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pos = np.repeat(pos, many)
            same = (loads[pos] & MASKS[min(8, m)]) == prefix[row]
            for p, i in zip(pos[same].tolist(), of[row[same]].tolist(), strict=True):
                if buf.startswith(self.patterns[i], p):
                    found.append((p, i))
        return np.array([p for p, _ in found], np.int64), np.array([i for _, i in found], np.int64)


def windows_of(text: str | None, n: int) -> list[bytes]:
    w = words_of((text or "").encode("utf-8", "replace"))
    return [b" " + b" ".join(w[i : i + n]) + b" " for i in range(max(1, len(w) - n + 1))] if w else []


def compiled(items: list[tuple[str | None, str | None]], n: int) -> tuple[WuManber, list[list[str]], np.ndarray]:
    """The tables, the items of each pattern, and each pattern's number of words."""
    by: dict[bytes, set] = {}
    for name, text in items:
        for w in windows_of(text, n):
            by.setdefault(w, set()).add(name)
    patterns = sorted(by)
    return WuManber(patterns), [sorted(x for x in by[p] if x is not None) for p in patterns], np.array([p.count(b" ") - 1 for p in patterns], np.int64)


def searcher(tables) -> Callable[[], Callable[[list[bytes]], list[pa.Array]]]:
    def make():
        wu, items, widths = tables.value

        def work(texts: list[bytes]) -> list[pa.Array]:
            words = [words_of(t) for t in texts]
            parts = [b" " + b" ".join(w) + b" \n" for w in words]
            ends = np.cumsum([len(p) for p in parts])
            buf = b"".join(parts)
            pos, pat = wu.find(buf)
            empty = [[] for _ in texts]
            froms, tos, names = list(empty), list(empty), list(empty)
            if len(pos):
                doc = np.searchsorted(ends, pos, side="right")
                spaces = np.cumsum(np.frombuffer(buf, np.uint8) == 32, dtype=np.int32)
                first = spaces[pos] - spaces[(ends - [len(p) for p in parts])[doc]]
                order = np.lexsort((pat, first, doc))
                doc, first, pat = doc[order], first[order], pat[order]
                for lo, hi in zip((b := np.flatnonzero(np.diff(doc, prepend=-1))).tolist(), [*b[1:].tolist(), len(doc)], strict=True):
                    d, a, z = int(doc[lo]), first[lo:hi].astype(np.int64), first[lo:hi] + widths[pat[lo:hi]]
                    reach = np.maximum.accumulate(z)
                    new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
                    froms[d], tos[d] = a[new].tolist(), reach[np.r_[new[1:] - 1, len(a) - 1]].tolist()
                    names[d] = sorted({x for p in set(pat[lo:hi].tolist()) for x in items[p]})
            longs = pa.list_(pa.int64())
            return [pa.array([len(w) for w in words], pa.int64()), pa.array(froms, longs), pa.array(tos, longs), pa.array(names, pa.list_(pa.string()))]

        return work

    return make


def find_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, keep: list[str] | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words, the word spans [hit_from, hit_to) that benchmark windows cover, and the items found.

    The pattern tables are broadcast only while the items hold at most most_bytes of text
    (measured first). Larger sets are cut into parts of that size by a hash of the text;
    each part is one more pass over docs, and the passes are merged by row.
    """
    src = items.select(named(item_id).cast("string").alias("name"), named(item_text).cast("string").alias("body")).where(F.col("body").isNotNull())
    total = src.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    passes = max(1, -(-2 * total // most_bytes)) if total > most_bytes else 1
    spark, keep = docs.sparkSession, [c for c in (docs.columns if keep is None else keep) if c not in FOUND.names]

    def one(df: DataFrame, part: int, kept: list[str]) -> DataFrame:
        own = src if passes == 1 else src.where(F.pmod(F.xxhash64("body"), F.lit(passes)) == part)
        tables = spark.sparkContext.broadcast(compiled([(r.name, r.body) for r in own.collect()], n))
        return map_texts(df, text, FOUND, searcher(tables), kept)

    if passes == 1:
        return one(docs, 0, keep)
    # Rows that agree in everything have the same words, so they may share a key.
    key, runs = spare(docs.columns, "row_key"), spare(docs.columns, "spans")
    keyed = docs.withColumn(key, F.sha2(F.to_json(F.struct(*(named(c) for c in docs.columns))), 256))
    found = None
    for part in range(passes):
        hits = one(keyed, part, [key]).where(F.size("hit_from") > 0).dropDuplicates([key]).select(key, F.arrays_zip("hit_from", "hit_to").alias(runs), "items")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(runs))).alias(runs), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    span = "struct<hit_from:bigint,hit_to:bigint>"
    joined = F.expr(f"aggregate({runs}, cast(array() as array<{span}>), (acc, s) -> if(size(acc) > 0 and s.hit_from <= acc[size(acc) - 1].hit_to, concat(slice(acc, 1, size(acc) - 1), array(named_struct('hit_from', acc[size(acc) - 1].hit_from, 'hit_to', greatest(acc[size(acc) - 1].hit_to, s.hit_to)))), concat(acc, array(s))))")
    none = F.array().cast("array<bigint>")
    counted = map_texts(keyed, text, T.StructType([FOUND["n_words"]]), word_counter, [*dict.fromkeys([*keep, key])])
    full = counted.join(merged.withColumn(runs, joined), key, "left")
    return full.select(*(named(c) for c in keep), "n_words", F.coalesce(f"{runs}.hit_from", none).alias("hit_from"), F.coalesce(f"{runs}.hit_to", none).alias("hit_to"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def word_counter():
    return lambda texts: [pa.array([len(words_of(t)) for t in texts], pa.int64())]


def report(found: DataFrame, *keep: str) -> DataFrame:
    """One row per document: counts, the digest of the item ids, and the verdict."""
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select(*(named(c) for c in keep), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_from") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, with exactly their own columns."""
    packed = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), named(text).alias("body"))
    return find_windows(packed, items, "body", item_id, item_text, n, ["row"]).where(F.size("hit_from") == 0).select("row.*")
