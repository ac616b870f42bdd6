"""Near-duplicate detection with DartMinHash signatures and banded joining.

A document is a weighted set: its word shingles with their counts. The weight axis of a
shingle is cut into dyadic regions [0, 1), [1, 2), [2, 4), ...; by hash, darts are thrown
into each region that the shingle's count reaches, about `DARTS / scale` for each unit of
weight, and those beyond the count are dropped. A dart lands in one of the signature's
coordinates with a hashed rank, and the earliest dart of each coordinate is kept, so the
cost is one hash for each region and dart and does not grow with the weights. scale is a
power of two at or above the document's total weight, so that weights are compared as
they are, not normalised; documents near a power of two have a signature at both scales.
Coordinates without a dart are filled by further slabs of ranks. Two signatures agree in a
coordinate with the probability of their weighted Jaccard similarity.

Equal bands of a signature make candidates, and no band is expanded into its pairs:

1. Each text is compared with the foremost of its bands' leads; a band's lead is the text
   that meets the most others over all bands. Links make components.
2. Bands that still hold several components compare each text with the band's lead.
3. Every pair of texts of different components is compared that shares one of the elements that two
   texts at the threshold must share: the rarest of each, in one order for all texts. This step alone is
   complete, and 1 and 2 leave little for it. Groups of many texts are compared in tiles (untested).

In 1 and 2, a comparison is first an estimate from the two signatures (pairs that are MARGIN standard
deviations under the threshold go), then the exact weighted Jaccard similarity of the shingle counts; 3 has no
estimate, so no link is missing. exact=False leaves 3 out. A large group of texts that are all just under the
threshold from each other has to be compared in full: n * n / TILE rows, in tasks of bounded memory.
Exact copies share one text from the start. The result is one row per document.

Defined results: ids can be of any type with an order; a null id ranks last; of ids that tie
the text of the smaller digest leads; a null text counts as empty; very long texts are a step of their own; texts of fewer words than a shingle are one shingle, texts without words
the empty one; equal rows are in the same class; an empty table gives no rows; further
columns are not read. The class id is the smallest document id in the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.common import CHUNK, ODD, STEP, TO_WORDS, bucketed, cuts, distinct_texts, mix, named, spare, text_row, word_hashes, written

WIDTH, SIMILARITY = 5, 0.8
#: Bands and coordinates per band: a pair at 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
COORDS = BANDS * ROWS
#: Darts for a total weight equal to the scale.
DARTS = int(COORDS * (np.log(COORDS) + 2))
#: Standard deviations under the threshold at which an estimate rules a pair out: 0.5 % of pairs at the threshold.
MARGIN = 2.6
#: Texts that a sample has at least before it takes only a part of them, and elements that it ranks at most.
SAMPLED, RANKED = 16384, 1 << 18
#: Texts of a group that are paired by a join; texts in a block of a larger group, where each LOAD elements of a text count once more.
PAIRED, TILE, LOAD = 16, 256, 4096
#: Slots that a text's elements are counted by, for a bound on what two texts share.
SLOTS = 512
#: Texts of a tile that gives all its links, and elements that are compared at once.
FEW, STRIPE = 64, 4096
#: Pairs of one lead that a task compares; the text of a lead with more is copied.
SHARE = 256


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' distinct shingles, as 64-bit values that are sorted in each, their counts, and where each document's begin, and the end.

    All texts are worked out at once: most are short, and a step for each would cost more than its words.
    """
    h, start, _ = word_hashes(b" ".join(texts).translate(TO_WORDS))
    first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    words = np.diff(first)
    g, short = np.zeros(len(h), np.uint64), np.flatnonzero(words < width)
    few = np.zeros(len(short), np.uint64)
    for i in range(width):
        m = max(0, len(h) - i)
        g[:m] = mix(g[:m] + h[i:])
        has = words[short] > i
        few[has] = mix(few[has] + h[first[short[has]] + i])
    n = np.maximum(1, words - width + 1)
    at = np.cumsum(n) - n
    place = np.arange(n.sum()) + np.repeat(first[:-1] - at, n)
    place[at[short]] = len(h) + np.arange(len(short))
    value = np.concatenate([g, few])[place]
    ends = sorted_parts(value, np.r_[at, len(value)])
    fresh = np.r_[True, value[1:] != value[:-1]]
    fresh[at] = True
    new = np.flatnonzero(fresh)
    return value[new], np.diff(np.r_[new, len(value)]), np.searchsorted(new, ends)


def sorted_parts(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorts the parts of value between ends in place; gives ends."""
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        value[lo:hi].sort()
    return ends


def shingles(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct shingles, as sorted 64-bit values, and their counts."""
    return shingle_sets([text], width)[:2]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two documents' shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def scales(total: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(documents, exponent of the scale): each at its own power of two, and at the next one if a similar document can be there."""
    own = np.ceil(np.log2(np.maximum(total, 1))).astype(np.int64)
    near = total / similarity > 2.0**own
    return [(np.arange(len(total)), own), (np.flatnonzero(near), own[near] + 1)]


@lru_cache(maxsize=256)
def poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, as 64-bit integers."""
    p, total, out, k = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-12 and k < 20 + 4 * mean:
        total += p
        out.append(min(total, 1.0))
        k += 1
        p *= mean / k
    return (np.array(out) * float(2**64 - 2**11)).astype(np.uint64)


def throw(shingle: np.ndarray, count: np.ndarray, doc: np.ndarray, exponent: int, slab: int, coords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The darts of one slab of ranks: document, coordinate and rank. A rank is as good as the dart's name: the hash is one to one."""
    found, low, level = [], 0, 0
    while len(shingle):
        region = max(1, low)
        seed = mix(shingle ^ np.uint64(((exponent << 32) + (slab << 8) + level + 1) * ODD & (2**64 - 1)))
        darts = np.searchsorted(poisson_steps(DARTS * region / 2.0**exponent), seed, side="left")
        hit = np.flatnonzero(darts)
        many = darts[hit]
        who = np.repeat(hit, many)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        value = mix(seed[who] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD))
        if region > 1:
            # Where on the weight axis a dart lies; beyond the count it is not the document's.
            within = low + (mix(value + np.uint64(ODD)) >> np.uint64(11)).astype(np.float64) * (region / 2.0**53) < count[who]
            who, value = who[within], value[within]
        found.append((doc[who], (value % np.uint64(coords)).astype(np.int64), mix(value ^ np.uint64(ODD))))
        low, level = low + region, level + 1
        more = count > low
        shingle, count, doc = shingle[more], count[more], doc[more]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def signatures(shingle: np.ndarray, count: np.ndarray, doc: np.ndarray, which: np.ndarray, exponent: np.ndarray, n: int, coords: int = COORDS) -> np.ndarray:
    """The rank of each coordinate's earliest dart, for the documents in which."""
    never = np.uint64(2**64 - 1)
    out = np.full(n * coords, never)
    at_scale = np.full(n, -1)
    at_scale[which] = exponent
    slab = 0
    while (at_scale >= 0).any():
        best = np.full(n * coords, never)
        for x in np.unique(at_scale[at_scale >= 0]).tolist():
            mine = (at_scale == x)[doc]
            d, c, rank = throw(shingle[mine], count[mine], doc[mine], x, slab, coords)
            np.minimum.at(best, d * coords + c, rank)
        # A coordinate keeps what an earlier slab gave it.
        out = np.where(out == never, best, out)
        at_scale[(out.reshape(n, coords) != never).all(axis=1)] = -1
        slab += 1
    return out.reshape(n, coords)


def signed(texts: DataFrame, similarity: float) -> DataFrame:
    """(row, scale, bands, sig): 53-bit band values with the scale (6 bits) and the band's number (5 bits) behind, and 16 bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, col = batch.column(0), batch.column(1).cast(pa.binary())
            sizes, at = np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            for end in cuts(sizes, STEP):
                shingle, count, begins = shingle_sets(col.slice(at, end - at).to_pylist())
                n, total = end - at, np.add.reduceat(count, begins[:-1])
                doc = np.repeat(np.arange(n), np.diff(begins))
                for which, exponent in scales(total, similarity):
                    if not len(which):
                        continue
                    sig = signatures(shingle, count, doc, which, exponent, n)[which]
                    band = np.zeros((len(which), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) + (exponent.astype(np.uint64) << np.uint64(8))[:, None]
                    for i in range(ROWS):
                        band = mix(band * np.uint64(ODD) + sig[:, i::ROWS])
                    band = band & ~np.uint64(2**11 - 1) | (exponent.astype(np.uint64) << np.uint64(5))[:, None] | np.arange(BANDS, dtype=np.uint64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1) * BANDS, pa.int32()), pa.array(band.view(np.int64).ravel()))
                    short = pa.array([s.tobytes() for s in sig.astype("<u2")], pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.slice(at, n).take(pa.array(which)), pa.array(exponent, pa.int32()), lists, short], names=["row", "scale", "bands", "sig"])
                at = end

    return texts.select("row", "text").mapInArrow(run, "row binary, scale int, bands array<long>, sig binary")


def scale_of(band: str) -> Column:
    return F.shiftright(band, 5).bitwiseAND(63).cast("int")


def least_agreement(similarity: float) -> float:
    """Coordinates in which two signatures agree at least, for a pair to be compared exactly."""
    return COORDS * (similarity - MARGIN * (similarity * (1 - similarity) / COORDS) ** 0.5)


def coordinates(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), "<u2").reshape(len(sigs), COORDS)


def alike(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b, scale) rows, those whose signatures agree often enough, as (a, b)."""
    least = least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array((coordinates(batch.column(2)) == coordinates(batch.column(3))).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda x: sigs.select(F.col("row").alias(x), "scale", F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("b"), ["b", "scale"]).join(side("a"), ["a", "scale"])
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary").distinct()


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b) rows, those whose weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            ok, at, col = [], 0, batch.column(3).cast(pa.binary())
            for end in cuts(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64), STEP):
                shingle, count, begins = shingle_sets(col.slice(at, end - at).to_pylist())
                for i, (a, lo, hi) in enumerate(zip(batch.column(0).slice(at, end - at).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True), at):
                    if a != last:
                        last, mine = a, shingles(batch.column(2).slice(i, 1).cast(pa.binary())[0].as_py())
                    ok.append(likeness(mine, (shingle[lo:hi], count[lo:hi])) >= similarity - 1e-9)
                at = end
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return with_texts(pairs, texts).mapInArrow(run, "a binary, b binary")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b). A lead of many pairs has its text copied, so that its pairs are dealt to several tasks."""
    own = texts.select("row", "text")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    left = dealt.join(own.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part")
    leads = own.select(F.col("row").alias("a"), F.col("text").alias("text_a")).join(parts, "a").select("a", "text_a", copies)
    return left.join(leads, ["a", "part"]).select("a", "b", "text_a", "text_b")


def components(links: DataFrame) -> DataFrame:
    """(row, root): every linked row with the smallest row of its component. Roots hook and jump until nothing changes."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(edges.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        # The smallest label among a row's neighbours, offered to its root as well.
        near = edges.join(label.select(F.col("row").alias("b"), F.col("root").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        own = label.join(near, label["row"] == near["a"]).select("row", "root", F.least("root", "seen").alias("low"))
        hooks = own.groupBy("root").agg(F.min("low").alias("hook"))
        met = own.join(hooks, "root").select("row", "root", F.least("low", "hook").alias("to"))
        jump = met.select(F.col("row").alias("to"), F.col("to").alias("next"))
        new = written(met.join(jump, "to", "left").select("row", F.least("to", F.coalesce("next", "to")).alias("root"), (F.least("to", F.coalesce("next", "to")) != F.col("root")).alias("moved")))
        label = new.select("row", "root")
        if new.where("moved").isEmpty():
            return label


def relabelled(label: DataFrame, found: DataFrame) -> DataFrame:
    """(row, root) after the links found between rows have joined components."""
    end = lambda x: label.select(F.col("row").alias(x), F.col("root").alias(f"root_{x}"))
    joined = written(found.join(end("a"), "a").join(end("b"), "b").where("root_a != root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    moved = components(joined).select(F.col("row").alias("root"), F.col("root").alias("to"))
    return written(label.join(moved, "root", "left").select("row", F.coalesce("to", "root").alias("root")))


def open_bands(led: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of the bands that hold several components, with their roots."""
    rooted = led.drop("root").join(label, "row")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    return written(rooted.join(mixed, "band"))


def element_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents' shingles as sets of 64-bit values, sorted in each, where the n-th occurrence of a shingle is one of its own; where each document's begin, and the end.

    Weighted Jaccard similarity of the counts is the plain one of these sets.
    """
    shingle, count, begins = shingle_sets(texts)
    before = np.r_[0, np.cumsum(count)]
    nth = np.arange(before[-1]) - np.repeat(before[:-1], count)
    value = mix(np.repeat(shingle, count) + nth.astype(np.uint64) * np.uint64(ODD))
    return value, sorted_parts(value, before[begins])


def elements(text: bytes) -> np.ndarray:
    """One document's set."""
    return element_sets([text])[0]


def element_lists(texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The set of each text."""
    texts, at, found = texts.cast(pa.binary()).to_pylist(), 0, []
    for end in cuts(np.array([len(t) for t in texts]), STEP):
        value, begins = element_sets(texts[at:end])
        found += [value[lo:hi] for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        at = end
    return found


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements that several texts of a sample hold (at most RANKED, sorted), with the logarithm of how many.

    They only order the elements of a text, so that groups are small; pairs are complete in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0).cast(pa.binary())
            sizes, at = np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            for end in cuts(sizes, CHUNK):
                value, n = np.unique(element_sets(col.slice(at, end - at).to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])
                at = end

    one_in = max(1, min(16, texts.count() // SAMPLED))
    counted = texts.where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counted.where("n > 2").orderBy(F.col("n").desc(), "key").limit(RANKED).toArrow()
    key, n = np.asarray(top["key"]).view(np.uint64), np.asarray(top["n"])
    order = np.argsort(key)
    return key[order], (np.log2(np.maximum(n[order], 1)) + 1).astype(np.int8)


def prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """(key, row, total): the rarest elements of each text, as many as it takes for two texts at the threshold to share one, and how many it has."""
    listed, level = frequent(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, col = batch.column(0), batch.column(1).cast(pa.binary())
            sizes, start = np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            for end in cuts(sizes, STEP):
                value, begins = element_sets(col.slice(start, end - start).to_pylist())
                totals = np.diff(begins)
                n = totals - np.ceil(similarity * totals - 1e-9).astype(np.int64) + 1
                who = np.repeat(np.arange(len(n)), n)
                if len(listed):
                    place = np.minimum(np.searchsorted(listed, value), len(listed) - 1)
                    rarity = np.where(listed[place] == value, level[place], 0)
                    first = [lo + np.argsort(rarity[lo : lo + of], kind="stable")[:k] for lo, of, k in zip(begins[:-1].tolist(), totals.tolist(), n.tolist(), strict=True)]
                else:
                    first = [np.arange(len(who)) + np.repeat(begins[:-1] - np.cumsum(n) + n, n)]
                cols = [pa.array(value[np.concatenate(first)].view(np.int64)), rows.slice(start, end - start).take(pa.array(who)), pa.array(totals[who])]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "row", "total"])
                start = end

    return texts.select("row", "text").mapInArrow(run, "key long, row binary, total long")


def slot_counts(texts: DataFrame) -> DataFrame:
    """(row, slots): how many of a text's elements fall into each slot; one byte each where that is enough, else four."""

    def counts(held: np.ndarray) -> bytes:
        n = np.bincount((held >> np.uint64(55)).astype(np.int64), minlength=SLOTS)
        return n.astype("u1" if n.max() < 256 else "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pa.array([counts(e) for e in element_lists(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), slots], names=["row", "slots"])

    return texts.select("row", "text").mapInArrow(run, "row binary, slots binary")


def tile_near(tile: pa.Table, similarity: float) -> pa.Table:
    """(a, b) rows that join what can be linked in one tile (i, j, block, row, root, slots): two texts share no more than their slots do."""
    slots = np.stack([np.frombuffer(s, "u1" if len(s) == SLOTS else "<u4").astype(np.uint32) for s in tile["slots"].to_pylist()])
    rows, size, block = tile["row"].to_pylist(), slots.sum(axis=1, dtype=np.int64), np.asarray(tile["block"])
    root = np.unique(np.array(tile["root"].to_pylist(), object), return_inverse=True)[1]
    two, part, found = tile["i"][0].as_py() != tile["j"][0].as_py(), np.arange(len(rows)), []
    for x in range(len(rows) - 1):
        y = np.arange(x + 1, len(rows))
        y = y[(part[y] != part[x]) & (root[y] != root[x]) & (np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x]) - 1e-6)]
        y = y[block[y] != block[x]] if two else y
        shared = np.minimum(slots[x], slots[y]).sum(axis=1, dtype=np.int64)
        for z in y[shared >= similarity * (size[x] + size[y] - shared) - 1e-9].tolist():
            if part[z] != part[x]:
                part[part == part[z]] = part[x]
                found.append((rows[x], rows[z]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def families(near: DataFrame, members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(family, i, j, block, row, root, text): tiles of the texts (row, root, total) that near joins, in which every two of a family that can be linked meet once.

    Texts of one family share many elements; a family's tiles have each text once, and not once for each of these.
    """
    held = Window.partitionBy("family")
    load = F.sum(1 + F.floor(F.col("total") / LOAD)).over(held.orderBy("total", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = written(members.join(components(near).select("row", F.col("root").alias("family")), "row").withColumn("block", F.floor((load - 1) / TILE)).withColumn("last", F.max("block").over(held)))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    # Blocks go by size: a text is not sent to those that hold only smaller or larger ones than it can be linked with.
    spans = blocks.groupBy("family", F.col("block").alias("other")).agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    sent = dealt.join(spans, ["family", "other"]).where(F.col("total") >= similarity * F.col("lo") - 1e-6).where(similarity * F.col("total") <= F.col("hi") + 1e-6)
    return sent.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "root").join(texts.select("row", "text"), "row")


def tile_links(tile: pa.Table, similarity: float) -> pa.Table:
    """(a, b): links between components of one tile (i, j, block, row, root, text); of a large tile, as many as join them."""
    sets = element_lists(tile["text"])
    rows, roots, block, n = tile["row"].to_pylist(), tile["root"].to_pylist(), np.asarray(tile["block"]), len(sets)
    size, owner = np.array([len(s) for s in sets]), np.repeat(np.arange(n), [len(s) for s in sets])
    _, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, number = owner[held[number] > 1], number[held[number] > 1]
    by = np.argsort(number, kind="stable")
    owner, number = owner[by], np.unique(number[by], return_inverse=True)[1]
    shared = np.zeros((n, n))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, STRIPE):
        lo, hi = np.searchsorted(number, [low, low + STRIPE])
        part = np.zeros((n, STRIPE), np.float32)
        part[owner[lo:hi], number[lo:hi] - low] = 1
        shared += part @ part.T
    near = np.triu(shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9, 1)
    if tile["i"][0].as_py() != tile["j"][0].as_py():
        near &= block[:, None] != block[None, :]
    found, root = [], {r: r for r in roots}

    def top(r: bytes) -> bytes:
        while root[r] != r:
            root[r] = r = root[root[r]]
        return r

    for x, y in zip(*(i.tolist() for i in np.nonzero(near)), strict=True):
        if roots[x] == roots[y]:
            continue
        if n > FEW:
            p, q = top(roots[x]), top(roots[y])
            if p == q:
                continue
            root[p] = q
        found.append((min(rows[x], rows[y]), max(rows[x], rows[y])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def untested(texts: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of texts of different components that can still reach the threshold.

    Two texts that do share an element among the rarest of each, taken in one order for all texts. Elements
    whose texts are of one component give no pair. Groups of PAIRED texts or fewer are paired by a join; larger ones
    are cut into blocks, and each two blocks are compared as a tile, by counts of elements in slots alone. What these
    leave possible makes families, which are cut and compared in the same way by their texts. A tile gives only the
    links in it, so that a group or family of n texts makes n * n / TILE rows.
    """
    held = Window.partitionBy("key")
    many = written(prefixes(texts, similarity).withColumn("n", F.count("*").over(held)).where("n > 1").drop("n"))
    rooted = many.join(label.select("row", "root"), "row").withColumns({"lo": F.min("root").over(held), "hi": F.max("root").over(held), "n": F.count("*").over(held)})
    left = written(rooted.where("lo != hi").drop("lo", "hi"))
    # Elements of a text whose groups are cut into tiles: a pair can share these too.
    tiled = left.groupBy("row").agg(F.count_if(F.col("n") > PAIRED).alias("tiled"))
    few = left.where(F.col("n") <= PAIRED).join(tiled, "row").select("key", "row", "total", "root", "tiled")
    other = few.select("key", *(F.col(c).alias(f"o_{c}") for c in ("row", "total", "root", "tiled")))
    least = similarity * (F.col("total") + F.col("o_total")) / (1 + similarity) - 1e-6
    met = few.join(other, "key").where((F.col("row") < F.col("o_row")) & (F.col("root") != F.col("o_root")) & (F.least("total", "o_total") >= least))
    # The text whose rarest elements end first has all else that the two share among its others.
    after = F.ceil(similarity * F.greatest("total", "o_total") - 1e-9) - 1
    pairs = met.groupBy(F.col("row").alias("a"), F.col("o_row").alias("b")).agg(F.count("*").alias("c"), F.first(F.least("tiled", "o_tiled")).alias("t"), F.first(after).alias("after"), F.first(least).alias("least")).where("c + t + after >= least").select("a", "b")
    load = F.sum(1 + F.floor(F.col("total") / LOAD)).over(held.orderBy("total", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = left.where(F.col("n") > PAIRED).withColumn("block", F.floor((load - 1) / TILE)).withColumn("last", F.max("block").over(held))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "root")
    counts = slot_counts(texts.join(blocks.select("row").distinct(), "row", "left_semi"))
    near = written(dealt.join(counts, "row").groupBy("key", "i", "j").applyInArrow(lambda t: tile_near(t, similarity), "a binary, b binary").distinct())
    tiles = families(near, blocks.select("row", "root", "total").distinct(), texts, similarity).groupBy("family", "i", "j").applyInArrow(lambda t: tile_links(t, similarity), "a binary, b binary")
    return pairs.unionByName(tiles).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """(doc, row, class_id, n_texts, first): each document's class, how many different texts it holds, and whether this is its first (id, text).

    exact: pairs that the bands leave untested are tested too; without it, they stay untested.
    """
    members, texts = distinct_texts(docs, doc_id, text)
    # Dealt out by row once: comparisons move pairs to the texts, and then only the texts that are compared.
    texts = bucketed(texts, "row")
    found = written(signed(texts, similarity))
    sigs, bands = bucketed(found.select("row", "scale", "sig"), "row", "scale"), found.select("row", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    held = written(bands.join(sizes, "band"))
    # A band is led by the text that meets the most others over all bands: an original before its variants.
    met = written(held.groupBy("row").agg(F.sum("size").alias("met")))
    ranked = held.join(met, "row").withColumn("rank", F.struct("met", "row"))
    lead = ranked.groupBy("band").agg(F.max("rank").alias("lead"))
    led = written(ranked.join(lead, "band").select("band", scale_of("band").alias("scale"), "size", "row", "lead"))
    label = met.select("row", F.col("row").alias("root"))
    pair = (F.least("lead", "row").alias("a"), F.greatest("lead", "row").alias("b"), "scale")
    best = led.groupBy("row").agg(F.max(F.struct("lead", "scale")).alias("best")).select("row", F.col("best.lead.row").alias("lead"), F.col("best.scale").alias("scale")).where("row != lead")
    tried = written(alike(best.select(*pair).distinct(), sigs, similarity))
    label = relabelled(label, written(similar(tried, texts, similarity)))
    left = open_bands(led.withColumn("lead", F.col("lead.row")), label)
    leads = label.select(F.col("row").alias("lead"), F.col("root").alias("lead_root"))
    star = left.join(leads, "lead").where("root != lead_root").select(*pair).distinct()
    fresh = written(alike(star, sigs, similarity).join(tried, ["a", "b"], "left_anti"))
    found = written(similar(fresh, texts, similarity))
    label = relabelled(label, found)
    if exact:
        label = written(texts.select("row").join(label, "row", "left").withColumn("root", F.coalesce("root", "row")))
        label = relabelled(label, written(similar(written(untested(texts, label, similarity)), texts, similarity)))
    # The class id is the smallest document id, so roots are renamed.
    roots = texts.select("row", "doc").join(label, "row", "left").withColumn("root", F.coalesce("root", "row"))
    names = roots.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("lead"), F.count("*").alias("n_texts"))
    by_row = roots.join(names, "root").select("row", F.col("lead.doc").alias("class_id"), "n_texts", (F.col("row") == F.col("lead.row")).alias("leads"))
    first = F.col("leads") & F.coalesce(F.col("doc") == F.col("class_id"), F.lit(False))
    return members.join(by_row, "row").select("doc", "row", "class_id", "n_texts", first.alias("first"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """One row per document: its class, the number of different texts there, and whether it is the one to keep."""
    found = classes(docs, doc_id, text, similarity, exact)
    return found.select(F.col("doc").alias(doc_id), "class_id", "n_texts", F.when(F.col("doc") == F.col("class_id"), F.col("first")).otherwise(F.col("doc") == F.col("class_id")).alias("keep"))


def one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """docs with one document of each class: the smallest id and, of its texts there, the one of the smallest digest; of equal rows, one. Rows without id stay."""
    id_key, row_key, one = (spare(docs.columns, c) for c in ("kept_id", "kept_row", "nth"))
    kept = classes(docs, doc_id, text, similarity, exact).where("first").select(F.col("doc").alias(id_key), F.col("row").alias(row_key)).distinct()
    digest = spare(docs.columns, "digest")
    first = docs.withColumn(digest, text_row(text)).join(kept, (named(doc_id) == F.col(id_key)) & (F.col(digest) == F.col(row_key)), "left_semi")
    order = Window.partitionBy(named(doc_id), F.col(digest)).orderBy(named(text))
    ranked = first.withColumn(one, F.row_number().over(order)).where(F.col(one) == 1).drop(one, digest)
    return ranked.unionByName(docs.where(named(doc_id).isNull()))
