"""Exact substring deduplication with a distributed sparse suffix array, sorted deep-shallow.

A string of SPAN bytes is assigned to the smallest hash among its K-byte grams, so equal
strings, wherever they stand, have one key; maximal runs of neighbouring strings with one
key form a piece of text of about 60 bytes. First only keys travel: a key that a single
document holds cannot repeat, and its text never moves. Then the pieces with shared keys
are dealt out by key, and each bucket sorts its pieces deep-shallow: multikey quicksort
by eight-byte characters to a shallow depth, then blind tries for the groups that still
agree. Where pieces of one key differ, the SPAN-byte strings in them are sorted in the
same way. Every decision compares bytes; hashes only bring candidates together.

Hot passages: within a chunk of documents a shared key is sent once, as is a piece that
occurs in several documents; the rest is settled where it is. Exact copies of texts are
one text from the start: copies of at least SPAN bytes go entirely, the smallest id stays.

Defined results: a null text counts as empty; a null id ranks last; equal rows get equal
results and remove nothing from each other; rows with one id and different texts do not
remove from each other; an empty table gives no rows; further columns are not read. Ids are
integers: another type is refused with a TypeError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.common import ANSWER, CHUNK, LAST, ODD, OUT, ROW, answers, blobs, by_bucket, cuts, distinct_texts, edges, integer_id, mix, named, pack_arrays, settled, text_bytes, unpack_arrays

SPAN, K = 50, 24
#: Strings that one piece holds at most, and the depth in bytes at which blind tries take over.
MOST, SHALLOW, PAD = 64, 32, 64
#: Bytes of text whose keys, and whose pieces, share a bucket; strings that are sorted at a time.
KEY_BYTES, PIECE_BYTES, SORTED = 32 << 20, 8 << 20, 200_000


# --- keys and pieces --------------------------------------------------------------


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, start in the text, number of strings) of each piece, in text order."""
    none = np.zeros(0, np.int64)
    buf = b"".join(texts)
    n = len(buf) - SPAN + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    loads = np.ndarray((len(buf) + 8,), dtype="<u8", buffer=buf + bytes(16), strides=(1,))
    grams = len(buf) - K + 1
    h = loads[:grams] * np.uint64(ODD)
    h ^= h >> np.uint64(32)
    for i in range(8, K, 8):
        h += loads[i : i + grams]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    low, width, want = h, 1, SPAN - K + 1
    while width < want:
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    begin = end - size
    edge = np.r_[True, low[1:] != low[:-1]]
    edge[begin[(size > 0) & (begin < n)]] = True
    start = np.flatnonzero(edge)
    stop = np.r_[start[1:], n]
    doc = np.searchsorted(end, start, side="right")
    count = np.minimum(stop, end[doc] - SPAN + 1) - start
    ok = count > 0
    start, doc, count = start[ok], doc[ok], count[ok]
    key = mix(low[start])
    if (count > MOST).any():
        many = -(-count // MOST)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, doc, key, left = np.repeat(start, many) + nth * MOST, np.repeat(doc, many), np.repeat(key, many), np.repeat(count, many) - nth * MOST
        count = np.minimum(left, MOST)
    return key, doc, start - begin[doc], count


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def chunks(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple[int, int, list[bytes]]]:
    col = batch.column("text").cast(pa.binary())
    sizes, at = np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    for end in cuts(sizes, chunk):
        yield at, end, col.slice(at, end - at).to_pylist()
        at = end


def steps(key: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences, in 32 bits where they fit."""
    d = np.diff(key, prepend=np.uint64(0))
    return np.r_[key[:1] >> np.uint64(32), key[:1] & np.uint64(0xFFFFFFFF), d[1:]].astype("<u4") if (d[1:] < 2**32).all() else d


def from_steps(d: np.ndarray) -> np.ndarray:
    if d.dtype.itemsize == 8:
        return np.cumsum(d)
    d = d.astype(np.uint64)
    return np.cumsum(np.r_[(d[0] << np.uint64(32)) | d[1], d[2:]])


def send_keys(buckets: int, bits: int):
    """Keys of all pieces, cut to bits, by bucket. What a chunk settles itself goes along as an answer.

    Cut keys may agree by chance: some text travels in vain, nothing is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in chunks(batch, CHUNK // 2):
                rows, rank = batch.column("row").slice(at, end - at).to_pylist(), batch.column("doc").slice(at, end - at).to_numpy()
                key, own, _, _ = pieces(texts)
                key >>= np.uint64(64 - bits)
                nth = np.arange(len(own)) - np.searchsorted(own, own, side="left")
                order = np.lexsort((rank[own], key))
                key, own, nth = key[order], own[order], nth[order]
                e = edges(key)
                group = np.repeat(np.arange(len(e) - 1), np.diff(e))
                shared = (rank[own[e[:-1]]] != rank[own[e[1:] - 1]])[group] if len(key) else np.zeros(0, bool)
                out = [(int.from_bytes(r[:4], "little") % buckets, pack_arrays(b"known", r, d)) for r, d in settled(rows, own[shared], nth[shared])]
                # Of a key that is shared here, one piece stands for all.
                lead = np.zeros(len(key), bool)
                lead[e[:-1]] = True
                sent = ~shared | lead
                key, own, nth = key[sent], own[sent], nth[sent]
                e = edges(b := bucket_of(key << np.uint64(64 - bits), buckets))
                for lo, hi in zip(e[:-1].tolist(), e[1:].tolist(), strict=True):
                    used, place = np.unique(own[lo:hi], return_inverse=True)
                    out.append((int(b[lo]), pack_arrays(b"keys", steps(key[lo:hi]), b"".join(rows[i] for i in used), rank[used], place.astype("<u4"), nth[lo:hi].astype("<u4"))))
                yield blobs(out)

    return run


def gathered(parts: list[list]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Rows and ranks of several blobs one after another, and how far each blob's text numbers move up."""
    raw = b"".join(p[2] for p in parts)
    return [raw[i : i + ROW] for i in range(0, len(raw), ROW)], np.concatenate([p[3] for p in parts]), np.cumsum([0, *(len(p[3]) for p in parts)])


def shared_keys(data: list[bytes]) -> pa.RecordBatch | None:
    """Of one bucket: for each text, the numbers of its pieces whose key another document holds too."""
    parts = [unpack_arrays(d) for d in data]
    out = [(p[1], p[2]) for p in parts if p[0] == b"known"]
    if parts := [p for p in parts if p[0] == b"keys"]:
        rows, rank, base = gathered(parts)
        key, nth = np.concatenate([from_steps(p[1]) for p in parts]), np.concatenate([p[5] for p in parts])
        own = np.concatenate([p[4].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
        order = np.lexsort((rank[own], key))
        key, own, nth = key[order], own[order], nth[order]
        e = edges(key)
        shared = np.repeat(rank[own[e[:-1]]] != rank[own[e[1:] - 1]], np.diff(e)) if len(key) else np.zeros(0, bool)
        out += settled(rows, own[shared], nth[shared])
    return answers(out)


def send_pieces(buckets: int):
    """The pieces with shared keys, by bucket; a piece that repeats in the chunk is sent for its smallest id only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in chunks(batch, CHUNK // 2):
                rows, rank = batch.column("row").slice(at, end - at).to_pylist(), batch.column("doc").slice(at, end - at).to_numpy()
                key, own, start, count = pieces(texts)
                first = np.searchsorted(own, np.arange(len(texts)))
                which = [np.zeros(0, np.int64)]
                for i, lists in enumerate(batch.column("found").slice(at, end - at).to_pylist()):
                    which.append(first[i] + np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in lists])).astype(np.int64))
                w = np.concatenate(which)
                key, own, start, count = key[w], own[w], start[w], count[w]
                mine = rank[own]
                text = [texts[o][s : s + c + SPAN - 1] for o, s, c in zip(own.tolist(), start.tolist(), count.tolist(), strict=True)]
                least: dict[bytes, int] = {}
                for t, r in zip(text, mine.tolist(), strict=True):
                    if r < least.get(t, LAST + 1):
                        least[t] = r
                later = mine > np.fromiter((least[t] for t in text), np.int64, len(text))
                out = [(int.from_bytes(r[:4], "little") % buckets, pack_arrays(b"known", r, d)) for r, d in settled(rows, own[later], start[later], count[later])]
                left = np.flatnonzero(~later)
                left = left[np.argsort(key[left], kind="stable")]
                e = edges(b := bucket_of(key[left], buckets))
                for lo, hi in zip(e[:-1].tolist(), e[1:].tolist(), strict=True):
                    g = left[lo:hi]
                    used, place = np.unique(own[g], return_inverse=True)
                    out.append((int(b[lo]), pack_arrays(b"text", key[g], b"".join(rows[i] for i in used), rank[used], place.astype("<u4"), start[g].astype("<u4"), count[g].astype("<u4"), b"".join(text[i] for i in g.tolist()))))
                yield blobs(out)

    return run


# --- sorting ----------------------------------------------------------------------


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Classes of equal strings (of one length), in order. Inner nodes hold only the depth at which their strings part."""
    root: list = [None, strings[0], [0]]  # a leaf: None, string, members; an inner node: depth, children by byte
    for i, s in enumerate(strings[1:], 1):
        node = root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if (t := node[1]) == s:
            node[2].append(i)
            continue
        lo, hi = 0, len(s)  # the first byte that differs lies in [lo, hi)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if s[:mid] == t[:mid] else (lo, mid)
        above, node = None, root
        while node[0] is not None and node[0] < lo:
            above, node = node, node[1][s[node[0]]]
        leaf = [None, s, [i]]
        if node[0] == lo:
            node[1][s[lo]] = leaf
        else:
            fork = [lo, {t[lo]: node, s[lo]: leaf}]
            if above is None:
                root = fork
            else:
                above[1][s[above[0]]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.append(node[2])
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def multikey_quicksort(load, size: np.ndarray, active: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sorts the strings of each place by their characters (eight bytes each) down to the shallow depth.

    Every round parts all open groups in three by a median of three characters: less,
    equal, greater. The middle part goes on with its next character. Places are set;
    what comes back are the strings, group after group, that agree down to the depth
    and are longer than that.
    """
    deep, depth = [active[:0]], np.zeros(len(active), np.int64)
    while len(active):
        e = edges(place[active])
        many = np.diff(e)
        group = np.repeat(np.arange(len(many)), many)
        word = load(active, depth)
        first, mid, last = word[e[:-1]], word[e[:-1] + many // 2], word[e[1:] - 1]
        pivot = np.maximum(np.minimum(first, mid), np.minimum(np.maximum(first, mid), last))[group]
        third = (word >= pivot).astype(np.int64) + (word > pivot)
        # Where each string goes: its group's start, the smaller thirds, and those of its own third before it.
        goes, start = np.empty(len(active), np.int64), e[:-1].copy()
        for t in range(3):
            own = third == t
            seen = np.r_[0, np.cumsum(own)]
            goes[own] = (start[group] + seen[:-1] - seen[e[:-1]][group])[own]
            start += seen[e[1:]] - seen[e[:-1]]
        moved, part, down = np.empty_like(active), np.empty_like(goes), np.empty_like(depth)
        moved[goes], part[goes], down[goes] = active, 3 * group + third, depth + 8 * (third == 1)
        cut = edges(part)
        place[moved] += np.repeat(cut[:-1], np.diff(cut)) - e[:-1][group]
        left = np.repeat(np.diff(cut) > 1, np.diff(cut)) & (down < size[moved])
        deep.append(moved[left & (down >= SHALLOW)])
        left &= down < SHALLOW
        active, depth = moved[left], down[left]
    return np.concatenate(deep)


def deep_shallow(buf: bytes, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of strings in the order of (group, string); equal strings share a place.

    Strings of one group have one size; buf ends with PAD spare bytes.
    """
    words = np.ndarray((len(buf) - 8,), dtype=">u8", buffer=buf, strides=(1,))

    def load(who: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        spare = np.clip(8 - (size[who] - depth), 0, 7).astype(np.uint64) * np.uint64(8)
        return (words[at[who] + depth].astype(np.uint64) >> spare) << spare

    place = np.empty(len(at), np.int64)
    order = np.argsort(group, kind="stable")
    e = edges(group[order])
    place[order] = np.repeat(e[:-1], np.diff(e))
    active = multikey_quicksort(load, size, order[np.repeat(np.diff(e) > 1, np.diff(e))], place)
    if not len(active):
        return place
    # Deep part. Groups whose members all agree need no order; blind tries order the others.
    e = edges(place[active])
    lead = np.repeat(active[e[:-1]], np.diff(e))
    same = np.ones(len(active), bool)
    for depth in range(SHALLOW, int(size[active].max()), 8):
        on = np.flatnonzero(size[active] > depth)
        same[on] &= load(active[on], depth) == load(lead[on], depth)
    for g in np.flatnonzero(~np.logical_and.reduceat(same, e[:-1])).tolist():
        who = active[e[g] : e[g + 1]]
        first, seen = place[who[0]], 0
        for members in blind_trie([buf[a + SHALLOW : a + s] for a, s in zip(at[who].tolist(), size[who].tolist(), strict=True)]):
            place[who[members]] = first + seen
            seen += len(members)
    return place


def repeats(data: list[bytes]) -> pa.RecordBatch | None:
    """Of one bucket: for each text, (start, number) of the strings that a document with a smaller id holds too."""
    parts = [unpack_arrays(d) for d in data]
    out = [(p[1], p[2]) for p in parts if p[0] == b"known"]
    parts = [p for p in parts if p[0] == b"text"]
    if not parts:
        return answers(out)
    rows, rank_of, base = gathered(parts)
    key, start, count = (np.concatenate([p[i] for p in parts]) for i in (1, 5, 6))
    own = np.concatenate([p[4].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
    buf = b"".join([*(p[7] for p in parts), bytes(PAD)])
    del parts, data
    start, count, rank = start.astype(np.int64), count.astype(np.int64), rank_of[own]
    size = count + SPAN - 1
    at = np.cumsum(size) - size
    # Equal pieces form classes; the smallest id of a class keeps the piece.
    kinds = np.unique(mix(key) ^ count.astype(np.uint64), return_inverse=True)[1]
    place = deep_shallow(buf, at, size, kinds)
    order = np.lexsort((rank, place))
    e = edges(place[order])
    least = np.repeat(rank[order[e[:-1]]], np.diff(e))
    gone = order[rank[order] > least]
    out += settled(rows, own[gone], start[gone], count[gone])
    # Classes that share a key but differ are compared string by string, one member for each.
    lead = order[e[:-1]]
    lead = lead[np.argsort(key[lead], kind="stable")]
    k = edges(key[lead])
    differ = np.flatnonzero(np.diff(k) > 1)
    todo, strings = [], 0
    for g in differ.tolist():
        todo.append(lead[k[g] : k[g + 1]])
        strings += int(count[todo[-1]].sum())
        if strings >= SORTED:
            out += by_string(buf, todo, key, at, start, count, rank, place, own, rows)
            todo, strings = [], 0
    if todo:
        out += by_string(buf, todo, key, at, start, count, rank, place, own, rows)
    return answers(out)


def by_string(buf, todo, key, at, start, count, rank, place, own, rows) -> Iterator[tuple[bytes, bytes]]:
    """Repeated strings within pieces that share a key."""
    lead = np.concatenate(todo)
    many = count[lead]
    who = np.repeat(np.arange(len(lead)), many)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    group = np.unique(key[lead], return_inverse=True)[1][who]
    spot = deep_shallow(buf, at[lead][who] + nth, np.full(len(who), SPAN), group)
    mine = rank[lead][who]
    order = np.lexsort((mine, spot))
    e = edges(spot[order])
    gone = np.zeros(len(who), bool)
    gone[order] = mine[order] > np.repeat(mine[order[e[:-1]]], np.diff(e))
    hit = np.flatnonzero(gone)
    if not len(hit):
        return
    # Neighbouring strings of a piece make one answer, for each place where the document holds the piece.
    new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (who[hit[1:]] != who[hit[:-1]])]
    head, length = hit[new], np.diff(np.r_[np.flatnonzero(new), len(hit)])
    piece = lead[who[head]]
    twins = np.flatnonzero(np.isin(place, place[piece]))
    twins = twins[np.argsort(place[twins], kind="stable")]
    lo, hi = np.searchsorted(place[twins], place[piece], "left"), np.searchsorted(place[twins], place[piece], "right")
    which = np.repeat(np.arange(len(piece)), hi - lo)
    twin = twins[np.repeat(lo, hi - lo) + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    ok = rank[twin] == rank[piece[which]]
    which, twin = which[ok], twin[ok]
    yield from settled(rows, own[twin], start[twin] + nth[head[which]], length[which])


# --- the whole job ------------------------------------------------------------------


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes what was found and reports on the rest."""
    for batch in batches:
        out = []
        for text, lists in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist(), strict=True):
            spans = [np.frombuffer(x, "<u4").reshape(2, -1).astype(np.int64) for x in lists or ()]
            kept, removed, n = text, 0, 0
            if spans:
                lo, hi = np.concatenate([s[0] for s in spans]), np.concatenate([s[0] + s[1] + SPAN - 1 for s in spans])
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.r_[True, lo[1:] > hi[:-1]]
                lo, hi = lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]
                kept = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
                removed, n = int((hi - lo).sum()), len(lo)
            out.append((len(text), removed, n, kept))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.binary())], names=["row", "doc", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_texts(texts: DataFrame, total: int) -> DataFrame:
    """(row, doc, n_bytes, n_removed, n_spans, kept bytes) of each distinct text."""
    keys = texts.select("row", "doc", "text").mapInArrow(send_keys(max(12, -(-total // KEY_BYTES)), min(64, total.bit_length() + 14)), OUT)
    shared = by_bucket(keys, shared_keys, ANSWER).groupBy("row").agg(F.collect_list("found").alias("found"))
    held = texts.join(shared, "row").select("row", "doc", "text", "found")
    found = by_bucket(held.mapInArrow(send_pieces(max(24, -(-total // PIECE_BYTES))), OUT), repeats, ANSWER).groupBy("row").agg(F.collect_list("found").alias("found"))
    return texts.join(found, "row", "left").select("row", "doc", "text", "found").mapInArrow(cut, "row binary, doc long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and kept_sha256."""
    members, texts = distinct_texts(docs.select(integer_id(docs, doc_id).alias(doc_id), named(text)), doc_id, text)
    texts = texts.withColumn("doc", F.coalesce("doc", F.lit(LAST)))
    done = dedup_texts(texts, text_bytes(docs, text)).select("row", F.col("doc").alias("least"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    both = members.join(done, "row")
    copy = (F.coalesce("doc", F.lit(LAST)) > F.col("least")) & (F.col("n_bytes") >= SPAN)
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(F.col("doc").alias(doc_id), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
