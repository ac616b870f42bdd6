"""Substring deduplication by line and sentence hashing.

Texts are cut into lines, and lines into sentences, and these are normalised (words only,
in lower case). A unit is a run of sentences, over line ends too, with enough words or
bytes and no more sentences than that takes, or a line or paragraph that is a little shorter; units are hashed. Globally, the occurrence with the
smallest (document id, offset) keeps its text, and every later one is removed; all spans
refer to the original text. Digests travel packed by bucket: a task sends each digest
once per chunk of documents, with its earliest occurrence there, so a line that is in a
third of all documents adds one entry per chunk, not one per document.

Defined results: a null text counts as empty; equal rows (same id and text) get equal
results and do not remove from each other; what is part of no repeated unit is never
removed (lone short sentences and lines); a null id ranks last; an empty table gives no rows;
further columns are not read. Ids are integers: another type is refused with a TypeError. Each word that is removed stands in an earlier place too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.common import ANSWER, CHUNK, LAST, OUT, TO_WORDS, answers, blobs, by_bucket, cuts, edges, integer_id, named, pack_arrays, settled, text_bytes, unpack_arrays

#: Least words of a line or paragraph, and of a run of sentences, that is compared; as many bytes of normal form are enough too, as some scripts have no spaces.
LINE_WORDS, SENTENCE_WORDS = 5, 8
LINE_BYTES, SENTENCE_BYTES = 6 * LINE_WORDS, 6 * SENTENCE_WORDS
#: A sentence ends after these marks, where white space follows; full-width marks need none.
SENTENCE = re.compile(rb"[.!?]+\s+|(?:\xe3\x80\x82|\xef\xbc[\x81\x8e\x9f]|\xef\xbd\xa1)+\s*")
#: Marks and spaces beyond ASCII: general, CJK and full-width punctuation, in UTF-8.
MARKS = re.compile(rb"\xc2[\xa0\xa1\xab\xb7\xbb\xbf]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]|\xe3\x80[\x80-\x83\x88-\x91\x94-\x9f]|\xe3\x83\xbb|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
#: Bytes of text whose units share a bucket.
BUCKET_BYTES = 16 << 20
RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())])


def sentences_of(text: bytes) -> tuple[list[tuple[int, int, bytes]], list[int], list[int]]:
    """(start, end, normal form) of the sentences with words; where each line and each paragraph (lines without a blank one between) begins among them."""
    found, lines, paragraphs = [], [], []
    at, blank = 0, True
    for line in text.split(b"\n"):
        lo, n, plain = 0, len(found), line.isascii()
        for hi in [*(m.end() for m in SENTENCE.finditer(line)), len(line)]:
            part = line[lo:hi]
            if words := (part if plain else MARKS.sub(b" ", part)).translate(TO_WORDS).split():
                found.append((at + lo, at + hi, b" ".join(words)))
            lo = hi
        if len(found) > n:
            lines.append(n)
            if blank:
                paragraphs.append(n)
        blank = not line.strip()
        at += len(line) + 1
    return found, lines, paragraphs


def units_of(text: bytes) -> tuple[list[tuple[int, int]], list[bytes]]:
    """Byte spans of the compared units, with 16-byte digests of their normal forms (one kind of digest for all).

    From each sentence on, and up to each sentence, the shortest run with enough words or
    bytes is a unit: so these cover every longer run, whatever stands around it. Lines and
    paragraphs that are shorter than that are units if they have enough for a line.
    """
    found, lines, paragraphs = sentences_of(text)
    n = len(found)
    words, size = [0], [0]
    for _, _, norm in found:
        words.append(words[-1] + norm.count(b" ") + 1)
        size.append(size[-1] + len(norm) + 1)
    enough = lambda i, j, w, b: words[j] - words[i] >= w or size[j] - size[i] > b
    runs, i = set(), 0
    for j in range(1, n + 1):
        while enough(i, j, SENTENCE_WORDS, SENTENCE_BYTES):
            runs.add((i, j))  # the shortest from i on
            i += 1
        if i:
            runs.add((i - 1, j))  # the shortest up to j
    for starts in (lines, paragraphs):
        for i, j in zip(starts, [*starts, n][1:], strict=True):
            if enough(i, j, LINE_WORDS, LINE_BYTES) and not enough(i, j, SENTENCE_WORDS, SENTENCE_BYTES):
                runs.add((i, j))
    spans, digests = [], []
    for i, j in sorted(runs):
        spans.append((found[i][0], found[j - 1][1]))
        digests.append(xxhash.xxh3_128_digest(found[i][2] if j == i + 1 else b" ".join(f[2] for f in found[i:j])))
    return spans, digests


def row_key(doc: int, text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text, seed=doc & 0xFFFFFFFFFFFFFFFF)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_units, n_removed, removed spans, kept text) of every document."""
    buckets = max(12, -(-text_bytes(docs, text) // BUCKET_BYTES))
    rank = F.coalesce(integer_id(docs, doc_id), F.lit(LAST))
    src = docs.select(rank.alias("doc"), F.coalesce(named(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            for end in cuts(sizes, CHUNK):
                yield packed(ids[at:end], texts.slice(at, end - at).to_pylist())
                at = end

    def packed(ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        keys, dig, doc, pos, unit = [], [], [], [], []
        for i, t in enumerate(texts):
            keys.append(row_key(int(ids[i]), t))
            spans, digests = units_of(t)
            dig += digests
            doc += [i] * len(spans)
            pos += [s for s, _ in spans]
            unit += range(len(spans))
        d = np.frombuffer(b"".join(dig), "<u8").reshape(-1, 2)
        doc, pos, unit = np.array(doc, np.int64), np.array(pos, np.int64), np.array(unit, np.int64)
        rank = ids[doc] if len(doc) else np.zeros(0, np.int64)
        order = np.lexsort((pos, rank, d[:, 1], d[:, 0]))
        d, doc, pos, unit, rank = d[order], doc[order], pos[order], unit[order], rank[order]
        first = np.r_[True, (d[1:] != d[:-1]).any(axis=1)] if len(d) else np.zeros(0, bool)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        # What an earlier occurrence in the chunk removes is settled here; only the earliest ones travel on.
        gone = (rank != rank[lead]) | (pos != pos[lead])
        out = [(int.from_bytes(r[:4], "little") % buckets, pack_arrays(b"known", r, u)) for r, u in settled(keys, doc[gone], unit[gone])]
        d, doc, pos, unit = d[~gone], doc[~gone], pos[~gone], unit[~gone]
        e = edges(b := (((d[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64))
        for lo, hi in zip(e[:-1].tolist(), e[1:].tolist(), strict=True):
            used, own = np.unique(doc[lo:hi], return_inverse=True)
            out.append((int(b[lo]), pack_arrays(b"units", d[lo:hi].ravel(), b"".join(keys[i] for i in used), ids[used], own.astype("<u4"), pos[lo:hi].astype("<u4"), unit[lo:hi].astype("<u4"))))
        return blobs(out)

    rows = src.mapInArrow(emit, OUT)
    hits = by_bucket(rows, later, ANSWER).groupBy("row").agg(F.collect_list("found").alias("units"))
    return keep(src, hits, doc_id, named(doc_id))


def later(data: list[bytes]) -> pa.RecordBatch | None:
    """Of one bucket: the units that are not the earliest with their digest, by document row."""
    parts = [unpack_arrays(x) for x in data]
    out = [(p[1], p[2]) for p in parts if p[0] == b"known"]
    if parts := [p for p in parts if p[0] == b"units"]:
        raw = b"".join(p[2] for p in parts)
        keys, ids, base = [raw[i : i + 16] for i in range(0, len(raw), 16)], np.concatenate([p[3] for p in parts]), np.cumsum([0, *(len(p[3]) for p in parts)])
        d = np.concatenate([p[1] for p in parts]).reshape(-1, 2)
        own = np.concatenate([p[4].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
        pos, unit = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (5, 6))
        order = np.lexsort((pos, ids[own], d[:, 1], d[:, 0]))
        d, own, pos, unit = d[order], own[order], pos[order], unit[order]
        first = np.r_[True, (d[1:] != d[:-1]).any(axis=1)] if len(d) else np.zeros(0, bool)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        gone = (ids[own] != ids[own[lead]]) | (pos != pos[lead])
        out += settled(keys, own[gone], unit[gone])
    return answers(out)


def keep(src: DataFrame, hits: DataFrame, name: str, _id) -> DataFrame:
    """Joins the removals to the texts and cuts them out."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [row_key(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *b.columns], names=["row", "doc", "text"])

    schema = T.StructType([T.StructField(name, T.LongType()), *RESULT.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, lists in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("units").to_pylist(), strict=True):
                spans, _ = units_of(t)
                gone = sorted({int(u) for x in lists or () for u in np.frombuffer(x, "<u4")})
                merged: list[list[int]] = []
                for lo, hi in sorted(spans[u] for u in gone):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(t[at:lo])
                    at = hi
                kept.append(t[at:])
                out.append((None if doc == LAST else doc, len(t), len(spans), sum(h - a for a, h in merged), [{"start": a, "end": h} for a, h in merged], b"".join(kept).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()))], names=schema.names)

    texts = src.mapInArrow(keyed, "row binary, doc long, text binary")
    return texts.join(hits, "row", "left").select("doc", "text", "units").mapInArrow(cut, schema)


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: counts, the removed spans as start:end in bytes of the original, and the digest of what is left."""
    line = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(named(doc_id), "n_bytes", "n_units", F.size("removed").cast("long").alias("n_spans"), "n_removed", line.alias("spans"), F.sha2("kept", 256).alias("kept_sha256"))
