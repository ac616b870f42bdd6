"""License detection by diagonal voting.

All rolling word k-grams of all documents are joined, by hash, to the positions at which
license templates hold the same k-gram; the gram's bytes are compared in the join, so a
hash collision casts no vote. Votes of a document and template are counted per diagonal
(document position minus template position); neighbouring diagonals, as inserted or
missing words make them, are merged into one span, and a span is accepted when it covers
enough of the template. The template table is fixed in size and is the broadcast side.

Defined results: a null text has no words; texts shorter than k words have no grams;
every row keeps its own result when ids repeat; an empty table gives no rows; input columns
named as the results are replaced, all others (maps too) are handed on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.common import map_texts, mix, named, spare, word_hashes, words_of

#: Phrases that count wherever they stand in full, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices that the method finds by votes, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("mozilla public license version 2 0", "mpl-2.0"),
)
K = 2
#: The hash that stands after the last gram of every text.
END = 0
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
#: Share of a notice's k-grams that a merged span must hold.
ACCEPT = 0.8
#: Diagonals that lie this close, in spans that lie as close, are merged.
DRIFT = 2
GRAMS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("norm", T.BinaryType()), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])


def gram_hashes(norm: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of words parted by single spaces: the hash of each k-gram and where its first word starts."""
    h, start, _ = word_hashes(norm)
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = mix(g + h[i : i + n])
    return g.view(np.int64), start[:n]


def gram_maker(k: int) -> Callable:
    def make():
        def work(texts: list[bytes]) -> list[pa.Array]:
            words = [words_of(t) for t in texts]
            norms = [b" ".join(w) + b" " for w in words]
            rows = [gram_hashes(n, k) for n in norms]
            rows = [(np.append(g, END), np.append(s, 0)) for g, s in rows]
            ends = pa.array(np.cumsum([0, *(len(g) for g, _ in rows)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), t)) for x, t in (([g for g, _ in rows], pa.int64()), ([s.astype(np.int32) for _, s in rows], pa.int32()))]
            return [pa.array([len(w) for w in words], pa.int64()), pa.array(norms, pa.binary()), *lists]

        return work

    return make


def templates(spark, notices, k: int) -> DataFrame:
    """(template, label, total, tpos, hash, gram): the k-grams of each notice, and the empty gram that ends every text."""
    rows = [(-1, "", 1, 0, END, b"")]
    for t, (notice, label) in enumerate(notices):
        w = words_of(notice.encode())
        g, _ = gram_hashes(b" ".join(w) + b" ", k)
        for i, h in enumerate(g.tolist()):
            rows.append((t, label, len(g), i, h, b" ".join(w[i : i + k]) + b" "))
    return spark.createDataFrame(rows, "template int, label string, total int, tpos int, hash long, gram binary")


def votes(docs: DataFrame, text: str, notices, k: int, keep: list[str]) -> DataFrame:
    """keep's columns, n_words, and template, label, total, pos, tpos for every vote; each text also votes once for template -1."""
    grams = map_texts(docs, text, GRAMS, gram_maker(k), keep)
    at = grams.select(*(named(c) for c in keep), "n_words", "norm", "starts", F.posexplode("grams").alias("pos", "hash"))
    own = F.broadcast(templates(docs.sparkSession, notices, k).withColumnRenamed("hash", "own_hash"))
    same = F.substring(F.col("norm"), F.element_at("starts", F.col("pos") + 1) + 1, F.octet_length("gram")) == F.col("gram")
    return at.join(own, (F.col("hash") == F.col("own_hash")) & same).select(*(named(c) for c in keep), "n_words", "template", "label", "total", "pos", "tpos")


def spans(hits: DataFrame, key: list[str], carry: list[str] | None = None, drift: int = DRIFT) -> DataFrame:
    """Votes per diagonal, then neighbouring diagonals merged: one row per key, template and span.

    A span goes on while the next diagonal is at most drift away and its first word at
    most drift + 1 after the last one. places: starts of diagonals with every vote. carry
    names columns that rows of one key agree in.
    """
    carried = [F.first(c).alias(c) for c in carry or ()]
    cols = [named(c) for c in key]
    diag = hits.groupBy(*cols, "n_words", "template", "label", "total", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_set("tpos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("votes"), *carried)
    by = Window.partitionBy(*cols, "template").orderBy("first", "diag")
    far = (F.col("first") - F.lag("last").over(by) > drift + 1) | (F.abs(F.col("diag") - F.lag("diag").over(by)) > drift)
    marked = diag.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(by))
    place = F.when(F.size("held") == F.col("total"), F.col("diag"))
    merged = marked.groupBy(*cols, "n_words", "template", "label", "total", "span").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.count(place).alias("places"), F.min(place).alias("first_place"), F.max(place).alias("last_place"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("votes").alias("votes"), *carried)
    return merged.withColumn("share", F.size("held") / F.col("total"))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: keep's columns, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    keep = docs.columns if keep is None else keep
    cols = [c for c in keep if c not in RESULT]
    # Rows count by a digest of their columns and text: a map among the columns can be no key.
    row = F.struct(*(named(c) for c in cols))
    digest = F.sha2(F.concat_ws("\n", F.to_json(row) if cols else F.lit(""), F.sha2(F.coalesce(named(text), F.lit("")), 256)), 256)
    packed = docs.select(row.alias("row"), digest.alias("digest"), named(text).alias("body")) if cols else docs.select(digest.alias("digest"), named(text).alias("body"))
    found = spans(votes(packed, "body", (*PHRASES, *NOTICES), K, ["row", "digest"] if cols else ["digest"]), ["digest"], ["row"] if cols else [])
    base, end = F.col("template").between(0, len(PHRASES) - 1), F.col("template") == -1
    phrase = base & (F.col("places") > 0)
    notice = (F.col("template") >= len(PHRASES)) & (F.col("share") >= ACCEPT)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = found.groupBy("digest", "n_words").agg(
        *([F.first("row").alias("row")] if cols else []),
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first_place"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last_place"))).cast("long").alias("last_word"),
        joined(phrase).alias("base_labels"),
        joined(phrase | notice).alias("labels"),
        F.round(F.coalesce(F.max(F.when(~end, F.col("share"))), F.lit(0.0)), 6).alias("score"),
        F.max(F.when(end, F.col("votes"))).alias("copies"),
    )
    # Rows that agree in everything were counted together; each gets its result.
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(["row.*"] if cols else []), *RESULT)
