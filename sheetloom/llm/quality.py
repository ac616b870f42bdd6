"""Quality classification from weak labels.

Overlapping heuristic labellers vote reject, keep or nothing on every document. Spark
counts how often each pattern of votes occurs over the whole table; from these counts
(at most 3^labellers rows) expectation-maximisation estimates each labeller's accuracy
and the posterior of every pattern. Posterior labels of a
bounded sample train a logistic scorer over hashed features (shapes of words, repeats),
which then scores every document. No gold label is used; they only measure the result.

Defined results: a null text counts as empty; a text without words is rejected with
score 0; rows keep their other columns; equal rows get equal results; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.common import ODD, STEP, map_texts, mix, named, spare, word_hashes

#: Labeller -> (measure, reject above, keep below); keep below 0 means that it never votes keep.
LABELLERS = (
    ("shouting", "upper", 0.4, -1.0),
    ("symbols", "marks", 0.15, -1.0),
    ("bars", "bars", 0.1, -1.0),
    ("clutter", "clutter", 0.4, -1.0),
    ("stutter", "again", 0.25, -1.0),
    ("monotony", "known", 0.75, -1.0),
    ("loops", "loops", 0.3, -1.0),
    ("line repeats", "lines", 0.3, -1.0),
    ("plain", "oddity", np.inf, 1.0),
    ("varied", "sameness", np.inf, 1.0),
)
#: Measures that a plain text keeps under these values, and a varied one.
PLAIN = {"upper": 0.1, "marks": 0.03, "bars": 0.02, "clutter": 0.2, "again": 0.1, "loops": 0.1, "lines": 0.2}
VARIED = {"known": 0.5, "clutter": 0.2, "upper": 0.3}
#: The accuracy that labellers are taken to have before any vote, and the votes that this counts for.
PRIOR, WORTH = 0.8, 10.0
MEASURES = ("upper", "marks", "bars", "clutter", "again", "known", "loops", "lines")
#: Buckets of hashed features, and documents that the scorer is trained on at most.
WIDTH, TRAIN_DOCS = 1 << 10, 8000
#: Upper case to A, lower case to a, digits to 0; white space stays; letters beyond ASCII vanish.
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else c for c in range(256))
BEYOND = bytes(range(128, 256))
SHOUTS = bytes(c if c == 10 else 0 for c in range(256))


def per_doc(flags: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=flags, minlength=n)


def seen_before(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a document held the same hash at an earlier place."""
    own = mix(hashes ^ (doc.astype(np.uint64) * np.uint64(ODD)))
    before = np.ones(len(own), bool)
    before[np.unique(own, return_index=True)[1]] = False
    return before


def measured(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each text; then the document, bucket and share of every hashed feature."""
    n = len(texts)
    flat = [t.replace(b"\x00", b" ") for t in texts]
    buf = b"\n".join(flat)
    ends = np.cumsum([len(t) + 1 for t in flat])
    h, start, end = word_hashes(buf)
    doc = np.searchsorted(ends, start, side="right")
    words = np.maximum(np.bincount(doc, minlength=n), 1).astype(float)
    b = np.frombuffer(buf, np.uint8)
    byte_doc = lambda at: np.searchsorted(ends, at, side="right")
    upper, lower = np.flatnonzero((b >= 65) & (b <= 90)), np.flatnonzero((b >= 97) & (b <= 122))
    ups, lows = (np.bincount(byte_doc(x), minlength=n) for x in (upper, lower))
    mark = np.isin(b, np.frombuffer(b"*%&$#!", np.uint8))
    pairs = np.flatnonzero(mark[1:] & mark[:-1] & ~np.r_[False, mark[:-2]]) if len(b) > 1 else np.zeros(0, np.int64)
    again = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, bool)
    known = seen_before(h, doc)
    five = np.zeros(max(0, len(h) - 4), np.uint64)
    for i in range(5):
        five = mix(five + h[i : i + len(five)])
    inside = doc[4:] == doc[: len(five)]
    loops = seen_before(five[inside], doc[: len(five)][inside])
    line_doc, line_hash = [], []
    for i, t in enumerate(flat):
        lines = [x for x in t.split(b"\n") if x.strip()]
        line_doc += [i] * len(lines)
        line_hash += map(hash, lines)
    line_doc = np.array(line_doc, np.int64)
    line_again = seen_before(np.array(line_hash, np.int64).view(np.uint64), line_doc)
    share = lambda flags, d, of: per_doc(flags, d, n) / np.maximum(of, 1)
    got = {
        "words": np.bincount(doc, minlength=n), "upper": ups / np.maximum(ups + lows, 1), "marks": np.bincount(byte_doc(pairs), minlength=n) / words,
        "bars": np.bincount(byte_doc(np.flatnonzero(b == 124)), minlength=n) / words, "again": share(again, doc, words), "known": share(known, doc, words),
        "loops": share(loops, doc[: len(five)][inside], np.bincount(doc[: len(five)][inside], minlength=n)), "lines": share(line_again, line_doc, np.bincount(line_doc, minlength=n)),
    }
    other = np.isin(b, np.frombuffer(b"*%&$#!|@^~=+<>{}[]_\\/", np.uint8))
    got["clutter"] = np.bincount(byte_doc(np.flatnonzero(other)), minlength=n) / words
    got["oddity"] = np.max([got[m] / most for m, most in PLAIN.items()], axis=0)
    got["sameness"] = np.max([got[m] / most for m, most in VARIED.items()], axis=0)
    # Features: the word's shape with runs collapsed, and whether it repeats.
    shape = np.frombuffer(buf.translate(SHAPE, BEYOND), np.uint8)
    fresh = np.r_[True, shape[1:] != shape[:-1]] | (shape == 10) if len(shape) else np.zeros(0, bool)
    s_hash, s_start, _ = word_hashes(shape[fresh].tobytes())
    origin = np.flatnonzero(b < 128)[np.flatnonzero(fresh)[s_start]] if len(s_start) else s_start
    f_doc = [byte_doc(origin), doc[again], doc[known]]
    f_hash = [s_hash, np.full(again.sum(), 1, np.uint64), np.full(known.sum(), 2, np.uint64)]
    for i, name in enumerate(MEASURES):
        step = np.minimum(got[name] * 10, 10).astype(np.uint64)
        f_doc.append(np.arange(n))
        f_hash.append(np.uint64(100 + 20 * i) + step)
    weights = [np.full(len(d), 1.0) / words[d] for d in f_doc[:3]] + [np.full(n, 0.5) for _ in MEASURES]
    f_doc, f_hash = np.concatenate(f_doc), np.concatenate(f_hash)
    return got, f_doc, (mix(f_hash * np.uint64(ODD)) % np.uint64(WIDTH)).astype(np.int64), np.concatenate(weights)


def votes_of(got: dict[str, np.ndarray]) -> list[str]:
    """One letter per labeller: r(eject), k(eep), or - for none; texts without words have no votes but rejects."""
    cols = [np.where(got[m] > hi, "r", np.where(got[m] < lo, "k", "-")) for _, m, hi, lo in LABELLERS]
    rows = ["".join(x) for x in zip(*cols, strict=True)]
    return ["r" * len(LABELLERS) if w == 0 else r for r, w in zip(rows, got["words"].tolist(), strict=True)]


@dataclass(frozen=True)
class LabelModel:
    """Each labeller's accuracy, and the probability that a document with a pattern of votes is good."""

    accuracy: dict[str, float]
    posterior: dict[str, float]


def fit_labels(counts: dict[str, int], rounds: int = 100) -> LabelModel:
    """EM over vote patterns: labellers err independently, say nothing when they abstain, and classes are balanced."""
    patterns = sorted(counts)
    if not patterns:
        return LabelModel({}, {})
    n = np.array([counts[p] for p in patterns], float)[:, None]
    keep, reject = (np.array([[v == c for v in p] for p in patterns], float) for c in "kr")
    right = np.full(len(LABELLERS), PRIOR)
    for _ in range(rounds):
        odds = np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip((keep - reject) @ odds, -50, 50)))[:, None]
        agreed = (n * (keep * post + reject * (1 - post))).sum(0)
        right = np.clip((agreed + WORTH * PRIOR) / ((n * (keep + reject)).sum(0) + WORTH), 0.01, 0.999)
    return LabelModel({x[0]: float(a) for x, a in zip(LABELLERS, right, strict=True)}, dict(zip(patterns, post[:, 0].tolist(), strict=True)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full gradient steps, both classes with equal weight; the last value is the intercept."""
    w, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    if not len(y):
        return w
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))
        e = (p - y) * weight / weight.sum()
        g = np.append(x.T @ e, e.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate / 20 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


VOTES = T.StructType([T.StructField("votes", T.StringType())])
SAMPLE = T.StructType([T.StructField("votes", T.StringType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])
SCORED = T.StructType([T.StructField("votes", T.StringType()), T.StructField("weak", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def voter():
    return lambda texts: [pa.array(votes_of(measured(texts)[0]), pa.string())]


def sampler():
    def work(texts: list[bytes]) -> list[pa.Array]:
        got, doc, bucket, share = measured(texts)
        dense = np.bincount(doc * WIDTH + bucket, weights=share, minlength=len(texts) * WIDTH).reshape(-1, WIDTH)
        rows = [np.flatnonzero(r) for r in dense]
        return [pa.array(votes_of(got), pa.string()), pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), pa.array([d[r].tolist() for d, r in zip(dense, rows, strict=True)], pa.list_(pa.float64()))]

    return work


def fit(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> tuple[LabelModel, np.ndarray]:
    """The label model over all documents, and the scorer's weights from a sample of about train_docs of them.

    The sample holds the distinct texts whose hash falls under a bound set from the number
    of documents; at most twice train_docs rows, by hash, reach the driver.
    """
    voted = map_texts(docs, text, VOTES, voter, [], STEP)
    counts = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_labels(counts)
    total = max(sum(counts.values()), 1)
    bound = int(min(1.0, train_docs / total) * (1 << 30))
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    some = docs.select(body.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < bound).distinct().orderBy(F.xxhash64("text"), "text").limit(2 * train_docs)
    rows = sorted(map(tuple, map_texts(some, "text", SAMPLE, sampler, [], STEP).collect()))
    x, y = np.zeros((len(rows), WIDTH)), np.zeros(len(rows))
    for i, (votes, buckets, shares) in enumerate(rows):
        x[i, buckets] = shares
        y[i] = model.posterior.get(votes, 0.5)
    return model, fit_scorer(x, y)


def scorer(fitted, threshold: float):
    def make():
        posterior, w = fitted.value

        def work(texts: list[bytes]) -> list[pa.Array]:
            got, doc, bucket, share = measured(texts)
            logit = np.bincount(doc, weights=w[bucket] * share, minlength=len(texts)) + w[-1]
            score = np.where(got["words"] > 0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0.0).round(6)
            votes = votes_of(got)
            return [pa.array(votes, pa.string()), pa.array([round(posterior.get(v, 0.5), 6) for v in votes], pa.float64()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_())]

        return work

    return make


def classify(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """keep's columns with votes, weak (the posterior of the votes), score and keep (score >= threshold)."""
    model, w = fit(docs, text, train_docs)
    fitted = docs.sparkSession.sparkContext.broadcast((model.posterior, w))
    return map_texts(docs, text, SCORED, scorer(fitted, threshold), keep, STEP)


def good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the classifier keeps, with exactly their own columns."""
    row, body = spare([], "row"), named(text)
    packed = docs.select(F.struct(*(named(c) for c in docs.columns)).alias(row), body.alias("body"))
    return classify(packed, "body", [row]).where("keep").select(f"{row}.*")
