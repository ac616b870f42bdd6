"""Periodic runs of words: stretches in which the same q words come again and again.

A run is a stretch of at least max(LEAST, TIMES * q) consecutive words with smallest period q
that can't be extended. Every word of a run occurs TIMES times in it or more, so a word that
occurs less often within a segment is in no run of that segment, and splits it. The pieces
are judged anew by their own counts, until none is split; what survives is scanned by lags.

The scan looks at each length k = 1, 2, 4, ...: how far on the k words from a place come again
next. In a run of period q, k/2 < q <= k, that is q for as many places as the run has words
beyond q + k - 1, and for no place beside them (a nearer one would give the run a smaller
period). So stretches of equal lags are the runs themselves, with their exact ends, and all
lags up to a quarter of a segment are scanned in n log n steps. Many texts are split and
scanned at once; each is a segment of its own at the start.

Defined results: a null text has no words and no runs; very long texts are a step of their
own; repeated rows are judged each; input columns that share a name with a made one are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetloom.llm.common import map_texts

#: A run has at least so many words, and its period at least so many times.
LEAST, TIMES = 6, 4
#: Rounds of splitting at most; segments that would go on are scanned as they are, which gives the same runs.
ROUNDS = 64
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
DIGESTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")])


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as numbers, one after another, and the texts' ends."""
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for words in texts for w in words]
    return np.array(ids, np.int64), np.cumsum([len(words) for words in texts], dtype=np.int64)


def segments(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, segment of each place) that survive the splitting. Words of different owners are never in one segment."""
    at, seg = np.arange(len(ids)), owner
    done: list[tuple[np.ndarray, np.ndarray]] = []
    base = 0
    for _ in range(ROUNDS):
        # How often a word occurs within its segment.
        _, which, counts = np.unique(seg * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
        frequent = counts[which.ravel()] >= TIMES
        split = np.zeros(int(seg.max(initial=-1)) + 1, bool)
        split[seg[~frequent]] = True
        # Segments without a rare word are stable.
        stable = ~split[seg]
        done.append((at[stable], seg[stable] + base))
        base += len(split)
        more = frequent & ~stable
        at, old = at[more], seg[more]
        if not len(at):
            break
        seg = np.cumsum((np.diff(at, prepend=at[0] - 1) != 1) | (np.diff(old, prepend=old[0]) != 0))
        long = np.bincount(seg)[seg] >= LEAST
        at, seg = at[long], seg[long]
        if not len(at):
            break
    else:
        done.append((at, seg + base))
    at, seg = (np.concatenate([d[i] for d in done]) for i in (0, 1))
    order = np.argsort(at, kind="stable")
    at, seg = at[order], seg[order]
    return at, np.cumsum(np.diff(seg, prepend=seg[:1]) != 0)


def ranked(*cols: np.ndarray) -> np.ndarray:
    """Equal rows get equal numbers."""
    order = np.lexsort(cols)
    new = np.zeros(len(order), bool)
    for c in cols:
        new[1:] |= np.diff(c[order]) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def scan(ids: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs; starts are places in ids. Segments follow each other."""
    n = len(ids)
    ends = np.searchsorted(seg, seg, "right") if n else seg
    left = ends - np.arange(n)
    gram, k, found = ranked(ids, seg), 1, []
    at = np.arange(n)
    while len(at):
        # Distance to the next place with the same k words, within the segment; 0: none.
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][same]] = (at[order][1:] - at[order][:-1])[same]
        fit = (lag <= k) & (2 * lag > k)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(lag) != 0) | (np.diff(at) != 1) | (np.diff(seg[at]) != 0)
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(at)])
        period = lag[first]
        length = size - 1 + period + k
        good = fit[first] & (length >= np.maximum(LEAST, TIMES * period))
        found.append(np.column_stack([at[first], length, period])[good])
        # The words from a place on are doubled: places need 2k words, and segments enough for a period over k.
        place = np.full(n, -1, np.int64)
        place[at] = np.arange(len(at))
        more = (left[at] >= 2 * k) & ((ends - np.searchsorted(seg, seg))[at] >= TIMES * (k + 1))
        at, a = at[more], gram[more]
        gram = ranked(gram[place[at + k]], a) if len(at) else a
        k *= 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Of each list of words its runs, rows (start, length, period) ordered by start and then by period."""
    ids, ends = numbered(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    at, seg = segments(ids, owner)
    rows = scan(ids[at], seg)
    rows[:, 0] = at[rows[:, 0]]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cut = np.searchsorted(rows[:, 0], ends)
    rows[:, 0] -= (ends - np.diff(ends, prepend=0))[owner[rows[:, 0]]]
    return np.split(rows, cut[:-1]) if len(texts) else []


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0).tolist()])


def longest(runs: np.ndarray) -> tuple | None:
    """(start, length, period, thousandths) of the run with the greatest exponent; of equal ones the first, then the shortest period."""
    if not len(runs):
        return None
    start, length, period = max(map(tuple, runs.tolist()), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return start, length, period, 1000 * length // period


def work(digests: bool):
    def make():
        def each(texts: list[bytes]) -> list[pa.Array]:
            words = [t.split() for t in texts]
            runs = runs_of(words)
            kept = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
            if not digests:
                found = [[dict(zip(("start", "length", "period"), row, strict=True)) for row in r.tolist()] for r in runs]
                return [pa.array(found, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())]
            best = [longest(r) or (None,) * 4 for r in runs]
            sha = lambda data: hashlib.sha256(data).hexdigest()
            lines = ["".join(f"{a},{b},{c}\n" for a, b, c in r.tolist()).encode() for r in runs]
            return [pa.array(map(len, runs), pa.int64()), *(pa.array([b[i] for b in best], pa.int64()) for i in range(4)), pa.array(map(sha, lines), pa.string()), pa.array(map(sha, kept), pa.string())]

        return each

    return make


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """keep's columns (default: all) with runs (start, length, period, in words from 0) and collapsed, the text without repeats.

    digests: instead, the number of runs, the one with the greatest exponent, and digests of both.
    Words are parted by blanks, tabs, line ends, vertical tabs and form feeds.
    """
    return map_texts(docs, text, DIGESTS if digests else FOUND, work(digests), keep)
