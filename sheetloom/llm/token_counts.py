"""Token counts of whole texts, with a shortcut for words that are one token.

The vocabulary is a piece BPE: a text gets a space in front, spaces become the mark ▁,
and the neighbouring pieces whose join scores highest merge, the leftmost first, until none
is in the vocabulary; what stays a single unknown character counts one token for each of
its UTF-8 bytes. No piece has a mark after another character, so merges never cross the
place before a mark: pre-tokens (marks and what follows them) are merged on their own.

Offline, on the driver, every piece that is a pre-token is merged once. Those that come
out as one token are the table; pre-tokens of a text that stand in it count one without
any merging. The others are cut where two characters stand beside each other in no piece
of the vocabulary (no merge can cross that place either), and only the parts are merged.

Defined results: a null text counts as empty and has no tokens; very long texts without
spaces are merged in n log n steps; repeated rows are counted each; input columns
that share a name with a made one are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetloom.llm.common import map_texts

MARK = "▁"
PRE = re.compile(f"{MARK}+[^{MARK}]*")
COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("n_whole", T.LongType())])
#: Parts that one worker remembers, and the longest that it does.
MEMORY, LONGEST = 500_000, 64
NONE = float("-inf")


def merged(part: str, scores: dict[str, float]) -> list[str]:
    """The pieces of a part of a pre-token: best score first, leftmost among equals."""
    if len(part) > LONGEST:
        return merged_by_heap(part, scores)
    get, pieces = scores.get, list(part)
    joins = [get(part[i : i + 2], NONE) for i in range(len(part) - 1)]
    while joins and (best := max(joins)) > NONE:
        i = joins.index(best)
        pieces[i] += pieces.pop(i + 1)
        del joins[i]
        if i < len(joins):
            joins[i] = get(pieces[i] + pieces[i + 1], NONE)
        if i:
            joins[i - 1] = get(pieces[i - 1] + pieces[i], NONE)
    return pieces


def merged_by_heap(part: str, scores: dict[str, float]) -> list[str]:
    """The same, in n log n steps."""
    pieces, n = list(part), len(part)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) >= 0 and (score := scores.get(pieces[i] + pieces[j])) is not None:
            heapq.heappush(heap, (-score, i, pieces[i] + pieces[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = after[i]
        # The offer holds only while both its pieces are still there.
        if not pieces[i] or j < 0 or pieces[i] + pieces[j] != whole:
            continue
        pieces[i], pieces[j] = whole, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in pieces if p]


def size(part: str, scores: dict[str, float]) -> int:
    """Tokens of a part; unknown characters are told by bytes."""
    return sum(1 if p in scores else len(p.encode()) for p in merged(part, scores))


def load(model: str) -> dict[str, float]:
    """Piece: score, of all pieces that merges can make. The table's size is that of the vocabulary."""
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    made = (i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)))
    scores = {p.id_to_piece(i): p.get_score(i) for i in made}
    if any(re.search(f"[^{MARK}]{MARK}", s) for s in scores):
        raise ValueError("the vocabulary has pieces over the place before a mark")
    return scores


def proven(scores: dict[str, float]) -> set[str]:
    """The pieces that are a pre-token and that merging makes one token of."""
    return {s for s in scores if PRE.fullmatch(s) and merged(s, scores) == [s]}


class Counter:
    """Counts the tokens of texts: the table for whole pre-tokens, merges for the rest."""

    def __init__(self, scores: dict[str, float], whole: set[str]):
        self.scores, self.whole = scores, whole
        #: Pairs of characters that stand beside each other in some piece.
        self.beside = {s[i : i + 2] for s in scores for i in range(len(s) - 1)}
        self.known: dict[str, int] = {}

    def part(self, part: str) -> int:
        if (n := self.known.get(part)) is None:
            n = size(part, self.scores)
            if len(part) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[part] = n
        return n

    def rest(self, pre: str) -> int:
        """Tokens of a pre-token that is not in the table."""
        beside = self.beside
        cut = [i for i in range(1, len(pre)) if pre[i - 1 : i + 1] not in beside]
        if not cut:
            return self.part(pre)
        n = sum([self.part(pre[a:b]) for a, b in zip([0, *cut], [*cut, len(pre)], strict=True)])
        if len(pre) <= LONGEST:
            self.known[pre] = n
        return n

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, those that the table told)."""
        pre = PRE.findall(MARK + text.replace(" ", MARK)) if text else []
        rest = [p for p in pre if p not in self.whole]
        told = len(pre) - len(rest)
        known = self.known.get
        return told + sum([known(p) or self.rest(p) for p in rest]), told


def counter(tables, limit: int) -> Callable:
    def make():
        own = Counter(*tables.value)

        def work(texts: list[bytes]) -> list[pa.Array]:
            found = [own.count(t.decode("utf-8", "replace")) for t in texts]
            n = [f[0] for f in found]
            return [pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array([f[1] for f in found], pa.int64())]

        return work

    return make


def count_tokens(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, limit: int = 4096) -> DataFrame:
    """keep's columns (default: all) with n_bytes, n_tokens, over_limit (more than limit tokens) and n_whole, the tokens that needed no merging.

    model is a vocabulary file of the piece kind, without begin, end or special tokens.
    """
    scores = load(model)
    tables = docs.sparkSession.sparkContext.broadcast((scores, proven(scores)))
    return map_texts(docs, text, COUNTS, counter(tables, limit), keep)
