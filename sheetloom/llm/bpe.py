"""BPE encoding and decoding with a tokenization automaton.

The automaton's states are tokens (the last one emitted) and its arcs are tokens. It is
the result of one merge gadget per merge rule, in rank order: the gadget for (u, v)
splits the states reached by u, takes their v arc away, and gives every state that still
has a u arc an arc for the merged token, which leads to a copy of v's state as it is at
that time. A path spells a word's BPE tokens exactly when all its arcs exist. As most
arcs are never asked for, the gadgets are replayed for one arc at a time and the outcome
is kept in the transition table. Exactly one path spells a pre-split word: encoding
follows arcs from left to right, the longest token first, and steps back from states
that prove dead, each at most once. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetloom.llm.common import map_texts

CODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
#: Pieces that one worker remembers, and the longest that it does.
MEMORY, LONGEST = 300_000, 48
#: Arcs that the transition table holds at a time.
ARCS = 300_000
EVER = float("inf")
#: Characters that Python splits at although they are no white space to the vocabulary's pattern.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\t\n\v\f\r \x85\xa0  -     　]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """The transition table over token ids, made from merges in rank order."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.born: dict[int, tuple[int, int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for letter in byte_letters().values():
            self.inner[letter], self.final[letter] = vocab[letter], vocab[letter + suffix]
        for rank, (u, v) in enumerate(merges):
            a, b, whole = vocab[u], vocab[v], vocab[u + v]
            self.pairs.setdefault((a, b), rank)
            if whole not in self.born:
                self.born[whole] = (rank, a, b)
                if v.endswith(suffix) and v != suffix:
                    self.final[(u + v)[: -len(suffix)]] = whole
                else:
                    self.inner[u + v] = whole
        #: By their first four letters, the length of the longest token that begins so.
        self.reach: dict[str, int] = {}
        for t in (*self.inner, *self.final):
            if len(t) > 3:
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 0))
        self.arcs: dict[tuple[int, int], float] = {}

    def gone(self, a: int, b: int) -> float:
        """The merge whose gadget took the arc b from state a away (or kept it from coming about; infinity: none did, the arc exists)."""
        key = (a, b)
        if (found := self.arcs.get(key)) is not None:
            return found
        (ra, _, a2), (rb, b1, _) = self.born.get(a, (-1, -1, -1)), self.born.get(b, (-1, -1, -1))
        when = self.pairs.get(key, EVER)
        if ra > rb:
            # a's state is a copy of its right part's, as that was when a was made.
            before = self.gone(a2, b)
            when = before if before < ra else when
        elif rb >= 0:
            # b got an arc only from states that still had its left part's. The gadget of (u, u)
            # takes u away from u's state first: the leftmost pair merges.
            before = self.gone(a, b1)
            when = before if before <= rb else when
        if len(self.arcs) >= ARCS:
            self.arcs.clear()
        self.arcs[key] = when
        return when

    def encode(self, letters: str) -> list[int]:
        """Token ids of one pre-split word, given as byte letters."""
        whole = self.final.get(letters)
        if whole is not None:
            return [whole]
        n, reach, inner, final, arcs = len(letters), self.reach.get, self.inner.get, self.final.get, self.arcs.get
        ids, starts, ends, dead = [], [0], [min(n, reach(letters[:4], 3))], set()
        while starts:
            start, end, last = starts[-1], ends[-1], ids[-1] if ids else -1
            while end > start:
                token = (inner if end < n else final)(letters[start:end])
                if token is not None:
                    if last >= 0 and (taken := arcs((last, token))) is None:
                        taken = self.gone(last, token)
                    if (last < 0 or taken == EVER) and (not dead or (end, token) not in dead):
                        break
                end -= 1
            else:
                # No arc goes on from here: step back, and never come here again.
                starts.pop()
                ends.pop()
                dead.add((start, ids.pop()))
                continue
            ids.append(token)
            if end == n:
                return ids
            ends[-1] = end - 1
            starts.append(end)
            most = end + reach(letters[end : end + 4], 3)
            ends.append(most if most < n else n)
        raise ValueError("no path: the vocabulary lacks a byte")


class Codec:
    """Whole texts to token ids and back, as the vocabulary file of a word-end BPE says."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.labels = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.automaton = Automaton(model["vocab"], (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]), model["end_of_word_suffix"])
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "words": {}}

    def piece(self, raw: str) -> bytes:
        """Ids (little-endian 32-bit) of a piece of text without white space."""
        if raw.isascii():
            norm = raw.lower()
        else:
            norm = unicodedata.normalize("NFC", raw)
            norm = "".join(c.lower() for c in norm) if "Σ" in norm else norm.lower()
        words = (norm,) if norm.isalpha() else self.pattern.findall(norm)
        if len(words) == 1:
            coded = self.words.get(words[0]) or self.word(words[0])
        else:
            coded = b"".join([self.words.get(w) or self.word(w) for w in words])
        if len(raw) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[raw] = coded
        return coded

    def word(self, word: str) -> bytes:
        """Ids of one pre-split word."""
        letters = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = self.automaton.encode(letters)
        coded = pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = coded
        return coded

    def plain(self, text: str) -> bytes:
        pieces = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        get, piece = self.known.get, self.piece
        return b"".join([get(p) or piece(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


def load(path: str) -> Codec:
    """The codec of a vocabulary file. The file's size is fixed by its vocabulary, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        return Codec(json.load(f))


def coder(codec, digests: bool) -> Callable:
    def make():
        own: Codec = codec.value

        def work(texts: list[bytes]) -> list[pa.Array]:
            coded = [own.encode(t.decode("utf-8", "replace")) for t in texts]
            back = [own.decode(c) for c in coded]
            if not digests:
                return [pa.array(coded, pa.binary()), pa.array(back, pa.string())]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(map(sha, coded), pa.string()), pa.array([sha(b.encode("utf-8")) for b in back], pa.string())]

        return work

    return make


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """keep's columns with ids (little-endian 32-bit integers) and decoded, or with their digests.

    A null text counts as empty and has no tokens; text that spells a special token becomes that token.
    """
    codec = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    return map_texts(docs, text, DIGESTS if digests else CODED, coder(codec, digests), keep)
