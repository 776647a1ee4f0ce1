"""Byte-pair encoding of a whole corpus with a public tokenizer, exact and in linear time.

The vocabulary's byte strings are mapped to Latin-1 text and put into an Aho-Corasick
automaton. A piece is encoded from the longest match at each position; a token is kept only if
it is *compatible* with its left neighbour, that is if no merge would have crossed their border
earlier. Where no shorter match is compatible the previous token is taken back; each border is
given up at most once, so the work stays linear. Compatibility of adjacent tokens is memoised.
The result equals applying the merges one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary: lines of a base64 byte string and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pattern that cuts text into pieces before the merges of byte_bpe_50k.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of each worker's memos; a full memo is emptied, which changes speed only.
MEMO = 200_000
#: Longer pieces are encoded each time, so that a memo's memory is bounded.
MEMO_CHARS = 48


# Blanks between two words, and white space that is neither a blank nor a line feed.
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")


class _Memo(dict):
    """Results by text, computed when first asked for."""

    def __init__(self, compute: Callable[[str], bytes]) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, text: str) -> bytes:
        got = self.compute(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[text] = got
        return got


class Encoder:
    """Encoder of one vocabulary; ids are the ranks of the merges."""

    def __init__(self, vocabulary: bytes, pieces: str = PIECES) -> None:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.find = regex.compile(pieces).findall
        self.find_ascii = re.compile(pieces.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace("?a-zA-Z+", "?[a-zA-Z]+").replace("?0-9+", "?[0-9]+"), re.ASCII).findall
        self.ids = ranks
        self.size = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self._halve()
        self.compatible.clear()
        self.pieces = _Memo(self._piece)
        self.first = _Memo(self._chunk)
        self.later = _Memo(lambda word: self._chunk(" " + word))

    def _halve(self) -> None:
        """Find the merge that makes each token, and its longest proper prefix in the vocabulary."""
        for text, token in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(text) == 1:
                self.halves[token] = (token, token)
                continue
            for n in range(len(text) - 1, 0, -1):
                left = self.ids.get(text[:n])
                if left is None:
                    continue
                self.shorter.setdefault(token, left)
                right = self.ids.get(text[n:])
                if right is not None and left < token and right < token and self._fits(left, right):
                    self.merged[left, right] = token
                    self.halves[token] = (left, right)
                    break
            else:
                self.halves[token] = (token, token)

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between the two tokens: undo them latest first.

        The check is the published one of linear-time back-tracking encoders (the ``bpe`` crate
        of the public rust-gems collection, MIT licence).
        """
        cap = 1 << 60
        while True:
            if self.merged.get((left, right), cap) < cap:
                return False
            if left > right:
                undone = self.halves[left][1]
                if undone != left:
                    cap, left = left, undone
                    continue
                undone = self.halves[right][0]
                if undone == right:
                    return True
                cap, right = right + 1, undone
            else:
                undone = self.halves[right][0]
                if undone != right:
                    cap, right = right + 1, undone
                    continue
                undone = self.halves[left][1]
                if undone == left:
                    return True
                cap, left = left, undone

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8").decode("latin-1")
        whole = self.ids.get(data)
        if whole is not None and (len(data) == 1 or self.halves[whole][0] != whole):
            return array("i", [whole]).tobytes()
        longest = [0] * len(data)
        for end, (n, token) in self.automaton.iter(data):  # ends ascend, so the last of a start is its longest
            longest[end - n + 1] = token
        fits, memo, shorter, size = self._fits, self.compatible, self.shorter, self.size
        if len(memo) > MEMO:
            memo.clear()
        tokens: list[int] = []
        given_up: set[int] = set()
        at, end = 0, len(data)
        token: int | None = longest[0]
        while at < end:
            while token is not None:
                if at + size[token] not in given_up:
                    if not tokens:
                        break
                    pair = (tokens[-1], token)
                    ok = memo.get(pair)
                    if ok is None:
                        ok = memo[pair] = fits(*pair)
                    if ok:
                        break
                token = shorter.get(token)
            if token is None:
                given_up.add(at)
                token = tokens.pop()
                at -= size[token]
            else:
                tokens.append(token)
                at += size[token]
                token = longest[at] if at < end else None
        return array("i", tokens).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, (self.find_ascii if chunk.isascii() else self.find)(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as packed 32-bit integers.

        A blank between two words starts a piece whatever stands around it, so the words with
        their leading blank are encoded (and memoised) apart; where blanks meet other white
        space the words stay together.
        """
        mixed = "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or _RARE_SPACE.search(text)
        words = _LONE_BLANK.split(text) if mixed else text.split(" ")
        first = self.first[words[0]]
        return first + b"".join(map(self.later.__getitem__, words[1:])) if len(words) > 1 else first


@lru_cache(maxsize=2)
def _encoder(digest: str, vocabulary: _Shared) -> Encoder:  # noqa: ARG001
    return Encoder(vocabulary.value)


class _Shared:
    """Vocabulary bytes that count as equal in the cache above, whose key is their digest."""

    def __init__(self, value: bytes) -> None:
        self.value = value

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shared)


def _load(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


def encode_corpus(df: DataFrame, key: str, text: str, *, ids_as: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every row's text, without special tokens: (``key``, ``ids_as``).

    Defined cases: a null or empty text gives an empty list; strings that look like special
    tokens are ordinary text; repeated rows and null keys are kept, one row out per row in;
    texts of any length are encoded whole; other columns, whatever their names, are ignored.
    """
    shared = _load(df, vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value[0], _Shared(shared.value[1])).encode
        for batch in it:
            packed = [encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, ids_as])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(batches, f"`{key}` {kind}, `{ids_as}` array<int>")


def count_tokens(df: DataFrame, key: str, text: str, *, count_as: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Number of tokens of every row's text: (``key``, ``count_as``); 0 for null and empty texts."""
    shared = _load(df, vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value[0], _Shared(shared.value[1])).encode
        for batch in it:
            counts = pa.array([len(encode(t)) // 4 if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[key, count_as])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(batches, f"`{key}` {kind}, `{count_as}` bigint")
