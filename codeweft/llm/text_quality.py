"""Per-document text quality statistics, and what kind of text a document mostly is.

A document is cut into blocks at blank lines. Each block is prose, list, table or junk by rules
over its lines' markers and delimiters, its words (share of common function words), its signs and
its repetition. Beside the usual statistics there are repetition statistics: shares of duplicate
lines and paragraphs, and the share of characters that the most frequent word n-gram covers. They
take part in the kind: blocks and lines of prose that the document had before are junk, and so is
all of its prose if one n-gram covers more than half of the letters of its 50 or more words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE_ENDS = re.compile("\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_BLOCKS = re.compile(r"\n\s*\n")
_MARKER = re.compile(r"\s*(?:[-*+•·–▪‣◦]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivx]{1,5}[.)])\s+\S")
_PAIR = re.compile(r"\s*\S+(?: \S+){0,2} ?(?:=>|->|:| [-–=]) ")
_TRACE = re.compile(r"\s*(?:at \S+.*\(.*\)|at \S+:\d+|File \".*\", line \d+|\w*(?:Error|Exception): |Caused by: |\.\.\. \d+ more)")
_LOG = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_GAP = re.compile(r"\s{2,}|\t")
_HEX = re.compile(r"(?:(?:0x)?[0-9a-fA-F]{2}[\s,:]+){8,}")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
_BROKEN = re.compile("\ufffd|[\u00c3\u00d0\u00d1\u00e2\u00ef][\u0080-\u00bf\u0178\u0152\u20ac\u2122\u201a-\u2022]|[\u00c3\u00d0\u00e2\u00ef\u0178\u20ac\u2122\u00bf\u00bd\u00a9]{3}")
_RULE = re.compile(r"[\s|+:=-]*$")
_END = ".!?:…\"'»)”"
_BEYOND = re.compile("[^\x00-\x7f]+")
_PLAIN = bytes(c for c in range(128) if chr(c).isalnum() or chr(c).isspace())
_OUTER = ".,;:!?…()[]{}<>\"'`*_#|=+-/\\«»“”„’"
KINDS = ("prose", "list", "table", "junk")


def _signs(text: str) -> int:
    """Characters that are neither letters, digits nor white space."""
    plain = len(text.encode("ascii", "ignore").translate(None, _PLAIN))
    return plain if text.isascii() else plain + sum(len(x) - sum(map(str.isalnum, x)) for x in _BEYOND.findall(text))


def _mostly(pattern: re.Pattern, lines: list[str], share: float) -> bool:
    """Whether at least ``share`` of all lines match; ends once the outcome is certain."""
    need, hits, left = share * len(lines), 0, len(lines)
    for line in lines:
        left -= 1
        hits += bool(pattern.match(line))
        if hits >= need or hits + left < need:
            break
    return hits >= need


def _is_table(block: str, lines: list[str], known: float) -> bool:
    """Rows of fields: the same delimiter, equally often, in nearly every line."""
    count = len(lines)
    if "|" in block and sum(x.count("|") >= 2 or x.startswith("+-") for x in lines) >= 0.8 * count:
        return True
    for mark in "\t;,":
        if block.count(mark) < 0.8 * count or (mark != "\t" and f"{mark} " in block):
            continue
        most, times = Counter(x[:-1].count(mark) if mark == ";" else x.count(mark) for x in lines).most_common(1)[0]
        if most and times >= 0.8 * count and (mark == "\t" or most > 1 or count > 3):
            return True
    if "  " in block and known < 0.3:
        gaps = [len(_GAP.findall(x.rstrip())) for x in lines]
        return sum(g > 0 for g in gaps) >= 0.8 * count and sum(gaps) >= 1.5 * count
    return False


def _is_junk(block: str, lines: list[str], words: list[str], known: float, marked: bool) -> bool:
    """Text not written to be read: machine output, encoded or broken characters, heaped words or signs."""
    n, count = len(block), len(lines)
    if _mostly(_LOG, lines, 0.6) or (count > 1 and _mostly(_TRACE, lines, 0.6)):
        return True
    distinct = len(set(words))
    if len(words) >= 12 and distinct < 0.25 * len(words) and (distinct <= 30 or known < 0.12):
        return True
    if count >= 5 and len(set(map(str.strip, lines))) < 0.3 * count:
        return True
    if known >= 0.12:
        return False
    solid, signs = sum(map(len, words)), _signs(block)
    return (
        len(_BROKEN.findall(block)) * 12 > n
        or sum(map(len, _HEX.findall(block))) > 0.5 * n
        or sum(len(x) for x in _ENCODED.findall(block) if not x.isalpha() or len(set(x)) < 8) > 0.5 * n
        or (signs > 0.45 * solid and not marked)
        or (n >= 24 and Counter(block).most_common(1)[0][1] > 0.5 * n)
        or (n > 40 * len(words) and signs > 0.15 * solid)
        or (known < 0.05 and len(words) >= 10 * count and not any(w[-1] in ".,;:!?" for w in words))
    )


def block_kind(block: str, words: list[str], known: float) -> str:
    """Kind of one block of lines, its lower-case words and their share of common words given."""
    if not words:
        return "prose"
    lines = [x for x in block.split("\n") if x.strip()]
    count, per_line = len(lines), len(words) / len(lines)
    marked = count >= 2 and _mostly(_MARKER, lines, 0.6)
    if count >= 2 and not marked and _is_table(block, lines, known):
        body = [x for x in lines if not _RULE.match(x)]
        return "junk" if len(body) > 4 and len(set(body)) < 0.3 * len(body) else "table"
    if _is_junk(block, lines, words, known, marked):
        return "junk"
    if marked and per_line < 9:
        return "list"
    if count >= 3 and known < 0.35:
        if per_line <= 8 and _mostly(_PAIR, lines, 0.7):
            return "list"
        if per_line <= 4.5 and sum(x.rstrip()[-1] in ".!?" for x in lines) < 0.3 * count and not lines[0].startswith(("```", "#")):
            return "list"
    return "prose"


def _coverage(words: list[str], chars: int) -> float:
    """Largest share of the characters that a most frequent 2-, 3- or 4-gram covers."""
    best = 0
    for n in (2, 3, 4):
        if len(words) > n:
            counts = Counter(zip(*(words[i:] for i in range(n)), strict=False))
            times = max(counts.values())
            if times > 1:
                best = max(best, times * max(sum(map(len, gram)) for gram, m in counts.items() if m == times))
    return min(best / chars, 1.0)


def _copied(block: str, known: set[str]) -> int:
    """Characters of the block's lines that the document's prose had before; its lines become known."""
    copied = 0
    for line in block.split("\n"):
        bare = line.strip().lower()
        if bare in known:
            copied += len(line)
        elif bare:
            known.add(bare)
    return copied


def _measure(text: str, lang: str | None, by_lang: dict[str, frozenset[str]], common: frozenset[str]) -> tuple:
    text = _LINE_ENDS.sub("\n", text)
    shares, blocks, words = dict.fromkeys(KINDS, 0), [], []
    known_blocks: set[str] = set()
    known_lines: set[str] = set()
    for block in _BLOCKS.split(text):
        parts = block.lower().split()
        if parts:
            blocks.append(block)
            bare = [w.strip(_OUTER) for w in parts]
            words += bare
            whole = " ".join(parts)
            kind = "junk" if whole in known_blocks else block_kind(block.strip("\n"), parts, sum(map(common.__contains__, bare)) / len(bare))
            known_blocks.add(whole)
            copied = _copied(block, known_lines) if kind == "prose" else 0
            shares[kind] += len(block) - copied
            shares["junk"] += copied
    total = sum(shares.values())
    if not total:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    solid = sum(map(len, text.split()))
    words = list(filter(None, words))
    letters = sum(map(len, words))
    own = by_lang.get((lang or "").lower()[:2]) or common
    coverage = _coverage(words, letters or 1)
    if coverage > 0.5 and len(words) >= 50:  # a short sentence may say a phrase twice
        shares["junk"], shares["prose"] = shares["junk"] + shares["prose"], 0
    kind = max(("list", "table", "junk"), key=lambda k: shares[k]) if 2 * shares["prose"] < total else "prose"
    return (
        len(words),
        letters / len(words) if words else 0.0,
        _signs(text) / solid,
        sum(x[-1] in _END for x in lines) / len(lines),
        sum(map(own.__contains__, words)) / len(words) if words else 0.0,
        1 - len(set(lines)) / len(lines),
        1 - len(set(blocks)) / len(blocks),
        coverage,
        *(shares[k] / total for k in KINDS),
        kind,
    )


_FIELDS = (
    "n_words", "mean_word_length", "symbol_share", "ended_line_share", "common_share", "duplicate_line_share", "duplicate_paragraph_share",
    "ngram_coverage", "prose_share", "list_share", "table_share", "junk_share", "doc_kind",
)


def text_quality(df: DataFrame, common_words: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(``key``, the statistics, doc_kind) of every row.

    doc_kind is ``prose`` unless more than half of the characters of the text's blocks are not,
    then the kind that holds most of them. Defined cases: null, empty and blank texts have zero
    statistics and a null kind; a null or unknown language takes the common words of all
    languages; repeated rows and null keys are kept, one row out per row in; texts are measured
    whole; other columns are ignored. ``common_words`` (lang, word) is a fixed list of a few
    hundred rows; more than 100,000 are refused, since every task holds them.
    """
    listed = common_words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct().limit(100_001).collect()
    if len(listed) > 100_000:
        raise ValueError("common_words is not a list of function words")
    by_lang = {x: frozenset(r.word for r in listed if r.lang == x) for x in {r.lang for r in listed}}
    common = frozenset(r.word for r in listed)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [_measure(t or "", x, by_lang, common) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
            types = [pa.int64(), *[pa.float64()] * 11, pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], names=[key, *_FIELDS])

    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "n_words bigint", *(f"{f} double" for f in _FIELDS[1:-1]), "doc_kind string"])
    return df.select(F.col(key), F.col(text).alias("_text"), F.col(lang).alias("_lang")).mapInArrow(batches, schema)
