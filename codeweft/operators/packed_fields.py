"""Several values packed in one text field, split by rules resolved per delimiter skeleton.

Every field is reduced to a *skeleton*: runs of ordinary characters (inner blanks included)
become one ``a``, blank runs one blank, structural characters stay. Fields that differ only in
their words share a skeleton, so the splitting rules are worked out once per distinct skeleton
(a small table) and joined back. A rule is a list of spans over the field's runs; values are
cut out by position, JVM-side.

Skeleton alphabet: ``a`` ordinary run, blank, and ``, ; | tab newline # quotes backslash [ ] { }``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import broadcast_if_small, materialise

_STRUCTURAL = ",;|\\t\\n\\r\\u0085\\u2028\\u2029#\"'\\\\\\[\\]{}"
_BLANK = " \\u000b\\u000c\\u00a0\\u1680\\u2000-\\u200b\\u202f\\u205f\\u3000\\ufeff"
_ORDINARY = f"[^{_STRUCTURAL}{_BLANK}]+(?:[{_BLANK}]+[^{_STRUCTURAL}{_BLANK}]+)*"
_SEPARATORS = ",;|\t\n\r\x85\u2028\u2029"

#: How a span's text is turned into its value.
RAW, QUOTED, ESCAPED = 0, 1, 2
_RULE = "array<struct<start:int,len:int,mode:int>>"


def skeleton(text: Column) -> Column:
    """Delimiter skeleton of a field."""
    return F.regexp_replace(F.regexp_replace(text, _ORDINARY, "a"), f"[{_BLANK}]+", " ")


def runs(text: Column) -> Column:
    """The runs of a field, one for each character of its skeleton."""
    return F.regexp_extract_all(text, F.lit(f"(?s)({_ORDINARY}|[{_BLANK}]+|.)"), F.lit(1))


def _closing(s: str, i: int, end: int, stops: str) -> int:
    """Index of the quote that closes the one at ``i``, or -1; doubled and escaped quotes go on."""
    q, j = s[i], i + 1
    while j < end:
        if s[j] == "\\":
            j += 2
            continue
        if s[j] == q:
            if j + 1 < end and s[j + 1] == q:
                # A doubled quote inside a value; at its very start the value is empty.
                if j > i + 1 or (j + 2 < end and s[j + 2] not in stops + " "):
                    j += 2
                    continue
                return j
            k = j + 1
            while k < end and s[k] == " ":
                k += 1
            if k >= end or s[k] in stops:
                return j
        j += 1
    return -1


def _trim(s: str, lo: int, hi: int, also: str = "") -> tuple[int, int]:
    while lo < hi and (s[lo] == " " or s[lo] in also):
        lo += 1
    while hi > lo and (s[hi - 1] == " " or s[hi - 1] in also):
        hi -= 1
    return lo, hi


def resolve(s: str) -> list[dict[str, int]]:
    """Spans of the non-empty values of a skeleton: first run, number of runs, mode."""
    out: list[dict[str, int]] = []

    def add(lo: int, hi: int, mode: int) -> None:
        lo, hi = _trim(s, lo, hi)
        if hi > lo:
            out.append({"start": lo, "len": hi - lo, "mode": mode})

    lo, hi = _trim(s, 0, len(s), _SEPARATORS)
    if lo < hi and s[lo] == "#":
        starts = [i for i in range(lo, hi) if s[i] == "#"]
        items = [_trim(s, a + 1, b, _SEPARATORS) for a, b in zip(starts, [*starts[1:], hi], strict=True)]
        if not any(c in _SEPARATORS for a, b in items for c in s[a:b]):
            for a, b in items:
                add(a, b, RAW)
            return out
    boxed = hi - lo >= 2 and s[lo] + s[hi - 1] in ("[]", "{}")
    quoted_mode, stops = QUOTED, _SEPARATORS
    if boxed:
        quoted_mode, stops = ESCAPED if s[lo] == "[" else QUOTED, ",\n\r"
        lo, hi = lo + 1, hi - 1
    i = lo
    while i < hi:
        while i < hi and (s[i] == " " or s[i] in stops):
            i += 1
        if i >= hi:
            break
        if s[i] in "\"'" and (j := _closing(s, i, hi, stops)) > 0:
            add(i + 1, j, quoted_mode)
            i = j + 1
            continue
        j = i
        while j < hi and s[j] not in stops:
            j += 1
        add(*_trim(s, i, j, "\"[]{}"), RAW)
        i = j
    return out


def _resolve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"_skeleton": pdf["_skeleton"], "_rule": [resolve(s) for s in pdf["_skeleton"]]})


def _unescape(value: Column) -> Column:
    """Undo the escapes of a quoted list element (``\\uXXXX``, ``\\t``, ``\\"`` ...)."""
    asjson = F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(value, r"\\'", "'"), r'(?<!\\)((?:\\\\)*)"', r'$1\\"'), F.lit('"]'))
    return F.coalesce(F.from_json(asjson, "array<string>", {"allowUnquotedControlChars": "true"})[0], value)


def _value(parts: Column, span: Column) -> Column:
    text = F.array_join(F.slice(parts, span["start"] + 1, span["len"]), "")
    plain = F.regexp_replace(F.regexp_replace(text, '""', '"'), r"\\([\"'\\])", "$1")
    value = (
        F.when(span["mode"] == RAW, text)
        .when(~text.contains("\\") & ~text.contains('""'), text)
        .when(span["mode"] == QUOTED, plain)
        .otherwise(_unescape(text))
    )
    return F.regexp_replace(value, rf"^[\s{_BLANK}]+|[\s{_BLANK}]+$", "")


def split_packed(df: DataFrame, key: str, field: str, *, key_as: str, pos_as: str, value_as: str) -> DataFrame:
    """One row per value packed in ``field``, with its key and its position among the values.

    Defined cases: a null, empty or blank field, and one of separators only, gives no rows; a
    null key is kept as it is; repeated values stay, each at its position; exact repeats of a
    (key, field) row count once; an unclosed quote is ordinary text; other columns of ``df``,
    whatever their names, are ignored. An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(field).alias("_text")).where(F.trim(F.col("_text")) != "").distinct()
    rows = rows.withColumn("_skeleton", skeleton(F.col("_text")))
    rules = materialise(rows.select("_skeleton").distinct().mapInPandas(_resolve_batches, f"_skeleton string, _rule {_RULE}"))
    ruled = rows.join(broadcast_if_small(rules), "_skeleton").select("_key", runs(F.col("_text")).alias("_runs"), "_rule")
    values = F.filter(F.transform("_rule", lambda span: _value(F.col("_runs"), span)), lambda v: v != "")
    return ruled.select(F.col("_key").alias(key_as), F.posexplode(values).alias(pos_as, value_as))
