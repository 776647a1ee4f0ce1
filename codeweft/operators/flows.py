"""Taint: what comes from outside and reaches a dangerous call without being cleaned."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where data enters, what cleans it, and calls it must not reach (class, pattern).
SOURCES = r"\breq(?:uest)?\.(?:query|body|params|headers|cookies|args|form)\b|\$_(?:GET|POST|REQUEST|COOKIE)\b|\bsys\.argv\b|\bprocess\.argv\b|\binput\s*\(|\bos\.environ\b|\bprocess\.env\b"
CLEANERS = r"\b(?:escape\w*|sanitize\w*|parseInt|Number|int|quote|encodeURIComponent|htmlspecialchars|validate\w*|clean\w*)\s*\("
SINKS = [
    ("CWE-78", r"\b(?:os\.system|subprocess\.\w+|child_process\.\w+|exec|execSync|shell_exec|spawn)\s*\("),
    ("CWE-89", r"\b(?:query|execute|raw)\s*\("),
    ("CWE-79", r"\binnerHTML\s*=|\bdocument\.write\s*\(|\.send\s*\("),
    ("CWE-94", r"\b(?:eval|Function)\s*\("),
    ("CWE-22", r"\b(?:open|readFile|readFileSync|sendFile|include|require)\s*\("),
    ("CWE-601", r"\bredirect\s*\("),
    ("CWE-918", r"\b(?:fetch|axios\.\w+|requests\.\w+|urlopen)\s*\("),
]
_SINK = "|".join(p for _, p in SINKS)
_ASSIGNED = re.compile(r"^\s*(?:const|let|var|final|auto|my)?\s*(\$?[A-Za-z_]\w*)\s*(?::[^=]+)?(?:\.|\+)?=(?!=)\s*(.+)$")
_STARTS = re.compile(r"^\s*(?:async\s+)?(?:def|function|fn|func|public|private|protected)\b")


def flows_of(text: str) -> list[tuple[int, int, str, str]]:
    """(source line, sink line, class, name) of the flows in one text; functions start afresh."""
    source, cleaner, sinks = re.compile(SOURCES), re.compile(CLEANERS), [(c, re.compile(p)) for c, p in SINKS]
    held: dict[str, int] = {}
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        if _STARTS.match(line):
            held = {}
        words = set(re.findall(r"\$?[A-Za-z_]\w*", line))
        dirty = {n: held[n] for n in words & held.keys()}
        direct = source.search(line) is not None
        if not cleaner.search(line):
            for kind, pattern in sinks:
                m = pattern.search(line)
                if m and direct and source.search(line, m.end()):
                    out.append((no, no, kind, "direct"))
                elif m:
                    after = set(re.findall(r"\$?[A-Za-z_]\w*", line[m.end() :]))
                    out += [(at, no, kind, n) for n, at in sorted(dirty.items()) if n in after]
        if m := _ASSIGNED.match(line):
            name, value = m.groups()
            used = set(re.findall(r"\$?[A-Za-z_]\w*", value))
            from_lines = [held[n] for n in used & held.keys()] + ([no] if source.search(value) else [])
            if from_lines and not cleaner.search(value):
                held[name] = min(from_lines)
            else:
                held.pop(name, None)
    return out


def taint(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source_line, sink_line, class, name) over texts; those without both a source and a sink are not looked at."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *f) for k, t in zip(pdf["_k"], pdf["_t"], strict=True) for f in flows_of(t)]
            yield pd.DataFrame(rows, columns=["key", "source_line", "sink_line", "class", "name"])

    asked = texts.where(F.col(text).rlike(SOURCES) & F.col(text).rlike(_SINK)).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    found = asked.mapInPandas(look, f"key {texts.schema[key].dataType.simpleString()}, source_line long, sink_line long, class string, name string")
    return found.withColumnRenamed("key", key)


def uses_of(text: str) -> list[tuple[str, int, int]]:
    """(name, line of the assignment, line of the use): which assignment each use of a name sees; functions start afresh."""
    held: dict[str, int] = {}
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        if _STARTS.match(line):
            held = {}
        m = _ASSIGNED.match(line)
        seen = m.group(2) if m else line
        out += [(n, held[n], no) for n in sorted(set(re.findall(r"\$?[A-Za-z_]\w*", seen)) & held.keys())]
        if m:
            held[m.group(1)] = no
    return out


def data_flow(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, assigned, used) over texts that assign anything."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *u) for k, t in zip(pdf["_k"], pdf["_t"], strict=True) for u in uses_of(t)], columns=["key", "name", "assigned", "used"])

    asked = texts.where(F.col(text).contains("=")).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return asked.mapInPandas(look, f"key {texts.schema[key].dataType.simpleString()}, name string, assigned long, used long").withColumnRenamed("key", key)
