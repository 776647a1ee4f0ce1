"""Scalar expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Round halves towards positive infinity on the binary value."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def clamp(x: Column, ceiling: float = 1.0) -> Column:
    return F.least(F.lit(1.0), x / F.lit(float(ceiling)))


def trigrams(text: Column) -> Column:
    """Distinct sliding triples of the lower-case text; the whole text where it is shorter."""
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array(low)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: low.substr(i, F.lit(3))))
    )


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def segments(name: Column) -> Column:
    """Lower-case parts of a camelCase, snake_case or dotted name."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(spaced), r"[_\-.:/]+"), lambda s: s != "")


def module_of(path: Column, depth: int = 2) -> Column:
    """Leading folders of a path, at most ``depth``; the path itself where it has no folder."""
    parts = F.split(path, "/")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    return F.when(n < 1, path).otherwise(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/"))


def path_divergence(a: Column, b: Column) -> Column:
    """Folders by which two paths differ: the deeper folder count less the common leading folders."""
    fa, fb = F.split(a, "/"), F.split(b, "/")
    na, nb = F.size(fa) - 1, F.size(fb) - 1
    depth = F.least(na, nb)
    steps = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    common = F.aggregate(steps, F.lit(0), lambda acc, i: F.when((acc == i) & (F.get(fa, i) == F.get(fb, i)), acc + 1).otherwise(acc))
    return F.greatest(na, nb) - common


def token_estimate(text: Column) -> Column:
    """Rough number of language-model tokens: characters over four, plus 15 percent."""
    return F.ceil(F.length(text) / 4 * 1.15)


def url_pattern(path: Column) -> Column:
    """One spelling for path parameters, without a trailing slash, numbers as parameters."""
    p = F.regexp_replace(path, r"\{[^}/]*\}", "{*}")
    p = F.regexp_replace(p, r":[A-Za-z_][A-Za-z0-9_]*", "{*}")
    p = F.regexp_replace(p, r"/[0-9]+(?=/|$)", "/{*}")
    return F.regexp_replace(p, r"(.)/+$", "$1")


def timestamp_of(text: Column) -> Column:
    """Instant of an ISO-like spelling (``T`` or blank, fraction, ``Z`` or offset, or none)."""
    return F.try_to_timestamp(text)


def decay_heat(hits: Column, age_days: Column, fresh_age: Column, half_life: float, fresh: float) -> Column:
    """Hits decaying with age plus a freshness term, at most 1000."""
    return F.least(F.lit(1000.0), hits * F.exp(-age_days / half_life) + F.exp(-fresh_age / fresh))


def recency(age_days: Column, window: float = 30.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - age_days / window)


def identity_score(name: Column, fqn: Column, query: str) -> Column:
    """How exactly a name answers a query, whatever the case: from 1 (the name or its qualified form) down to 0."""
    asked = query.lower()
    low, full = F.lower(name), F.coalesce(F.lower(fqn), F.lit(""))
    parts, places = segments(name), F.split(full, r"[:#./-]+")
    # What each kind of match is worth.
    rungs = [
        (low == asked, 1.0),
        (full == asked, 1.0),
        (full.endswith(asked), 0.9),
        (low.startswith(asked), 0.8),
        (F.array_contains(parts, asked), 0.7),
        (F.array_contains(places, asked), 0.6),
        (F.exists(parts, lambda p: p.startswith(asked)), 0.5),
        (low.contains(asked), 0.3),
        (full.contains(asked), 0.2),
    ]
    score = F.lit(0.0)
    for met, worth in reversed(rungs):
        score = F.when(met, worth).otherwise(score)
    return score


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where lengths differ or a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot / both).otherwise(0.0)


def branch_complexity(code: Column) -> Column:
    """One more than the number of branches, outside strings and line comments."""
    # possessive groups are matched in a loop; others take a stack frame per character, and a long literal ends the executor
    bare = F.regexp_replace(code, r"""("(?:[^"\\]|\\[^\n])*+"|'(?:[^'\\]|\\[^\n])*+'|//[^\n]*)""", " ")
    return 1 + F.size(F.regexp_extract_all(bare, F.lit(r"(\b(?:if|for|while|case|catch)\b|&&|\|\||\?)"), F.lit(1)))


def brace_depth(code: Column) -> Column:
    """Deepest nesting of braces."""
    marks = F.split(F.regexp_replace(code, "[^{}]", ""), "")
    state = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s: Column, c: Column) -> Column:
        d = F.greatest(F.lit(0), s["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(marks, state, step, lambda s: s["m"])


def glob_to_regex(glob: str) -> str:
    """Regular expression of a path glob with ``*``, ``**``, ``?`` and ``{a,b}``."""
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, "\\" + c if c in r".+()^$|\[]" else c)
        i += 1
    return out + "$"


def param_count(signature: Column) -> Column:
    """Parameters of a signature: commas of its first parentheses that no inner bracket holds; 0 for none and void."""
    inner = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)$", 1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(False).alias("filled"), F.lit(0).alias("n"), F.lit("").alias("word"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "<", "[", "{"), 1).when(c.isin(")", ">", "]", "}"), -1).otherwise(0)
        splits = (c == ",") & (s["depth"] == 1)
        filled = s["filled"] | ((c != " ") & (depth > 0))
        after = F.struct(
            depth.alias("depth"), F.when(splits, False).otherwise(filled).alias("filled"), (s["n"] + F.when(splits & s["filled"], 1).otherwise(0)).alias("n"),
            F.when((depth > 0) & (F.length(s["word"]) < 5), F.concat(s["word"], c)).otherwise(s["word"]).alias("word"),
        )
        return F.when(s["depth"] == 0, s).otherwise(after)

    total = F.aggregate(F.split(inner, ""), start, step, lambda s: F.when((s["depth"] > 0) | (F.trim(s["word"]) == "void") & (s["n"] == 0), 0).otherwise(s["n"] + s["filled"].cast("int")))
    return F.when(signature.contains("("), total).otherwise(0)


def iso_of_nanos(nanos: Column) -> Column:
    """Instant of nanoseconds, given as text, cut to milliseconds; null for what is no number."""
    millis = F.floor(F.try_to_number(nanos, F.lit("9999999999999999999")) / 1_000_000).cast("long")
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds between two texts of nanoseconds; 0 where one is no number."""
    number = lambda x: F.try_to_number(x, F.lit("9999999999999999999"))
    return F.coalesce(F.floor((number(end) - number(start)) / 1000).cast("long"), F.lit(0))
