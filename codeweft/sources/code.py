"""Symbols and edges out of source files: a registry of languages, each a table of line patterns.

A language is (endings, kinds of symbols with their pattern, patterns of imports, of heritage).
All patterns of a language run JVM-side over the lines of its files; a language that needs more
registers a function over Arrow batches instead. Edge builders are functions of frames, run in
the order of their registration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL = "path string, name string, kind string, line long"


@dataclass(frozen=True)
class Language:
    """Endings of files, (kind, pattern with the name as its group), and import and heritage patterns."""

    name: str
    endings: tuple[str, ...]
    symbols: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    heritage: tuple[str, ...] = ()
    parse: Callable[[str, str], Iterator[tuple[str, str, int]]] | None = field(default=None, compare=False)


# How languages declare and import.
_C_LIKE = (("class", r"^\s*(?:[a-z]+\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:[a-z]+\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:[a-z]+\s+)*enum\s+(?:class\s+)?(\w+)"))
_SCRIPT = (
    *_C_LIKE, ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
    ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*[=<]"), ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^)]*\)\s*(?::[^{]+)?\{\s*$"),
)
_EXTENDS = (r"\bclass\s+\w+(?:<[^>]*>)?\s+extends\s+([\w.]+)", r"\bimplements\s+([\w.]+)")
LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> None:
    """Add a language, or replace it."""
    LANGUAGES[language.name] = language


for _language in (
    Language("python", (".py", ".pyi"), (("class", r"^\s*class\s+(\w+)"), ("function", r"^(?:async\s+)?def\s+(\w+)"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)")), (r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)"), (r"^\s*class\s+\w+\(\s*([\w.]+)",)),
    Language("javascript", (".js", ".jsx", ".mjs", ".cjs"), _SCRIPT, (r"\bfrom\s+['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]"), _EXTENDS),
    Language("typescript", (".ts", ".tsx"), _SCRIPT, (r"\bfrom\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]"), _EXTENDS),
    Language("go", (".go",), (("function", r"^func\s+(\w+)\s*[(\[]"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("class", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b")), (r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$",)),
    Language("rust", (".rs",), (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")), (r"^\s*use\s+([\w:]+)",), (r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)\s+for\s",)),
    Language("java", (".java",), (*_C_LIKE, ("method", r"^\s+(?:public|private|protected|static|final|synchronized|abstract|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$")), (r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",), _EXTENDS),
    Language("kotlin", (".kt", ".kts"), (*_C_LIKE, ("function", r"^\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)")), (r"^\s*import\s+([\w.*]+)",), (r"\bclass\s+\w+[^:{]*:\s*([\w.]+)",)),
    Language("csharp", (".cs",), (*_C_LIKE, ("method", r"^\s+(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$")), (r"^\s*using\s+([\w.]+)\s*;",), (r"\bclass\s+\w+[^:{]*:\s*([\w.]+)",)),
    Language("php", (".php",), (*_C_LIKE, ("trait", r"^\s*trait\s+(\w+)"), ("function", r"^\s*function\s+&?(\w+)"), ("method", r"^\s+(?:public|private|protected|static|final|abstract|\s)+function\s+&?(\w+)")), (r"^\s*use\s+([\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"), _EXTENDS),
    Language("ruby", (".rb",), (("class", r"^\s*class\s+(\w+)"), ("namespace", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")), (r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",), (r"^\s*class\s+\w+\s*<\s*([\w:]+)",)),
    Language("c", (".c", ".h", ".cpp", ".hpp", ".cc"), (("class", r"^\s*(?:typedef\s+)?(?:struct|class)\s+(\w+)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)"), ("function", r"^[\w*&<>: ]+\s+\*?(\w+)\s*\([^;]*\)\s*\{?\s*$")), (r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]",), (r"\bclass\s+\w+\s*:\s*(?:public|private|protected)?\s*([\w:]+)",)),
    Language("swift", (".swift",), (("class", r"^\s*(?:[a-z]+\s+)*(?:class|struct|actor)\s+(\w+)"), ("interface", r"^\s*(?:[a-z]+\s+)*protocol\s+(\w+)"), ("enum", r"^\s*(?:[a-z]+\s+)*enum\s+(\w+)"), ("function", r"^\s*(?:[a-z]+\s+)*func\s+(\w+)")), (r"^\s*import\s+([\w.]+)",), (r"\bclass\s+\w+\s*:\s*([\w.]+)",)),
    Language("scala", (".scala",), (("class", r"^\s*(?:[a-z]+\s+)*(?:class|object)\s+(\w+)"), ("trait", r"^\s*(?:[a-z]+\s+)*trait\s+(\w+)"), ("function", r"^\s*(?:[a-z]+\s+)*def\s+(\w+)")), (r"^\s*import\s+([\w.]+)",), (r"\b(?:class|object)\s+\w+[^{]*?extends\s+([\w.]+)",)),
    Language("sql", (".sql",), (("table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp\w*\s+)?table\s+(?:if\s+not\s+exists\s+)?[\"`]?(\w+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\"`]?(\w+)"), ("view", r"(?i)^\s*create\s+(?:or\s+replace\s+)?view\s+[\"`]?(\w+)"))),
    Language("shell", (".sh", ".bash"), (("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"),), (r"^\s*(?:source|\.)\s+(\S+)",)),
    Language("markdown", (".md", ".mdx"), (("heading", r"^#{1,6}\s+(.+?)\s*$"),), (r"\]\((?!https?:)([^)#\s]+)",)),
):
    register(_language)


def _of(language: Language) -> Column:
    return reduce(lambda a, b: a | b, (F.lower("path").endswith(e) for e in language.endings))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("_i", "_line"))


def _parsed(files: DataFrame, language: Language) -> DataFrame:
    parse = language.parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *s) for p, t in zip(pdf["path"], pdf["text"], strict=True) for s in parse(p, t)], columns=["path", "name", "kind", "line"])

    return files.select("path", "text").mapInPandas(run, SYMBOL)


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, line) of files (path, text): the first pattern of its language that a line meets.

    Files of no language, and null texts, have no symbols.
    """
    files = files.where("path is not null and text is not null")
    parts = []
    for language in LANGUAGES.values():
        own = files.where(_of(language))
        if language.parse is not None:
            parts.append(_parsed(own, language))
            continue
        found = F.get(F.filter(F.array(*[F.when(F.col("_line").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("_line", p, 1).alias("name"))) for k, p in language.symbols]), lambda s: s.isNotNull()), 0)
        parts.append(_lines(own).withColumn("_s", found).where("_s is not null").select("path", "_s.name", "_s.kind", (F.col("_i") + 1).cast("long").alias("line")))
    return reduce(DataFrame.unionByName, parts)


def references(files: DataFrame, what: str = "imports") -> DataFrame:
    """(path, target, line) of what files import, or (``heritage``) extend and implement."""
    files = files.where("path is not null and text is not null")
    parts = []
    for language in LANGUAGES.values():
        patterns = getattr(language, what)
        if patterns:
            found = F.array_distinct(F.concat(*[F.regexp_extract_all("_line", F.lit(p), F.lit(1)) for p in patterns]))
            parts.append(_lines(files.where(_of(language))).select("path", F.explode(found).alias("target"), (F.col("_i") + 1).cast("long").alias("line")).where("target <> ''"))
    return reduce(DataFrame.unionByName, parts)


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(/index|/__init__|/mod)?\.[A-Za-z]+$", "")


def import_edges(files: DataFrame) -> DataFrame:
    """(src, dst, type): imports of files that are there; relative ones from the file's folder, dotted ones from the root."""
    known = files.where("path is not null").select(_stem(F.col("path")).alias("_stem"), F.col("path").alias("dst")).groupBy("_stem").agg(F.min("dst").alias("dst"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    dotted = F.col("target").rlike(r"^[\w.]+$") & ~F.col("target").startswith(".") & ~F.col("target").contains("/")
    joined = F.when(F.col("target").startswith("."), F.concat_ws("/", F.when(folder != "", folder), "target")).when(dotted, F.replace("target", F.lit("."), F.lit("/"))).otherwise(F.col("target"))
    plain = F.regexp_replace(joined, r"(^|/)\./", "$1")
    for _ in range(4):  # a/b/../c is a/c
        plain = F.regexp_replace(plain, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    wanted = references(files).select(F.col("path").alias("src"), _stem(plain).alias("_stem"), F.regexp_replace(plain, r"/$", "").alias("_whole"))
    keyed = wanted.select("src", F.explode(F.array_distinct(F.array("_stem", "_whole"))).alias("_stem"))
    return keyed.join(known, "_stem").where("src <> dst").select("src", "dst", F.lit("imports").alias("type")).distinct()


def heritage_edges(files: DataFrame) -> DataFrame:
    """(src, dst, type): files whose classes extend or implement a class of another file, if only one declares it."""
    named = symbols(files).where("kind in ('class', 'interface', 'trait')").groupBy("name").agg(F.min("path").alias("dst"), F.countDistinct("path").alias("_n")).where("_n = 1")
    wanted = references(files, "heritage").select(F.col("path").alias("src"), F.regexp_extract("target", r"(\w+)$", 1).alias("name"))
    return wanted.join(named, "name").where("src <> dst").select("src", "dst", F.lit("heritage").alias("type")).distinct()


def member_edges(found: DataFrame) -> DataFrame:
    """(path, member, owner): each method with the last class, interface or trait declared before it in its file."""
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("kind").isin("class", "interface", "trait"), F.col("name")), ignorenulls=True).over(before)
    return found.withColumn("owner", owner).where("kind = 'method' and owner is not null").select("path", F.col("name").alias("member"), "owner")


def test_edges(files: DataFrame) -> DataFrame:
    """(src, dst, type): test files with the file of the same name they test."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), r"([._-](test|spec|tests)$|^(test_|Test)|Tests?$)", "")
    is_test = F.col("path").rlike(r"(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.[A-Za-z]+$|(^|/)test_[^/]*$")
    rows = files.where("path is not null").select("path", F.lower(bare).alias("_bare"), is_test.alias("_test"))
    tests, own = rows.where("_test").select(F.col("path").alias("src"), "_bare"), rows.where("not _test").select(F.col("path").alias("dst"), "_bare")
    return tests.join(own, "_bare").select("src", "dst", F.lit("test_covers").alias("type")).distinct()


#: Edge builders, files to (src, dst, type), in the order they run.
BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"imports": import_edges, "heritage": heritage_edges, "tests": test_edges}


def edges(files: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All edges of the registered builders; an edge that several find keeps the first builder's type."""
    built = [(i, build(files)) for i, build in enumerate((builders or BUILDERS).values())]
    rows = reduce(DataFrame.unionByName, (df.select("src", "dst", "type", F.lit(i).alias("_i")) for i, df in built))
    return rows.groupBy("src", "dst").agg(F.min(F.struct("_i", "type"))["type"].alias("type"))
