"""Rule tables of patterns over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules (name, class, pattern) over single lines.
RULES = [
    ("hard_coded_secret", "CWE-798", r"(?i)(password|passwd|secret|api_?key|token)\s*[:=]\s*['\"][^'\"]{6,}['\"]"),
    ("password_in_url", "CWE-798", r"[a-z]+://[^/\s:@]+:[^/\s@]+@"),
    ("weak_hash", "CWE-327", r"(?i)\b(md5|sha1)\s*\("),
    ("shell_call", "CWE-78", r"(?i)\b(os\.system|subprocess\.[a-z_]+\(.*shell\s*=\s*True|child_process\.exec)\b"),
    ("sql_by_concatenation", "CWE-89", r"(?i)(select|insert|update|delete)\b.*['\"]\s*\+"),
    ("path_traversal", "CWE-22", r"\.\./\.\./"),
    ("script_injection", "CWE-79", r"(?i)(innerHTML\s*=|document\.write\()"),
    ("open_redirect", "CWE-601", r"(?i)redirect\(\s*(req|request)\."),
    ("request_to_private_host", "CWE-918", r"(?i)\b(curl|fetch|get)\b.*https?://(127\.0\.0\.1|localhost|169\.254\.)"),
    ("todo", "smell", r"\b(TODO|FIXME|HACK|XXX)\b"),
    ("forced_kill", "smell", r"\bkill -9\b"),
]


def scan_lines(texts: DataFrame, key: str, text: Column, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(key, line_no, rule, class): every rule that a line breaks.

    Texts that break none are dropped before they are split; all rules are tried in one pass.
    """
    whole = "|".join(f"(?:{p})" for _, _, p in rules)
    lines = texts.where(text.rlike(whole)).select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    found = F.filter(F.array(*[F.when(F.col("_line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(c).alias("class"))) for n, c, p in rules]), lambda r: r.isNotNull())
    return lines.select(key, (F.col("_i") + 1).cast("long").alias("line_no"), F.explode(found).alias("r")).select(key, "line_no", "r.rule", "r.class")


# Shapes of secrets, each with what replaces it.
SECRETS = [
    (r"(?s)<private>.*?</private>", ""),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[SECRET]"),
    (r"([a-z]+://[^/\s:@]+:)[^/\s@]+@", "$1[SECRET]@"),
    (r"(?i)((?:password|passwd|secret|api_?key|token)\s*[:=]\s*['\"])[^'\"]{6,}(['\"])", "$1[SECRET]$2"),
    (r"(?i)(\bauthorization:\s*(?:bearer|basic)\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[SECRET]"),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,})", "[SECRET]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[SECRET]"),
]


def strip_secrets(text: Column) -> Column:
    """A text without its private passages, and with its secrets replaced."""
    for shape, instead in SECRETS:
        text = F.regexp_replace(text, shape, instead)
    return text


def gates(metrics: DataFrame, rules: list[tuple[str, str, float, float]]) -> DataFrame:
    """(rule, value, verdict): each metric column against a warning and an error bound."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(c).cast("double").alias("value"), F.when(F.col(c) > e, "error").when(F.col(c) > w, "warning").otherwise("pass").alias("verdict")) for n, c, w, e in rules])
    return metrics.select(F.explode(rows).alias("g")).select("g.*")


def env_type(value: Column) -> Column:
    """Kind of a configuration value."""
    return (
        F.when(value.isNull() | (value == ""), "empty").when(value.rlike("(?i)^(true|false|yes|no|on|off)$"), "boolean").when(value.rlike(r"^-?\d+$"), "integer")
        .when(value.rlike(r"^-?\d*\.\d+$"), "number").when(value.rlike(r"^[a-z][a-z0-9+.-]*://"), "url").when(value.rlike(r"^\S+@\S+\.\S+$"), "email")
        .when(value.rlike(r"^(\.{0,2}/|~/|[A-Z]:\\)"), "path").when(value.rlike(r"^[\[{].*[\]}]$"), "json").otherwise("text")
    )


# Shapes of code that costs or leaks (name, class, pattern), over single lines.
ANTIPATTERNS = [
    ("unbounded_query", "query", r"(?i)\bselect\s+\*\s+from\s+\w+\s*(;|['\"`)]|$)"),
    ("query_in_loop", "query", r"(?i)\b(for|foreach|while)\b.*\b(query|execute|find_one|findone|fetch)\s*\("),
    ("listener_without_end", "leak", r"\baddEventListener\s*\("),
    ("timer_without_end", "leak", r"\bsetInterval\s*\("),
    ("blocking_call", "stall", r"\b(readFileSync|execSync|time\.sleep)\s*\("),
    ("plain_transport", "transport", r"\bhttp://[0-9A-Za-z]"),
    ("everything_caught", "error", r"(?i)\bexcept\s*:|\bcatch\s*\(?\s*(\w+)?\s*\)?\s*\{\s*\}"),
]
SMELLS = [
    ("todo", "note", r"\b(TODO|FIXME|HACK|XXX)\b"),
    ("stub", "stub", r"(?i)not[ _]?implemented|\bunimplemented!"),
    ("fixed_address", "value", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("fixed_port", "value", r"localhost:[0-9]{2,5}"),
    ("printed", "leftover", r"\bconsole\.(log|debug)\s*\(|\bdebugger\b"),
    ("switched_off_check", "check", r"eslint-disable|@ts-ignore|# ?noqa|# ?type: ?ignore"),
]


def counted_rules(texts: DataFrame, key: str, text: Column, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, class, texts, lines): how many texts and lines break each rule."""
    found = scan_lines(texts, key, text, rules)
    return found.groupBy("rule", "class").agg(F.countDistinct(key).alias("texts"), F.count("*").alias("lines"))


def complexity_report(symbols: DataFrame, *, least: int = 5, top: int = 50) -> DataFrame:
    """The symbols that are hardest to follow: by complexity, nesting and parameters, with the verdict of each bound."""
    verdict = F.concat_ws(",", F.when(F.col("cyclomatic") > 10, "complex"), F.when(F.col("max_nesting") > 4, "nested"), F.when(F.col("param_count") > 5, "parameters"))
    rows = symbols.where(F.col("cyclomatic") >= least).select("id", "name", "cyclomatic", "max_nesting", "param_count", verdict.alias("verdict"))
    return rows.orderBy(F.col("cyclomatic").desc(), F.col("max_nesting").desc_nulls_last(), F.col("param_count").desc_nulls_last(), "id").limit(top)


def edit_safety(files: DataFrame) -> DataFrame:
    """Verdict on editing each file (dependents, complexity, tests): ``safe``, ``careful`` or ``risky``."""
    points = F.when(F.col("dependents") >= 10, 2).when(F.col("dependents") >= 3, 1).otherwise(0) + F.when(F.col("complexity") > 20, 1).otherwise(0) + F.when(F.col("tests") == 0, 1).otherwise(0)
    return files.select("node", points.cast("long").alias("points"), F.when(points >= 3, "risky").when(points == 2, "careful").otherwise("safe").alias("verdict"))
