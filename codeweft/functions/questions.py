"""What a question asks for: intent, anchors, retrieval mode, and statements that are no questions.

Every rule is written once as a pattern that means the same in Java, Python and RE2, so questions
are judged one by one on the driver or as a column of a table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of questions, in the order they are tried.
INTENTS = [
    ("path", r"how\s+does?\s+(.+?)\s+(?:flow|get|reach|connect|go)\s+(?:to|from|into|through)\s+(.+)"),
    ("path", r"(?:trace|path|flow)\s+(?:from|between)\s+(.+?)\s+(?:to|and|through)\s+(.+)"),
    ("path", r"from\s+(.+?)\s+to\s+(.+)"),
    ("between", r"(?:what\s+connects?|relationship|link)\s+(?:between\s+)?(.+?)\s+(?:and|to|with)\s+(.+)"),
    ("between", r"(?:between)\s+(.+?)\s+(?:and)\s+(.+)"),
    ("dependents", r"what\s+(?:depends?\s+on|uses?|imports?|consumes?|calls?)\s+(.+)"),
    ("dependents", r"(?:dependents?|callers?|consumers?|importers?)\s+(?:of|for)\s+(.+)"),
    ("dependents", r"who\s+(?:uses?|calls?|depends?\s+on)\s+(.+)"),
    ("dependencies", r"what\s+does?\s+(.+?)\s+(?:depend\s+on|use|import|call|require)"),
    ("dependencies", r"(?:dependencies|imports)\s+(?:of|for)\s+(.+)"),
    ("flow", r"(?:trace|show|visuali[sz]e)\s+(?:the\s+)?(?:flow|path|chain|pipeline)\s+(?:of|through|for|in)\s+(.+)"),
    ("flow", r"(?:flow|lifecycle|chain)\s+(?:of|for)\s+(.+)"),
]
SMALL_WORDS = "how does the from what is are and to in of for a an this that with".split()
SQL_WORDS = ["select", "from", "where", r"group\s+by", r"order\s+by", "join", "insert", "update", "delete"]
SURE_SQL = r"\bselect\s+(?:\*|distinct|count|sum|avg|min|max|top)|\binsert\s+into\b|\bupdate\s+\w+\s+set\b|\bdelete\s+from\b|\bcount\s*\(\s*\*\s*\)"
GRAPH_WORDS = r"\b(?:flow|depends?|breaks?|calls?|imports?|references?|how|path|trace)\b"
#: A path: folders, or a name with an ending, and no blanks.
PATH_SHAPE = r"^[^\s]*[^\s/]/[^\s/][^\s]*$|^[\w.-]+\.[A-Za-z]{1,5}$"
KIND_WORTH = {
    "class": 1.0, "interface": 0.9, "trait": 0.9, "enum": 0.8, "function": 0.7, "method": 0.6, "type": 0.5, "constant": 0.4, "property": 0.3, "enum_case": 0.3, "variable": 0.2,
    "namespace": 0.1, "heading": 0.05, "tag": 0.05,
}


def classify(question: str) -> tuple[str, list[str]]:
    """Intent and anchors of one question; without a known shape its first and last telling words."""
    for intent, shape in INTENTS:
        if m := re.search(shape, question, re.I):
            return intent, [g.strip() for g in m.groups()]
    words = [w for w in re.sub(r"[?!.,;:'\"]", "", question).split() if len(w) > 2 and w.lower() not in SMALL_WORDS]
    return ("path", [words[0], words[-1]]) if len(words) >= 2 else ("flow", words)


def telling_words(question: Column) -> Column:
    bare = F.regexp_replace(question, r"[?!.,;:'\"]", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(SMALL_WORDS))


def intent_of(question: Column) -> Column:
    """Intent of each question of a column."""
    intent = F.when(F.size(telling_words(question)) >= 2, "path").otherwise("flow")
    for name, shape in reversed(INTENTS):
        intent = F.when(question.rlike(f"(?i){shape}"), name).otherwise(intent)
    return intent


def is_sql(text: Column) -> Column:
    """Whether a text is a database statement: one sure idiom, or two of its words and none of the graph's."""
    n = sum((text.rlike(rf"(?i)\b{w}\b").cast("int") for w in SQL_WORDS), F.lit(0))
    return text.rlike(f"(?i){SURE_SQL}") | ((n >= 2) & ~text.rlike(f"(?i){GRAPH_WORDS}"))


def mode_of(question: Column) -> Column:
    """``get`` for what looks like a path, else ``single``."""
    return F.when(question.rlike(PATH_SHAPE), "get").otherwise("single")


def kind_worth(kind: Column) -> Column:
    """How much a kind of symbol is worth in a ranking."""
    table = F.create_map(*[F.lit(x) for pair in KIND_WORTH.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0.1))
