"""Personal information in free text, found and replaced by typed placeholders.

Candidates are cut out by shape: addresses of mail and street, digit groups, listed name parts and
capitalised runs. Some shapes are decisive; the others say little by themselves (a run of digits,
a name that is also a word). For these the corpus decides, in the manner of information-theoretic
sanitisation: over all records, how strongly does a context term reveal a protected entity of a
type? The disclosure of a term is its pointwise mutual information with the type over the type's
information content, log(p(type | term) / p(type)) / -log p(type), at most 1. Candidates next to a
term above the threshold are taken for what the term reveals; the rest stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import materialise

TYPES = ("email", "phone", "id_number", "address", "name")
#: Least disclosure of a context term, least chance of the type beside it, and least number of
#: decisive entities it must stand beside.
DISCLOSURE, CONFIDENCE, SUPPORT = 0.5, 0.5, 3
#: Share of a listed part's occurrences alone, or as a lower-case word, from which it is a word too.
ALONE = 0.6

_AT = r"(?:@|\s?\[at\]\s?|\s?\(at\)\s?|\s?\{at\}\s?| AT | at (?=[\w-]+ dot ))"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?| DOT | dot )"
_EMAIL = re.compile(rf"(?<![\w.+@/:-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@-])(?!:[\w/~])(?!\.[A-Za-z])")

_STREET = r"(?:Street|Road|Lane|Avenue|Ave\.?|Crescent|St\.|Rd\.|Ln\.|Drive|Dr\.|Way|Close|Court|Place|Row|Square|Terrace|Gardens|Grove|Hill|Mews|Walk|Boulevard|Blvd\.?)"
_PROPER = r"[A-ZÀ-Þ][\w'’]*(?:-[A-ZÀ-Þ][\w'’]*)*"
_DOOR = r"(?:, (?:Apt|Flat|Unit|Suite|App\.|Appt) ?\w{1,4}\b)?"
_ADDRESS = re.compile(
    rf"(?<![\w/])(?:(?:Flat|Apt|Unit|Suite) \d+\w?, )?\d+[a-z]?(?:[/-]\d+)? (?:{_PROPER} ){{1,3}}{_STREET}(?![\w]){_DOOR}"
    rf"|(?<![\w/])\d+(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours|square|passage)(?: (?:de la|de l['’]|du|des|de|d['’]))? ?{_PROPER}(?: {_PROPER})*{_DOOR}"
    r"|(?<![\w/])(?:(?:Am|An der|Im|In der|Auf dem|Zum|Zur|Unter den) [A-ZÄÖÜ][a-zäöüß]+|(?:(?:Alte|Neue|Untere|Obere|Kleine|Große|Hintere|Vordere|Lange) )?[A-ZÄÖÜ][a-zäöüß-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer|steig|Straße|Str\.)) \d+ ?[a-z]?(?![\w.-])"
    rf"|(?<![\w/])(?:Calle|Avenida|Avda\.|Paseo|Plaza|Camino|Ronda|Travesía|C/)(?: (?:de las|de los|de la|del|de))?(?: {_PROPER})+,? \d+(?:, ?\d+º ?[A-Z]?)?"
)

#: Shapes of numbers: type, whether the shape decides, pattern.
_NUMBERS = [
    ("id_number", True, re.compile(r"(?<![\w.+-])[A-Z]\d{4}[A-Z]\d{3}(?![\w-])")),
    ("id_number", True, re.compile(r"(?<![\w.+-])(?!(?:AT|BY|IN|IS|NO|OF|ON|OR|TO) )[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])")),
    ("id_number", True, re.compile(r"(?<![\w.+-])\d{8}-?[A-HJ-NP-TV-Z](?![\w-])")),
    ("id_number", True, re.compile(r"(?<![\w.+-])\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}(?![\w-])")),
    ("id_number", True, re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("id_number", False, re.compile(r"(?<![\w.+-])\d{2}(?:0\d|1[0-2])(?:[0-2]\d|3[01])[-+]\d{4}(?![\w-])")),
    ("phone", True, re.compile(r"(?<![\w.])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,6}){2,6}(?![\w-])")),
    ("phone", True, re.compile(r"(?<![\w.])\(\d{3}\) ?\d{3}[-. ]\d{4}(?![\w-])")),
    ("phone", False, re.compile(r"(?<![\w.+/:-])(?:00\d{2}[- ]\d{1,3}[- ]\d{4,6}[- ]\d{3}|\d{3}[-.]\d{3}[-.]\d{4}|0\d(?:[ .]\d{2}){4}|0\d{4} \d{6}|0\d{2,4}[ /-]\d{6,8})(?![\w-])")),
    ("id_number", False, re.compile(r"(?<![\w.+/:-])\d{4} \d{4} \d{3}(?![\w-])")),
]

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Fields that hold two words and nothing else, in any case: perhaps an unlisted name.
_FIELD = re.compile(
    r"(?:(?<=[\"=<;:])|(?<=[;:] )|(?<= by )|(?<= from )|(?<= is ))([^\W\d_]+(?:['’-][^\W\d_]+)*,? (?:[A-Za-z]\. )?[^\W\d_]{2,}(?:['’-][^\W\d_]+)*(?: [A-Z]\.)?)(?=\s?[<;\"\n]|$| \+\d| \(\d| 0\d)",
    re.M,
)
_INITIAL = re.compile(r"(?:^| )[A-Z]\.(?: |$)")
_BREAK = re.compile(r"[.!?]\s+(?=[A-Z-])|\n")
_UNIT = re.compile(r"[\w'’]+|[^\w\s]")
_TITLES = frozenset("mr mrs ms miss dr prof herr frau mme mlle monsieur madame sr sra señor señora don doña".split())
_TITLE_CASE = re.compile(r"(?:[A-ZÀ-Þ][a-zà-ÿ]+|[A-ZÀ-Þ]['’][A-ZÀ-Þ][a-zà-ÿ]+|Ma?c[A-Z][a-z]+)(?:-[A-ZÀ-Þ][a-zà-ÿ]+)*$")


def _units(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Words and signs of a text; a mail address is one unit."""
    out, at = [], 0
    for lo, hi in [*spans, (len(text), len(text))]:
        out += [(m.start(), m.end(), re.sub(r"\d+", "0", m.group().lower())) for m in _UNIT.finditer(text, at, lo)]
        if hi > lo:
            out.append((lo, hi, "EMAIL"))
        at = hi
    return out


def _beside(text: str, units: list[tuple[int, int, str]], lo: int, hi: int, number: bool) -> list[str]:
    """Context terms of a span: bags of near words for numbers, the exact neighbours for names."""
    left = [u for _, e, u in units if lo - 60 <= e <= lo]
    right = [u for s, _, u in units if hi <= s <= hi + 60]
    if number:
        breaks = [m.end() for m in _BREAK.finditer(text, max(0, lo - 60), lo)]
        stop = next((m.start() for m in _BREAK.finditer(text, hi, hi + 60)), hi + 60)
        left = [u for s, e, u in units if max([lo - 60, *breaks]) <= s and e <= lo]
        right = [u for s, _, u in units if hi <= s < stop]
        return sorted({f"l:{u}" for u in left[-5:] if u[0].isalpha()} | {f"r:{u}" for u in right[:7] if u[0].isalpha()})
    terms = []
    if left and left[-1] not in ".!?":
        word = next((i for i in range(len(left) - 1, max(-1, len(left) - 7), -1) if left[i][0].isalpha()), None)
        terms = [f"L:{' '.join(left[-2:])}", f"L:{' '.join(left[-3:])}"]
        if word is not None:
            terms.append(f"W:{' '.join(left[word:])}")
    if right and right[0] not in ".!?\"'":
        terms.append(f"R:{' '.join(right[:2])}")
    return terms


def _name_spans(text: str, names: dict[str, str], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str], bool]]:
    """Spans that may be names: (from, to, listed parts, unlisted); lower-case parts alone are none."""
    tokens = []
    for m in _TOKEN.finditer(text):
        lo, hi = m.span()
        before, after = text[lo - 1 : lo], text[hi : hi + 2]
        if before in ("@", ".", "_", "/", "\\", "+", "#", "$", "-") and before or after[:1] in ("@", "_", "/", "\\", "(", "[", "+") and after[:1]:
            continue
        if after[:1] in (".", ":", "-", "=") and after[1:2].isalnum() or before.isdigit() or after[:1].isdigit():
            continue
        word = m.group()
        kind = names.get(word.lower())
        initial = len(word) == 1 and word.isupper() and after[:1] == "."
        if kind or initial or _TITLE_CASE.match(word):
            if not any(a <= lo < b for a, b in taken):
                tokens.append((lo, hi, word, kind, initial))
    i = 0
    while i < len(tokens):
        run = [tokens[i]]
        while i + len(run) < len(tokens):
            last, nxt = run[-1], tokens[i + len(run)]
            gap = text[last[1] : nxt[0]]
            if gap == " " or (last[4] and gap == ". "):
                run.append(nxt)
            elif gap == ", " and last[3] and (nxt[3] or nxt[4]) and sum(t[3] is not None for t in run) == 1 and run[-1][3]:
                run.append(nxt)
            else:
                break
        i += len(run)
        listed = [k for k, t in enumerate(run) if t[3]]
        start = text[: run[0][0]].rstrip(" -*>")[-1:] in ("", ".", "!", "?", "\n", ":", ";")
        if not listed:
            words = [t for t in run if not t[4]]
            if len(run) >= 2 and words and run[-1] is words[-1] and len(run) <= 4 and all(_TITLE_CASE.match(t[2]) for t in words):
                yield run[0][0], run[-1][1], [], True
                if start and len(run) > 2 and not run[0][4]:
                    yield run[1][0], run[-1][1], [], True
            continue
        # Contiguous groups of listed parts and initials.
        k = 0
        while k < len(listed):
            a = b = listed[k]
            while k + 1 < len(listed) and all(t[4] for t in run[b + 1 : listed[k + 1]]):
                k += 1
                b = listed[k]
            k += 1
            while a > 0 and run[a - 1][4]:
                a -= 1
            parts = [t[2].lower() for t in run[a : b + 1] if t[3]]
            if text[run[a][1] : run[a][1] + 2] == ", ":
                while b + 1 < len(run) and run[b + 1][4]:
                    b += 1
            cases = {t[2].islower() for t in run[a : b + 1] if t[3]}
            end = run[b][1] + (1 if run[b][4] else 0)
            titled = text[: run[a][0]].rstrip(" .").rpartition(" ")[2].lower() in _TITLES
            if True in cases and (len(parts) < 2 or False in cases) and not titled:
                continue
            if len(parts) == 1 and True not in cases and not run[a][4]:
                only = run[a]
                if "given" in only[3] and b + 1 < len(run) and not run[b + 1][3] and not run[b + 1][4] and _TITLE_CASE.match(only[2]) and text[only[1] : run[b + 1][0]] == " ":
                    yield run[a][0], run[b + 1][1], parts, True
                if "family" in only[3] and a > 0 and not run[a - 1][3] and run[a - 1][2].lower() not in _TITLES and not (start and a == 1):
                    yield run[a - 1][0], end, parts, True
            kinds = {t[3] for t in run[a : b + 1] if t[3]}
            yield run[a][0], end, parts, len(parts) > 1 and kinds == {"family"}


def _candidates(batches: Iterator[pd.DataFrame], names: dict[str, str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out, lower = [], dict.fromkeys(names, 0)
        for table, key, text in zip(pdf["record_table"], pdf["record_key"], pdf["_text"], strict=True):
            mails = [m.span() for m in _EMAIL.finditer(text)]
            found: list[tuple[int, int, str, bool, list[str], bool]] = [(a, b, "email", True, [], False) for a, b in mails]
            taken = list(mails)
            for m in _ADDRESS.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    taken.append(m.span())
                    found.append((*m.span(), "address", True, [], False))
            for kind, decisive, pattern in _NUMBERS if any(map(str.isdigit, text)) else ():
                for m in pattern.finditer(text):
                    if not any(a < m.end() and m.start() < b for a, b in taken):
                        taken.append(m.span())
                        found.append((*m.span(), kind, decisive, [], False))
            named = [(a, b, "name", _INITIAL.search(text[a:b]) is not None, parts, more) for a, b, parts, more in _name_spans(text, names, taken)]
            covered = {(a, b) for a, b, *_ in named}
            fields = (m.span(1) for m in _FIELD.finditer(text))
            named += [(a, b, "name", False, [], True) for a, b in fields if (a, b) not in covered and not any(x < b and a < y for x, y in taken)]
            found += named
            if found:
                units = _units(text, mails)
                for a, b, kind, decisive, parts, more in found:
                    terms = [] if kind in ("email", "address") else _beside(text, units, a, b, kind != "name")
                    out.append((table, key, a, b, text[a:b], kind, decisive, parts, more, terms))
            for w in _TOKEN.findall(text):
                if w in lower:
                    lower[w] += 1
        out += [("", w, n, 0, "", "word", False, [], False, []) for w, n in lower.items() if n]
        yield pd.DataFrame(out, columns=["record_table", "record_key", "lo", "hi", "value", "kind", "decisive", "parts", "more", "terms"])


_CANDIDATE = "record_table string, record_key string, lo int, hi int, value string, kind string, decisive boolean, parts array<string>, more boolean, terms array<string>"


def find_personal_data(records: DataFrame, name_parts: DataFrame, *, disclosure: float = DISCLOSURE, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Spans of personal information: (record_table, record_key, lo, hi, pii_type, pii_value).

    ``records`` has record_table, record_key and text, one row per record; ``name_parts``
    (name_part, part_kind) is a fixed list and refused above 100,000 rows. Offsets count code
    points. Defined cases: null and empty texts have no spans; repeated rows count once; texts
    are read whole; overlapping spans of names keep the longest accepted one; a corpus without
    decisive entities of a type accepts decisive shapes only; other columns are ignored.
    """
    listed = name_parts.where("name_part is not null").groupBy(F.lower("name_part").alias("w")).agg(F.array_join(F.array_sort(F.collect_set("part_kind")), " ").alias("k")).limit(100_001).collect()
    if len(listed) > 100_000:
        raise ValueError("name_parts is not a list of name parts")
    names = {r.w: r.k or "given" for r in listed}
    texts = records.where(F.length("text") > 0).select("record_table", "record_key", F.col("text").alias("_text")).distinct()
    cut = materialise(texts.mapInPandas(lambda it: _candidates(it, names), _CANDIDATE))

    # A listed part that the corpus also writes in lower case, or mostly alone, reveals little.
    spans = cut.where("kind <> 'word'")
    uses = spans.where("kind = 'name'").select(F.explode("parts").alias("part"), ((F.size("parts") > 1) & ~F.col("more")).alias("pair"))
    uses = uses.groupBy("part").agg(F.count_if(~F.col("pair")).alias("alone"), F.count_if("pair").alias("paired"))
    lower = cut.where("kind = 'word'").groupBy(F.col("record_key").alias("part")).agg(F.sum("lo").alias("lower"))
    counted = uses.join(lower, "part", "outer").na.fill(0)
    # The parts are a fixed list of bounded length, so one row holds those that are words too.
    words = counted.where(F.col("alone") + F.col("lower") >= F.greatest(ALONE * (F.col("alone") + F.col("lower") + F.col("paired")), F.lit(10))).agg(F.collect_set("part").alias("_words"))
    spans = spans.crossJoin(F.broadcast(words))
    telling = F.size(F.array_except("parts", "_words")) > 0
    decisive = F.when(F.col("kind") == "name", ~F.col("more") & (telling | (F.col("decisive") & (F.size("parts") > 0)))).otherwise(F.col("decisive"))
    spans = spans.withColumn("decisive", F.coalesce(decisive, F.lit(False))).withColumn("domain", F.when(F.col("kind") == "name", "name").otherwise("number")).drop("_words")

    # How strongly each context term reveals each type, against all candidates it stands beside.
    # Most undecided names are words, so they count against a term; undecided digits do not.
    open_kinds = spans.where("kind not in ('email', 'address')")
    shares = open_kinds.groupBy("domain").agg(F.count("*").alias("all_n"))
    base = open_kinds.where("decisive").groupBy("domain", F.col("kind").alias("type")).agg(F.count("*").alias("type_n")).join(F.broadcast(shares), "domain")
    seen = open_kinds.select("domain", "kind", "decisive", F.explode("terms").alias("term"))
    beside = seen.groupBy("domain", "term").agg(
        F.count_if(F.col("decisive") | (F.col("domain") == "name")).alias("n"), *[F.count_if(F.col("decisive") & (F.col("kind") == t)).alias(t) for t in ("phone", "id_number", "name")]
    )
    unpivoted = beside.select("domain", "term", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("hits")) for t in ("phone", "id_number", "name")])).alias("h"))
    rated = unpivoted.select("domain", "term", "n", "h.type", "h.hits").where(F.col("hits") >= support).join(F.broadcast(base), ["domain", "type"])
    prior = F.greatest(F.col("type_n") / F.col("all_n"), F.lit(1e-9))
    strength = F.when(prior >= 1, 1.0).otherwise(F.ln(F.col("hits") / F.col("n") / prior) / -F.ln(prior))
    revealing = rated.withColumn("strength", strength).where((F.col("strength") >= disclosure) & (F.col("hits") >= confidence * F.col("n")))

    doubtful = open_kinds.where("not decisive")
    span = ["record_table", "record_key", "lo", "hi"]
    judged = doubtful.select(*span, "domain", "kind", "value", F.explode("terms").alias("term")).join(revealing, ["domain", "term"])
    accepted = judged.where(F.col("kind") == F.col("type")).groupBy(*span).agg(F.max(F.struct("strength", "type", "value")).alias("best"))
    sure = spans.where("decisive").select("record_table", "record_key", "lo", "hi", F.col("kind").alias("pii_type"), F.col("value").alias("pii_value"))
    likely = accepted.select(*span, F.col("best.type").alias("pii_type"), F.col("best.value").alias("pii_value"))
    return _longest(sure.unionByName(likely))


def _longest(spans: DataFrame) -> DataFrame:
    """Drop spans that lie inside a longer one of the same record; a record's spans are few."""

    def inside(other, own):
        return (other["lo"] <= own["lo"]) & (own["hi"] <= other["hi"]) & (other["hi"] - other["lo"] > own["hi"] - own["lo"])

    kept = F.collect_set(F.struct("lo", "hi", "pii_type", "pii_value")).alias("all")
    grouped = spans.groupBy("record_table", "record_key").agg(kept)
    outer = F.filter("all", lambda own: ~F.exists("all", lambda other: inside(other, own)))
    return grouped.select("record_table", "record_key", F.explode(outer).alias("s")).select("record_table", "record_key", "s.*")


def sanitise(records: DataFrame, spans: DataFrame) -> DataFrame:
    """(record_table, record_key, text): every span replaced by its type in brackets.

    Records without spans, null texts included, stay as they are.
    """

    def replace(text: str | None, lows: list[int] | None, highs: list[int] | None, kinds: list[str] | None) -> str | None:
        if text is None or lows is None:
            return text
        end = len(text)
        for lo, hi, kind in sorted(zip(lows, highs, kinds, strict=True), reverse=True):
            if hi <= end:
                text, end = f"{text[:lo]}[{kind.upper()}]{text[hi:]}", lo
        return text

    @F.pandas_udf("string")
    def replaced(text: pd.Series, lows: pd.Series, highs: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([replace(*row) for row in zip(text, lows, highs, kinds, strict=True)])

    listed = spans.groupBy("record_table", "record_key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "pii_type"))).alias("s"))
    joined = records.join(listed, ["record_table", "record_key"], "left")
    return joined.select("record_table", "record_key", replaced("text", F.col("s.lo"), F.col("s.hi"), F.col("s.pii_type")).alias("text"))
