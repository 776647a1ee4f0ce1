"""Generated, minified, vendored and data files among hand-written sources.

Linear support-vector machines are trained on hashed character n-grams of the path and of the kept
first line, path components, language and size shape. Labels come from *giveaways* on a bounded
sample: headers that name a generator or a foreign project, values dumped as code, well-known places
and lines no hand-written file has. Rows without a giveaway count as hand-written only if their
metadata was kept and shows an ordinary file; everything else stays unlabelled and is for the
machine alone. Giveaway phrases are masked in the features, and rows whose label does not rest on
the metadata enter a second time without it, so that files of unknown shape can be judged too.

Repositories are dealt into folds. A file is judged by the machine that was fitted on the other
folds, never by one that saw its own label or its repository's, and by its margin alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import last_version, materialise

#: Most rows that are labelled for the machines (by order of a hash of the id), folds of
#: repositories, and bits of a feature's number.
TRAIN_ROWS, FOLDS, FEATURE_BITS = 9_000, 3, 16
#: Weight of the squared hinge losses against the squared norm of the machine.
COST = 4.0

# Headers that tools leave, values kept as code, names of places and of files nobody writes by hand.
_MADE = r"(?i)(^|//|[/*]\*|\*/|#|--|;|<!--)[\s/#*!;<>\"'-]*(code generated|auto-?generated|@generated|generated (by|from|with|using)|(this (file|code) (is|was) |automatically )(auto|gener|produced))"
_FOREIGN = r"(?i)^[\s/#*!;<>\"'-]*(@license|@preserve|copyright .*contributors|imported from upstream|vendored from)|^/\*!"
_DATA = r"^(#define \w+ |[^/#]{0,60}|.{0,40}\"data:[a-z/-]{0,40};)(\[\[|\[\(|\[-?\d|\{ ?-?\d|0x[0-9a-f]|base64,|\"[A-Za-z0-9+/]{12}|b\"\\x|VALUES \()"
# The same behind a lead of any length, where one value alone may be an index or a constant.
_DATA_LATE = r"^[^/#]*[=(:{\[,]\s*(\[\[|\[\(|\[-?\d[\d.]*,|\{ ?-?\d[\d.]*,|0x[0-9a-f]+,|\"[A-Za-z0-9+/]{24}|b\"\\x)|\"data:[a-z/-]*;base64,| VALUES \("
_SQUEEZED = r"^(!function\(|\(\(\)=>|\(function\(|\.[a-z]\{|var e=|\"use strict\";)"
_MENTION = r"(?i)generat|do not edit|licen[cs]e|copyright|upstream|vendor|minif|overwritten"
_DENIED = r"(?i)\b(not|never) (auto-?)?generated\b|hand-?written|written by hand"
_PLACES = (
    r"(^|/)(node_modules|bower_components|third_party|Pods|site-packages|\.venv|\.next|__generated__|__snapshots__|lcov-report|coverage|generated-sources)/"
    r"|^(vendor|external|deps|dist)/"
)
_NAMES = (
    r"[.-]min\.(js|css)$|\.generated\.|\.pb\.go$|_pb2(_grpc)?\.py$|\.g\.dart$|\.Designer\.cs$|\.snap$|\.(js|css)\.map$|zz_generated\."
    r"|(^|/)(package-lock\.json|poetry\.lock|yarn\.lock|Cargo\.lock|Gemfile\.lock|composer\.lock|go\.sum|pnpm-lock\.yaml)$"
)
_MASK = re.compile(r"(?i)(?:code |auto-?|@|automatically )?generated|do not edit|@license|@preserve|copyright|imported from upstream|vendored|minified|^/\*!")


def _conform(files: DataFrame) -> DataFrame:
    """Latest version of each file with its metadata parsed and the fold of its repository."""
    columns = ["id", "path", "language", "gitignored", "byte_length", "metadata", "workspace", "loaded_at"]
    rows = last_version(files.where(F.col("id").isNotNull()).select(*columns), ["id"])
    meta = F.from_json("metadata", "lines bigint, maxLine bigint, head string")
    path = F.coalesce("path", F.lit(""))
    fold = F.pmod(F.xxhash64(F.coalesce("workspace", F.element_at(F.split(path, "/"), 1))), F.lit(FOLDS)).cast("int")
    return rows.select(
        "id", path.alias("path"), F.coalesce(F.lower("language"), F.lit("")).alias("language"), F.coalesce("gitignored", F.lit(0)).alias("ignored"),
        F.col("byte_length").alias("bytes"), fold.alias("fold"), meta.alias("m"),
    ).select("*", F.col("m.lines").alias("lines"), F.col("m.maxLine").alias("longest"), F.coalesce("m.head", F.lit("")).alias("head")).drop("m")


def label_of_giveaways(files: DataFrame) -> DataFrame:
    """Adds label (1 not hand-written, 0 hand-written, null unsure) and whether it rests on the first line."""
    head = F.col("head")
    header = head.rlike(_MADE) | head.rlike(_FOREIGN) | head.rlike(_DATA) | head.rlike(_DATA_LATE) | head.rlike(_SQUEEZED)
    bulk = F.coalesce(F.col("longest") >= 10_000, F.lit(False))
    place = F.col("path").rlike(_PLACES) | F.col("path").rlike(_NAMES)
    plain = F.coalesce(F.col("longest") < 1_000, F.lit(False)) & (~head.rlike(_MENTION) | head.rlike(_DENIED))
    return files.withColumn("by_head", header).withColumn("label", F.when(header | bulk | place, 1.0).when(plain, 0.0))


def _grams(texts: list[str], n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every run of ``n`` characters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = len(codes) - n + 1
    if starts <= 0:
        return row[:0], row[:0]
    value = np.full(starts, salt, np.uint64)
    for i in range(n):
        value = (value ^ codes[i : i + starts]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
    whole = row[:starts] == row[n - 1 :]
    return row[:starts][whole], (value >> np.uint64(64 - FEATURE_BITS))[whole].astype(np.int64)


def _log(value: float, base: float) -> int:
    return int(np.log(max(value, 1)) / np.log(base))


def _parts(row: tuple) -> list[str]:
    """Path components, endings and their combinations, language and size; shape where it is known."""
    path, language, ignored, size, lines, longest, _ = row
    *folders, name = path.split("/")
    stem, dot, rest = name.partition(".")
    ending, top, inner = dot + rest, folders[0] if folders else "", folders[-1] if folders else ""
    last = re.search(r"([a-z0-9]+)$", stem)
    out = [f"d:{f}" for f in folders] + [
        f"i:{ignored}", f"l:{language}", f"le:{language}|{ending}", f"te:{top}|{ending}", f"ts:{top}|{len(folders)}|{ending}", f"ie:{inner}|{ending}",
        f"la:{last.group() if last else ''}|{ending}", f"ti:{top}|{inner}",
    ]
    if size == size:
        out += [f"b:{_log(size, 2)}", f"ib:{ignored}|{_log(size, 4)}"]
    if longest == longest:
        out.append(f"m:{_log(longest, 4)}")
        if lines == lines and size == size:
            out.append(f"w:{_log(size / max(lines, 1), 2)}")
    return out


class Features:
    """Hashed features of rows as a sparse matrix; path runs, parts and first line weigh the same."""

    def __init__(self, rows: list[tuple]) -> None:
        paths = [re.sub(r"\d", "0", f"/{r[0]}$") for r in rows]
        heads = [re.sub(r"\d", "0", _MASK.sub("", r[6])) for r in rows]
        parts = [(i, zlib.crc32(t.encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS)) for i, r in enumerate(rows) for t in _parts(r)]
        of_parts = np.array(parts, np.int64).reshape(-1, 2)
        blocks = [[_grams(paths, 4, 1), _grams(paths, 6, 2)], [(of_parts[:, 0], of_parts[:, 1])], [_grams(heads, 3, 3), _grams(heads, 5, 4)]]
        row, feature, value = [], [], []
        for block in blocks:
            cells = np.sort(np.concatenate([r << FEATURE_BITS | f for r, f in block]))
            cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells
            row.append(cells >> FEATURE_BITS)
            feature.append(cells & (1 << FEATURE_BITS) - 1)
            value.append(1 / np.sqrt(np.maximum(np.bincount(row[-1], minlength=len(rows)), 1))[row[-1]])
        self.n, self.row, self.feature, self.value = len(rows), np.concatenate(row), np.concatenate(feature), np.concatenate(value)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.feature] * self.value, minlength=self.n) + weights[-1]

    def transposed(self, per_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.feature, per_row[self.row] * self.value, minlength=1 << FEATURE_BITS), per_row.sum())


def fit_machine(rows: list[tuple], label: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights, the offset last, of least squared norm and squared hinge loss, by Newton steps."""
    x, y = Features(rows), np.where(label > 0, 1.0, -1.0)
    each = cost * np.where(y > 0, len(y) / max((y > 0).sum(), 1), len(y) / max((y < 0).sum(), 1)) / 2
    w = np.zeros((1 << FEATURE_BITS) + 1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        gap = np.maximum(1 - y * x.times(w), 0)
        return w @ w / 2 + (each * gap * gap).sum(), gap

    now, gap = loss(w)
    for _ in range(12):
        gradient = w - x.transposed(2 * each * y * gap)
        active = 2 * each * (gap > 0)
        step, rest = np.zeros_like(w), -gradient
        way, size = rest.copy(), rest @ rest
        first = size
        for _ in range(12):
            bent = way + x.transposed(active * x.times(way))
            length = size / (way @ bent)
            step, rest = step + length * way, rest - length * bent
            size, before = rest @ rest, size
            if size < 0.01 * first:
                break
            way = rest + size / before * way
        scale = 1.0
        while (tried := loss(w + scale * step))[0] > now and scale > 1e-3:
            scale /= 2
        w, done, (now, gap) = w + scale * step, now - tried[0] < 1e-3 * now, tried
        if done:
            break
    return w.astype(np.float32)


_INPUT = ["path", "language", "ignored", "bytes", "lines", "longest", "head"]


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(*[pdf[c].astype(float) if c in ("bytes", "lines", "longest") else pdf[c] for c in _INPUT], strict=True))


def _fit_fold(pdf: pd.DataFrame) -> pd.DataFrame:
    fold, label = int(pdf["judged"].iloc[0]), pdf["label"].to_numpy()
    if len(set(label)) < 2:
        constant = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
        constant[-1] = 1.0 if set(label) == {1.0} else -1.0
        return pd.DataFrame({"judged": [fold], "weights": [constant.tobytes()]})
    bare = pdf[~pdf["by_head"]].assign(lines=np.nan, longest=np.nan, head="")
    return pd.DataFrame({"judged": [fold], "weights": [fit_machine(_rows(pd.concat([pdf, bare])), np.concatenate([label, bare["label"].to_numpy()])).tobytes()]})


def _machines(files: DataFrame, train_rows: int) -> dict[int, np.ndarray]:
    """The machine of each fold, fitted on labelled rows of the others; without any, all files are hand-written."""
    sampled = materialise(files.orderBy(F.xxhash64("id")).limit(train_rows))
    labelled = label_of_giveaways(sampled).where("label is not null")
    dealt = labelled.withColumn("judged", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).where("judged <> fold")
    fitted = dealt.select("judged", "label", "by_head", *_INPUT).groupBy("judged").applyInPandas(_fit_fold, "judged int, weights binary")
    out = {r.judged: np.frombuffer(r.weights, np.float32) for r in fitted.collect()}
    nothing = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
    nothing[-1] = -1.0
    return {k: out.get(k, nothing) for k in range(FOLDS)}


def _margins(files: DataFrame, machines: dict[int, np.ndarray], *keep: str) -> DataFrame:
    shared = files.sparkSession.sparkContext.broadcast(machines)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            margin = np.zeros(len(pdf))
            if len(pdf):
                x, fold = Features(_rows(pdf)), pdf["fold"].to_numpy()
                for k, weights in shared.value.items():
                    if (fold == k).any():
                        margin = np.where(fold == k, x.times(weights), margin)
            yield pdf[["id", *keep]].assign(margin=margin)

    kept = [f"{c} {files.schema[c].dataType.simpleString()}" for c in ("id", *keep)]
    return files.select(*dict.fromkeys(("id", "fold", *_INPUT, *keep))).mapInPandas(score, ", ".join([*kept, "margin double"]))


def _not_written() -> Column:
    return F.col("margin") > 0


def judge_files(files: DataFrame, *, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(file_id, margin, not_written): the decision on every file, by a machine that never saw its repository.

    At most ``train_rows`` rows are labelled and fitted on; every file is judged. Defined cases:
    repeated and re-indexed ids count once, in their latest version; null ids take no part; a null
    path is an empty one; null or broken metadata, sizes and languages give no features; a
    repository is the workspace, or else the first folder; a fold whose others know one class only
    gets that class, without labels hand-written; an empty table gives no rows; further columns
    are ignored.
    """
    rows = _conform(files)
    return _margins(rows, _machines(rows, train_rows)).select(F.col("id").alias("file_id"), "margin", _not_written().alias("not_written"))


def validate_by_repository(files: DataFrame, *, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per held-out fold of repositories: files, labelled ones and the right ones among them, and what was found without a label."""
    rows = _conform(files)
    judged = _margins(label_of_giveaways(rows), _machines(rows, train_rows), "fold", "label")
    right = F.count_if(_not_written() == (F.col("label") > 0))
    return judged.groupBy("fold").agg(
        F.count("*").alias("n_files"), F.count("label").alias("n_labelled"), F.count_if(F.col("label") > 0).alias("n_not_written"), right.alias("n_right"),
        F.count_if(F.col("label").isNull() & _not_written()).alias("n_found_unlabelled"),
    )
