"""A graph of named tasks over frames: each runs once, what it wrote is found again by its key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from codeweft.runtime import shared_dir


@dataclass(frozen=True)
class Task:
    """``make`` gets the frames of ``needs`` by name; ``version`` changes the key when the code does."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    version: str = "1"
    keep: bool = field(default=True)


def key_of(task: Task, keys: dict[str, str], inputs: str) -> str:
    """Key of a task's result: its name and version, the keys of what it needs, and the state of the inputs."""
    text = "|".join([task.name, task.version, inputs, *(keys[n] for n in task.needs)])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def run(spark: SparkSession, tasks: Iterable[Task], *, inputs: str, folder: str | None = None, wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Results of the wanted tasks (default: all) by name.

    A kept result is written under its key and read back, now and by later runs with equal inputs;
    a half-written one is made anew. An unknown need or a cycle is an error.
    """
    known = {t.name: t for t in tasks}
    order = list(TopologicalSorter({t.name: t.needs for t in known.values()}).static_order())
    if missing := [n for n in order if n not in known]:
        raise KeyError(f"no task {missing[0]}")
    asked, todo = set(), list(known if wanted is None else wanted)
    while todo:
        name = todo.pop()
        if name not in asked:
            asked.add(name)
            todo += known[name].needs
    base, keys, out = (folder or f"{shared_dir(spark)}/tasks").rstrip("/"), {}, {}
    for name in order:
        task = known[name]
        keys[name] = key_of(task, keys, inputs)
        if name not in asked:
            continue
        path = f"{base}/{name}-{keys[name]}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not task.keep:
            out[name] = task.make(**{n: out[n] for n in task.needs})
            continue
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            task.make(**{n: out[n] for n in task.needs}).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out if wanted is None else {n: out[n] for n in wanted}
