"""Tables to which runs add and whose documents later runs replace.

A run writes new folders only: its rows of each table, and its keys.  Then one small file, the run's entry
in the log, makes all of them visible at once.  Nothing that readers see is ever changed, so a crash
between any two steps leaves the version before, and a run costs what it carries, not what is
there.  Rows of earlier runs whose keys come again are hidden by the later run's keys: an entry says
whether there are any, and only then do readers take an anti-join.  :func:`compact` writes the visible
rows as one run.

Runs have names.  A name that is in the log is not written again, so a run repeated after a crash, or a
micro-batch delivered twice, leaves one copy.  One writer at a time is expected: of two that
commit the same version, the second gets an error and its rows stay unseen.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version int, run string, folder string, keys string, replaces boolean, base int"


def entries(spark: SparkSession, path: str) -> list:
    """The log from the last compaction on: one entry for each run that is visible, oldest first."""
    try:
        rows = spark.read.schema(_LOG).json(f"{path}/_log/*").orderBy("version").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    base = max([r["base"] for r in rows], default=0)
    return [r for r in rows if r["version"] >= base]


def _runs(spark: SparkSession, path: str) -> set[str]:
    try:
        return {r["run"] for r in spark.read.schema(_LOG).json(f"{path}/_log/*").select("run").collect()}
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def has_run(spark: SparkSession, path: str, run: str) -> bool:
    return run in _runs(spark, path)


def new_folder() -> str:
    """A name for a run's folder below the table's path; a crashed attempt's folder is never used again."""
    return f"run-{uuid.uuid4().hex}"


def commit(path: str, run: str, tables: dict[str, DataFrame], keys: DataFrame | None = None,
           folder: str | None = None, compacts: bool = False) -> bool:
    """Add a run's ``tables``; False if the log has the run already.

    ``keys`` are the documents that the run replaces, those without rows included; without it the run
    only adds.  Tables that already lie in ``folder`` (see :func:`new_folder`) are not written again.
    """
    spark = next(iter(tables.values())).sparkSession
    if has_run(spark, path, run):
        return False
    ready, folder = folder is not None, folder or new_folder()
    for name, table in tables.items():
        if not (ready and _is_there(spark, f"{path}/{folder}/{name}")):
            table.write.parquet(f"{path}/{folder}/{name}")
    before, replaces, columns = entries(spark, path), False, ""
    if keys is not None:
        keys.distinct().write.parquet(f"{path}/{folder}/_keys")
        own = spark.read.schema(keys.schema).parquet(f"{path}/{folder}/_keys")
        columns = ",".join(keys.columns)
        earlier = [f"{path}/{e['folder']}/_keys" for e in before if e["keys"]]
        if earlier and not compacts:
            replaces = not own.join(spark.read.schema(keys.schema).parquet(*earlier),
                                    keys.columns, "left_semi").isEmpty()
    version = max([e["version"] for e in before], default=0) + 1
    while True:
        entry = (version, run, folder, columns, replaces, version if compacts else 0)
        try:
            (spark.createDataFrame([entry], _LOG).coalesce(1).write.mode("error")
             .json(f"{path}/_log/{version:010d}"))
            return True
        except AnalysisException as there:
            if there.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            if version in {e["version"] for e in entries(spark, path)}:
                raise RuntimeError(f"another writer committed version {version} of {path}") from there
            version += 1  # left by a crash before its entry was whole


def _is_there(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(folder)
        return True
    except AnalysisException:
        return False


def read(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The visible rows of a table, or None before its first run."""
    found = entries(spark, path)
    if not found:
        return None
    schema = spark.read.parquet(f"{path}/{found[0]['folder']}/{table}").schema
    folder_of = lambda e, name: f"{path}/{e['folder']}/{name}"
    later = [e for e in found if e["replaces"]]
    if not later:
        return spark.read.schema(schema).parquet(*[folder_of(e, table) for e in found])
    rows, parts = None, []
    names = later[0]["keys"].split(",")
    for e in found:
        part = spark.read.schema(schema).parquet(folder_of(e, table)).withColumn("_version", F.lit(e["version"]))
        parts.append(part)
    for e in later:
        own = spark.read.parquet(folder_of(e, "_keys")).withColumn("_until", F.lit(e["version"]))
        rows = own if rows is None else rows.unionByName(own)
    hidden = rows.groupBy(*names).agg(F.max("_until").alias("_until"))
    # Nothing hides the rows of the last run that replaces, nor those after it: they take no join.
    last = max(e["version"] for e in later)
    older = [part for e, part in zip(found, parts, strict=True) if e["version"] < last]
    newer = [part for e, part in zip(found, parts, strict=True) if e["version"] >= last]
    every = reduce(DataFrame.unionByName, older)
    same = [every[n].eqNullSafe(hidden[n]) for n in names]
    condition = (every["_version"] < hidden["_until"])
    for s in same:
        condition = condition & s
    return reduce(DataFrame.unionByName, newer, every.join(hidden, condition, "left_anti")).drop("_version")


def compact(spark: SparkSession, path: str, tables: Sequence[str], keys: Sequence[str] = ("doc_id",)) -> None:
    """The visible rows of ``tables`` as one run.  Folders of earlier runs stay for readers that began before."""
    found = entries(spark, path)
    if len(found) < 2:
        return
    known = [spark.read.parquet(f"{path}/{e['folder']}/_keys").select(*keys) for e in found if e["keys"]]
    every = None
    for k in known:
        every = k if every is None else every.unionByName(k)
    commit(path, f"compact-{uuid.uuid4().hex}", {t: read(spark, path, t) for t in tables}, every, compacts=True)
