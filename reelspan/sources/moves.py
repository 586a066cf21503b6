"""Exports and restores of files: a plan as a table, checked by joins before anything is touched, then copies and moves by tasks.

A plan has a row for each file: source, destination, bytes and conflict, which is null where nothing speaks against it. Files are listed by Spark and copied in
tasks by Arrow's file systems, so both may be in any store. A copy is written beside its destination and renamed when whole, and what is there already, byte for
byte, is left as it is; so a task that is run again, or a job that was broken off, ends in the same state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

PIECE = 1 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and where the file is in it."""
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def spelled(path: str) -> str:
    """A folder in the one spelling that plans have, with a slash at its end."""
    plain = path.rstrip("/") + "/"
    return "file:///" + plain.removeprefix("file:").lstrip("/") if plain.startswith(("/", "file:")) else plain


def listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, bytes) of all files under some folders, empty ones too; a folder that is missing has none.

    The driver looks at the two upper levels only, which are media sets and their folders; each folder below is listed by a task of its own. Copies that are not whole are left out.
    """
    folders, files = [], []
    for root in map(spelled, roots):
        store, found = place(root.rstrip("/"))
        if store.get_file_info(found).type != fs.FileType.Directory:
            continue
        stem = root[: len(root) - len(found) - 1]
        upper = [(found, 2)]
        while upper:
            folder, levels = upper.pop()
            for info in store.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File:
                    files.append((stem + info.path, info.size))
                elif levels > 1:
                    upper.append((info.path, levels - 1))
                else:
                    folders.append((stem + info.path, stem))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, stem in zip(b.column("path").to_pylist(), b.column("stem").to_pylist(), strict=True):
                store, found = place(path)
                infos = [i for i in store.get_file_info(fs.FileSelector(found, recursive=True)) if i.type == fs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([stem + i.path for i in infos], pa.string()), pa.array([i.size for i in infos], pa.int64())], names=["path", "bytes"])

    known = spark.createDataFrame(files, "path string, bytes long")
    deep = spark.createDataFrame(folders, "path string, stem string").repartition(max(1, min(len(folders), 10_000)))
    every = known.union(deep.mapInArrow(run, "path string, bytes long")).distinct()
    return every.where(~F.col("path").rlike(r"/\.[^/]*\.part$"))


def digest_of(path: str) -> str | None:
    """The SHA-256 of a file, or None where there is none. It is read in pieces."""
    store, found = place(path)
    if store.get_file_info(found).type != fs.FileType.File:
        return None
    digest = hashlib.sha256()
    with store.open_input_stream(found) as file:
        while piece := file.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def restore_plan(spark: SparkSession, project: str, moved: list[str]) -> DataFrame:
    """source, destination, bytes, conflict of all files below the folders of moved files: each goes back to project/..., without its folder and the media set below it.

    Conflicts: no_media_set (a file that lies in no media set's folder), outside (a way out of the project), exists (its place is taken), and twice (several files have one place).
    """
    plans = spark.createDataFrame([], "source string, rest string, bytes long")
    for root in moved:
        inside = F.col("path").substr(F.lit(len(spelled(root)) + 1), F.length("path"))
        plans = plans.union(listed(spark, [root]).select(F.col("path").alias("source"), inside.alias("rest"), "bytes"))
    rest = F.regexp_extract("rest", "^[^/]+/(.+)$", 1)
    aimed = plans.select("source", F.when(rest != "", F.concat(F.lit(spelled(project)), rest)).alias("destination"), "bytes", F.array_contains(F.split(rest, "/"), "..").alias("out"))
    taken = listed(spark, [project]).select(F.col("path").alias("destination"), F.lit(True).alias("taken"))
    often = aimed.where("destination is not null").groupBy("destination").agg(F.count("*").alias("n"))
    checked = aimed.join(taken, "destination", "left").join(often, "destination", "left")
    conflict = F.when(F.col("destination").isNull(), "no_media_set").when(F.col("out"), "outside").when(F.col("taken"), "exists").when(F.col("n") > 1, "twice")
    return checked.select("source", "destination", "bytes", conflict.alias("conflict"))


def cleanup_plan(spark: SparkSession, generated: list[str], restored: DataFrame) -> DataFrame:
    """(path, bytes) of the files below generated folders that are not to be restored."""
    return listed(spark, generated).join(restored.select(F.col("source").alias("path")), "path", "left_anti")


def export_plan(spark: SparkSession, chosen: DataFrame, root: str, target: str, overwrite: bool = False) -> DataFrame:
    """source, destination, bytes, conflict of chosen files (relative source and destination): identical (nothing to do), differs (another file is there, unless it may be replaced), missing, twice.

    What is there already is compared by bytes in number first, then by digest, in tasks.
    """
    there = listed(spark, [root]).select(F.col("path").alias("source"), "bytes")
    made = listed(spark, [target]).select(F.col("path").alias("destination"), F.col("bytes").alias("taken"))
    home, goal = (F.lit(spelled(x)) for x in (root, target))
    aimed = chosen.select(F.concat(home, "source").alias("source"), F.concat(goal, "destination").alias("destination")).distinct()
    often = aimed.groupBy("destination").agg(F.count("*").alias("n"))
    known = aimed.join(there, "source", "left").join(made, "destination", "left").join(often, "destination")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [n is not None and n == t and digest_of(s) == digest_of(d) for s, d, n, t in zip(*(b.column(c).to_pylist() for c in ("source", "destination", "bytes", "taken")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("source", "destination", "bytes", "taken", "n")), pa.array(same, pa.bool_())], names=["source", "destination", "bytes", "taken", "n", "same"])

    judged = known.select("source", "destination", "bytes", "taken", "n").mapInArrow(compare, "source string, destination string, bytes long, taken long, n long, same boolean")
    conflict = F.when(F.col("bytes").isNull(), "missing").when(F.col("n") > 1, "twice").when(F.col("same"), "identical").when(F.col("taken").isNotNull() & F.lit(not overwrite), "differs")
    return judged.select("source", "destination", "bytes", conflict.alias("conflict"))


def _carried(source: str, destination: str, away: bool) -> str:
    """Copies or moves one file; what was done before is not done again."""
    store, found = place(destination)
    here, what = place(source)
    if here.get_file_info(what).type != fs.FileType.File:
        return "done" if away and store.get_file_info(found).type == fs.FileType.File else "missing"
    if store.get_file_info(found).type == fs.FileType.File and digest_of(source) == digest_of(destination):
        if away:
            here.delete_file(what)
        return "identical"
    folder, _, name = found.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.part"
    with here.open_input_stream(what) as a, store.open_output_stream(part) as b:
        while piece := a.read(PIECE):
            b.write(piece)
    store.move(part, found)
    if away:
        here.delete_file(what)
    return "moved" if away else "copied"


def carry_out(plan: DataFrame, away: bool = False, parts: int | None = None) -> DataFrame:
    """source, destination, outcome of the rows of a plan without conflict, written when this returns: copied, moved, identical, done or missing.

    A plan with a conflict other than identical is refused before any file is touched, with up to ten of them.
    """
    spark = plan.sparkSession
    plan = scratch.written(plan, "file-plan")
    against = plan.where("conflict is not null and conflict <> 'identical'")
    if found := against.orderBy("destination", "source").limit(10).collect():
        raise FileExistsError("nothing was touched: " + "; ".join(f"{r.source} -> {r.destination}: {r.conflict}" for r in found) + f" ({against.count()} in all)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outcome = [_carried(s, d, away) for s, d in zip(b.column("source").to_pylist(), b.column("destination").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("destination"), pa.array(outcome, pa.string())], names=["source", "destination", "outcome"])

    todo = plan.where("conflict is null").select("source", "destination")
    todo = todo.repartition(parts or max(1, spark.sparkContext.defaultParallelism), "destination")  # a file is one task's work
    return scratch.written(todo.mapInArrow(run, "source string, destination string, outcome string"), "file-outcomes")


def removed(paths: DataFrame) -> int:
    """Deletes the files of paths (path) in tasks; how many there were. Those that are gone already are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for path in b.column("path").to_pylist():
                store, found = place(path)
                if store.get_file_info(found).type == fs.FileType.File:
                    store.delete_file(found)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return scratch.written(paths.select("path").mapInArrow(run, "n long"), "removed-files").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
