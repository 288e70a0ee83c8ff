"""Markdown trees and JSONL files as DataFrames, and a stream of edited files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from math import ceil
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lodestone.session import cut

#: Folders that are never scanned.
SKIPPED = (".cache", ".audit", ".git", ".dreams", "node_modules")
NAMES = "path string, modified double, size long"
FILES = f"{NAMES}, text string, damaged boolean"


def walk(root: str, extra_skip: tuple[str, ...] = (), include_parent: bool = False) -> list[tuple[str, float, int]]:
    """``(path relative to root, modified, size)`` of the markdown files under ``root``.

    Names that begin with a dot, skipped folders, symbolic links and unreadable
    folders are left out; ``.md`` counts in any case.  ``include_parent`` adds the
    ``MEMORY.md`` beside ``root``.  Order: length of the path, then the path.
    """
    found: list[tuple[str, float, int]] = []
    skip = set(SKIPPED) | set(extra_skip)

    def visit(folder: Path) -> None:
        try:
            entries = list(os.scandir(folder))
        except OSError:
            return
        for entry in entries:
            if entry.name in skip or entry.name.startswith(".") or entry.is_symlink():
                continue
            if entry.is_dir():
                visit(Path(entry.path))
            elif entry.is_file() and entry.name.lower().endswith(".md"):
                stat = entry.stat()
                found.append((os.path.relpath(entry.path, root), stat.st_mtime, stat.st_size))

    visit(Path(root))
    parent = Path(root).parent / "MEMORY.md"
    if include_parent and parent.is_file() and not parent.is_symlink():
        stat = parent.stat()
        found.append(("../MEMORY.md", stat.st_mtime, stat.st_size))
    return sorted(found, key=lambda x: (len(x[0]), x[0]))


def list_markdown(spark: SparkSession, root: str, extra_skip: tuple[str, ...] = (), include_parent: bool = False) -> DataFrame:
    """``path, modified, size``: what ``walk`` finds, listed by the tasks, one job for each level of the tree.

    ``root`` is a folder that all machines see.
    """
    skip = set(SKIPPED) | set(extra_skip)

    def visit(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                try:
                    entries = list(os.scandir(Path(root, folder)))
                except OSError:
                    continue
                for e in entries:
                    if e.name in skip or e.name.startswith(".") or e.is_symlink():
                        continue
                    if e.is_dir():
                        rows.append((os.path.join(folder, e.name), None, None))
                    elif e.is_file() and e.name.lower().endswith(".md"):
                        stat = e.stat()
                        rows.append((os.path.join(folder, e.name), stat.st_mtime, stat.st_size))
            yield pd.DataFrame(rows, columns=["path", "modified", "size"]).astype({"path": object, "modified": "Float64", "size": "Int64"})

    level = spark.createDataFrame([("",)], "path string")
    levels: list[DataFrame] = []
    while True:
        there = cut(level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(visit, NAMES))
        levels.append(there.where("modified is not null"))
        level = there.where("modified is null").select("path")
        if level.isEmpty():
            break
    parent = Path(root).parent / "MEMORY.md"
    if include_parent and parent.is_file() and not parent.is_symlink():
        stat = parent.stat()
        levels.append(spark.createDataFrame([("../MEMORY.md", stat.st_mtime, stat.st_size)], NAMES))
    return reduce(DataFrame.unionByName, levels)


def read_markdown(spark: SparkSession, root: str, files_per_task: int = 256, **options) -> DataFrame:
    """The files of a tree: ``path, modified, size, text, damaged``.

    Names are listed and texts read by the tasks, ``files_per_task`` each.  Bytes that
    aren't UTF-8 become U+FFFD, and ``damaged`` says so.
    """
    names = cut(list_markdown(spark, root, **options))

    def load(batches: Iterator) -> Iterator:
        for batch in batches:
            raw = [Path(root, p).read_bytes() for p in batch["path"]]
            batch["text"] = [r.decode("utf-8", errors="replace") for r in raw]
            batch["damaged"] = [t.encode("utf-8", errors="surrogatepass") != r for t, r in zip(batch["text"], raw, strict=True)]
            yield batch

    return names.repartition(max(1, ceil(names.count() / files_per_task))).mapInPandas(load, FILES)


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), drop_bad: bool = False, missing_ok: bool = False) -> DataFrame:
    """Records of a JSON-lines file; blank lines and those that begin with ``//`` or ``#`` are skipped.

    A line that doesn't parse or lacks a required field raises an error, or with
    ``drop_bad`` is left out.  A file that isn't there is an error, or with
    ``missing_ok`` empty (as labels are that nobody gave yet).
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path).select(F.btrim("value").alias("line")).where((F.length("line") > 0) & ~F.col("line").rlike("^(//|#)"))
    parsed = raw.select("line", F.from_json("line", schema).alias("r"))
    ok = F.try_parse_json("line").isNotNull() & F.col("r").isNotNull()
    for name in required:
        ok = ok & F.col(f"r.{name}").isNotNull()
    if drop_bad:
        return parsed.where(ok).select("r.*")
    checked = parsed.select(F.when(ok, F.col("r")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: bad record: "), F.left("line", F.lit(80))))).alias("r"))
    return checked.select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Hadoop knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, verdict, notes, labeled_at`` (the line's number): verdicts on cases; a missing file gives none.

    Lines whose case isn't named by a text are left out; later lines hold
    (``evaluate.latest_labels``).
    """
    schema = "case_id string, verdict string, notes string, labeled_at long"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    # One whole file is one row, so that lines have numbers; labels are written by hand.
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("labeled_at", "line"))
    kept = lines.where((F.length(F.btrim("line")) > 0) & ~F.btrim("line").rlike("^(//|#)"))
    parsed = kept.withColumn("v", F.parse_json("line"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias
    named = parsed.where(F.schema_of_variant(F.try_variant_get("v", "$.caseId", "variant")) == "STRING")
    return named.select(text("caseId")("case_id"), text("verdict")("verdict"), text("notes")("notes"), F.col("labeled_at").cast("long"))


def read_present(paths: DataFrame, root: str) -> DataFrame:
    """``path, text`` of the files of a batch that are still there; the tasks read them.

    A file that is gone is left out (the stream emits its removal next); any other
    failure to read is raised, so that the batch isn't taken as done.
    """

    def load(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = []
            for p in batch["path"]:
                try:
                    texts.append(Path(root, p).read_text(encoding="utf-8", errors="replace"))
                except (FileNotFoundError, NotADirectoryError):
                    texts.append(None)
            batch["text"] = texts
            yield batch[batch["text"].notna()]

    return paths.select("path").mapInPandas(load, "path string, text string")


class _EditedFiles(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._now(start)
        return self.readBetweenOffsets(start, now), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [(p, float(modified), None) for p, modified in end.items() if start.get(p) != modified]
        return iter(rows + [(p, None, None) for p in start if p not in end])

    def _now(self, start: dict) -> dict:
        """The next offset; what can't be read just now stays as it was in ``start``, so that it comes once it can."""
        if not os.path.isdir(self.root):
            return start
        there = {path: modified for path, modified, _ in walk(self.root)}
        now = {p: modified for p, modified in there.items() if os.access(Path(self.root, p), os.R_OK)}
        for p in start:
            if p not in now and (p in there or not self._gone(p)):
                now[p] = start[p]
        return now

    def _gone(self, path: str) -> bool:
        """Whether a file that the walk didn't find isn't there; a folder that can't be listed or entered says nothing."""
        try:
            os.lstat(Path(self.root, path))
        except (FileNotFoundError, NotADirectoryError):
            return True
        except OSError:
            return False
        return os.access(Path(self.root, path).parent, os.R_OK)


class EditedMarkdown(DataSource):
    """A stream source that emits the name of a file whenever it is new or was edited in place.

    A file that was removed comes without a time of change; ``size`` is null.  Texts
    aren't emitted: ``read_present`` reads them in the tasks.  The offset is a snapshot of paths and times of change, so an edit is seen,
    which Spark's own file source doesn't do.
    """

    @classmethod
    def name(cls) -> str:
        return "edited_markdown"

    def schema(self) -> str:
        return NAMES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _EditedFiles(self.options)


__all__ = ["EditedMarkdown", "list_markdown", "read_jsonl", "read_labels", "read_markdown", "read_present", "walk"]
