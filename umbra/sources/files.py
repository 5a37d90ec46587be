"""Files as rows: listing, reading with reasons to skip, and writing back."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.text import newlines

# Folders that hold no sources, the largest file read, and the bytes looked at for a NUL.
NOISE = frozenset(".git .hg .svn node_modules .venv venv __pycache__ .mypy_cache .ruff_cache .pytest_cache dist build .idea .vscode".split())
MAX_BYTES, SNIFF_BYTES = 5 * 1024 * 1024, 1024


def list_files(paths: Iterable[str | os.PathLike], recursive: bool = True) -> Iterator[str]:
    """Files as they are, folders walked without noise folders (or one level deep); what does not exist is left out.

    Spark's own listing hides names that start with a dot, so ``.env`` would be missed.
    """
    for path in map(os.fspath, paths):
        if os.path.isfile(path):
            yield path
        elif os.path.isdir(path) and recursive:
            for folder, below, names in os.walk(path):
                below[:] = sorted(set(below) - NOISE)
                yield from (os.path.join(folder, n) for n in sorted(names))
        elif os.path.isdir(path):
            yield from sorted(e.path for e in os.scandir(path) if e.is_file())


def staged_files(cwd: str | None = None) -> list[str]:
    """Paths of added, copied and modified files in git's index; their contents are read from the working tree."""
    said = subprocess.run(["git", "diff", "--cached", "--name-only", "--diff-filter=ACM"], capture_output=True, text=True, check=True, cwd=cwd)
    return [line for line in said.stdout.splitlines() if line]


def read_files(spark: SparkSession, paths: Sequence[str | os.PathLike], recursive: bool = True) -> DataFrame:
    """``path``, ``text`` and ``skipped`` (a reason, or null); one row for each file, read on the executors.

    The folders must be reachable under the same path there. For other stores see :func:`read_store`.
    """
    files = list(list_files(paths, recursive))
    names = spark.createDataFrame([(p,) for p in files], "path string")
    parts = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                content, why = None, None
                try:
                    with open(path, "rb") as f:
                        if os.fstat(f.fileno()).st_size > MAX_BYTES:
                            why = "too large"
                        else:
                            content = f.read()
                except OSError as error:
                    why = f"unreadable: {error}"
                if content is not None and b"\0" in content[:SNIFF_BYTES]:
                    content, why = None, "binary"
                yield pd.DataFrame({"path": [path], "text": [None if content is None else content.decode("utf-8", "replace")], "skipped": [why]})

    return names.repartition(parts).mapInPandas(read, "path string, text string, skipped string")


def skip_reason(content: Column, length: Column) -> Column:
    """Why a file is not scanned, or null."""
    return F.when(length > MAX_BYTES, F.lit("too large")).when(F.expr(f"contains(substring(content, 1, {SNIFF_BYTES}), x'00')"), F.lit("binary"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The same for any store that Spark reads; names with a leading dot or underscore stay hidden there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    why = skip_reason(F.col("content"), F.col("length"))
    return files.select("path", F.when(why.isNull(), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), why.alias("skipped"))


def read_text(path: str | None, stdin: Iterable[str] | None = None) -> str:
    """A file, or standard input for None and ``-``; CRLF as LF, bad bytes replaced."""
    if path in (None, "-"):
        import sys

        return "".join(stdin if stdin is not None else sys.stdin)
    return Path(path).read_text(encoding="utf-8", errors="replace")


def as_read_text(text: Column) -> Column:
    """Scanned text as :func:`read_text` would give it."""
    return newlines(text)


def write_back(results: DataFrame, path: str = "path", text: str = "sanitized") -> None:
    """Overwrite each row's file with its text. Opt-in: the rows must have been computed from newline-normalised texts."""

    def write(rows: Iterable) -> None:
        for row in rows:
            mode = stat.S_IMODE(os.stat(row[path]).st_mode)
            with open(row[path], "w", encoding="utf-8", newline="") as f:
                f.write(row[text])
            os.chmod(row[path], mode)

    results.select(path, text).foreachPartition(write)
