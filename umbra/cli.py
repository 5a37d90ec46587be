"""Command line: ``python -m umbra [sanitize] FILE``, ``scan``, ``check``, ``install-hook``, ``clipboard``, ``ui``."""

from __future__ import annotations

import argparse
import os
import shutil
import subprocess
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.config import Config
from umbra.operators import report
from umbra.operators.python_rules import unified_diffs
from umbra.plans.sanitize import Sanitizer
from umbra.session import ship
from umbra.sources.files import as_read_text, read_files, read_text, staged_files, write_back

# The sentences that the commands print are an interface: their words are fixed values.
COMMANDS = ("sanitize", "scan", "check", "install-hook", "clipboard", "ui")
HOOK = """#!/bin/sh
# Stops a commit of staged files with secrets in them.
if ! {python} -m umbra check; then
    echo "umbra: the commit was stopped: staged files hold what look like secrets (listed above)." >&2
    echo "umbra: take them out, list them under [allowlist] in umbra.toml, or commit with --no-verify." >&2
    exit 1
fi
"""
#: (read, write) commands of a desktop's clipboard, tried in this order.
CLIPBOARDS = (
    (["wl-paste", "--no-newline"], ["wl-copy"]), (["xclip", "-selection", "clipboard", "-o"], ["xclip", "-selection", "clipboard"]),
    (["xsel", "--clipboard", "--output"], ["xsel", "--clipboard", "--input"]), (["pbpaste"], ["pbcopy"]),
    (["powershell.exe", "-NoProfile", "-Command", "Get-Clipboard -Raw"], ["clip.exe"]),
)


def local_session() -> SparkSession:
    """A quiet session on this machine."""
    session = SparkSession.builder.master(os.environ.get("UMBRA_MASTER", "local[*]")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _sanitized(spark: SparkSession, text: str, config: Config, name: str) -> DataFrame:
    rows = spark.createDataFrame([(name, text)], "name string, text string")
    return Sanitizer.from_config(config).sanitize(rows)


def _counts(df: DataFrame) -> list[tuple[str, int]]:
    return [(r["label"], r["n"]) for r in report.summary(df).collect()]


def sanitize(spark: SparkSession, options: argparse.Namespace) -> int:
    try:
        text = read_text(options.input)
    except OSError as why:
        _say(f"umbra: cannot read the input: {why}")
        return 2
    done = _sanitized(spark, text, Config.load(options.config), options.input or "stdin").persist()
    shown = unified_diffs(done, "name").select("diff") if options.diff else done.select("sanitized")
    sys.stdout.write(shown.first()[0])
    if options.preview:
        lines = [r["shown"] for r in report.preview(done, "name").orderBy("position").collect()]
        _say("\n".join([f"Preview — {len(lines)} redaction(s):", *lines]) if lines else report.summary_text([]))
    if options.audit:
        document = report.audit(done, "name").first()["audit"]
        if options.audit == "-":
            _say(document)
        else:
            with open(options.audit, "w", encoding="utf-8") as f:
                f.write(document + "\n")
    if options.summary:
        _say(report.summary_text(_counts(done)))
    done.unpersist()
    return 0


def scan(spark: SparkSession, options: argparse.Namespace) -> int:
    files = read_files(spark, options.paths or ["."], not options.no_recursive)
    sanitizer = Sanitizer.from_config(Config.load(options.config))
    rows = report.scan_report(sanitizer.scan(files), "path").orderBy("path").collect()  # one line each is printed
    if options.write and rows:
        dirty = sanitizer.scan(files, out="found").filter(F.size("found") > 0).drop("found")
        write_back(sanitizer.sanitize(dirty.withColumn("text", as_read_text(F.col("text")))))
    for r in rows:
        print(f"fixed  {r['path']}  ({r['findings']}: {r['labels']})" if options.write else f"{r['path']}: {r['findings']} finding(s) — {r['labels']}")
    total = sum(r["findings"] for r in rows)
    _say(f"\n{total} finding(s) {'sanitized' if options.write else 'found in'} {len(rows)} file(s).")
    return 1 if total and not options.write else 0


def check(spark: SparkSession, options: argparse.Namespace) -> int:
    staged = [p for p in staged_files() if os.path.isfile(p)]
    if not staged:
        return 0
    files = read_files(spark, [os.path.abspath(p) for p in staged])
    names = {os.path.abspath(p): p for p in staged}
    rows = report.scan_report(Sanitizer.from_config(Config.load(options.config)).scan(files), "path").orderBy("path").collect()
    for r in rows:
        _say(f"{names[r['path']]}: {r['findings']} finding(s) — {r['labels']}")
    return 1 if rows else 0


def install_hook(spark: SparkSession, options: argparse.Namespace) -> int:
    said = subprocess.run(["git", "rev-parse", "--git-path", "hooks"], capture_output=True, text=True)
    if said.returncode:
        _say(f"umbra: could not install the hook: {said.stderr.strip()}")
        return 2
    path = os.path.join(said.stdout.strip(), "pre-commit")
    if os.path.exists(path) and not options.force:
        _say(f"umbra: {path} exists; --force overwrites it")
        return 1
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(HOOK.format(python=sys.executable))
    os.chmod(path, 0o755)
    _say(f"Installed {path}")
    return 0


def clipboard(spark: SparkSession, options: argparse.Namespace) -> int:
    tools = next((c for c in CLIPBOARDS if shutil.which(c[0][0])), None)
    if tools is None:
        _say("umbra: no clipboard command found")
        return 2
    text = subprocess.run(tools[0], capture_output=True, text=True, check=True).stdout
    done = _sanitized(spark, text, Config.load(options.config), "clipboard").persist()
    counts = _counts(done)
    if counts:
        subprocess.run(tools[1], input=done.first()["sanitized"], text=True, check=True)
    _say(report.summary_text(counts))
    return 0


def ui(spark: SparkSession, options: argparse.Namespace) -> int:
    from umbra import web

    return web.serve(spark, options.host, options.port, options.config, not options.no_browser)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="umbra", description="Finds and redacts sensitive text.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, config: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if config:
            p.add_argument("-c", "--config")
        return p

    p = add("sanitize", sanitize)
    p.add_argument("input", nargs="?")
    for flag in ("--summary", "--preview", "--diff"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--audit", metavar="PATH")
    p = add("scan", scan)
    p.add_argument("paths", nargs="*")
    p.add_argument("--write", action="store_true")
    p.add_argument("--no-recursive", action="store_true")
    add("check", check)
    add("install-hook", install_hook, config=False).add_argument("--force", action="store_true")
    add("clipboard", clipboard)
    p = add("ui", ui)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8765)
    p.add_argument("--no-browser", action="store_true")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    words = list(sys.argv[1:] if arguments is None else arguments)
    if not words or words[0] not in (*COMMANDS, "-h", "--help"):
        words.insert(0, "sanitize")
    options = parser().parse_args(words)
    needs_spark = options.command != "install-hook"
    return options.run(spark or (local_session() if needs_spark else None), options)
