from __future__ import annotations

import json
import os
import subprocess
import threading
from urllib import error, request

import pytest

from umbra import cli, web
from umbra.config import Config
from umbra.plans.sanitize import Sanitizer
from umbra.sources.files import list_files, read_files, read_store
from umbra.streaming.sanitize import findings_by_window, write_stream

KEY = "ghp_" + "A" * 36


@pytest.fixture
def tree(tmp_path):
    for name, content in {".env": f"TOKEN={KEY}\r\nX=1\r\n", "a/plain.txt": "nothing", ".git/config": KEY, "a/node_modules/x.js": KEY}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content.encode())
    (tmp_path / "blob.bin").write_bytes(b"x\0" + KEY.encode())
    (tmp_path / "big.txt").write_bytes(b"a" * (5 * 1024 * 1024 + 1))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe " + KEY.encode())
    return tmp_path


def test_listing(tree):
    names = sorted(os.path.relpath(p, tree) for p in list_files([tree, tree / "missing"]))
    assert names == [".env", "a/plain.txt", "bad.txt", "big.txt", "blob.bin"]
    assert sorted(os.path.basename(p) for p in list_files([tree], recursive=False)) == [".env", "bad.txt", "big.txt", "blob.bin"]


def test_reading(spark, tree):
    rows = {os.path.relpath(r.path, tree): r for r in read_files(spark, [tree]).collect()}
    assert rows["blob.bin"].skipped == "binary" and rows["big.txt"].skipped == "too large"
    assert rows[".env"].text.endswith("\r\n") and rows["bad.txt"].text.startswith("�� ")
    stored = {os.path.basename(r.path): r for r in read_store(spark, str(tree)).collect()}
    assert stored["bad.txt"].text == rows["bad.txt"].text and stored["blob.bin"].skipped == "binary" and stored["big.txt"].skipped == "too large"


def test_scan_and_write(spark, tree, capsys):
    assert cli.main(["scan", str(tree)], spark) == 1
    said = capsys.readouterr()
    assert ".env: 1 finding(s) — GitHub Token" in said.out and "2 finding(s) found in 2 file(s)." in said.err
    assert cli.main(["scan", str(tree), "--write"], spark) == 0
    assert (tree / ".env").read_bytes() == b"TOKEN=[REDACTED: GitHub Token]\nX=1\n"
    assert (tree / ".git/config").read_text() == KEY
    capsys.readouterr()
    assert cli.main(["scan", str(tree / "a")], spark) == 0


def test_sanitize_command(spark, tree, tmp_path, capsys):
    path = str(tree / ".env")
    assert cli.main([path, "--summary", "--preview", "--audit", str(tmp_path / "audit.json")], spark) == 0
    said = capsys.readouterr()
    assert said.out == "TOKEN=[REDACTED: GitHub Token]\nX=1\n"
    assert "Redacted 1 item(s):\n  - GitHub Token: 1" in said.err and "Ln 1" in said.err and KEY not in said.err
    audit = json.loads((tmp_path / "audit.json").read_text())
    assert audit["redaction_count"] == 1 and audit["version"] == 1
    assert cli.main(["sanitize", path, "--diff"], spark) == 0
    assert capsys.readouterr().out.startswith(f"--- {path} (original)\n+++ {path} (sanitized)\n")
    assert cli.main(["sanitize", str(tree / "missing")], spark) == 2


def test_check_and_hook(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["install-hook"], spark) == 2
    subprocess.run(["git", "init", "-q"], check=True)
    assert cli.main(["install-hook"], spark) == 0 and os.access(".git/hooks/pre-commit", os.X_OK)
    assert cli.main(["install-hook"], spark) == 1 and cli.main(["install-hook", "--force"], spark) == 0
    (tmp_path / "f.txt").write_text("ok")
    subprocess.run(["git", "add", "f.txt"], check=True)
    assert cli.main(["check"], spark) == 0
    (tmp_path / "f.txt").write_text(KEY)
    assert cli.main(["check"], spark) == 1 and "f.txt: 1 finding(s)" in capsys.readouterr().err


def test_config_file(tmp_path):
    (tmp_path / "umbra.toml").write_text('redact_pii = true\nplaceholder_template = "<{label}>"\n[allowlist]\npatterns = ["x"]\n[[rules]]\nname = "n"\nlabel = "L"\npattern = "p"\ngroup = "1"\n')
    (tmp_path / "sub").mkdir()
    config = Config.load(start=tmp_path / "sub")
    assert config.redact_pii and config.allowlist_patterns == ("x",) and config.custom_rules[0].group == 1
    assert Config.from_dict({"unknown": 1}) == Config()
    with pytest.raises(KeyError):
        Config.from_dict({"rules": [{"name": "n"}]})


def test_web(spark):
    handle = web.handler(spark)
    done = handle({"text": f"x {KEY} a@b.org", "redact_pii": True})
    assert done == {"sanitized": "x [REDACTED: GitHub Token] [REDACTED: Email Address]", "count": 2, "summary": [{"label": "Email Address", "n": 1}, {"label": "GitHub Token", "n": 1}]}
    server = web.server(spark, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        reply = request.urlopen(request.Request(f"{base}/api/sanitize", json.dumps({"text": KEY}).encode()), timeout=60)
        assert json.load(reply)["count"] == 1
        assert b"<html" in request.urlopen(base, timeout=60).read()
        for path, body, code in (("/api/sanitize", b"{", 400), ("/other", b"{}", 404)):
            with pytest.raises(error.HTTPError) as why:
                request.urlopen(request.Request(base + path, body), timeout=60)
            assert why.value.code == code
    finally:
        server.shutdown()


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, f"x {KEY}"), (2, "clean")], "id long, text string").write.parquet(source)
    stream = spark.readStream.schema("id long, text string").parquet(source)
    write_stream(stream, Sanitizer(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1].sanitized == "x [REDACTED: GitHub Token]" and rows[2].redaction_count == 0 and "matches" not in rows[1]


def test_stream_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60) AS ts, concat('k {KEY}', id) AS text FROM range(40)").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, text string").parquet(source)
    query = findings_by_window(stream, Sanitizer(), "ts").writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.sql("SELECT n FROM found ORDER BY start").collect()] == [10, 10, 10, 10]


def test_file_scan_is_said_to_be_the_small_case(spark):
    from umbra import catalog

    got = {r.name: (r.findings, r.skipped) for r in catalog.file_scan(spark, "").collect()}
    assert set(got) == {".env", "blob.bin", "plain.txt"} and got["blob.bin"][1] == "binary" and got[".env"][0] == 1
    assert "own sources" not in catalog.file_scan.__doc__ and "read_store" in catalog.file_scan.__doc__
