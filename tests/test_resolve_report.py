from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from umbra.config import Config
from umbra.functions.text import entropy, fingerprint, spans
from umbra.operators import report
from umbra.operators.detect import MATCHES
from umbra.operators.python_rules import BackendUnavailable, Counted, HttpBackend, named_parts, parse_reply, unified_diffs
from umbra.operators.resolve import resolve, resolve_relational
from umbra.plans.sanitize import Sanitizer


def brute(matches):
    """Islands one by one; the winner is the first of highest confidence, then length."""
    out, island = [], []
    for m in [*sorted(matches, key=lambda m: (m[0], m[1], m[2])), None]:
        if island and (m is None or m[0] >= max(x[1] for x in island)):
            rep = max(island, key=lambda x: (x[6], x[1] - x[0]))
            out.append((min(x[0] for x in island), max(x[1] for x in island), *rep[2:]))
            island = []
        if m is not None:
            island.append(m)
    return out


def random_matches(seed):
    rng, out = random.Random(seed), []
    for _ in range(rng.randint(0, 12)):
        start, ord_ = rng.randint(0, 30), rng.randint(0, 4)
        end = start + rng.randint(1, 8)
        if any(x[:3] == (start, end, ord_) for x in out):
            continue
        out.append((start, end, ord_, f"k{ord_}", f"l{ord_}", f"v{start}-{end}", rng.choice([0.5, 0.9]), f"k{ord_}"))
    return out


def test_resolve_both_ways(spark):
    cases = [random_matches(i) for i in range(300)] + [[(0, 10, 0, "a", "a", "v", 0.5, "a"), (5, 15, 1, "b", "b", "w", 0.9, "b")], [(0, 5, 0, "a", "a", "v", 0.5, "a"), (5, 9, 0, "a", "a", "w", 0.5, "a")]]
    df = spark.createDataFrame(list(enumerate(cases)), f"id long, matches {MATCHES}").repartition(4)
    rows = {r.id: [tuple(m) for m in r.r] for r in df.select("id", resolve(F.col("matches")).alias("r")).collect()}
    islands = {i: [] for i in rows}
    for r in resolve_relational(df.select("id", F.explode("matches").alias("m")), "id").orderBy("start").collect():
        islands[r.id].append(tuple(r)[1:])
    for i, case in enumerate(cases):
        want = brute(case)
        assert rows[i] == want
        assert islands[i] == [(m[0], m[1], *m[3:]) for m in want]


def test_spans_against_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 é😀\n") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in df.select("text", spans(F.col("text"), r"(?U)a+\b|[b1]é?").alias("s")).collect():
        assert [(s.start, s.end, s.value) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"a+\b|[b1]é?", r.text)]


def test_scalars(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("0123456789abcdef",)], "v string")
    assert [round(r[0], 9) for r in df.select(entropy(F.col("v"))).collect()] == [0, 0, 1, 4]
    import hashlib

    got = df.limit(1).select(fingerprint(F.lit("é"), F.lit("salt"))).first()[0]
    assert got == hashlib.sha256("salté".encode()).hexdigest()[:12]


TEXT = "first line\nmail a.b@example.org and 10.0.0.1 here\n" + "x" * 100 + " 192.168.1.1 " + "y" * 100 + "\nlast"


def scanned(spark):
    return Sanitizer.from_config(Config(redact_pii=True)).scan(spark.createDataFrame([(1, TEXT), (2, "clean")], "doc_id long, text string"))


def test_reports(spark):
    df = scanned(spark)
    assert [tuple(r) for r in report.summary(df).collect()] == [("Email Address", 1), ("IPv4 Address", 2)]
    assert [tuple(r) for r in report.scan_report(df, "doc_id").collect()] == [(1, 3, "Email Address, IPv4 Address")]
    assert tuple(report.scan_totals(report.scan_report(df, "doc_id")).first()) == (1, 3)
    assert report.summary_text([]) == "No sensitive data detected."
    assert report.summary_text([("B", 1), ("A", 2)]) == "Redacted 3 item(s):\n  - A: 2\n  - B: 1"
    assert "value" not in report.findings(df, "doc_id").columns


def test_preview(spark):
    lines = [r.shown for r in report.preview(scanned(spark), "doc_id").orderBy("position").collect()]
    assert lines[0] == "  Ln 2    Email Address  mail [Email Address] and 10.0.0.1 here"
    assert lines[1] == "  Ln 2    IPv4 Address   mail a.b@example.org and [IPv4 Address] here"
    assert lines[2].startswith("  Ln 3    IPv4 Address   …xxx") and lines[2].endswith("y…") and "[IPv4 Address]" in lines[2] and "192" not in lines[2]
    assert len(lines[2].split("  ", 4)[-1].strip()) <= 72 + 2 + 20


def test_audit(spark):
    rows = report.audit(scanned(spark), "doc_id", salt="s").orderBy("doc_id").collect()
    doc = json.loads(rows[0].audit)
    assert list(doc) == ["version", "salt", "redaction_count", "records"] and doc["redaction_count"] == 3 and doc["salt"] == "s"
    assert list(doc["records"][0]) == ["kind", "label", "detector", "start", "end", "length", "fingerprint"]
    assert all(re.fullmatch("[0-9a-f]{12}", r["fingerprint"]) for r in doc["records"]) and "example" not in rows[0].audit
    salts = {json.loads(r.audit)["salt"] for r in report.audit(scanned(spark), "doc_id").collect()}
    assert len(salts) == 1


class Fake:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, prompt):
        if self.reply is None:
            raise BackendUnavailable("down")
        return self.reply


def test_model_rule(spark):
    reply = 'Here: [{"text": " pig latin ", "type": "Phrase"}, {"text": "invented"}, {"text": "abc"}, 7]'
    assert named_parts(reply, 4) == [{"value": "pig latin", "label": "Phrase"}, {"value": "invented", "label": "Sensitive Value"}]
    assert parse_reply("no json") == parse_reply('{"a": 1}') == parse_reply("[1] or [2]") == parse_reply("] [") == []
    assert parse_reply('{"found": [{"text": "x"}]} ok') == [{"text": "x"}]
    df = spark.createDataFrame([("say pig latin now, pig latin",), (" \n",), (None,), ("\\Epig latin\\E",)], "text string").repartition(2)
    done = sorted(str(r.sanitized) for r in Sanitizer.from_config(Config(), Fake(reply)).sanitize(df).collect())
    assert done == sorted(["say [REDACTED: Phrase] now, [REDACTED: Phrase]", " \n", "None", "\\E[REDACTED: Phrase]\\E"])
    awkward = Fake(json.dumps([{"text": "a\\E.b\\Qc"}]))
    odd = spark.createDataFrame([("xa\\E.b\\Qcy a\\E+b",)], "text string")
    assert Sanitizer.from_config(Config(), awkward).sanitize(odd).first().sanitized == "x[REDACTED: Sensitive Value]y a\\E+b"


def test_model_failures_are_counted(spark):
    failures = Counted(spark)
    df = spark.createDataFrame([("say pig latin now",), ("more",), (" ",)], "text string")
    done = Sanitizer.from_config(Config(), Fake(None), failures).sanitize(df).collect()
    assert {r.sanitized for r in done} == {"say pig latin now", "more", " "} and failures.total.value == 2


def test_http_backend():
    import http.server
    import threading

    asked = []

    class Model(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.client_address))
            raw = json.dumps({"response": f"reply {len(asked)}"}).encode()
            self.send_response(500 if len(asked) == 3 else 200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    backend = HttpBackend("m", f"http://127.0.0.1:{server.server_port}", 10)
    try:
        assert [backend.complete("a"), backend.complete("b")] == ["reply 1", "reply 2"]
        assert asked[0][:2] == ("/api/generate", {"model": "m", "prompt": "a", "stream": False, "options": {"temperature": 0}}) and asked[0][2] == asked[1][2]
        import pickle

        import pytest

        with pytest.raises(BackendUnavailable):
            backend.complete("c")
        assert pickle.loads(pickle.dumps(backend)).complete("d") == "reply 4"
    finally:
        server.shutdown()
    with pytest.raises(BackendUnavailable):
        HttpBackend("m", "http://127.0.0.1:9", 1).complete("e")


def test_diff(spark):
    df = spark.createDataFrame([("a\nb\n", "a\nc\n", "f"), (None, None, "g"), ("same", "same", "h")], "x string, y string, n string")
    want = {"f": "--- f (original)\n+++ f (sanitized)\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n", "g": "", "h": ""}
    for _ in range(2):
        assert {r.n: r.diff for r in unified_diffs(df, "n", "x", "y").collect()} == want


def test_one_text(spark):
    import umbra

    done = umbra.sanitize_text(spark, "mail a@b.org", umbra.Sanitizer.from_config(umbra.Config(redact_pii=True)))
    assert done.text == "mail [REDACTED: Email Address]" and done.redaction_count == 1 and done.matches[0].value == "a@b.org"
    assert umbra.sanitize_text(spark, None) == (None, ())


def test_each_pattern_is_in_the_plan_once(spark, small):
    from umbra import catalog
    from umbra.operators.specs import SPECS

    for name in ("detect_all_pii", "redact_documents", "scan_totals", "summary_by_label", "resolve_overlaps"):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        for spec in SPECS:
            if spec.default_on or spec.category == "pii":
                assert plan.count(f"regexp_extract_all(text#") <= 32, name
        assert plan.count("md5(") <= 2, name


def test_columns_with_inner_names(spark):
    df = spark.createDataFrame([("a@b.org", 1, 2, 3, 4)], "text string, __rule int, __proposed int, __pairs int, __filled int")
    from umbra.config import CustomRule

    config = Config(redact_pii=True, custom_rules=(CustomRule("n", "L", "b"),))
    row = Sanitizer.from_config(config, Fake("[]")).sanitize(df).first()
    assert row.sanitized == "[REDACTED: Email Address]" and (row["__rule"], row["__proposed"], row["__pairs"], row["__filled"]) == (1, 2, 3, 4)
